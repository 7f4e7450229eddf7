"""The corpus pipeline over documents: language ID, near-dedup, substring dedup, decontamination, packing.

Each stage takes what the one before kept and, but for the last, returns the columns of documents. doc_id is
taken as the documents' key; rows without an id pass the near-duplicate stage and are never matched.

Defined results: a null or empty text goes in the first stage, as it has no letters; very long texts are read whole; of repeated
rows, and of several rows of one id, one stays in the near-duplicate stage; ties between near-duplicates go to the smaller id; an
empty table stays empty; other columns pass all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from episodica.llm import decontaminate, language_id, packing, simhash, substring_dedup
from episodica.llm.common import read_table, stored


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents too far from every language, or without letters, go."""
    return language_id.recognised(docs, language_id.train(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row of the smallest id stays."""
    return simhash.one_of_each(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that also start in a document with a smaller id are cut out of the texts."""
    return substring_dedup.remove_repeats(docs)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark, up to some edits, go."""
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("language ID", known_language),
    ("SimHash near-dedup", one_of_each),
    ("suffix-array dedup", without_repeats),
    ("benchmark decontamination", without_leaks),
    ("best-fit packing", packed),
]

#: Fingerprints, suffix arrays, edit distances and token ids are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
