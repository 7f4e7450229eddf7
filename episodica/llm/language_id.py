"""Operator 6, language identification by nearest centroid.

Byte trigrams of the lower-cased text, weighted by TF-IDF and scaled to unit length, are compared by
cosine with several centroids per language (spherical k-means within each language). Trigrams that are no
feature count in a text's length with the weight of the rarest feature, so they lower its score. A text whose
score lies under a threshold is rejected. Thresholds go by language and number of different trigrams, since short
texts score low: a part of a low quantile of the scores of the language's training rows and pieces of them.

The model is fitted on at most ``per_lang`` documents of each language, those with the smallest hash of id and
language; this bound is a parameter. Every document is scored, over its whole text.

Defined results: null text, or text without any letter, gives ``und`` with score 0 and is rejected;
a null lang or id teaches nothing; of several documents of one id and language the least text teaches; with no training rows, as
with an empty table, every text is ``und``; repeated rows each get their own (equal) result; ties between languages go to the smaller
name; very long texts are counted whole. Other columns pass through, but for those named like the results, which are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, private, read_table, slices, text_bytes

UNKNOWN = "und"
SPACE = 1 << 21  # hash space of trigrams
SIZES = 18  # classes of numbers of trigrams, by powers of two
LETTER = re.compile(r"[^\W\d_]")
#: A-Z to lower case; every other ASCII byte but a-z to a space, so marks and digits only end words.
FOLD = np.arange(256, dtype=np.uint32)
FOLD[65:91] += 32
FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 32


@dataclass
class LanguageModel:
    """slot: trigram hash to feature (-1: none); idf by feature; centroids as rows; their languages; least score kept, by language and binary logarithm of the number of different trigrams."""

    slot: np.ndarray
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    names: list[str]
    least: np.ndarray


def trigram_codes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each byte trigram inside one text, and the row it belongs to.

    Texts are padded by a space on both sides; trigrams around a space are left out.
    """
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    padded = np.full(int(offsets[-1]) + 2 * n, 32, dtype=np.uint32)
    starts = offsets[:-1] + 2 * np.arange(n)
    at = np.arange(int(offsets[-1])) + np.repeat(2 * np.arange(n) + 1, lengths)
    padded[at] = FOLD[raw]
    row = np.repeat(np.arange(n, dtype=np.int32), lengths + 2)
    if len(padded) < 3:
        return np.zeros(0, np.uint32), np.zeros(0, np.int32)
    code = (padded[:-2] << 16) | (padded[1:-1] << 8) | padded[2:]
    code = (code * np.uint32(2654435761)) >> np.uint32(32 - 21)
    inside = padded[1:-1] != 32
    ends = (starts + lengths + 2)[:-1]
    inside[ends - 1] = False
    inside[ends - 2] = False
    return code[inside], row[:-2][inside]


def weighted(slot: np.ndarray, idf: np.ndarray, code: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit TF-IDF rows over the features (float32; all zero with no known trigram), the features' share in each row's whole length, and its number of different trigrams."""
    width = len(idf)
    feature = slot[code]
    known = feature >= 0
    counts = np.bincount(row[known].astype(np.int64) * width + feature[known], minlength=n * width).reshape(n, width)
    x = np.log1p(counts).astype(np.float32) * idf
    length = np.linalg.norm(x, axis=1, keepdims=True)
    other, times = np.unique(row[~known].astype(np.int64) * SPACE + code[~known], return_counts=True)
    rest = np.bincount(other // SPACE, (np.log1p(times) * idf.max()) ** 2, minlength=n)
    share = length[:, 0] / np.maximum(np.sqrt(length[:, 0].astype(float) ** 2 + rest), 1e-12)
    return x / np.maximum(length, 1e-12), share, (counts > 0).sum(axis=1) + np.bincount(other // SPACE, minlength=n)


def vectors(model_slot: np.ndarray, idf: np.ndarray, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Unit TF-IDF rows (float32); a text with no known trigram stays all zero."""
    return weighted(model_slot, idf, *trigram_codes(raw, offsets), len(offsets) - 1)[0]


def size_class(number: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(number, 1)).astype(int), SIZES - 1)


#: Trigrams of the longest pieces that rejection is calibrated on; a text of more different ones than any piece counts as the rows do.
LONGEST_PIECE = 1 << 19


def thresholds(texts: list[str], score: Callable[[np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray]], low: float, slack: float) -> np.ndarray:
    """Least score kept of a language's texts, by size class.

    Besides the rows, pieces of 1, 2, 4 and so on trigrams, up to LONGEST_PIECE, are cut evenly from the whole rows put one after
    another. Of each class the lower quantile of rows and pieces counts, if 20 or more are there; other classes are as the one before.
    """
    parts, rows, pieces = [], [], []
    for i in range(0, len(texts), 64):
        code, row = trigram_codes(*_rows(texts[i : i + 64]))
        rows.append(score(code, row, len(texts[i : i + 64])))
        parts.append(code.astype(np.int32))
    stream = np.concatenate(parts)
    size = 1
    while len(stream) >= 4 * size and size <= LONGEST_PIECE:
        n = int(np.clip((1 << 20) // size, 16, 400))
        starts = np.linspace(0, len(stream) - size, n).astype(int)
        for i in range(0, n, 64):
            at = starts[i : i + 64]
            pieces.append(score(stream[at[:, None] + np.arange(size)].ravel(), np.repeat(np.arange(len(at), dtype=np.int32), size), len(at)))
        size *= 2
    pools = [(np.concatenate([s for s, _ in x]), size_class(np.concatenate([k for _, k in x]))) for x in (rows, pieces) if x]
    least = np.zeros(SIZES)
    for c in range(SIZES):
        cuts = [np.quantile(s[k == c], low) for s, k in pools if (k == c).sum() >= 20]
        least[c] = slack * min(cuts) if cuts else (least[c - 1] if c else 0.0)
    return least


def _rows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return text_bytes(pa.array(texts, pa.string()))


def fit(texts: list[str], langs: list[str], features: int = 4096, per_language: int = 4, rounds: int = 8, low: float = 0.01, slack: float = 0.5) -> LanguageModel:
    """Fit on the given rows. A text is rejected below slack times the quantile low of scores of its language and size."""
    names = sorted(set(langs))
    if not names:
        return LanguageModel(np.full(SPACE, -1, np.int32), np.ones(1, np.float32), np.zeros((0, 1), np.float32), np.zeros(0, np.int64), [], np.ones((0, SIZES)))
    present = np.zeros(SPACE, np.int64)
    for i in range(0, len(texts), 64):
        code, row = trigram_codes(*_rows(texts[i : i + 64]))
        pair = np.unique(row.astype(np.int64) * SPACE + code)
        present += np.bincount(pair % SPACE, minlength=SPACE)
    top = np.lexsort((np.arange(SPACE), -present))[:features]
    top = np.sort(top[present[top] > 0])
    if not len(top):
        top = np.zeros(1, np.int64)
    slot = np.full(SPACE, -1, np.int32)
    slot[top] = np.arange(len(top))
    idf = (np.log((1 + len(texts)) / (1 + present[top])) + 1).astype(np.float32)
    x = np.concatenate([vectors(slot, idf, *_rows(texts[i : i + 64])) for i in range(0, len(texts), 64)])
    centroids, owner = [], []
    lang_of = np.array([names.index(v) for v in langs])
    for k in range(len(names)):
        own = x[lang_of == k]
        c = own[np.linspace(0, len(own) - 1, min(per_language, len(own))).astype(int)].copy()
        for _ in range(rounds):
            near = (own @ c.T).argmax(axis=1)
            for j in range(len(c)):
                if (near == j).any():
                    c[j] = own[near == j].mean(axis=0)
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        centroids.append(c)
        owner += [k] * len(c)
    centroids = np.concatenate(centroids).astype(np.float32)

    def score(code: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        v, share, number = weighted(slot, idf, code, row, n)
        return (v @ own.T).max(axis=1) * share, number

    least = []
    for k in range(len(names)):
        own = centroids[np.array(owner) == k]
        least.append(thresholds([t for t, v in zip(texts, lang_of) if v == k], score, low, slack))
    return LanguageModel(slot, idf, centroids, np.array(owner), names, np.array(least))


def predict(model: LanguageModel, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and whether it was rejected, for each text."""
    raw, offsets = text_bytes(column)
    n = len(offsets) - 1
    letters = np.array([v is not None and LETTER.search(v) is not None for v in column.to_pylist()], bool)
    if not model.names or not n:
        return [UNKNOWN] * n, np.zeros(n), np.ones(n, bool)
    cosine, share, number = np.zeros((n, len(model.owner)), np.float32), np.zeros(n), np.zeros(n, np.int64)
    for i in range(0, n, 256):
        part = offsets[i : i + 257]
        x, share[i : i + 256], number[i : i + 256] = weighted(model.slot, model.idf, *trigram_codes(raw[part[0] : part[-1]], part - part[0]), len(part) - 1)
        cosine[i : i + 256] = x @ model.centroids.T
    at = cosine.argmax(axis=1)
    score = np.clip(cosine[np.arange(n), at] * share, 0, 1)
    names = [model.names[model.owner[j]] if ok else UNKNOWN for j, ok in zip(at, letters)]
    return names, np.where(letters, score, 0.0), ~letters | (score <= 0) | (score < model.least[model.owner[at], size_class(number)])


def sampled(docs: DataFrame, folds: int, rest: int, per_lang: int) -> DataFrame:
    """(doc_id, lang, text) of at most per_lang documents of each language outside the held-out fold.

    Those with the least hash of id and language. The hash is cut at about twice the wanted share of a language's ids, so that
    only a bounded number of ids of each language, and no text, is gathered before the texts are fetched.
    """
    spark = docs.sparkSession
    rows = docs.filter(~held_out("doc_id", folds, rest) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang")
    u = F.shiftrightunsigned(F.xxhash64("doc_id", "lang"), 11).cast("double") / float(1 << 53)
    ids = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")).collect()}
    cuts = spark.createDataFrame([(lang, min(1.0, (2 * per_lang + 50) / n)) for lang, n in sorted(ids.items())], "lang string, cut double")
    near = rows.withColumn("u", u).join(F.broadcast(cuts), "lang").filter("u <= cut").select("lang", "u", "doc_id").distinct().collect()
    least: dict[str, list] = {}
    for r in sorted((r["lang"], r["u"], r["doc_id"]) for r in near):
        least.setdefault(r[0], []).append((r[2], r[0]))
    picked = [pair for own in least.values() for pair in own[:per_lang]]
    kind = docs.schema["doc_id"].dataType.simpleString()
    mine, its = private(["doc_id", "lang"], "picked_id", "picked_lang")
    wanted = spark.createDataFrame(picked, f"{mine} {kind}, {its} string")
    found = docs.select("doc_id", "lang", "text").join(F.broadcast(wanted), (F.col("doc_id") == F.col(mine)) & (F.col("lang") == F.col(its)))
    return found.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))


def train(docs: DataFrame, folds: int = 5, rest: int = 0, per_lang: int = 400) -> LanguageModel:
    """Fit from documents outside the held-out fold; at most per_lang rows of each language reach the driver."""
    found = sorted((r["lang"], r["doc_id"], r["text"]) for r in sampled(docs, folds, rest, per_lang).filter("text is not null").collect())
    return fit([text for _, _, text in found], [lang for lang, _, _ in found])


OWN = ("lang_pred", "score", "rejected")


def _batches(batches, model):
    for whole in batches:
        for batch in slices(whole, "text", 1 << 20):
            yield batch, *predict(model, batch.column("text"))


def identify(docs: DataFrame, model: LanguageModel, keep: list[str]) -> DataFrame:
    """docs' columns `keep`, with lang_pred, score and rejected; columns of these names are replaced."""
    keep = [c for c in keep if c.lower() not in OWN]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*dict.fromkeys([*keep, "text"]))
    schema = T.StructType([*(source.schema[c] for c in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def run(batches):
        for batch, names, score, rejected in _batches(batches, shared.value):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(rejected)], names=schema.names)

    return source.mapInArrow(run, schema)


def recognised(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs, all columns, without the rows whose text is rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch, _, _, rejected in _batches(batches, shared.value):
            yield batch.filter(pa.array(~rejected))

    return docs.mapInArrow(run, docs.schema)


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = identify(docs, train(docs), ["doc_id"])
    return found.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score", "rejected")
