"""Operator 7, benchmark decontamination by pigeonhole edit matching.

Text and test items are lower-cased and every run of other than letters and digits becomes one space. An item of m
characters may occur with up to floor(rate * m) edits. It is cut into one piece more than that, so an
occurrence holds at least one piece unchanged. One automaton finds all pieces of all items in a pass over a
text; the stretches around the hits are verified with Myers' bit-parallel distance. Of an item of fewer than ``least`` characters, which
could be part of any words, only an occurrence without edits and between words counts.

Items are sent to the workers in blocks of about ``block`` bytes of text, one pass over the documents for each block. With
several blocks each pass is written to the shared folder before the next, so one block is alive at a time; a worker keeps
the automaton of its block between tasks.

Defined results: null or empty texts match nothing; null items, and those without letters and digits, match
nothing; items of equal text match each, equal items (id and text) count once, repeated documents get equal rows; an empty
benchmark or table marks nothing; very long texts are searched whole; an item's distance is the least of its occurrences. Other columns
pass through or are ignored; `leaks` replaces a column of that name.
"""

from __future__ import annotations

import math
import uuid

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import private, read_table, slices, stored

RATE = 0.05
LEAST = 24
BLOCK = 4 << 20
LEAKS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("distance", T.IntegerType())]))
ELEMENT = pa.struct([("item_id", pa.int64()), ("distance", pa.int32())])
_WORKER: dict[str, object] = {}


def normalized(column: pa.Array) -> pa.Array:
    text = pc.replace_substring_regex(pc.utf8_lower(column.cast(pa.large_string())), r"[^\pL\pN]+", " ")
    return pc.utf8_trim_whitespace(text)


class Pattern:
    """One item: its pieces and the Myers tables."""

    def __init__(self, text: str, rate: float, least: int = LEAST):
        self.text, self.size = text, len(text)
        self.apart = self.size < least
        self.budget = 0 if self.apart else int(rate * self.size)
        cuts = [round(k * self.size / (self.budget + 1)) for k in range(self.budget + 2)]
        self.pieces = [(a, text[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
        self.equal: dict[str, int] = {}
        for k, c in enumerate(text):
            self.equal[c] = self.equal.get(c, 0) | 1 << k

    def found(self, text: str, spans: list[list[int]]) -> int:
        """The least distance within the spans; over the budget if a short item nowhere stands between words."""
        if self.apart:
            whole = any(a >= 0 and text[a:b] == self.text and text[a - 1 : a] in ("", " ") and text[b : b + 1] in ("", " ") for a, b in spans)
            return 0 if whole else 1
        return min(self.distance(text[max(0, a) : b]) for a, b in spans)

    def distance(self, text: str) -> int:
        """The least edit distance between the item and any part of the text."""
        full, top, get = (1 << self.size) - 1, 1 << (self.size - 1), self.equal.get
        up, down, score, best = full, 0, self.size, self.size
        for c in text:
            eq = get(c, 0)
            diagonal = (((eq & up) + up) ^ up) | eq | down
            more, less = down | (full & ~(diagonal | up)), diagonal & up
            if more & top:
                score += 1
            elif less & top:
                score -= 1
                if score < best:
                    best = score
                    if not best:
                        return 0
            more, less = more << 1, less << 1
            up, down = full & (less | ~(diagonal | more)), full & more & diagonal
        return best


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float = RATE, least: int = LEAST):
        texts = normalized(pa.array([t for _, t in items], pa.large_string())).to_pylist()
        self.patterns: dict[str, Pattern] = {}
        self.ids: dict[str, list[int]] = {}
        where: dict[str, list] = {}
        for (item, _), text in zip(items, texts):
            if not text:
                continue
            self.ids.setdefault(text, []).append(item)
            if text not in self.patterns:
                self.patterns[text] = pattern = Pattern(text, rate, least)
                for at, piece in pattern.pieces:
                    where.setdefault(piece, []).append((pattern, at))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in where.items():
            self.automaton.add_word(piece, (len(piece), owners))
        if where:
            self.automaton.make_automaton()

    def match(self, text: str) -> list[tuple[int, int]]:
        """(item, distance) of every item found within its budget in a normalized text."""
        if not self.patterns:
            return []
        around: dict[str, list] = {}
        for end, (size, owners) in self.automaton.iter(text):
            for pattern, at in owners:
                start = end + 1 - size - at - pattern.budget
                spans = around.setdefault(pattern.text, [])
                if pattern.apart:
                    spans.append([start, start + pattern.size])
                elif spans and start <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], start + pattern.size + 2 * pattern.budget)
                    spans[-1][0] = min(spans[-1][0], start)
                else:
                    spans.append([start, start + pattern.size + 2 * pattern.budget])
        found = []
        for key, spans in around.items():
            pattern = self.patterns[key]
            best = pattern.found(text, spans)
            if best <= pattern.budget:
                found += [(item, best) for item in self.ids[key]]
        return sorted(found)


def _items(benchmark: DataFrame, block: int) -> tuple[list[DataFrame], int]:
    """The items, dealt to blocks by their hash, and the number of these."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").filter("item_id is not null and text is not null").distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(total / block))
    return [items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) for k in range(blocks)], blocks


def _matcher(key: str, items, rate: float, least: int) -> Matcher:
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Matcher(items.value, rate, least)
    return _WORKER[key]


def _pass(docs: DataFrame, block: DataFrame, marks: str, rate: float, least: int) -> DataFrame:
    """docs with the block's finds added to the array column `marks`."""
    items = docs.sparkSession.sparkContext.broadcast(sorted((r["item_id"], r["text"]) for r in block.collect()))
    key, names = uuid.uuid4().hex, docs.columns
    at = names.index(marks)

    def run(batches):
        matcher = _matcher(key, items, rate, least)
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = normalized(pc.fill_null(batch.column("text"), "")).to_pylist()
                found = [before + [{"item_id": i, "distance": d} for i, d in matcher.match(t)] for before, t in zip(batch.column(at).to_pylist(), texts)]
                columns = batch.columns
                columns[at] = pa.array(found, pa.list_(ELEMENT))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)


def marked(docs: DataFrame, benchmark: DataFrame, marks: str, rate: float = RATE, least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """docs and an array column `marks` of (item_id, distance), empty where nothing leaked."""
    out = docs.withColumn(marks, F.array().cast(LEAKS))
    blocks, n = _items(benchmark, block)
    for k, own in enumerate(blocks):
        out = _pass(out, own, marks, rate, least)
        if k < n - 1:
            out = stored(out, "leaks")
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, keep: list[str], rate: float = RATE, least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """docs' columns `keep` and an array `leaks` of (item_id, distance), empty where nothing leaked."""
    keep = [c for c in keep if c.lower() != "leaks"]
    return marked(docs.select(*dict.fromkeys([*keep, "text"])), benchmark, "leaks", rate, least, block).select(*keep, "leaks")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs, all columns, without the rows in which an item leaked."""
    (marks,) = private(docs.columns, "leaks")
    return marked(docs, benchmark, marks).filter(F.size(marks) == 0).select(*docs.columns)


def op7_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    found = leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.item_id", "leak.distance")
