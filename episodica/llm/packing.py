"""Operator 3, best-fit packing by exact-complement hashing.

Only lengths matter to a packing, so the plan is made on the driver from a histogram of at most
``capacity`` lengths. Lengths are taken from the largest down. For the gap a length leaves, single, pair and
triple sums of available lengths are looked up and combinations that fill it exactly are used as often as
the counts allow. What remains is packed best-fit: the largest length that fits, with an exact fill tried
after each. The plan is a list of patterns with multiplicities; it doesn't grow with the number of documents.

Pieces are numbered within their length by counts of (length, salt) groups, so a length that a third of all
pieces share, or rows that are repeated, are spread over ``salts`` tasks; each piece then finds its place in the plan by its number.

Defined results: null text is empty and gives one piece of the end id; texts over ``capacity`` ids, however long, are cut into
pieces of ``capacity`` and a rest; repeated rows are packed each; pieces of equal length are packed in any order; an empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import private, read_table, slices, stored
from .tokens import END_ID, encoder, vocabulary_path

CAPACITY = 4096


class _Stock:
    """Counts of lengths, with the index of pair sums."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = np.zeros(capacity + 1, np.int64)
        for length, count in counts.items():
            self.left[length] = count
        there = self.left > 0
        self.paired = np.zeros(capacity + 1, bool)
        for s in range(2, capacity + 1):
            self.paired[s] = (there[1 : s // 2 + 1] & there[s - 1 : (s - 1) // 2 : -1][: s // 2]).any()

    def pair(self, total: int) -> list[int] | None:
        if total < 2 or not self.paired[total]:
            return None
        half = total // 2
        small = np.flatnonzero((self.left[1 : half + 1] > 0) & (self.left[total - 1 : total - half - 1 : -1] > 0)) + 1
        if len(small) and small[-1] * 2 == total and self.left[small[-1]] < 2:
            small = small[:-1]
        return [int(total - small[-1]), int(small[-1])] if len(small) else None

    def exact(self, gap: int, most: int = 3) -> list[int] | None:
        """At most that many lengths that fill the gap."""
        if self.left[gap] > 0:
            return [gap]
        if most < 2:
            return None
        if found := self.pair(gap):
            return found
        if most < 3:
            return None
        third = np.flatnonzero((self.left[1 : gap // 3 + 1] > 0) & self.paired[gap - 1 : gap - gap // 3 - 1 : -1]) + 1 if gap >= 3 else []
        for a in third[::-1]:
            if not self.pair(gap - a):
                self.paired[gap - a] = False  # counts only fall
                continue
            self.left[a] -= 1
            found = self.pair(gap - a)
            self.left[a] += 1
            if found:
                return [*found, int(a)]
        return None

    def take(self, pattern: list[int]) -> int:
        """Use the pattern as often as the counts allow."""
        need = Counter(pattern)
        times = min(int(self.left[length]) // m for length, m in need.items())
        for length, m in need.items():
            self.left[length] -= times * m
        return times


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns of lengths and how many sequences use each.

    Of the plans that complete gaps with up to three, two or one lengths at once, the shortest: where lengths
    are few, spending small ones on triples early can cost more than it saves.
    """
    plans = [_plan(counts, capacity, most) for most in (3, 2, 1)]
    return min(plans, key=lambda p: sum(times for _, times in p))


def _plan(counts: dict[int, int], capacity: int, most: int) -> list[tuple[list[int], int]]:
    stock, out = _Stock(counts, capacity), []
    for length in range(capacity, 0, -1):
        while stock.left[length] > 0:
            stock.left[length] -= 1
            rest = stock.exact(capacity - length, most) if length < capacity else []
            stock.left[length] += 1
            if rest is None:
                break
            out.append(([length, *rest], stock.take([length, *rest])))
    for length in range(capacity, 0, -1):
        while stock.left[length] > 0:
            pattern, gap = [length], capacity - length
            stock.left[length] -= 1
            while gap:
                more = stock.exact(gap, most)
                if more is None:
                    fits = np.flatnonzero(stock.left[1 : gap + 1])
                    if not len(fits):
                        break
                    more = [int(fits[-1]) + 1]
                for x in more:
                    stock.left[x] -= 1
                pattern += more
                gap -= sum(more)
            for x in pattern:
                stock.left[x] += 1
            out.append((pattern, stock.take(pattern)))
    return out


def places(patterns: list[tuple[list[int], int]]) -> dict[int, np.ndarray]:
    """By length: rows (first number, pieces in a sequence, first sequence, offset), in order of the number."""
    slots: dict[int, list] = {}
    used: Counter = Counter()
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for length, m in Counter(pattern).items():
            slots.setdefault(length, []).append((used[length], m, sequence, offset))
            used[length] += m * times
            offset += m * length
        sequence += times
    return {length: np.array(rows, np.int64) for length, rows in slots.items()}


def place(slots: dict[int, np.ndarray], length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    for own in np.unique(length):
        at = np.flatnonzero(length == own)
        rows = slots[int(own)]
        row = rows[np.searchsorted(rows[:, 0], number[at], side="right") - 1]
        k = number[at] - row[:, 0]
        sequence[at] = row[:, 2] + k // row[:, 1]
        offset[at] = row[:, 3] + k % row[:, 1] * own
    return sequence, offset


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, spread (a number that differs between rows that don't) and the ids, if wanted, of each piece."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        encode, task, done = encoder(path, end_id).encode, TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, offsets = encode(batch.column("text"))
                pieces = -(-np.diff(offsets) // capacity)
                owner = np.repeat(np.arange(batch.num_rows), pieces)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                first = offsets[owner] + start
                length = np.minimum(capacity, offsets[owner + 1] - first)
                parts = [ids[a:b] for a, b in zip(first.tolist(), (first + length).tolist())]
                crc = pa.array([zlib.crc32(x) for x in parts], pa.int64())
                spread = (task * 7919 + done + np.arange(len(owner))) % 1_000_003
                done += len(owner)
                more = [pa.array([x.astype(np.int64) for x in parts], pa.list_(pa.int64()))] if with_ids else []
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(owner)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), crc, pa.array(spread), *more], names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "spread", *(["ids"] if with_ids else [])]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint, spread bigint" + ", ids array<bigint>" * with_ids)


def pack(pieces: DataFrame, order: list[str], capacity: int = CAPACITY, salts: int | None = None) -> DataFrame:
    """pieces (a stored table with a length from 1 to capacity) and their sequence_id and offset; `order` deals and numbers them."""
    spark = pieces.sparkSession
    salt, its_length, its_salt, n, base, rank, number = private(pieces.columns, "salt", "its_length", "its_salt", "n", "base", "rank", "number")
    counts = {r["length"]: r[n] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias(n)).collect()}
    slots = spark.sparkContext.broadcast(places(plan(counts, capacity)))
    salts = salts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = pieces.withColumn(salt, F.pmod(F.xxhash64(*order), F.lit(salts)))
    groups = salted.groupBy(F.col("length").alias(its_length), F.col(salt).alias(its_salt)).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy(its_length).orderBy(its_salt).rowsBetween(Window.unboundedPreceding, -1)
    bases = groups.select(its_length, its_salt, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(base))
    ranked = salted.withColumn(rank, F.row_number().over(Window.partitionBy("length", salt).orderBy(*order)) - 1)
    numbered = ranked.join(bases, (F.col("length") == F.col(its_length)) & (F.col(salt) == F.col(its_salt))).select(*pieces.columns, (F.col(base) + F.col(rank)).alias(number))
    columns = pieces.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id bigint, offset bigint"

    def run(batches):
        for batch in batches:
            sequence, offset = place(slots.value, batch.column("length").to_numpy(), batch.column(number).to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    return numbered.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    pieces = stored(token_pieces(docs, path or vocabulary_path(), capacity), "pieces")
    return pack(pieces, ["doc_id", "piece", "ids_crc32", "spread"], capacity).drop("spread")


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))
