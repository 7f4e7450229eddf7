"""Operator 8, SimHash near-duplicates by covering locality-sensitive hashing.

A text's fingerprint has 64 bits: a bit is 1 if set in over half the XXH64 values (seed 42) of its 3-word
shingles. Texts link at 3 or fewer differing bits. Structured masks find every such pair: bit i gets a
non-zero code c(i) of radius+1 bits, and for each of the 15 non-zero vectors v the mask keeps the bits with
odd <c(i), v>. Any 3 positions have codes that some v annuls, so each pair within the radius agrees on
all kept bits of some table and meets there.

Only distinct fingerprints are compared. Within a bucket pairs are compared by exact bit counts, and each
member is linked to the smallest of its own in-bucket component, so a bucket yields fewer links than
members. A bucket of more than ``split`` fingerprints is dealt again by the same masks over the bits it
doesn't yet share, which loses no pair; what is left after three levels has under 8 open bits, so no task holds an
unbounded bucket. Components are then labelled on the cluster.

Defined results: null text is empty; no words give fingerprint zero, linked like any other; fewer than three
words form one shingle; very long texts are read whole; repeated rows share a fingerprint and each get a row; component_id is the
smallest non-null doc_id (null if a component has none); an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import private, read_table, slices, stored
from .components import connected_components

RADIUS = 3
BITS = 64
SPLIT = 4096


def masks(bits: list[int], radius: int = RADIUS) -> list[int]:
    """Masks of kept bits; for any `radius` of the given positions, one keeps none of them."""
    codes = 2 ** (radius + 1)
    code = {b: 1 + k % (codes - 1) for k, b in enumerate(bits)}
    return [sum(1 << b for b in bits if bin(code[b] & v).count("1") % 2) for v in range(1, codes)]


def fingerprint(text: str | None, size: int = 3) -> int:
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    return fingerprint_words(words, size)


def fingerprint_words(words: list[bytes], size: int = 3) -> int:
    if not words:
        return 0
    line = b" ".join(words)
    n = max(1, len(words) - size + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    last = ends[min(size, len(words)) - 1 :]
    first = np.concatenate(([0], ends[: n - 1] + 1))
    hash64 = xxhash.xxh64_intdigest
    values = np.array([hash64(line[a:b], 42) for a, b in zip(first.tolist(), last.tolist())], dtype="<u8")
    ones = np.zeros(BITS, np.int64)
    for k in range(0, n, 1 << 16):
        ones += np.unpackbits(values[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: list[str]) -> DataFrame:
    """docs' columns `keep` and fp, the fingerprint as a signed long."""
    source = docs.select(*keep, *(["text"] if "text" not in keep else []))
    schema = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep) + ", fp bigint"

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                fp = np.array([fingerprint(v) for v in batch.column("text").to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(fp)], names=[*keep, "fp"])

    return source.mapInArrow(run, schema)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def star(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links from each value to the smallest of its component under `radius`, values being one bucket's."""
    values = np.unique(values)
    label = np.full(len(values), -1)
    for i in range(len(values)):
        if label[i] < 0:
            label[i], wave = i, [i]
            while wave:
                far = np.flatnonzero(label < 0)
                if not len(far):
                    break
                near = (np.bitwise_count((values[far, None] ^ values[None, wave[:64]]).view(np.uint64)) <= radius).any(axis=1)
                label[far[near]] = i
                wave = wave[64:] + far[near].tolist()
    moved = label != np.arange(len(values))
    return values[moved], values[label[moved]]


def _links(batches, radius: int):
    """Of rows (key, fp) sorted by key: star links of each key's run."""
    key, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def flush(upto: int):
        cut = np.concatenate(([0], np.flatnonzero(np.diff(key[:upto])) + 1, [upto]))
        found = [star(fp[a:b], radius) for a, b in zip(cut[:-1], cut[1:]) if b - a > 1]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in found])) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        key = np.concatenate((key, batch.column("key").to_numpy(zero_copy_only=False)))
        fp = np.concatenate((fp, batch.column("fp").to_numpy(zero_copy_only=False)))
        upto = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last key's run may go on
        if upto:
            yield from flush(upto)
            key, fp = key[upto:], fp[upto:]
    if len(key):
        yield from flush(len(key))


def levels(depth: int, radius: int = RADIUS) -> list[dict[int, list[int]]]:
    """For each level: the number of a path of tables to the masks that deal its open bits again."""
    out, open_bits = [], {0: list(range(BITS))}
    for _ in range(depth):
        out.append({path: masks(bits, radius) for path, bits in open_bits.items()})
        open_bits = {path * 16 + t + 1: [b for b in open_bits[path] if not m >> b & 1] for path, kept in out[-1].items() for t, m in enumerate(kept)}
    return out


def near_links(fps: DataFrame, radius: int = RADIUS, split: int = SPLIT, tag: str = "simhash") -> DataFrame:
    """Links (a, b) between distinct fingerprints, of the same components as all pairs within the radius."""
    level = fps.select("fp", F.lit(0).cast("bigint").alias("group"), F.lit(0).alias("path"))
    found = []
    for depth, paths in enumerate(plan := levels(3, radius)):
        choice = None
        for path, kept in paths.items():
            entries = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("kept")) for t, m in enumerate(kept)])
            here = F.col("path") == path
            choice = entries if len(paths) == 1 else F.when(here, entries) if choice is None else choice.when(here, entries)
        dealt = level.select("fp", "group", "path", F.explode(choice).alias("e"))
        rows = dealt.select("fp", (F.col("path") * 16 + F.col("e.t") + 1).alias("path"), F.xxhash64("group", "e.t", "e.kept").alias("key"))
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        met = stored(rows.join(sizes, "key"), f"{tag}-met{depth}")
        last = depth == len(plan) - 1
        small = met if last else met.filter(F.col("n") <= split)
        found.append(small.select("key", "fp").repartition("key").sortWithinPartitions("key", "fp").mapInArrow(lambda it: _links(it, radius), "a bigint, b bigint"))
        level = met.filter(F.col("n") > split).select("fp", F.col("key").alias("group"), "path")
        if last or level.isEmpty():
            break
    return reduce(DataFrame.union, found)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", tag: str = "simhash", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, columns `keep`, fp, component_id) of every row."""
    marked = stored(fingerprints(docs, [id_col, *keep]), f"{tag}-fp")
    nodes = stored(marked.groupBy("fp").agg(F.min(id_col).alias("first")), f"{tag}-nodes")
    roots = connected_components(near_links(nodes.select("fp"), tag=tag), tag)
    owned = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = owned.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = owned.join(least, "root").select(F.col("fp").alias("node_fp"), "component_id")
    return marked.join(by_fp, marked.fp == by_fp.node_fp).select(id_col, *keep, "fp", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs, all columns, with one row of each group of near-duplicates: that of the smallest doc_id.

    doc_id is the key: of several rows of that id one stays, which has the least text hash. Rows without an id stay.
    """
    th, own, its, n = private(docs.columns, "th", "own", "its", "n")
    keyed = docs.withColumn(th, F.xxhash64("text"))
    named = keyed.filter("doc_id is not null")
    groups = near_duplicates(named.select("doc_id", "text", F.col(th).alias("th")), keep=("th",))
    rows = groups.filter("doc_id = component_id").groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("n"))
    first = stored(rows.groupBy(F.col("doc_id").alias(own)).agg(F.min(F.struct("th", "n")).alias(n)).select(own, F.col(f"{n}.th").alias(its), F.col(f"{n}.n").alias(n)), "simhash-first")
    match = lambda part: named.join(part.select(own, its), (F.col("doc_id") == F.col(own)) & (F.col(th) == F.col(its)), "left_semi").select(*docs.columns)
    once, often = match(first.filter(F.col(n) == 1)), first.filter(F.col(n) > 1)
    kept = once.unionByName(docs.filter("doc_id is null"))
    return kept if often.isEmpty() else kept.unionByName(match(often).dropDuplicates(["doc_id"]))


def op8_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
