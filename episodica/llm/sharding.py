"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

Each shard owns many arcs of the ring. Rows come in an order that their keys' hashes give; a row goes to the first shard clockwise
of its key that isn't full yet. So the whole outcome follows from one number a shard: the place in that order from which it is
full. These places are found one after another from counts: rows by arc and by stretch of the order, narrowed where a shard
fills up, until the very row is known. Then every row finds its shard by itself. A shard more moves rows into itself, and else
only those that overflow.

Under the law `rows` shards take equally many rows, but for one; under `bytes` a shard is full with the row that reaches its share
of all bytes, so it exceeds it by less than a row; under `key` no shard is ever full: doc_id and the number of shards decide, and
grown_shard tells where a row goes with one shard more. slack lets shards take more than their share, which moves less.

Defined results: a null text has no bytes; a null key is a key like any other; rows of one key start at one place of the ring, and
continue clockwise when its shard is full, in the order of the input, however many they are; equal texts and repeated rows are
rows like others; very long texts count whole; an empty table gives no rows; other columns are never looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, stored

SHARDS = 8
NODES = 64  # virtual nodes of a shard
RING = 1 << 14  # places on the ring
STRETCHES = 1024  # of the order, at each narrowing
RANK = 33  # bits that monotonically_increasing_id keeps for the row within a task


def ring(spark: SparkSession, shards: int, nodes: int = NODES) -> DataFrame:
    """(place, arc, turns): for each place the arc it lies in and all shards in the order they are met clockwise. RING rows."""
    ends = spark.range(shards * nodes).select((F.col("id") % shards).cast("int").alias("shard"), F.floor(F.col("id") / shards).alias("node"))
    ends = ends.select("shard", F.pmod(F.xxhash64("shard", "node"), F.lit(RING)).alias("place")).groupBy("shard", "place").agg(F.lit(1).alias("end"))
    each = spark.range(RING).select(F.col("id").alias("place"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    onward = Window.partitionBy("shard").orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, 0)
    own = each.join(ends, ["shard", "place"], "left").withColumn("at", F.when(F.col("end") == 1, F.col("place")))
    own = own.withColumn("next", F.coalesce(F.min("at").over(onward), F.min("at").over(Window.partitionBy("shard")) + RING))
    met = F.array_sort(F.collect_list(F.struct("next", F.xxhash64("shard", F.col("next") % RING).alias("tie"), "shard")))
    turned = own.groupBy("place").agg(met.alias("met"))
    return turned.select("place", F.pmod(F.element_at("met", 1)["next"], F.lit(RING)).alias("arc"), F.transform("met", lambda m: m["shard"]).alias("turns"))


def ranked(rows: DataFrame) -> DataFrame:
    """rows (with columns t and input) and their rank from 0 in the order of t, then input; input must differ in all rows.

    Ranges of the order are sorted each in its task; a row's rank is its place there and the number of rows of the ranges before.
    """
    ranges = rows.repartitionByRange("t", "input").sortWithinPartitions("t", "input").withColumn("at", F.monotonically_increasing_id())
    ranges = stored(ranges, "in-order")
    part = F.shiftright("at", RANK)
    n = ranges.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = n.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return ranges.withColumn("part", part).join(F.broadcast(before), "part").withColumn("rank", F.col("before") + F.col("at").bitwiseAND(F.lit((1 << RANK) - 1))).drop("part", "before", "at")


def _open_shard(turns: Column, last: list[int], rank: Column) -> Column:
    """The first shard met that isn't full at that rank; last: of each shard the last rank it takes."""
    full = F.array(*[F.lit(x).cast("long") for x in last])
    return F.element_at(F.filter(turns, lambda s: F.get(full, s) >= rank), 1)


def last_ranks(rows: DataFrame, arcs: DataFrame, room: list[int], n: int) -> list[int]:
    """Of each shard the last rank it takes (n: never full). rows: arc, rank, weight; room: the weight at which a shard is full.

    From one shard that fills up to the next, the ranks left are narrowed to the first stretch in which an open shard reaches its
    room, until that is one rank. The driver sees at most STRETCHES sums a shard at a time.
    """
    last = [n if r > 0 else -1 for r in room]
    left, start = list(room), 0
    while last.count(n) > 1 and start < n:
        owners = F.broadcast(arcs.select("arc", _open_shard(F.col("turns"), last, F.lit(start)).alias("shard")))
        first, end = start, n
        while True:
            width = -(-(end - first) // STRETCHES)
            own = rows.filter((F.col("rank") >= first) & (F.col("rank") < end)).join(owners, "arc")
            sums = own.groupBy(F.floor((F.col("rank") - first) / width).alias("stretch"), "shard").agg(F.sum("weight").alias("weight"))
            by: dict[int, dict[int, int]] = {}
            for row in sums.collect():
                by.setdefault(row["stretch"], {})[row["shard"]] = row["weight"]
            for stretch in sorted(by):
                if any(weight >= left[shard] for shard, weight in by[stretch].items()):
                    break
                for shard, weight in by[stretch].items():
                    left[shard] -= weight
            else:
                return last
            first, end = first + stretch * width, min(end, first + (stretch + 1) * width)
            if width == 1:
                last[next(iter(by[stretch]))], start = first, first + 1
                break
    return last


def shard_rows(docs: DataFrame, shards: int = SHARDS, law: str = "rows", key: str = "doc_id", text: str = "text", slack: float = 0.0, nodes: int = NODES) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row."""
    if law not in ("rows", "bytes", "key"):
        raise ValueError(f"no such law: {law}")
    spark = docs.sparkSession
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    own = docs.select(F.col(key).alias("doc_id"), size.alias("size"), crc.alias("text_crc32"))
    placed = own.select("*", F.pmod(F.xxhash64("doc_id"), F.lit(RING)).alias("place"), F.xxhash64("doc_id", F.lit("order")).alias("t"), F.monotonically_increasing_id().alias("input"))
    rows = ranked(stored(placed, "sizes"))
    turns = stored(ring(spark, shards, nodes), "ring")
    rows = stored(rows.join(F.broadcast(turns.select("place", "arc")), "place").select("doc_id", "size", "text_crc32", "place", "arc", "rank"), "ranked")
    arcs = turns.groupBy("arc").agg(F.min("turns").alias("turns"))
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).first()
    n = total["n"]
    last = [n] * shards
    if law != "key" and n:
        weight, share = (F.lit(1), n) if law == "rows" else (F.col("size"), total["bytes"])
        whole = math.floor(share * (1 + slack))
        room = [whole // shards + (s < whole % shards) for s in range(shards)]
        last = last_ranks(rows.select("arc", "rank", weight.cast("long").alias("weight")), arcs, room, n)
    grown = F.lit(None).cast("int")
    if law == "key":
        more = ring(spark, shards + 1, nodes).select(F.col("place").alias("place_"), F.element_at("turns", 1).alias("grown"))
        rows = rows.join(F.broadcast(more), F.col("place") == F.col("place_"))
        grown = F.col("grown")
    chosen = rows.join(F.broadcast(arcs), "arc").select("doc_id", "size", "text_crc32", "rank", _open_shard(F.col("turns"), last, F.col("rank")).alias("shard"), grown.alias("grown_shard"))
    stretch = F.floor(F.col("rank") / max(1, -(-n // STRETCHES))).alias("stretch")
    counts = chosen.groupBy("shard", stretch).agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("shard", "stretch", (F.sum("n").over(Window.partitionBy("shard").orderBy("stretch")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("shard", "stretch").orderBy("rank")) - 1
    slotted = chosen.withColumn("stretch", stretch).withColumn("inside", inside).join(F.broadcast(before), ["shard", "stretch"])
    return slotted.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", (F.col("before") + F.col("inside")).alias("slot"), "grown_shard")


def op13_consistent_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(read_table(spark, sf_dir, "documents"))
