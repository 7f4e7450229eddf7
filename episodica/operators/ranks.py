"""Exact numbers of the rows of groups of any size: no task gets a group, and no window one partition of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored

ROW_BITS = 33  # monotonically_increasing_id keeps the row within its task in so many bits
OWN = ("_at", "_part", "_before", "_first")


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """rows with `name`: 1, 2, ... within `by` (no columns: all rows) in the order of `order`, which must differ within a group.

    Rows are dealt to ranges of (by, order) and sorted there. Only the first group of a range can have begun in an earlier one; how
    many rows it has there is known from one row of each range (broadcast: as many rows as tasks). Within a range the groups' first
    places are windows over the rows of one group in one range, so at most a task's share.
    """
    ranges = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    ranges = stored(ranges.withColumn("_at", F.monotonically_increasing_id()), "in-order").withColumn("_part", F.shiftright("_at", ROW_BITS))
    if not by:
        sizes = ranges.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
        before = sizes.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))
        place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1)) + 1
        return ranges.join(F.broadcast(before), "_part").withColumn(name, place).drop(*OWN)
    key = F.struct(*by)
    ends = ranges.groupBy("_part").agg(F.min_by(key, "_at").alias("head"), F.max_by(key, "_at").alias("tail"), F.count(F.lit(1)).alias("n"))
    in_tail = ranges.join(F.broadcast(ends.select("_part", "tail")), "_part").filter(key.eqNullSafe(F.col("tail"))).groupBy("_part").agg(F.count(F.lit(1)).alias("held"))
    # ranges that end with one group lie end to end, so what it has in all of them so far is a running sum
    run = ends.join(F.broadcast(in_tail), "_part").withColumn("run", F.sum("held").over(Window.partitionBy("tail").orderBy("_part")))
    last = Window.orderBy("_part")
    goes_on = F.col("head").eqNullSafe(F.lag("tail").over(last))
    before = run.select("_part", "head", F.when(goes_on, F.lag("run").over(last)).otherwise(0).alias("_before"))
    first = F.min("_at").over(Window.partitionBy("_part", *by))
    own = ranges.withColumn("_first", first).join(F.broadcast(before), "_part")
    return own.withColumn(name, F.col("_at") - F.col("_first") + 1 + F.when(key.eqNullSafe(F.col("head")), F.col("_before")).otherwise(0)).drop(*OWN, "head")
