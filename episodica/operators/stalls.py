"""Runs without progress: repeated actions and cycles under unchanged observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAST_REPEATS = 3
LONGEST_PERIOD = 4
RUN = ("trajectory_id", "start", "end", "action", "length", "kind", "period")


def _runs(steps: DataFrame, periods: tuple[int, ...], least: int, whitelist: tuple[str, ...]) -> DataFrame:
    """Maximal stretches in which each step equals, in action and observation, the one a period on.

    Steps that match so form islands; an island is cut where an earlier stretch of its period still reaches. Period 1
    gives repeats. All periods run through one plan: they share its windows, and no union has to line up partitions.
    """
    by = Window.partitionBy("trajectory_id").orderBy("idx")

    def match(p: int):
        same = F.lead("action", p).over(by).eqNullSafe(F.col("action")) & F.lead("obs", p).over(by).eqNullSafe(F.col("obs"))
        return F.struct(F.lit(p).alias("period"), (same & F.lead("idx", p).over(by).isNotNull()).alias("match"))

    ahead = F.collect_list("action").over(by.rowsBetween(0, max(periods) - 1))
    marked = steps.select("trajectory_id", F.col("idx").cast("bigint").alias("idx"), ahead.alias("ahead"), F.array(*map(match, periods)).alias("matches"))
    every = marked.select("trajectory_id", "idx", F.explode("matches").alias("m")).select("trajectory_id", "idx", "m.*").filter("match")
    island = F.col("idx") - F.row_number().over(Window.partitionBy("trajectory_id", "period").orderBy("idx"))
    islands = every.withColumn("island", island).groupBy("trajectory_id", "period", "island").agg(F.min("idx").alias("s"), (F.max("idx") + 1).alias("e"))
    per = islands.groupBy("trajectory_id", "period").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("islands"))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start: bigint, length: bigint>>").alias("runs"))

    def step(acc, island):
        first = F.greatest(island["s"], acc["at"])
        run = F.struct(first.alias("start"), (island["e"] - first + F.col("period")).alias("length"))
        longer = F.struct((island["e"] + F.col("period")).alias("at"), F.array_append(acc["runs"], run).alias("runs"))
        return F.when(island["e"] - first >= F.col("period"), longer).otherwise(acc)

    runs = per.select("trajectory_id", "period", F.explode(F.aggregate("islands", start, step, lambda a: a["runs"])).alias("run")).select("trajectory_id", "period", "run.start", "run.length")
    named = runs.join(marked.select("trajectory_id", F.col("idx").alias("start"), "ahead"), ["trajectory_id", "start"]).withColumn("pattern", F.slice("ahead", 1, F.col("period")))
    repeat = F.col("period") == 1
    kept = F.when(repeat, F.col("length") >= least).otherwise(F.size(F.array_distinct("pattern")) > 1)
    if whitelist:
        kept = kept & (F.size(F.array_except("pattern", F.array(*map(F.lit, whitelist)))) > 0)
    return named.filter(kept).select(
        "trajectory_id", "start", (F.col("start") + F.col("length") - 1).alias("end"), F.array_join("pattern", "|").alias("action"), "length", F.when(repeat, "repeat_action").otherwise("cycle").alias("kind"), F.when(~repeat, F.col("period")).alias("period")
    )


def repeat_runs(steps: DataFrame, least: int = LEAST_REPEATS, whitelist: tuple[str, ...] = ()) -> DataFrame:
    """Maximal runs of one action under one observation, of at least `least` (2 or more) steps."""
    return _runs(steps, (1,), least, whitelist)


def cycle_runs(steps: DataFrame, longest: int = LONGEST_PERIOD, whitelist: tuple[str, ...] = ()) -> DataFrame:
    """Periodic stretches of at least two periods of 2 to `longest` steps whose actions aren't all alike or all allowed."""
    return _runs(steps, tuple(range(2, longest + 1)), 2, whitelist)


def merged_runs(runs: DataFrame) -> DataFrame:
    """Runs not contained in another; of equal ones repeats come first, then the smaller action.

    In order of start, a run lies in an earlier one just if some earlier end reaches its own.
    """
    order = Window.partitionBy("trajectory_id").orderBy("start", F.desc("length"), F.when(F.col("kind") == "repeat_action", 0).otherwise(1), "action")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return runs.withColumn("before", before).filter(F.col("before").isNull() | (F.col("before") < F.col("end"))).select(*RUN)


def stall_runs(steps: DataFrame, least: int = LEAST_REPEATS, longest: int = LONGEST_PERIOD, whitelist: tuple[str, ...] = ()) -> DataFrame:
    return merged_runs(_runs(steps, tuple(range(1, longest + 1)), least, whitelist))


def stall_report(steps: DataFrame, episodes: DataFrame, least: int = LEAST_REPEATS, longest: int = LONGEST_PERIOD, whitelist: tuple[str, ...] = ()) -> DataFrame:
    """One row per episode, also without runs: its runs in order, whether it stalled, the longest run, step_cap_hit as recorded."""
    runs = stall_runs(steps, least, longest, whitelist).groupBy("trajectory_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind", "action", "length", "period"))).alias("runs"))
    joined = episodes.select("trajectory_id", "step_cap_hit").join(runs, "trajectory_id", "left")
    longest_run = F.coalesce(F.array_max(F.transform("runs", lambda r: r["length"])), F.lit(0))
    return joined.select("trajectory_id", "step_cap_hit", F.col("runs").isNotNull().alias("stalled"), longest_run.cast("bigint").alias("longest"), "runs")


def stall_rate(report: DataFrame) -> DataFrame:
    """Share of episodes that stalled; 0 with none."""
    return report.agg(F.coalesce(F.avg(F.col("stalled").cast("double")), F.lit(0.0)).alias("stall_rate"), F.count_if("stalled").alias("stalled"), F.count(F.lit(1)).alias("trajectories"))
