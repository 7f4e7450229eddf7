"""Action n-grams and what they say about winning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

N_VALUES = (1, 2, 3)
MIN_COUNT = 3
PER_EPISODE = 5


def action_sequences(steps: DataFrame) -> DataFrame:
    """(trajectory_id, actions) in step order."""
    ordered = F.array_sort(F.collect_list(F.struct("idx", "action")))
    return steps.groupBy("trajectory_id").agg(F.transform(ordered, lambda s: s["action"]).alias("actions"))


def ngrams(actions, n_values=N_VALUES):
    """All n-grams of an array column, sorted by n then place."""
    empty = F.array().cast("array<array<string>>")

    def of(n: int):
        starts = F.sequence(F.lit(1), F.size(actions) - n + 1)
        return F.when(F.size(actions) >= n, F.transform(starts, lambda i: F.slice(actions, i, n))).otherwise(empty)

    return F.concat(*map(of, sorted(set(n_values))))


def ngram_report(steps: DataFrame, episodes: DataFrame, n_values=N_VALUES, min_count: int = MIN_COUNT, per_episode: int = PER_EPISODE) -> DataFrame:
    """Per n-gram: capped count, episodes with it, of those won and lost, and the difference of the shares.

    An episode adds at most per_episode occurrences to a count. A win is a reward above 0 (NaN is not). Every
    episode counts in the totals, also one shorter than n. Order: |lift| desc, count desc, gram asc.
    """
    flags = episodes.select("trajectory_id", ((F.col("reward") > 0) & ~F.isnan("reward")).alias("win"))
    totals = flags.agg(F.count_if("win").alias("wins"), F.count_if(~F.col("win")).alias("losses"))
    grams = action_sequences(steps).join(flags, "trajectory_id").select("trajectory_id", "win", F.explode(ngrams(F.col("actions"), n_values)).alias("ngram"))
    per = grams.groupBy("trajectory_id", "win", "ngram").agg(F.least(F.count(F.lit(1)), F.lit(per_episode)).alias("n")).filter("n > 0")
    rows = per.groupBy("ngram").agg(
        F.sum("n").alias("count"),
        F.count(F.lit(1)).alias("doc_freq"),
        F.count_if("win").alias("count_in_wins"),
        F.count_if(~F.col("win")).alias("count_in_losses"),
    )
    share = lambda part, all_: F.coalesce(F.try_divide(F.col(part), F.col(all_)), F.lit(0.0))
    out = rows.filter(F.col("count") >= min_count).crossJoin(F.broadcast(totals))
    out = out.withColumn("lift", share("count_in_wins", "wins") - share("count_in_losses", "losses"))
    return out.select("ngram", F.size("ngram").alias("n"), "count", "doc_freq", "count_in_wins", "count_in_losses", "lift").orderBy(F.abs("lift").desc(), F.desc("count"), "ngram")
