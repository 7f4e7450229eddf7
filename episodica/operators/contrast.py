"""What distinguishes wins from losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import benjamini_hochberg, fisher_exact, mcnemar_exact

EVIDENCE = 3
OUT = ("predicate", "p_given_win", "p_given_loss", "lift", "n_win", "n_loss", "p_value", "p_adjusted", "significant", "test_used", "evidence")


def is_win(threshold: float = 0.0) -> Column:
    return (F.col("reward") > threshold) & ~F.isnan("reward")


def melted(predicates: dict[str, Column]) -> Column:
    """An array of (predicate, hit) to explode."""
    return F.array(*[F.struct(F.lit(k).alias("predicate"), F.coalesce(c, F.lit(False)).alias("hit")) for k, c in sorted(predicates.items())])


def _finished(rows: DataFrame, test: str, q: float) -> DataFrame:
    adjusted = benjamini_hochberg(rows, "p_value", "predicate", q).withColumn("test_used", F.lit(test))
    return adjusted.select(*OUT).orderBy("p_adjusted", F.abs("lift").desc(), "predicate")


def unpaired_contrast(episodes: DataFrame, predicates: dict[str, Column], q: float = 0.10, threshold: float = 0.0, most: int = EVIDENCE) -> DataFrame:
    """Fisher's exact test for each predicate; no rows unless there are wins and losses.

    Predicates true or false of all episodes are dropped before the adjustment. Evidence: the first winners,
    then losers, by id.
    """
    rows = episodes.select("trajectory_id", is_win(threshold).alias("win"), F.explode(melted(predicates)).alias("p")).select("trajectory_id", "win", "p.*")
    counts = rows.groupBy("predicate").agg(
        F.count_if(F.col("win") & F.col("hit")).alias("a"), F.count_if(F.col("win") & ~F.col("hit")).alias("b"), F.count_if(~F.col("win") & F.col("hit")).alias("c"), F.count_if(~F.col("win") & ~F.col("hit")).alias("d")
    )
    kept = counts.filter("a + b > 0 and c + d > 0 and a + c > 0 and b + d > 0")
    by = Window.partitionBy("predicate").orderBy(F.desc("win"), "trajectory_id")
    first = rows.filter("hit").withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= most)
    evidence = first.groupBy("predicate").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "trajectory_id"))), lambda x: x["trajectory_id"]).alias("evidence"))
    share = kept.withColumns({"p_given_win": F.col("a") / (F.col("a") + F.col("b")), "p_given_loss": F.col("c") / (F.col("c") + F.col("d"))})
    tested = share.withColumns({"lift": F.col("p_given_win") - F.col("p_given_loss"), "n_win": F.col("a"), "n_loss": F.col("c"), "p_value": fisher_exact("a", "b", "c", "d")})
    return _finished(tested.join(evidence, "predicate", "left"), "fisher_exact", q)


def pairs(episodes: DataFrame, predicates: dict[str, Column], threshold: float = 0.0) -> DataFrame:
    """(task_id, think, no_think) of tasks run in both modes: win and hits of the arm with the largest id."""
    arm = F.struct(is_win(threshold).alias("win"), melted(predicates).alias("hits"))
    latest = episodes.groupBy("task_id").agg(*[F.max_by(F.when(F.col("mode") == m, arm), F.when(F.col("mode") == m, F.col("trajectory_id"))).alias(m) for m in ("think", "no_think")])
    return latest.filter("think is not null and no_think is not null")


def paired_contrast(episodes: DataFrame, predicates: dict[str, Column], q: float = 0.10, threshold: float = 0.0, most: int = EVIDENCE) -> DataFrame:
    """McNemar's exact test over tasks: p_given_win is of the think arm, p_given_loss of the other; n_win and n_loss are the discordant counts."""
    held = pairs(episodes, predicates, threshold)
    both = F.arrays_zip(F.col("think.hits").alias("t"), F.col("no_think.hits").alias("n"))
    rows = held.select("task_id", F.explode(both).alias("x")).select("task_id", F.col("x.t.predicate").alias("predicate"), F.col("x.t.hit").alias("t"), F.col("x.n.hit").alias("n"))
    counts = rows.groupBy("predicate").agg(F.count(F.lit(1)).alias("pairs"), F.count_if("t").alias("in_t"), F.count_if("n").alias("in_n"), F.count_if(F.col("t") & ~F.col("n")).alias("b"), F.count_if(F.col("n") & ~F.col("t")).alias("c")).filter("b + c > 0")
    first = rows.filter(F.col("t") != F.col("n")).withColumn("rank", F.row_number().over(Window.partitionBy("predicate").orderBy("task_id"))).filter(F.col("rank") <= most)
    evidence = first.groupBy("predicate").agg(F.array_sort(F.collect_list("task_id")).alias("evidence"))
    share = counts.withColumns({"p_given_win": F.col("in_t") / F.col("pairs"), "p_given_loss": F.col("in_n") / F.col("pairs")})
    tested = share.withColumns({"lift": F.col("p_given_win") - F.col("p_given_loss"), "n_win": F.col("b"), "n_loss": F.col("c"), "p_value": mcnemar_exact("b", "c")})
    return _finished(tested.join(evidence, "predicate", "left"), "mcnemar_exact", q)


def contrast_header(episodes: DataFrame, paired: bool = False, threshold: float = 0.0) -> DataFrame:
    """(wins, losses, status): status says why a contrast has no rows."""
    rows = pairs(episodes, {}, threshold).select(F.col("think.win").alias("win")) if paired else episodes.select(is_win(threshold).alias("win"))
    counts = rows.agg(F.count_if("win").alias("wins"), F.count_if(~F.col("win")).alias("losses"))
    status = F.when(F.col("wins") + F.col("losses") == 0, "degenerate_no_pairs").otherwise("ok") if paired else F.when((F.col("wins") == 0) | (F.col("losses") == 0), "degenerate_no_contrast").otherwise("ok")
    return counts.withColumn("status", status)


def default_predicates(error_types: list[str]) -> dict[str, Column]:
    """Over episodes with error_types, stalled, step_cap_hit and n_steps."""
    own = {f"error:{t}": F.array_contains("error_types", t) for t in sorted(set(error_types))}
    return own | {"stalled": F.col("stalled"), "step_cap_hit": F.col("step_cap_hit"), "long_episode": F.col("n_steps") >= 20}
