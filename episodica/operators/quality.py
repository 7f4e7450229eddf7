"""Checks of ingested data, one row each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: name: (threshold, comparison, what a breach does); fixed values.
CHECKS = {
    "normalization_success_rate": (0.99, ">", "alert"),
    "reward_presence": (1.0, ">=", "quarantine"),
    "step_contiguity": (1.0, ">=", "quarantine"),
    "token_accounting_completeness": (0.999, ">", "alert"),
    "duplicate_rate": (0.001, "<", "alert"),
    "redaction_recall": (0.98, ">", "block_corpus_creation"),
    "corpus_class_balance": (None, "report_only", "report_only"),
}


def tokens_complete(tokens: Column, keys: tuple[str, ...]) -> Column:
    """All components known; a missing one is never zero."""
    out = F.lit(True)
    for k in keys:
        out = out & tokens[k].isNotNull()
    return out


def output_total(tokens: Column) -> Column:
    """Null where any part is."""
    return tokens["output_visible"] + tokens["output_tool_args"] + tokens["output_reasoning"]


def quality_report(episodes: DataFrame, submitted: int | None = None, redaction_recall: float | None = None, on_breach: Callable[[dict], None] | None = None) -> DataFrame:
    """(check, value, threshold, comparison, passed, action) in a single pass.

    episodes: reward, contiguous, steps, complete_steps, content_sha256, success. With no rows each check but the
    duplicate rate and the balance has the value 1.0, and passes.
    """
    n = F.count(F.lit(1))
    rate = lambda up, down, empty: F.coalesce(F.try_divide(up, down), F.lit(empty))
    values = {
        "normalization_success_rate": rate(n, F.lit(submitted) if submitted is not None else n, 1.0),
        "reward_presence": rate(F.count("reward"), n, 1.0),
        "step_contiguity": rate(F.count_if("contiguous"), n, 1.0),
        "token_accounting_completeness": rate(F.coalesce(F.sum("complete_steps"), F.lit(0)), F.coalesce(F.sum("steps"), F.lit(0)), 1.0),
        "duplicate_rate": rate(n - F.count_distinct("content_sha256"), n, 0.0),
        "corpus_class_balance": rate(F.count_if("success"), n, 0.0),
    }
    if redaction_recall is not None:
        values["redaction_recall"] = F.lit(redaction_recall)
    one = episodes.agg(*[v.cast("double").alias(k) for k, v in values.items()])
    entry = lambda k: F.struct(F.lit(k).alias("check"), F.col(k).alias("value"), F.lit(CHECKS[k][0]).cast("double").alias("threshold"), F.lit(CHECKS[k][1]).alias("comparison"), F.lit(CHECKS[k][2]).alias("action"))
    rows = one.select(F.explode(F.array(*map(entry, values))).alias("e")).select("e.*")
    passed = F.when(F.col("comparison") == ">", F.col("value") > F.col("threshold")).when(F.col("comparison") == ">=", F.col("value") >= F.col("threshold")).when(F.col("comparison") == "<", F.col("value") < F.col("threshold")).otherwise(True)
    report = rows.withColumn("passed", passed)
    if on_breach:
        for r in report.filter(~F.col("passed")).collect():
            on_breach(r.asDict())
    return report


def duplicate_rate(rows: DataFrame, column: str = "content_sha256") -> DataFrame:
    """(n, duplicates, rate)."""
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("c")).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("duplicates"))
    return counts.withColumn("rate", F.coalesce(F.try_divide("duplicates", "n"), F.lit(0.0)))


def contiguity(steps: DataFrame) -> DataFrame:
    """(trajectory_id, n_steps, contiguous): whether the indices are 0, 1, ... each once."""
    per = steps.groupBy("trajectory_id").agg(F.count(F.lit(1)).alias("n_steps"), F.count_distinct("idx").alias("d"), F.min("idx").alias("lo"), F.max("idx").alias("hi"))
    return per.select("trajectory_id", "n_steps", ((F.col("lo") == 0) & (F.col("hi") == F.col("n_steps") - 1) & (F.col("d") == F.col("n_steps"))).alias("contiguous"))
