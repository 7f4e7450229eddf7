"""The driver's tables as steps and episodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CAP = 25  # steps after which a view's episode counts as cut short


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One episode per user and week: trajectory_id, task_id, mode, idx, action, obs, value, event_type, n_steps, step_cap_hit.

    The mode alternates by week; the observation is the value in bands of 25.
    """
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    week = F.date_trunc("week", F.col("ts").cast("timestamp"))
    rows = events.withColumn("week", F.to_date(week)).withColumn("trajectory_id", F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("week", "yyyyMMdd")))
    by = Window.partitionBy("trajectory_id").orderBy("ts", "event_id")
    odd = F.pmod(F.floor(F.datediff("week", F.lit("1970-01-05").cast("date")) / 7), F.lit(2)) == 1
    rows = rows.withColumns(
        {"idx": (F.row_number().over(by) - 1).cast("bigint"), "n_steps": F.count(F.lit(1)).over(Window.partitionBy("trajectory_id")), "mode": F.when(odd, "think").otherwise("no_think")}
    )
    return rows.select(
        "trajectory_id", F.col("user_id").alias("task_id"), "mode", "idx", F.col("event_type").alias("action"), F.floor(F.col("value") / 25).cast("string").alias("obs"), "value", "event_type", "n_steps", (F.col("n_steps") >= CAP).alias("step_cap_hit")
    )


def event_episodes(steps: DataFrame) -> DataFrame:
    """trajectory_id, task_id, mode, n_steps, step_cap_hit, reward (0 or 1), success, tokens, has_* flags."""
    has = {f"has_{t}": F.coalesce(F.bool_or(F.col("event_type") == t), F.lit(False)) for t in ("error", "purchase", "signup")}
    total = F.sum(F.col("value").cast("decimal(18,6)"))
    won = total > F.lit(50) * F.count(F.lit(1))
    return steps.groupBy("trajectory_id").agg(
        F.first("task_id").alias("task_id"), F.first("mode").alias("mode"), F.count(F.lit(1)).alias("n_steps"), F.first("step_cap_hit").alias("step_cap_hit"),
        F.when(won, 1.0).otherwise(0.0).alias("reward"), won.alias("success"), F.sum(F.floor("value").cast("bigint")).alias("tokens"), *[c.alias(k) for k, c in has.items()],
    )


def event_detector_steps(steps: DataFrame) -> DataFrame:
    """The steps as error detectors read them: an error event is a failed tool call, of a type by its band."""
    kind = F.when(F.col("value") < 10, F.lit("")).when(F.col("value") < 50, "not_found").otherwise("timeout")
    return steps.select(
        "trajectory_id", "idx", "n_steps", "step_cap_hit", F.lit("tool_call").alias("kind"), F.col("event_type").alias("tool"), F.lit(None).cast("map<string,string>").alias("arguments"),
        F.col("obs").alias("observation"), F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("result_status"), kind.alias("error_type"),
    )


def document_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as episodes: quality 1 is a win; language and source as predicates."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = docs.select("doc_id", "lang", "source", "n_chars").join(labels, "doc_id")
    return rows.select(
        F.col("doc_id").alias("trajectory_id"), F.col("source").alias("task_id"), F.col("quality").cast("double").alias("reward"), (F.col("quality") == 1).alias("success"), (F.col("toxic") == 1).alias("toxic"), "lang", "n_chars"
    )


def conversation_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.select(F.col("conv_id").alias("trajectory_id"), F.col("turn").alias("idx"), F.col("role").alias("action"), F.col("text").alias("observation"))
