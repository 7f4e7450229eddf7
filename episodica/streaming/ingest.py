"""Continuous ingest: files of records in, bodies and quarantine out, each record once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..sources import batch, store


def read_stream(spark: SparkSession, folder: str, tenant_id: str, source_format: str) -> DataFrame:
    rows = spark.readStream.text(folder)
    return rows.select(F.lit(tenant_id).alias("tenant_id"), F.lit(source_format).alias("source_format"), F.col("value").alias("raw"))


def write_stream(rows: DataFrame, root: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Each micro-batch: hash, drop what is stored, validate, write both sinks.

    Known records are those stored, found by the index of their hashes, so no key state grows in memory, and none is ever forgotten. A batch that is run again after a
    failure finds its own bodies stored and adds nothing to them; a quarantined record may be listed twice.
    """
    def sink(part: DataFrame, _: int) -> None:
        spark = part.sparkSession
        numbered = part.withColumn("position", F.monotonically_increasing_id())
        results = batch.ingest(numbered, lambda keys: store.known(spark, root, keys)).persist()
        try:
            accepted = results.filter("status = 'accepted'")
            store.put(accepted.select("tenant_id", "domain", F.current_date().alias("day"), "content_sha256", F.col("raw").alias("body")), root)
            store.put_quarantine(results.filter("status = 'quarantined'"), root)
        finally:
            results.unpersist()

    writer = rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def deduplicated(rows: DataFrame) -> DataFrame:
    """A streaming dedup by content with key state, where no store is at hand."""
    keyed = rows.withColumn("content_sha256", batch.canonical_hash_native(F.col("raw"))).withColumn("domain", F.coalesce(F.try_variant_get(F.try_parse_json("raw"), "$.domain", "string"), F.lit("unknown")))
    return keyed.dropDuplicates(["tenant_id", "domain", "content_sha256"])
