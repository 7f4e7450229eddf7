"""Batches as they are sent: whole envelopes, admitted or refused where they lie, and their records as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batch import MAX_BATCH_BYTES, MAX_BATCH_RECORDS

DETAILS = {413: "a batch over the cap", 400: "the body isn't JSON", 422: "expected tenant_id and records of source_format and body", 200: ""}


def _keys(v: str, path: str) -> str:
    return f"array_sort(coalesce(map_keys(try_variant_get({v}, '{path}', 'map<string, variant>')), array()))"


def _is(v: str, path: str, kind: str) -> str:
    return f"coalesce(startswith(schema_of_variant(try_variant_get({v}, '{path}', 'variant')), '{kind}'), false)"


def status(body: str, v: str, max_bytes: int = MAX_BATCH_BYTES, max_records: int = MAX_BATCH_RECORDS) -> Column:
    """413 over a cap, 400 for no JSON, 422 for another envelope, else 200; body and v name the text and its variant (null: no JSON)."""
    record = f"{_keys('r', '$')} = array('body', 'source_format') and {_is('r', '$.source_format', 'STRING')} and {_is('r', '$.body', 'OBJECT')}"
    records = f"try_variant_get({v}, '$.records', 'array<variant>')"
    shape = f"{_keys(v, '$')} = array('records', 'tenant_id') and {_is(v, '$.tenant_id', 'STRING')} and {_is(v, '$.records', 'ARRAY')} and forall({records}, r -> {record})"
    return F.expr(
        f"case when octet_length({body}) > {max_bytes} then 413 when {v} is null then 400 when not coalesce({shape}, false) then 422 when size({records}) > {max_records} then 413 else 200 end"
    )


def admitted(envelopes: DataFrame, max_bytes: int = MAX_BATCH_BYTES, max_records: int = MAX_BATCH_RECORDS) -> DataFrame:
    """envelopes (envelope: a whole number, body) with v, status, detail and n_records (of those admitted). A null body is no JSON."""
    parsed = envelopes.withColumn("v", F.when(F.octet_length("body") <= max_bytes, F.try_parse_json("body")))
    out = parsed.withColumn("status", status("body", "v", max_bytes, max_records))
    told = F.create_map(*[F.lit(x) for pair in DETAILS.items() for x in pair])
    n = F.when(F.col("status") == 200, F.size(F.try_variant_get("v", "$.records", "array<variant>")))
    return out.withColumns({"detail": F.element_at(told, F.col("status")), "n_records": n})


def records(admitted_ones: DataFrame, max_records: int = MAX_BATCH_RECORDS) -> DataFrame:
    """The records of admitted envelopes as rows for `batch.ingest`: envelope, tenant_id, source_format, raw, position (by envelope, then place).

    An envelope's records are taken out where it lies: nothing passes the driver, and nothing is shuffled.
    """
    rows = admitted_ones.filter("status = 200").select("envelope", F.try_variant_get("v", "$.tenant_id", "string").alias("tenant_id"), F.posexplode(F.try_variant_get("v", "$.records", "array<variant>")).alias("pos", "record"))
    place = (F.col("envelope") * max_records + F.col("pos")).cast("long")
    return rows.select("envelope", "tenant_id", F.try_variant_get("record", "$.source_format", "string").alias("source_format"), F.to_json(F.try_variant_get("record", "$.body", "variant")).alias("raw"), place.alias("position"))
