"""Drift of records' schemas, found in the data: which fields come, go, change their kinds or become required from one group to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NONE = "array<struct<path: string, v: variant>>"


def _kind(v: Column) -> Column:
    """string, number, boolean, object, array or null."""
    name = F.schema_of_variant(v)
    return (
        F.when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array").when(name == "STRING", "string").when(name == "BOOLEAN", "boolean").when(name == "VOID", "null").otherwise("number")
    )


def _inside(x: Column) -> Column:
    """The fields of an object and the elements of an array, with their paths; nothing for other values."""
    fields = F.transform(F.map_entries(F.try_variant_get(x["v"], "$", "map<string, variant>")), lambda e: F.struct(F.concat(x["path"], F.lit("."), e["key"]).alias("path"), e["value"].alias("v")))
    elements = F.transform(F.try_variant_get(x["v"], "$", "array<variant>"), lambda e: F.struct(F.concat(x["path"], F.lit("[]")).alias("path"), e.alias("v")))
    kind = _kind(x["v"])
    return F.when(kind == "object", fields).when(kind == "array", elements).otherwise(F.array().cast(NONE))


def field_kinds(records: DataFrame, by: str, raw: str, depth: int = 4) -> DataFrame:
    """(by, path, kinds, required) of all fields down to `depth`: the sorted kinds of a path's values, and whether every record has it.

    Fields are listed within their record and counted with partial aggregation, so what is shuffled grows with the number of
    different fields. Text that is no JSON has no fields, but counts as a record; a null value is there.
    """
    own = records.select(F.col(by).alias("g"), F.try_parse_json(raw).alias("v"))
    level = own.withColumn("l0", F.when(F.col("v").isNull(), F.array().cast(NONE)).otherwise(F.array(F.struct(F.lit("$").alias("path"), F.col("v").alias("v")))))
    for k in range(depth):
        level = level.withColumn(f"l{k + 1}", F.flatten(F.transform(f"l{k}", _inside)))
    every = F.concat(*[F.transform(f"l{k + 1}", lambda x: F.struct(x["path"].alias("path"), _kind(x["v"]).alias("kind"))) for k in range(depth)])
    # an array's elements share a path, so a record's different ones are kept
    fields = level.select("g", F.explode(F.array_distinct(every)).alias("f")).select("g", "f.path", "f.kind")
    paths = level.select("g", F.explode(F.array_distinct(F.transform(every, lambda f: f["path"]))).alias("path")).groupBy("g", "path").agg(F.count(F.lit(1)).alias("n"))
    kinds = fields.distinct().groupBy("g", "path").agg(F.array_join(F.array_sort(F.collect_set("kind")), "|").alias("kinds"))
    totals = own.groupBy("g").agg(F.count(F.lit(1)).alias("total"))
    return kinds.join(paths, ["g", "path"]).join(totals, "g").select(F.col("g").alias(by), "path", "kinds", (F.col("n") == F.col("total")).alias("required"))


def drift(fields: DataFrame, by: str) -> DataFrame:
    """(by, path, change) from each group to the one after it: added, removed, kinds changed (from > to), became required, became optional."""
    groups = fields.select(by).distinct()
    follow = groups.select(F.col(by).alias("was"), F.lead(by).over(Window.orderBy(by)).alias("now")).filter("now is not null")  # a row a group
    old = fields.join(F.broadcast(follow), F.col(by) == F.col("was")).select("now", "path", F.col("kinds").alias("a"), F.col("required").alias("ra"))
    new = fields.join(F.broadcast(follow), F.col(by) == F.col("now")).select("now", "path", F.col("kinds").alias("b"), F.col("required").alias("rb"))
    both = old.join(new, ["now", "path"], "full_outer")
    changes = F.array(
        F.when(F.col("a").isNull(), "added"), F.when(F.col("b").isNull(), "removed"), F.when(F.col("a") != F.col("b"), F.concat(F.lit("kinds changed: "), "a", F.lit(" > "), "b")),
        F.when(~F.col("ra") & F.col("rb"), "became required"), F.when(F.col("ra") & ~F.col("rb"), "became optional"),
    )
    return both.select(F.col("now").alias(by), "path", F.explode(F.array_compact(changes)).alias("change"))
