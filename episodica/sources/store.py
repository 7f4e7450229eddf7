"""Write-once storage of bodies, quarantine and metadata, partitioned by tenant, domain and day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.constraints import CONTENT_KEY, violations
from .shared import stored

PARTS = ("tenant_id", "domain", "day")


class ConflictError(ValueError):
    """Other bytes under a hash that is stored."""


class ConstraintError(ValueError):
    """A row that the metadata table may not hold."""


def read(spark: SparkSession, root: str, what: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{what}")
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.parquet(f"{root}/{what}") if there else None


KEY = ("tenant_id", "domain", "content_sha256")
#: Hexadecimal digits of a content hash that choose its folder in the index: 256 folders.
PREFIX = 2
#: Files of an index folder; with more, a folder that a batch adds to is put together anew.
MOST_FILES = 8
INDEX = "tenant_id string, domain string, content_sha256 string, body_sha256 string, day date"


def _files(spark: SparkSession, folder: str) -> list:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [x for x in system.listStatus(path) if x.getPath().getName().startswith("part-")] if system.exists(path) else []


def _write_index(rows: DataFrame, path: str) -> None:
    writer = rows.repartition("prefix").sortWithinPartitions("prefix", "content_sha256").write.mode("append").partitionBy("prefix")
    writer.option("parquet.bloom.filter.enabled#content_sha256", "true").parquet(path)


def _prefix(sha: Column | str) -> Column:
    return F.substring(sha, 1, PREFIX)


def known(spark: SparkSession, root: str, keys: DataFrame, what: str = "bodies") -> DataFrame | None:
    """The index rows (INDEX) that lie in the folders which the hashes of `keys` meet; None where nothing is stored.

    Bodies are neither read nor hashed. The driver collects prefixes: 16 ** PREFIX at most.
    """
    prefixes = sorted(r[0] for r in keys.select(_prefix("content_sha256").alias("p")).filter("p is not null").distinct().collect())
    folders = [f"{root}/{what}_index/prefix={p}" for p in prefixes]
    there = [f for f in folders if _files(spark, f)]
    return spark.read.schema(INDEX).parquet(*there) if there else None


def compact(spark: SparkSession, root: str, prefixes: list[str], what: str = "bodies", most: int = MOST_FILES) -> None:
    """Put the index folders with more than `most` files together, sorted by hash. New files come before the old ones go, and a key that is listed twice counts once."""
    system_of = lambda path: path.getFileSystem(spark._jsc.hadoopConfiguration())
    for p in prefixes:
        old = _files(spark, f"{root}/{what}_index/prefix={p}")
        if len(old) > most:
            names = [x.getPath().toString() for x in old]
            _write_index(spark.read.schema(INDEX).parquet(*names).dropDuplicates([*KEY]).withColumn("prefix", F.lit(p)), f"{root}/{what}_index")
            for x in old:
                system_of(x.getPath()).delete(x.getPath(), False)


def put(bodies: DataFrame, root: str, what: str = "bodies") -> None:
    """Append (tenant_id, domain, day, content_sha256, body); stored ones are left, another body under a stored hash is refused.

    Beside the bodies lies an index of their keys and the hashes of their bytes, in folders by hash: a batch reads those that its
    own hashes meet, and no stored body. The index is written last; a batch that failed between is found by the bodies alone, so run
    reindex() after such a failure.
    """
    spark = bodies.sparkSession
    if read(spark, root, what) is not None and read(spark, root, f"{what}_index") is None:
        reindex(spark, root, what)
    own = bodies.withColumn("body_sha256", F.sha2("body", 256))
    if not own.groupBy(*KEY).agg(F.min("body_sha256").alias("a"), F.max("body_sha256").alias("b")).filter("a <> b").isEmpty():
        raise ConflictError("one hash came with two bodies")
    held = known(spark, root, own, what)
    if held is not None:
        old = held.select(*KEY, F.col("body_sha256").alias("_old")).dropDuplicates([*KEY])
        if not own.join(old, [*KEY]).filter(F.col("body_sha256") != F.col("_old")).isEmpty():
            raise ConflictError("a stored hash came with another body")
        own = own.join(old, [*KEY], "left_anti")
    fresh = stored(own.dropDuplicates([*KEY]), "bodies")
    fresh.drop("body_sha256").write.mode("append").partitionBy(*PARTS).parquet(f"{root}/{what}")
    entries = fresh.select(*KEY, "body_sha256", F.col("day").cast("date").alias("day"), _prefix("content_sha256").alias("prefix"))
    _write_index(entries, f"{root}/{what}_index")
    compact(spark, root, [r[0] for r in entries.select("prefix").distinct().collect()], what)


def reindex(spark: SparkSession, root: str, what: str = "bodies") -> None:
    """Add what the index lacks of the stored bodies: the one place that reads them all."""
    every = read(spark, root, what).select(*KEY, F.sha2("body", 256).alias("body_sha256"), F.col("day").cast("date").alias("day")).dropDuplicates([*KEY])
    held = read(spark, root, f"{what}_index")
    lacking = every if held is None else every.join(held.select(*KEY), [*KEY], "left_anti")
    _write_index(stored(lacking, "entries").withColumn("prefix", _prefix("content_sha256")), f"{root}/{what}_index")


def put_quarantine(results: DataFrame, root: str) -> None:
    """The rule, detail and field beside each refused body; repeated deliveries are kept."""
    results.select("tenant_id", "domain", F.current_date().alias("day"), "content_sha256", "rule", "detail", "field_path", F.col("raw").alias("body")).write.mode("append").partitionBy(*PARTS).parquet(f"{root}/quarantine")


def _entry(spark: SparkSession, root: str, tenant: str, domain: str, sha: str):
    one = spark.range(1).select(F.lit(sha).alias("content_sha256"))
    held = known(spark, root, one)
    return held.filter((F.col("content_sha256") == sha) & (F.col("tenant_id") == tenant) & (F.col("domain") == domain)).first() if held is not None else None


def exists(spark: SparkSession, root: str, tenant: str, domain: str, sha: str) -> bool:
    return _entry(spark, root, tenant, domain, sha) is not None


def get(spark: SparkSession, root: str, tenant: str, domain: str, sha: str) -> str | None:
    """A stored body, or None: the index tells the day, so one folder of bodies is read."""
    entry = _entry(spark, root, tenant, domain, sha)
    if entry is None:
        return None
    held = read(spark, root, "bodies").filter((F.col("tenant_id") == tenant) & (F.col("domain") == domain) & (F.col("day").cast("date") == F.lit(entry["day"])) & (F.col("content_sha256") == sha))
    return held.select("body").first()["body"]


def put_metadata(rows: DataFrame, root: str, tenants: DataFrame | None = None, domains: DataFrame | None = None) -> None:
    """Append the flat rows of accepted records, in partitions by the month of `created_at`; content that is stored already is left.

    Rows that break a constraint refuse the whole batch. tenants and domains: what rows may refer to; without them, their own.
    """
    held, key = read(rows.sparkSession, root, "metadata"), list(CONTENT_KEY)
    fresh = rows if held is None else rows.join(held.select(*key).distinct(), key, "left_anti")
    broken = violations(fresh, rows if tenants is None else tenants, rows if domains is None else domains)
    if first := broken.orderBy("rule", "trajectory_id").first():
        raise ConstraintError(f"{first['rule']} is broken by {first['trajectory_id']}; nothing was written")
    created = F.col("created_at") if "created_at" in fresh.columns else F.current_timestamp()
    fresh.withColumn("created_at", created).withColumn("month", F.date_format("created_at", "yyyy-MM")).write.mode("append").partitionBy("month").parquet(f"{root}/metadata")


def select_metadata(spark: SparkSession, root: str, months: list[str] | None = None, error_type: str | None = None) -> DataFrame | None:
    """Stored rows, of some months (only these are read) and of episodes with an error type."""
    held = read(spark, root, "metadata")
    if held is None:
        return None
    if months is not None:
        held = held.filter(F.col("month").isin(*months))
    return held if error_type is None else held.filter(F.array_contains("error_types", error_type))
