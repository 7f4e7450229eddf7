"""Shared plumbing: tables, the shared folder, lineage cuts and Arrow text access."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which driver and executors share.

    Where it is unset, a temporary folder is set in local mode only (tests); a cluster
    without the setting is refused, since a machine-local folder would lose rows there.
    """
    named = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="shared-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


#: Spark removes the shuffle files of a statement when it ends, not when the driver collects its garbage.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors, and frees the shuffles before."""
    spark = df.sparkSession
    path, before = new_folder(spark, tag), spark.conf.get(TIDY, None)
    spark.conf.set(TIDY, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(TIDY, before) if before is not None else spark.conf.unset(TIDY)
    return spark.read.schema(df.schema).parquet(path)


def bucket(doc_id: str, n: int):
    """crc32 of the id as text, modulo n; null ids fall in no bucket (null)."""
    return F.crc32(F.col(doc_id).cast("string")) % F.lit(n)


def held_out(doc_id: str, n: int, rest: int):
    return F.coalesce(bucket(doc_id, n) == rest, F.lit(False))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string or binary column, end to end, and its n+1 offsets; null reads as empty."""
    column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "") if column.null_count else column
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(offsets) else np.zeros(0, np.uint8)
    return raw, (offsets - offsets[0]) if len(offsets) else np.zeros(1, np.int64)


def slices(batch: pa.RecordBatch, column: str, limit: int = 2 << 20):
    """Cut a batch into runs of rows of about `limit` text bytes, one row at least."""
    _, offsets = text_bytes(batch.column(column))
    start, n = 0, batch.num_rows
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(n, max(end, start + 1))
        yield batch.slice(start, end - start)
        start = end
    _give_back()


def _give_back() -> None:
    """Return freed memory to the system: workers outlive their tasks, and an executor holds several."""
    pa.default_memory_pool().release_unused()
    if TRIM:
        TRIM(0)


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values[offsets[i]:offsets[i+1]] for each i; empty ranges give 0."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def private(columns: list[str], *stems: str) -> list[str]:
    """Names for an operator's own columns that none of the input's has; Spark ignores case."""
    taken, out = {c.lower() for c in columns}, []
    for stem in stems:
        name = stem
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def of_ids(docs: DataFrame, picked: DataFrame) -> DataFrame:
    """picked's rows with a text each: the least one of the documents of its doc_id. Ids without a text are left out.

    picked is broadcast, so its size must be bounded by a parameter of the caller; no other text is shuffled.
    """
    rows = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(picked), "doc_id")
    return rows.groupBy(*picked.columns).agg(F.min("text").alias("text"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, rest: int, limit: int) -> DataFrame:
    """(doc_id, label, text) of at most `limit` label rows outside the held-out fold, least hash of the id first.

    Ids are picked first, then their texts are fetched; of several documents of one id the least text counts.
    Rows with a null id, text or label teach nothing.
    """
    picked = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out("doc_id", folds, rest))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label")
        .limit(limit)
    )
    return of_ids(docs, picked.distinct())
