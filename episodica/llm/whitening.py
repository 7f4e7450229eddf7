"""Embedding whitening: the Gramian of exactly centred rows by MLlib's RowMatrix, eigenvectors of it on the driver, projection where the rows are.

Entries become whole numbers, so the sums over the fit list (each different vector once) are exact, and n*x - S is exact before it is
divided by n: rows enter the Gramian centred, never as differences of large moments. The driver gets d sums and a d x d matrix; the
projection is broadcast with the code (at most d x `most` numbers).

Defined results: a row whose vector is null or holds a null or non-finite entry is left out, and so is one whose length isn't that
of most rows (ties: the longer); a row with a null vec_id stays; repeated rows are each returned and count once in the fit list; a
component whose eigenvalue is zero to working precision (d * 2.2e-16 of the first) has no whitened value and is left out, as are all
of a single vector; an empty table gives no rows; deviation is null where it passes 64 bits; entries of 2**55 and more are an error;
other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, stored

MOST = 16  # components
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
SAFE = 2.0**62


@dataclass(frozen=True)
class Whitening:
    """n and S of the fit list; the eigenvectors, as columns over the root of their eigenvalues; and what is reported of them."""

    n: int
    base: np.ndarray  # S = n * base + rest
    rest: np.ndarray
    project: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n*x - S, exactly: 64-bit numbers, or Python's where these don't do."""
        away = x - self.base
        if len(away) and float(np.abs(away).max()) * self.n > SAFE:
            away, rest = away.astype(object), self.rest.astype(object)
            return away * self.n - rest
        return away * self.n - self.rest


def whole_vectors(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows that take part, but for their length: x = floor(64 * entry) + 1000000."""
    entries = rows.select("vec_id", F.col(vector).cast("array<double>").alias("c")).filter("c is not null")
    sound = entries.filter(~F.exists("c", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    far = F.raise_error(F.lit("an entry of 2**55 or more can't be whitened")).cast("long")
    return sound.select("vec_id", F.transform("c", lambda v: F.when(F.abs(v) < 2.0**55, F.floor(v * 64) + 1_000_000).otherwise(far)).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            total = _matrix(batch.column(0)).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["place", "total"])


def _centred(fit: DataFrame, n: int, base: np.ndarray, rest: np.ndarray) -> RowMatrix:
    at, over = F.lit(base.tolist()), F.lit(rest.tolist())
    exact = F.transform("x", lambda v, i: (F.lit(n) * (v - F.get(at, i)) - F.get(over, i)).cast("double") / F.lit(float(n)))
    return RowMatrix(MLUtils.convertVectorColumnsFromML(fit.select(array_to_vector(exact).alias("row")), "row"))


def fit_whitening(fit: DataFrame, most: int = MOST) -> Whitening | None:
    """Of a table of different vectors x of one length; None where they have no spread."""
    n = fit.count()
    if not n:
        return None
    sums = {r["place"]: r["total"] for r in fit.mapInArrow(_partial_sums, "place int, total long").groupBy("place").agg(F.sum("total").alias("total")).collect()}
    base = np.array([sums[k] // n for k in range(len(sums))], np.int64)
    rest = np.array([sums[k] % n for k in range(len(sums))], np.int64)
    if not len(base):
        return None
    rows = _centred(fit, n, base, rest)
    covariance = rows.computeGramianMatrix().toArray() / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    kept = values > max(values[0], 0) * len(base) * np.finfo(float).eps
    if not kept.any():
        return None
    project = vectors[:, kept] / np.sqrt(values[kept])
    whitened = rows.multiply(DenseMatrix(*project.shape, project.ravel(order="F")))
    error = np.abs(whitened.computeGramianMatrix().toArray() / n - np.eye(project.shape[1])).max()
    return Whitening(n, base, rest, project, values[kept] / np.trace(covariance), float(error))


def _whiten(model: Whitening):
    """Rows of RESULT, one for each row and component."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = model.project.shape[1]
        for rows in batches:
            if not len(rows):
                continue
            exact = model.deviations(np.stack(rows["x"].to_list()))
            if exact.dtype == object or float((exact.astype(float) ** 2).sum(axis=1).max()) > SAFE:
                squares = [sum(int(v) ** 2 for v in row) for row in exact]
                away = pd.array([s if s < 1 << 63 else None for s in squares], dtype="Int64")
            else:
                away = pd.array((exact**2).sum(axis=1), dtype="Int64")
            whitened = (exact.astype(float) / model.n) @ model.project
            yield pd.DataFrame(
                {
                    "vec_id": rows["vec_id"].astype("Int64").repeat(size).array,
                    "component": np.tile(np.arange(1, size + 1, dtype=np.int32), len(rows)),
                    "n": model.n,
                    "deviation": away.repeat(size),
                    "whitened": whitened.ravel(),
                    "explained": np.tile(model.explained, len(rows)),
                    "identity_error": model.identity_error,
                }
            )

    return run


def whiten(rows: DataFrame, vector: str = "embedding", most: int = MOST) -> DataFrame:
    """RESULT's columns for each row that takes part and each of at most `most` components."""
    every = whole_vectors(rows, vector)
    usual = every.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    own = every.filter(F.size("x") == (usual["size"] if usual else -1))
    model = fit_whitening(stored(own.select("x").distinct(), "fit-list"), most)
    if model is None:
        return rows.sparkSession.createDataFrame([], RESULT)
    return own.mapInPandas(_whiten(model), RESULT)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read_table(spark, sf_dir, "embeddings"))
