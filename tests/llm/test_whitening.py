"""Whitening against numpy on the same whole numbers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodica.llm import whitening


def vectors(n=300, d=20, seed=3):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) + rng.normal(size=d)).tolist()


def table(spark, rows):
    return spark.createDataFrame([(i, v, 7, "x") for i, v in rows], "vec_id long, embedding array<double>, n int, whitened string")


def plain(rows, most=16):
    x = {}
    own = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(v) for _, v in own}), np.int64)
    n, s = len(fit), fit.sum(axis=0)
    centred = (n * fit - s) / n
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    for i, v in own:
        away = [n * a - int(b) for a, b in zip(v, s)]
        x.setdefault(i, []).append((sum(a * a for a in away), (np.array(away) / n) @ u / np.sqrt(e)))
    return n, e / np.trace(cov), x


def by_row(found):
    out = {}
    for r in found.collect():
        out.setdefault(r.vec_id, {})[r.component] = r
    return out


def test_equal_to_numpy(spark):
    rows = list(enumerate(vectors()))
    rows += [(1000 + k, rows[4][1]) for k in range(200)]  # a hot vector counts once
    rows += [(2000, None), (2001, [1.0] * 19 + [None]), (2002, [math.nan] * 20), (2003, [math.inf] * 20), (2004, [1.0] * 3), (2005, [])]
    sound = [r for r in rows if r[0] < 2000]
    n, explained, expected = plain(sound)
    found = whitening.whiten(table(spark, rows).repartition(4))
    assert found.columns == [c.split()[0] for c in whitening.RESULT.split(", ")]
    got = by_row(found)
    assert set(got) == {i for i, _ in sound}
    signs = [np.sign(got[0][k + 1].whitened * expected[0][0][1][k]) for k in range(16)]
    for i, own in got.items():
        deviation, whitened = expected[i][0]
        assert sorted(own) == list(range(1, 17)) and {r.n for r in own.values()} == {n} and {r.deviation for r in own.values()} == {deviation}
        assert np.allclose([own[k + 1].whitened * signs[k] for k in range(16)], whitened, rtol=1e-8, atol=1e-9)
        assert np.allclose([own[k + 1].explained for k in range(16)], explained, rtol=1e-9) and own[1].identity_error < 1e-9


def test_repeated_rows_and_null_ids_stay(spark):
    rows = [*enumerate(vectors(40, 3)), (None, [0.5, 0.5, 0.5]), (None, [0.5, 0.5, 0.5]), (3, [9.0, 9.0, 9.0])]
    found = whitening.whiten(table(spark, rows))
    assert found.groupBy("vec_id").agg(F.count(F.lit(1)).alias("c")).filter("vec_id is null or vec_id = 3").agg(F.min("c"), F.max("c")).first() == (6, 6)


def test_directions_without_spread_are_left_out(spark):
    flat = [(k, [float(k), 2.0 * k, 5.0, 0.0]) for k in range(30)]
    got = whitening.whiten(table(spark, flat)).collect()
    assert {r.component for r in got} == {1} and len(got) == 30 and abs(got[0].explained - 1) < 1e-9


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, []), (2, [])], [(1, [1.0]), (2, [1.0])]])
def test_nothing_to_whiten(spark, rows):
    found = whitening.whiten(table(spark, rows))
    assert found.collect() == [] and found.columns[0] == "vec_id"


def test_wide_numbers(spark):
    rows = [(k, [float(k) * 2.0**40, float(k % 7)]) for k in range(50)]
    n, _, expected = plain(rows)
    got = by_row(whitening.whiten(table(spark, rows)))
    for i, own in got.items():
        exact = expected[i][0][0]
        assert own[1].deviation == (exact if exact < 1 << 63 else None)
    with pytest.raises(Exception, match="whitened"):
        whitening.whiten(table(spark, [(1, [2.0**60]), (2, [0.0])])).collect()
