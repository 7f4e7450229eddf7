"""The mergeable bootstrap against a plain loop over the same hashes."""

import hashlib
import math

import numpy as np

from episodica.functions import stats


def plain(rows, resamples, seed):
    means = []
    for r in range(resamples):
        h = hashlib.sha256(f"{seed}:{r}".encode()).hexdigest()
        a, b = int(h[:8], 16) % (stats.PRIME - 1) + 1, int(h[8:16], 16) % stats.PRIME
        keys = [int(hashlib.sha256(t.encode()).hexdigest()[:12], 16) % stats.PRIME for t, _ in rows]
        weights = [sum((a * k + b) % stats.PRIME >= x for x in stats.WEIGHT_BOUNDS) for k in keys]
        if sum(weights):
            means.append(sum(w * d for w, (_, d) in zip(weights, rows)) / sum(weights))
    return [float(np.mean([d for _, d in rows])), *np.percentile(means, [2.5, 97.5]).tolist()]


def test_equal_to_a_plain_loop_however_rows_are_dealt(spark):
    rows = [(f"t{k}", math.sin(k)) for k in range(300)]
    table = spark.createDataFrame([*rows, ("none", None), (None, 0.5)], "task_id string, delta double")
    expected = plain(rows, 150, 4)
    for parts in (1, 7, 400):
        got = stats.bootstrap_delta_distributed(table.repartition(parts), 150, 4).first()
        assert np.allclose([got.point, got.low, got.high], expected)


def test_weights_are_those_of_a_poisson_law(spark):
    u = np.linspace(0, stats.PRIME - 1, 200_001).astype(np.int64)
    w = np.searchsorted(np.array(stats.WEIGHT_BOUNDS), u, side="right")
    assert abs(w.mean() - 1) < 1e-3 and abs(w.var() - 1) < 1e-2 and abs((w == 0).mean() - math.exp(-1)) < 1e-4


def test_no_tasks_and_one_task(spark):
    none = spark.createDataFrame([], "task_id string, delta double")
    assert stats.bootstrap_delta_distributed(none, 50).first() == (None, None, None)
    one = spark.createDataFrame([("a", 0.25)], "task_id string, delta double")
    assert stats.bootstrap_delta_distributed(one, 50).first() == (0.25, 0.25, 0.25)
