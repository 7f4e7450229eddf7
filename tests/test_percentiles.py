import random

import numpy as np

from episodica.functions.stats import exact_percentiles


def test_exact_percentiles_of_skewed_and_tied_groups(spark):
    rng = random.Random(1)
    groups = {"many": [rng.gauss(0, 1) for _ in range(70_000)], "tied": [float(rng.choice([1, 1, 1, 2])) for _ in range(5000)], "one": [7.0], "two": [1.0, 2.0]}
    rows = [(g, v) for g, own in groups.items() for v in own] + [("many", None), ("none", None)]
    percents = (0.0, 0.025, 0.5, 0.975, 1.0)
    got = {(r.g, r.percent): r.value for r in exact_percentiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", percents).collect()}
    assert set(got) == {(g, p) for g in groups for p in percents}
    for (g, p), value in got.items():
        assert np.isclose(value, np.quantile(groups[g], p), rtol=0, atol=1e-12)
    assert exact_percentiles(spark.createDataFrame([], "g string, v double"), "g", "v", percents).isEmpty()
