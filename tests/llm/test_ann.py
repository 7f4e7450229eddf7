import numpy as np
from pyspark.sql import functions as F

from episodica.llm import ann


def brute(rows, k=10):
    size = max({len(v) for _, v in rows}, key=lambda n: sum(len(v) == n for _, v in rows))
    held = sorted({(i, tuple(v)) for i, v in rows if len(v) == size})
    ids, x = np.array([i for i, _ in held]), np.array([v for _, v in held], float)
    out = {}
    for q in sorted(set(ids[ids % 100 == 0].tolist())):
        d = np.sqrt(((x[ids == q][:, None] - x[None]) ** 2).sum(axis=2)).min(axis=0)
        order = [j for j in np.lexsort((ids, d)) if ids[j] != q]
        out[q] = [(int(ids[j]), float(d[j])) for j in order][:k]
    return out


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(8, 16)) * 2
    rows = [(k, (centres[k % 8] + rng.normal(size=16)).astype(np.float32).tolist()) for k in range(3000)]
    rows += [(3000 + k, rows[0][1]) for k in range(40)]
    bad = [(9000, None), (9100, []), (9200, [0.0] * 16), (9300, [1.0] * 15 + [None]), (9400, [1.0] * 15 + [float("nan")]), (9500, [1.0, 2.0]), (None, [1.0] * 16)]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows + bad + rows[:5]], "vec_id long, embedding array<float>, rank int, list int")
    got = {}
    for r in ann.search(table, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    true = brute(rows)
    assert set(got) == set(true)
    hits = [len({i for i, _ in got[q]} & {i for i, _ in true[q]}) / 10 for q in true]
    assert np.mean(hits) >= 0.9 and got[0] == true[0]
    exact = {i: np.array(v, float) for i, v in rows}
    assert all(np.isclose(s, np.linalg.norm(exact[q] - exact[i])) for q, found in got.items() for i, s in found)
    assert all(found == sorted(found, key=lambda x: (x[1], x[0])) for found in got.values())
    split = ann.search(table, F.col("vec_id") % 100 == 0, per_task=50)
    assert sorted(map(tuple, split.collect())) == sorted((q, k + 1, i, s) for q, found in got.items() for k, (i, s) in enumerate(found))


def test_few_rows(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (100, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = [tuple(r) for r in ann.search(table, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 0.0), (0, 2, 100, 2**0.5), (100, 1, 0, 2**0.5), (100, 2, 1, 2**0.5)]
    assert ann.search(table.limit(0), F.lit(True)).isEmpty() and ann.search(table.limit(1), F.lit(True)).isEmpty()


def test_graph_search_finds_the_nearest_lists():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 8))
    index = ann.build(x, 150, 3, 0.1)
    sizes = np.bincount(ann.distances(x.astype(np.float32), index.centroids).argmin(axis=1))
    assert sizes.max() <= 3 * len(x) / 150
    q = rng.normal(size=(200, 8)).astype(np.float32)
    ids, far = index.near(q, 16)
    true = np.argsort(ann.distances(q, index.centroids), axis=1)[:, 0]
    assert (ids[:, 0] == true).mean() > 0.97 and (np.diff(far[:, :8], axis=1) >= -1e-6).all()


def test_equal_vectors_and_ids_with_several(spark):
    """A vector that very many rows share, an id with several vectors and both sides dealt to salts: exact in one list."""
    rng = np.random.default_rng(3)
    hot = rng.normal(size=4).tolist()
    rows = [(k, hot) for k in range(400)] + [(400 + k, rng.normal(size=4).tolist()) for k in range(300)]
    rows += [(500, rng.normal(size=4).tolist()) for _ in range(30)] + [(7, hot)] * 20 + [(800, [x + 1e-3 * k for x in hot]) for k in range(30)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("list", F.lit(1)).withColumn("score", F.lit("x"))
    true = brute(rows)
    for size in (8192, 40):
        got = {}
        for r in ann.search(table, F.col("vec_id") % 100 == 0, per_list=10_000, per_task=size).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert set(got) == set(true)
        for q, own in true.items():
            best = {}
            for i, d in brute(rows, k=2000)[q]:
                best[i] = min(d, best.get(i, d))
            expected = sorted(best.items(), key=lambda x: (x[1], x[0]))[:10]
            assert [i for i, _ in got[q]] == [i for i, _ in expected] and np.allclose([s for _, s in got[q]], [d for _, d in expected])
