"""Operator 1, approximate nearest neighbours in balanced posting lists.

Centroids are fitted on a bounded sample by k-means; lists that
hold more than their share of the sample are split again, so the lists are balanced. There is a list for every ``per_list`` points, up to
``most_lists``; the sample has about ``sample`` vectors, by the hash of their values, and eight for each list where these are many, up
to ``most_sample``. A graph joins each centroid to its
nearest ones and a best-first beam search on it, in memory, finds the centroids near a vector. Every vector is
indexed: in its nearest list and, where it lies near a boundary, in up to ``copies`` lists whose centroids are
at most (1 + margin) times as far. A query searches the lists whose centroids are at most (1 + ratio) times as far as its
nearest one; ratio is calibrated so that sampled queries reach the wanted recall within the sample.

Equal vectors are one point with its smallest ids, one more than are asked for, since no query needs others of them; so a vector that very
many rows share is compared once. The lists, not the driver, hold the points: asking and held points meet by list, in blocks, and each block
returns its own nearest ids. A list's points are dealt to salts of at most about ``per_task``, those that ask likewise, and each
pair of salts is a task of its own.

Distances are exact: squared differences of the original vectors in double precision. Defined results: vectors that
are null, zero, of another length than most, or hold null or non-finite components take no part; ties
go to the smaller vec_id; repeated rows count once, an id with several vectors has its nearest one; a query without candidates, as
any with an empty table or a single vector, gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import read_table, stored

FOUND = 10


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances in single precision, for choosing lists only."""
    return np.maximum((a**2).sum(1)[:, None] - 2 * a @ b.T + (b**2).sum(1)[None, :], 0)


def assigned(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest row of c for each row of x, in blocks."""
    return np.concatenate([distances(x[i : i + 2048], c).argmin(axis=1) for i in range(0, len(x), 2048)])


@dataclass
class Index:
    centroids: np.ndarray
    graph: np.ndarray  # neighbours of each centroid
    entries: np.ndarray  # where every search begins
    ratio: float = 0.1

    def near(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The `beam` centroids found nearest to each row, and their distances: best-first search of the graph."""
        n, k = len(x), len(self.centroids)
        beam = min(beam, k)
        seen = np.zeros((n, k), bool)
        ids = np.broadcast_to(self.entries, (n, len(self.entries)))
        seen[:, self.entries] = True
        far = distances(x, self.centroids[self.entries])
        done = np.zeros(ids.shape, bool)
        while True:
            order = np.argsort(far, axis=1, kind="stable")[:, :beam]
            ids, far, done = (np.take_along_axis(v, order, 1) for v in (ids, far, done))
            open_far = np.where(done, np.inf, far)
            at = open_far.argmin(axis=1)
            active = np.flatnonzero(np.isfinite(open_far[np.arange(n), at]))
            if not len(active):
                return ids, np.sqrt(far)
            done = done.copy()
            done[active, at[active]] = True
            step = self.graph[ids[active, at[active]]]
            fresh = ~seen[active[:, None], step]
            seen[active[:, None], step] = True
            more = ((self.centroids[step] - x[active, None, :]) ** 2).sum(axis=2)
            grown = np.full((n, step.shape[1]), np.inf, more.dtype)
            grown[active] = np.where(fresh, more, np.inf)
            steps = np.zeros((n, step.shape[1]), ids.dtype)
            steps[active] = step
            ids, far = np.concatenate([ids, steps], 1), np.concatenate([far, grown], 1)
            done = np.concatenate([done, ~np.isfinite(grown)], 1)

    def home(self, x: np.ndarray, copies: int, margin: float, beam: int = 16) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of the lists that hold each vector: nearest first, near-boundary ones copied."""
        ids, far = self.near(x, max(beam, copies))
        take = np.isfinite(far) & (far <= far[:, :1] * (1 + margin))
        take[:, copies:] = False
        return np.nonzero(take)[0], ids[take]

    def lists(self, x: np.ndarray, ratio: float | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of the lists a query searches: all within the distance ratio, the beam widened until it covers them."""
        ratio = self.ratio if ratio is None else ratio
        beam = min(32, len(self.centroids))
        while True:
            ids, far = self.near(x, beam)
            take = np.isfinite(far) & (far <= far[:, :1] * (1 + ratio) + 1e-9)
            if beam == len(self.centroids) or not take[:, -1].any():
                return np.nonzero(take)[0], ids[take]
            beam = min(4 * beam, len(self.centroids))


def _kmeans(x: np.ndarray, k: int, rounds: int, rng) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = assigned(x, c)
        size = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[size > 0] = total[size > 0] / size[size > 0, None]
        empty = np.flatnonzero(size == 0)
        c[empty] = x[rng.choice(len(x), len(empty))]
    return c


def balanced_centroids(x: np.ndarray, k: int, rounds: int = 8, slack: float = 2.0) -> np.ndarray:
    """About k centroids, none with over `slack` times its share of x unless its vectors are all alike."""
    rng = np.random.default_rng(0)
    most, out, todo = max(2.0, slack * len(x) / k), [], [x]
    while todo:
        own = todo.pop()
        parts = min(len(own), k if own is x else 2)
        c = _kmeans(own, parts, rounds, rng)
        near = assigned(own, c)
        order = np.argsort(near, kind="stable")
        ends = np.searchsorted(near[order], np.arange(parts + 1))
        for j in range(parts):
            mine = own[order[ends[j] : ends[j + 1]]]
            if not len(mine):
                continue
            if len(mine) > most and len(mine) < len(own) and (mine != mine[0]).any():
                todo.append(mine)
            else:
                out.append(mine.mean(axis=0))
    return np.array(out, x.dtype)


def build(x: np.ndarray, lists: int, copies: int, margin: float, recall: float = 0.97, degree: int = 24, seed: int = 1) -> Index:
    """Fit on the sample; ratio is the least that lets sampled queries find `recall` of their nearest ones in it."""
    x = x.astype(np.float32)
    c = balanced_centroids(x, min(lists, len(x)))
    near = np.concatenate([np.argsort(distances(c[i : i + 512], c), axis=1, kind="stable")[:, : degree + 1] for i in range(0, len(c), 512)])
    near = near[:, 1:] if len(c) > 1 else near
    rng = np.random.default_rng(seed)
    links = rng.integers(0, len(c), (len(c), 4))  # long links keep the graph in one piece
    links[:, 0] = (np.arange(len(c)) + 1) % len(c)
    graph = np.concatenate([near, links], axis=1)
    # a step lists a neighbour once: repeats point home, which is seen already
    graph.sort(axis=1)
    repeat = np.zeros(graph.shape, bool)
    repeat[:, 1:] = graph[:, 1:] == graph[:, :-1]
    graph = np.where(repeat, np.arange(len(c))[:, None], graph)
    entries = np.unique(np.linspace(0, len(c) - 1, min(len(c), 16)).astype(int))
    index = Index(c, graph, entries)
    reach = []
    for i in rng.choice(len(x), min(len(x), 400), replace=False):
        d = distances(x[i : i + 1], x)[0]
        d[i] = np.inf
        true = np.argpartition(d, min(FOUND, len(x) - 1) - 1)[: min(FOUND, len(x) - 1)] if len(x) > 1 else np.zeros(0, int)
        far = np.sqrt(distances(x[i : i + 1], c))[0]
        relative = far / max(float(far.min()), 1e-9) - 1
        row, own = index.home(x[true], copies, margin)
        # the ratio at which each true neighbour is first reached
        first = np.full(len(true), np.inf)
        np.minimum.at(first, row, relative[own])
        reach.append(first)
    index.ratio = float(np.quantile(np.concatenate(reach), recall)) + 1e-6 if len(x) > 1 else 0.0
    return index


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v (doubles) of the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null")
    rows = rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").limit(1).collect()
    return rows.filter(F.size("v") == (sizes[0]["size"] if sizes else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def nearest(q: np.ndarray, x: np.ndarray, ids: list[np.ndarray], k: int, block: int = 1 << 22) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, id, distance) of the k different ids nearest to each row of q among the points x and their ids, exactly, in blocks."""
    rows, found, scores = [], [], []
    size = np.array([len(i) for i in ids])
    flat, point = np.concatenate(ids), np.repeat(np.arange(len(ids)), size)
    several = len(np.unique(flat)) < len(flat)  # else an id is one point's alone
    step = max(1, block // max(1, x.size))
    for a in range(0, len(q), step):
        far = ((q[a : a + step, None, :] - x[None, :, :]) ** 2).sum(axis=2)
        for i, own in enumerate(far):
            wanted = k
            while True:  # an id with several vectors may fill places
                most = np.partition(own, wanted - 1)[wanted - 1] if len(own) > wanted else np.inf
                at = np.flatnonzero(own[point] <= most)
                at = at[np.lexsort((flat[at], own[point[at]]))]
                first = np.unique(flat[at], return_index=True)[1] if several else np.arange(len(at))
                if len(first) >= k or wanted >= len(own):
                    break
                wanted *= 2
            at = at[np.sort(first)[:k]]
            rows.append(np.full(len(at), a + i))
            found.append(flat[at])
            scores.append(np.sqrt(own[point[at]]))
    return np.concatenate(rows) if rows else np.zeros(0, np.int64), np.concatenate(found) if found else np.zeros(0, np.int64), np.concatenate(scores) if scores else np.zeros(0)


def points(rows: DataFrame, is_query, k: int) -> DataFrame:
    """Different vectors: v, its key (first, h), its k least ids, and whether a row of it asks."""
    ranked = rows.withColumn("at", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("at") <= k)
    ids = ranked.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    asking = rows.filter(is_query).select(F.col("v").alias("w")).distinct()
    return ids.join(asking, ids.v == asking.w, "left").select("v", F.element_at("ids", 1).alias("first"), F.xxhash64("v").alias("h"), "ids", F.col("w").isNotNull().alias("asks"))


def search(vectors: DataFrame, is_query, k: int = FOUND, per_list: int = 256, most_lists: int = 16_384, sample: int = 20_000, most_sample: int = 131_072, copies: int = 3, margin: float = 0.1, per_task: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row that is_query (a column over vec_id) picks."""
    spark = vectors.sparkSession
    rows = stored(usable(vectors).dropDuplicates(["vec_id", "v"]), "vectors")
    found = "query_id bigint, rank int, vec_id bigint, score double"
    if rows.select("vec_id").limit(2).count() < 2:
        return spark.createDataFrame([], found)
    held = stored(points(rows, is_query, k + 1), "points")
    n = held.count()
    sample = max(sample, min(8 * (n // per_list), most_sample))
    share = F.shiftrightunsigned("h", 11).cast("double") / float(1 << 53) < sample / n
    picked = held.filter(share | F.lit(n <= sample)).select("h", "v").toArrow().sort_by("h")["v"].combine_chunks()
    if not len(picked):
        picked = held.limit(1).select("v").toArrow()["v"].combine_chunks()
    index = build(_matrix(picked), max(1, min(n // per_list, most_lists, len(picked) // 8)), copies, margin)
    shared = spark.sparkContext.broadcast(index)

    def deal(home: bool, names: list[str]):
        def run(batches):
            for whole in batches:
                for at in range(0, whole.num_rows, 1024):
                    batch = whole.slice(at, 1024)
                    x = _matrix(batch.column("v")).astype(np.float32)
                    row, own = shared.value.home(x, copies, margin) if home else shared.value.lists(x)
                    took = batch.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), *(took.column(c) for c in names)], names=["list", *names])

        return run

    key = "first bigint, h bigint, v array<double>"
    homes = stored(held.select("first", "h", "v", "ids").mapInArrow(deal(True, ["first", "h", "v", "ids"]), f"list int, {key}, ids array<bigint>"), "postings")
    asked = stored(held.filter("asks").select("first", "h", "v").mapInArrow(deal(False, ["first", "h", "v"]), f"list int, {key}"), "asked")
    # a row per list: at most `most_lists`
    sizes = lambda df, name: df.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / per_task).cast("int").alias(name))
    salts = F.broadcast(sizes(homes, "held_salts").join(sizes(asked, "asked_salts"), "list"))

    def salted(df: DataFrame, own: str, other: str, names: list[str]) -> DataFrame:
        """Each row under a salt of its own side and all salts of the other."""
        mine = F.pmod(F.xxhash64("first", "h"), F.col(f"{own}_salts")).cast("int")
        return df.join(salts, "list").select("list", mine.alias(own), F.explode(F.sequence(F.lit(0), F.col(f"{other}_salts") - 1)).alias(other), *names)

    def meet(key, queries: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(own):
            return pd.DataFrame({"first": [], "h": [], "vec_id": [], "score": []})
        at, ids, score = nearest(np.stack(queries["v"].to_numpy()), np.stack(own["v"].to_numpy()), [np.asarray(i, np.int64) for i in own["ids"]], k + 1)
        return pd.DataFrame({"first": queries["first"].to_numpy()[at], "h": queries["h"].to_numpy()[at], "vec_id": ids, "score": score})

    by = ["list", "held", "asked"]
    pairs = salted(asked, "asked", "held", ["first", "h", "v"]).groupBy(*by).cogroup(salted(homes, "held", "asked", ["first", "h", "v", "ids"]).groupBy(*by))
    once = pairs.applyInPandas(meet, "first bigint, h bigint, vec_id bigint, score double").groupBy("first", "h", "vec_id").agg(F.min("score").alias("score"))
    best = once.withColumn("at", F.row_number().over(Window.partitionBy("first", "h").orderBy("score", "vec_id"))).filter(F.col("at") <= k + 1)
    listed = stored(best.groupBy(F.col("first").alias("its"), F.col("h").alias("its_h")).agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("near")), "nearest")
    # the rows that ask get their vector's list, without themselves
    firsts = held.filter("asks").select(F.col("v").alias("w"), "first", "h").join(listed, (F.col("first") == F.col("its")) & (F.col("h") == F.col("its_h"))).select("w", "near")
    asking = rows.filter(is_query).select(F.col("vec_id").alias("query_id"), "v")
    theirs = asking.join(firsts, F.col("v") == F.col("w")).select("query_id", F.explode("near").alias("x")).select("query_id", "x.vec_id", "x.score").filter("vec_id <> query_id")
    least = theirs.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = least.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    return search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
