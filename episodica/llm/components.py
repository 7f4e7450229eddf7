"""Connected components of an edge table, on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def connected_components(edges: DataFrame, tag: str, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges(a, b); root is the smallest node reachable.

    Each round hangs every node under the smallest label around it and then under that label's own label
    (pointer jumping), so labels travel in about log(diameter) rounds. Minima are taken with partial
    aggregation, so a node with very many edges sends one row per task. Each round is written to the shared
    folder. Stops when a round changes nothing.
    """
    links = stored(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).filter("a <> b").distinct(), f"{tag}-links")
    labels = stored(links.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("root")), f"{tag}-0")
    for k in range(1, rounds + 1):
        near = links.join(labels, links.b == labels.node).groupBy(F.col("a").alias("at")).agg(F.min("root").alias("around"))
        pulled = labels.join(near, labels.node == near["at"], "left").select("node", "root", F.least("root", F.coalesce("around", "root")).alias("next"))
        # the old root is told of the smaller label too, so whole trees move at once
        told = pulled.filter("next < root").groupBy(F.col("root").alias("told")).agg(F.min("next").alias("by"))
        hung = pulled.join(told, F.col("node") == F.col("told"), "left").select("node", "root", F.least("next", F.coalesce("by", "next")).alias("next"))
        hung = stored(hung, f"{tag}-{k}a")
        up = hung.select(F.col("node").alias("up"), F.col("next").alias("top"))
        jumped = stored(hung.join(up, hung["next"] == up["up"]).select("node", F.col("top").alias("root"), (F.col("top") != hung["root"]).alias("moved")), f"{tag}-{k}b")
        labels = jumped.select("node", "root")
        if jumped.filter("moved").isEmpty():
            return labels
    raise RuntimeError(f"labels still move after {rounds} rounds")
