"""Operator 5, quality classification by histogram gradient-boosted trees.

Statistics of a whole text (shares of character classes, word and line shapes, repetition) feed boosted
trees, fitted on histograms of binned features on the driver and flattened into arrays, so that scoring is
one vectorised numpy traversal of all trees for a batch.

The trees are fitted on at most ``sample`` labelled rows (a parameter); only their statistics reach the
driver. Every document is scored over its whole text.

Defined results: null text scores as an empty one; without labelled rows of both classes the score is the
share of label 1 (0.5 with no rows); repeated rows each get their own (equal) result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, labelled_sample, read_table, row_sums, slices, text_bytes

THRESHOLD = 0.3
CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "space": b" \t\n\r\x0b\x0c", "stop": b".,;:", "call": b"!?", "mark": b"#$%&*@^~|\\_=+<>", "quote": b"\"'`()[]{}/-"}
MEMBER = {k: np.isin(np.arange(256), list(v)) for k, v in CLASSES.items()} | {"high": np.arange(256) >= 128, "newline": np.arange(256) == 10}
NAMES = ["log_bytes", "log_words", "log_lines", *(f"share_{k}" for k in CLASSES), "share_high", "word_bytes", "upper_words", "marked_words", "stop_per_word", "distinct_words", "top_word", "distinct_pairs", "distinct_lines", "longest_word"]


def statistics(column: pa.Array) -> np.ndarray:
    """One row of NAMES for each text."""
    raw, offsets = text_bytes(column)
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    per = np.maximum(size, 1)
    counts = {k: row_sums(m[raw], offsets) for k, m in MEMBER.items()}
    space = MEMBER["space"][raw]
    first = ~space
    first[1:] &= space[:-1]
    first[offsets[:-1][size > 0]] = ~space[offsets[:-1][size > 0]]
    words = row_sums(first, offsets)
    upper = row_sums(first & MEMBER["upper"][raw], offsets)
    odd = (MEMBER["mark"] | MEMBER["call"])[raw]
    marked = odd.copy()
    marked[1:] &= ~odd[:-1]
    marked[offsets[:-1][size > 0]] = odd[offsets[:-1][size > 0]]  # a run ends with its text
    per_word = np.maximum(words, 1)
    rest = np.zeros((n, 5))
    for i, text in enumerate(column.to_pylist()):
        own = (text or "").split()
        if own:
            seen = Counter(own)
            lines = text.split("\n")
            rest[i] = len(seen) / len(own), max(seen.values()) / len(own), len(set(zip(own, own[1:]))) / max(1, len(own) - 1), len(set(lines)) / len(lines), max(map(len, seen))
    return np.column_stack(
        [np.log1p(size), np.log1p(words), np.log1p(counts["newline"]), *(counts[k] / per for k in CLASSES), counts["high"] / per,
         (size - counts["space"]) / per_word, upper / per_word, row_sums(marked, offsets) / per_word, counts["stop"] / per_word, rest[:, 0], rest[:, 1], rest[:, 2], rest[:, 3], np.log1p(rest[:, 4])]
    )


@dataclass
class Trees:
    """Complete trees of one depth, in heap order: feature and threshold of inner nodes, values of leaves."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        if len(self.feature) and len(x):
            tree = np.arange(len(self.feature))
            at = np.zeros((len(x), len(tree)), np.int64)
            for _ in range(int(np.log2(self.leaf.shape[1]))):
                right = np.take_along_axis(x, self.feature[tree, at], axis=1) > self.threshold[tree, at]
                at = 2 * at + 1 + right
            total += self.leaf[tree, at - self.feature.shape[1]].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, ridge: float = 1.0, least: float = 2.0) -> Trees:
    """Newton boosting of the logistic loss over binned features."""
    inner, leaves = 2**depth - 1, 2**depth
    rise = float(np.mean(y)) if len(y) else 0.5
    base = float(np.log(np.clip(rise, 1e-4, 1 - 1e-4) / np.clip(1 - rise, 1e-4, 1)))
    if not len(y) or rise in (0.0, 1.0):
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), base)
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.column_stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)])
    edge = np.full((width, bins), np.inf)
    for f, c in enumerate(cuts):
        edge[f, : len(c)] = c
    flat = binned + np.arange(width) * bins
    total = np.full(n, base)
    feature, threshold, leaf = np.zeros((rounds, inner), np.int64), np.full((rounds, inner), np.inf), np.zeros((rounds, leaves))
    for t in range(rounds):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            nodes, first = 2**level, 2**level - 1
            cell = ((at - first)[:, None] * (width * bins) + flat).ravel()
            shape = (nodes, width, bins)
            hist_g = np.bincount(cell, np.repeat(g, width), nodes * width * bins).reshape(shape).cumsum(axis=2)
            hist_h = np.bincount(cell, np.repeat(h, width), nodes * width * bins).reshape(shape).cumsum(axis=2)
            all_g, all_h = hist_g[:, :, -1:], hist_h[:, :, -1:]
            gain = hist_g**2 / (hist_h + ridge) + (all_g - hist_g) ** 2 / (all_h - hist_h + ridge) - all_g**2 / (all_h + ridge)
            gain[(hist_h < least) | (all_h - hist_h < least)] = 0
            best = gain.reshape(nodes, -1).argmax(axis=1)
            for k in range(nodes):
                f, b = divmod(int(best[k]), bins)
                if gain[k, f, b] > 1e-9:
                    feature[t, first + k], threshold[t, first + k] = f, edge[f, b]
            at = 2 * at + 1 + (x[np.arange(n), feature[t, at]] > threshold[t, at])
        slot = at - inner
        leaf[t] = rate * np.bincount(slot, g, leaves) / (np.bincount(slot, h, leaves) + ridge)
        total += leaf[t, slot]
    return Trees(feature, threshold, leaf, base)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, rest: int = 0, sample: int = 20_000) -> Trees:
    rows = labelled_sample(docs, labels, label, folds, rest, sample)

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                x = statistics(batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(list(x), pa.list_(pa.float64()))], names=["label", "x"])

    found = rows.select("text", "label").mapInArrow(run, "label int, x array<double>").toArrow()
    y = np.array(found["label"].to_pylist(), float)
    x = np.array(found["x"].to_pylist(), float).reshape(len(y), len(NAMES))
    order = np.lexsort((*x.T, y))  # rows arrive in any order
    return boost(x[order], y[order])


def score_quality(docs: DataFrame, trees: Trees) -> DataFrame:
    """doc_id and the score of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                score = shared.value.score(statistics(batch.column("text")))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def op5_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    scored = score_quality(docs, train(docs, labels))
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
