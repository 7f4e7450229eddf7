"""Statistics and training of the quality classifier against plain recomputations."""

import math
import random

import numpy as np
import pyarrow as pa

from episodica.llm import quality


def plain(text):
    raw, words = (text or "").encode(), (text or "").split()
    size = len(raw)
    share = lambda own: sum(b in own for b in raw) / max(1, size)
    ascii_words = raw.split()
    n = len(ascii_words)
    odd = set(quality.CLASSES["mark"] + quality.CLASSES["call"])
    runs = sum(b in odd and (k == 0 or raw[k - 1] not in odd) for k, b in enumerate(raw))
    lines = (text or "").split("\n")
    top = max((words.count(w) for w in words), default=0)
    rest = [len(set(words)) / len(words), top / len(words), len(set(zip(words, words[1:]))) / max(1, len(words) - 1), len(set(lines)) / len(lines), max(map(len, words))] if words else [0] * 5
    return [
        math.log1p(size), math.log1p(n), math.log1p(raw.count(b"\n")), *(share(own) for own in quality.CLASSES.values()), sum(b >= 128 for b in raw) / max(1, size), (size - sum(b in quality.CLASSES["space"] for b in raw)) / max(1, n),
        sum(w[0] in quality.CLASSES["upper"] for w in ascii_words) / max(1, n), runs / max(1, n), sum(b in quality.CLASSES["stop"] for b in raw) / max(1, n), *rest[:4], math.log1p(rest[4]),
    ]


def test_statistics_match_a_plain_count():
    rng = random.Random(2)
    texts = [None, "", " ", "\n", "A", "!!a!! b#c"] + ["".join(rng.choices("abC dé\n\t.,!#19(", k=rng.randint(1, 300))) for _ in range(200)]
    got = np.concatenate([quality.statistics(pa.array([t], pa.string())) for t in texts])
    assert np.allclose(got, [plain(t) for t in texts])
    assert np.array_equal(quality.statistics(pa.array(texts, pa.string())), got)


def test_first_split_has_the_best_gain():
    rng = np.random.default_rng(4)
    for seed in range(5):
        x = rng.integers(0, 12, size=(300, 4)).astype(float)
        y = ((x[:, seed % 4] > 6) ^ (rng.random(300) < 0.15)).astype(float)
        trees = quality.boost(x, y, rounds=1, depth=1)
        p = y.mean()
        g, h = y - p, np.full(300, p * (1 - p))
        gain = lambda left: g[left].sum() ** 2 / (h[left].sum() + 1) + g[~left].sum() ** 2 / (h[~left].sum() + 1) - g.sum() ** 2 / (h.sum() + 1)
        best = max(((gain(x[:, f] <= c), f, c) for f in range(4) for c in range(12) if h[x[:, f] <= c].sum() >= 2 and h[x[:, f] > c].sum() >= 2), key=lambda t: t[0])
        left = x[:, trees.feature[0, 0]] <= trees.threshold[0, 0]
        assert np.isclose(gain(left), best[0])
        values = [0.15 * g[side].sum() / (h[side].sum() + 1) for side in (left, ~left)]
        assert np.allclose(trees.leaf[0], values)
