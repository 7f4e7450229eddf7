import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from episodica.llm import language_id, quality, toxicity


def crc(i):
    return zlib.crc32(str(i).encode())


RNG = random.Random(0)
STEMS = {"aa": ["kal", "mor", "tun", "sil", "vek"], "bb": ["öst", "ügr", "äln", "ßar", "wöh"], "cc": ["qui", "que", "eau", "oux", "ais"]}


def prose(lang, n):
    return " ".join("".join(RNG.choices(STEMS[lang], k=RNG.randint(1, 3))) for _ in range(n))


def test_language(spark):
    rows = [(k, prose(lang, RNG.randint(3, 60)), lang, lang, k) for k, lang in enumerate(RNG.choices(list(STEMS), k=300))]
    rows += [(1000, None, "aa", "", 0), (1001, "", "aa", "", 0), (1002, "12 34 !!", "bb", "", 0), (1003, "x", None, "", 0), (None, prose("bb", 30), "bb", "", 0), (7, rows[7][1], rows[7][2], "", 0), (1004, prose("cc", 40_000), "cc", "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score long")
    model = language_id.train(docs)
    assert model.names == ["aa", "bb", "cc"]
    got = language_id.identify(docs.drop("lang_pred", "score"), model, ["doc_id", "lang", "text"]).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[k].lang_pred for k in (1000, 1001, 1002)] == ["und"] * 3 and all(by[k].rejected and by[k].score == 0 for k in (1000, 1001, 1002))
    assert by[1004].lang_pred == "cc" and by[None].lang_pred == "bb" and by[1003].lang_pred in model.names
    held = [r for r in got if r.doc_id is not None and r.doc_id < 1000 and crc(r.doc_id) % 5 == 0]
    assert held and np.mean([r.lang_pred == r.lang for r in held]) > 0.97 and not any(r.rejected for r in held) and all(0 <= r.score <= 1 for r in got)
    none = language_id.train(docs.limit(0))
    assert {r.lang_pred for r in language_id.identify(docs, none, ["doc_id"]).collect()} == {"und"}
    assert language_id.identify(docs.limit(0), model, ["doc_id"]).isEmpty()


def test_trees_match_a_plain_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    y = ((x[:, 0] > 0) & (x[:, 3] < 0.5)).astype(float)
    trees = quality.boost(x, y, rounds=20, depth=3)

    def walk(row):
        total = trees.base
        for f, t, leaf in zip(trees.feature, trees.threshold, trees.leaf):
            at = 0
            while at < len(f):
                at = 2 * at + 1 + (row[f[at]] > t[at])
            total += leaf[at - len(f)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(trees.score(x), [walk(r) for r in x]) and ((trees.score(x) > 0.5) == y).mean() > 0.98
    assert np.allclose(quality.boost(x, np.ones(400)).score(x), 1, atol=1e-3) and np.allclose(quality.boost(x[:0], y[:0]).score(x), 0.5)


def test_statistics_of_odd_texts():
    texts = [None, "", " ", "\n\n", "A", "é" * 9, "word " * 50_000, "a b\na b"]
    x = quality.statistics(pa.array(texts, pa.string()))
    assert x.shape == (len(texts), len(quality.NAMES)) and np.isfinite(x).all() and (x[0] == x[1]).all()
    one = np.concatenate([quality.statistics(pa.array([t], pa.string())) for t in texts])
    assert np.allclose(x, one)


@pytest.mark.parametrize("module,label,folds,rest", [(quality, "quality", 5, 0), (toxicity, "toxic", 4, 2)])
def test_labelled(spark, module, label, folds, rest):
    def text(bad):
        words = prose("aa", RNG.randint(30, 80)).split()
        if label == "quality":
            return " ".join(w.upper() + "!!" if bad else w for w in words)
        return " ".join(w if not bad or RNG.random() > 0.1 else RNG.choice(["grobian", "zyxwort"]) for w in words)

    rows, labels = [], []
    for k in range(500):
        bad = k % 3 == 0
        rows.append((k, text(bad), 1, label))
        labels.append((k, int(bad) if label == "toxic" else int(not bad), None))
    rows += [(900, None, 0, ""), (901, "", 0, ""), (None, "kal mor", 0, ""), (3, rows[3][1], 0, ""), (902, "kal " * 60_000, 0, "")]
    labels += [(901, None, None), (None, 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int, label string")
    held = spark.createDataFrame(labels, f"doc_id long, {label} int, text string")
    train, score = (module.train, module.score_quality) if label == "quality" else (module.train, module.score_toxicity)
    model = train(docs, held, label)
    got = {r.doc_id: r.score for r in score(docs, model).collect()}
    assert len(got) == len(rows) - 1 and all(0 <= s <= 1 for s in got.values()) and got[900] == got[901]
    truth = {i: y for i, y, _ in labels if i is not None and y is not None and crc(i) % folds == rest}
    assert np.mean([(got[i] >= module.THRESHOLD) == bool(y) for i, y in truth.items()]) > 0.95
    empty = train(docs, held.limit(0), label)
    assert {r.score for r in score(docs, empty).collect()} == {0.5}
    assert score(docs.limit(0), model).isEmpty()
