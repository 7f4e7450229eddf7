"""Phrase collocations against plain counting, also with so few buckets that the filters keep nearly everything."""

import random
import re
from collections import Counter, defaultdict

import pytest

from episodica.llm import collocations

RNG = random.Random(5)


def brute(rows, least, longest=4, inside=80, top=2000):
    words, counts = Counter(), defaultdict(Counter)
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            own = re.findall("[^\x20\x09]+", piece)
            words[lang] += len(own)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(own[i : i + k]) for i in range(len(own) - k + 1))
    out = []
    for lang, f in counts.items():
        found, around = {}, Counter()
        for phrase, a in f.items():
            if len(phrase) < 2 or a < least:
                continue
            cuts = [(2_000_000 * a // (f[phrase[:k]] + f[phrase[k:]]), k, f[phrase[:k]], f[phrase[k:]]) for k in range(1, len(phrase))]
            found[phrase] = (a, *min(cuts))
            for m in range(2, len(phrase)):
                for i in range(len(phrase) - m + 1):
                    around[phrase[i : i + m]] = max(around[phrase[i : i + m]], a)
        left = [(-score, -a, " ".join(p).encode(), left, right) for p, (a, score, _, left, right) in found.items() if 100 * around[p] < inside * a or not around[p]]
        out += [(lang, k, p.decode(), -a, l, r, words[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(left)[:top], 1)]
    return sorted(out)


def sample():
    stems = ["kal", "Mor", "tun", "öst", "ßar", "vek", "sil"]
    rows = [(" ".join(RNG.choices(stems, k=RNG.randint(0, 40))), RNG.choice(["aa", "bb", None])) for _ in range(120)]
    rows += [("the fixed phrase stands here, and \t again; the fixed phrase", "aa")] * 40
    rows += [(None, "aa"), ("", None), ("!!.,\n", "aa"), ("one", "cc"), ("kal kal kal kal kal kal", "und"), ("a\x0bb c\x0cb", "bb"), ("x " * 5000, "aa"), ("İ É É É", "bb")]
    return rows


def run(spark, rows, **how):
    docs = spark.createDataFrame([(t, lang, "x", 1) for t, lang in rows], "text string, lang string, phrase string, n int")
    return sorted(map(tuple, collocations.collocations(docs.repartition(3), **how).collect()))


@pytest.mark.parametrize("buckets,least", [(1 << 12, 10), (8, 10), (1 << 12, 200)])
def test_equal_to_plain_counting(spark, buckets, least):
    rows = sample()
    assert run(spark, rows, least=least, buckets=buckets) == brute(rows, least) != []


def test_first_ranks_only(spark):
    rows = sample()
    assert run(spark, rows, least=5, buckets=64, top=7) == brute(rows, 5, top=7)


def test_long_texts_are_cut_where_a_piece_ends(spark, monkeypatch):
    rows = sample()
    batches = [collocations.pa.RecordBatch.from_pydict({"text": [t for t, _ in rows], "lang": [x for _, x in rows]})]
    monkeypatch.setattr(collocations, "STEP", 50)
    small = list(collocations._steps(iter(batches)))
    assert len(small) > 20 and sum(len(raw) for raw, _, _ in small) == sum(len((t or "").encode()) for t, _ in rows)
    total = Counter()
    for step in small:
        texts = collocations.Texts(*step)
        got = texts.counted(collocations.np.flatnonzero(texts.phrases(2)), 2)
        total.update({(x, p): n for x, p, n in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), got.column(2).to_pylist())})
    whole = collocations.Texts(*next(iter(collocations._steps(iter(batches)))))
    assert total and sum(total.values()) >= len(collocations.np.flatnonzero(whole.phrases(2)))


def test_no_rows(spark):
    docs = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(docs, buckets=64).collect() == []
    with pytest.raises(ValueError):
        collocations.frequent_phrases(docs, buckets=100)
