import re

import numpy as np
import xxhash
from pyspark.sql import Row
from pyspark.sql import functions as F

from episodica.llm import simhash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def brute_components(ids, fps):
    near = {i: [j for j in range(len(fps)) if bin(fps[i] ^ fps[j]).count("1") <= 3] for i in range(len(fps))}
    out = [None] * len(fps)
    for i in range(len(fps)):
        if out[i] is None:
            seen, todo = {i}, [i]
            while todo:
                for j in near[todo.pop()]:
                    if j not in seen:
                        seen.add(j)
                        todo.append(j)
            known = [ids[j] for j in seen if ids[j] is not None]
            for j in seen:
                out[j] = min(known, default=None)
    return out


def test_masks_cover_every_pair_within_the_radius():
    rng = np.random.default_rng(1)
    for bits in (list(range(64)), list(range(5, 35)), list(range(14))):
        kept = simhash.masks(bits)
        for _ in range(500):
            flips = sum(1 << int(b) for b in rng.choice(bits, 3, replace=False))
            assert any(m & flips == 0 for m in kept)


def test_fingerprint_matches_brute_force():
    for text in (None, "", "  ", "a", "A b", "One two THREE four", "é ü x\x0by \t z É", "w " * 70_001):
        assert simhash.fingerprint(text) == (brute_fingerprint(text) if text is None or len(text) < 9999 else simhash.fingerprint("w w w"))


def test_components_match_brute_force(spark):
    rng = np.random.default_rng(7)
    words = [f"w{k}" for k in range(50)]
    texts = [None, "", "   ", "one", "one", "one two"]
    for _ in range(30):
        base = list(rng.choice(words, 120))
        for _ in range(rng.integers(1, 5)):
            texts.append(" ".join(base))
            base[int(rng.integers(120))] = "changed"
    ids = [None if k == 3 else k for k in range(len(texts))]
    docs = spark.createDataFrame([Row(doc_id=i, text=t, fp="x", component_id=1, node="y") for i, t in zip(ids, texts)], "doc_id long, text string, fp string, component_id int, node string")
    got = simhash.near_duplicates(docs.union(docs.filter("doc_id = 9"))).collect()
    fps = [brute_fingerprint(t) for t in texts]
    expected = sorted(zip(map(str, ids), fps, map(str, brute_components(ids, fps))))
    expected = sorted(expected + [x for x in expected if x[0] == "9"])
    assert sorted((str(r.doc_id), r.fp % (1 << 64), str(r.component_id)) for r in got) == expected


def test_split_buckets_lose_no_link(spark):
    rng = np.random.default_rng(3)
    base, values = int(rng.integers(1 << 62)), set()
    while len(values) < 400:
        v = base
        for b in rng.choice(64, int(rng.integers(0, 6)), replace=False):
            v ^= 1 << int(b)
        values.add(v if v < 1 << 63 else v - (1 << 64))
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    from episodica.llm.components import connected_components

    roots = {}
    for split in (5, 4096):
        roots[split] = sorted(map(tuple, connected_components(simhash.near_links(fps, split=split), "t").collect()))
    assert roots[5] == roots[4096]
    signed = [v % (1 << 64) for v in values]
    brute = brute_components(sorted(values), [v % (1 << 64) for v in sorted(values)])
    linked = {v: c for v, c in zip(sorted(values), brute) if sum(c == d for d in brute) > 1}
    assert dict(roots[5]) == linked and signed


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).agg(F.count("*")).first()[0] == 0
