import hashlib
import random

import numpy as np

from episodica.llm import suffix_array as sa
from episodica.llm import substring_dedup as sd


def test_suffix_array_and_common_prefixes_match_sorting():
    rng = np.random.default_rng(0)
    for _ in range(400):
        n, a = int(rng.integers(1, 60)), int(rng.integers(1, 5))
        t = np.append(rng.integers(1, a + 1, n), 0)
        order, plain = sa.suffix_array(t, a + 1), t.tolist()
        assert order.tolist() == sorted(range(n + 1), key=lambda i: plain[i:])
        prefix = sa.common_prefixes(t, order, 7)
        for x, y in zip(order[:-1], order[1:]):
            k = 0
            while max(x, y) + k < len(plain) and plain[x + k] == plain[y + k]:
                k += 1
            assert prefix[y] == min(k, 7)


def brute(docs, width):
    first = {}
    for i, t in docs:
        raw = (t or "").encode()
        for k in range(len(raw) - width + 1):
            if i is not None:
                w = raw[k : k + width]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in docs:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for k in range(len(raw) - width + 1):
            if i is not None and first[raw[k : k + width]] < i:
                gone[k : k + width] = True
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((i, len(raw), int(gone.sum()), int((gone[:-1] & ~np.concatenate(([False], gone[:-2]))).sum()) if len(raw) else 0, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def sample():
    rng = random.Random(2)
    prose = lambda n: "".join(rng.choices("abcdé fgh", k=n))
    passages = [prose(rng.randint(45, 200)) for _ in range(6)]
    docs = [(None, passages[0]), (1, None), (2, ""), (3, "short"), (4, "ab" * 300), (5, "x" + "ab" * 200), (6, "é" * 90), (7, "éé" + "é" * 60)]
    for k in range(8, 60):
        docs.append((k, "".join(prose(rng.randint(0, 80)) + rng.choice(passages)[rng.randint(0, 20) :] for _ in range(rng.randint(1, 4)))))
    docs += [(60, docs[20][1]), (60, docs[20][1]), (5, docs[21][1]), (61, docs[4][1])]
    return docs


def test_matches_brute_force(spark):
    docs = sample()
    table = spark.createDataFrame([(i, t, "z", 1, 2) for i, t in docs], "doc_id long, text string, th string, start int, m int")
    expected = brute(docs, sd.WIDTH)
    for crowd in (sd.CROWD, 3):
        assert sorted(map(tuple, sd.digest(table, crowd=crowd).collect()), key=str) == expected


def test_small_shards_give_the_same(spark, monkeypatch):
    docs = sample()
    rows = []
    for i, t in docs[8:40]:
        raw = t.encode()
        row, at, n, key = sd.window_runs(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        rows += [(int(k), i, 0, int(a), raw[a : a + c + 49]) for a, c, k in zip(at, n, key)]
    import pyarrow as pa

    rows.sort(key=lambda r: r[0])
    schema = pa.schema([("m", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int64()), ("at", pa.int32()), ("content", pa.binary())])
    batches = [pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[k : k + 7]), schema)], schema=schema) for k in range(0, len(rows), 7)]
    found = []
    for shard in (sd.SHARD, 300):
        monkeypatch.setattr(sd, "SHARD", shard)
        found.append(sorted(r for b in sd._shards(iter(batches), 50) for r in zip(*b.to_pydict().values())))
    assert found[0] == found[1] and found[0]


def test_remove_repeats_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "é" * 60, 60, "a"), (2, "xé" + "é" * 40, 42, "b"), (3, "y" + "é" * 30, 31, None)], "doc_id long, text string, n_chars long, lang string")
    got = {r.doc_id: r for r in sd.remove_repeats(docs).collect()}
    assert got[2].text == "x" and got[2].n_chars == 1 and got[1].text == "é" * 60
    assert sd.remove_repeats(docs.limit(0)).isEmpty()


def test_equal_windows_agree_in_a_side():
    rng = random.Random(5)
    texts = [b"ab" * 60, b"a" * 90]
    passages = ["".join(rng.choices("abc", k=rng.randint(50, 90))) for _ in range(8)]
    for _ in range(60):
        texts.append("".join("".join(rng.choices("abc", k=rng.randint(0, 60))) + rng.choice(passages) for _ in range(3)).encode())
    raw, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    eight = sd._eights(raw)
    hashes = sd.gram_hashes(eight, len(raw) - 15)
    keys = sd.least_hashes(hashes)
    row, at, n, key = sd.window_runs(raw, offsets)
    left, right = sd.run_sides(eight, hashes, keys, at + offsets[row], n)
    assert (left > 0).any() and (right > 0).any() and ((left == 0) & (right == 0)).any()
    runs = {}
    for i, (r, a, c) in enumerate(zip(row, at, n)):
        for k in range(a, a + c):
            runs.setdefault(texts[r][k : k + 50], set()).add(i)
    pairs = {(x, y) for same in runs.values() for x in same for y in same if row[x] < row[y]}
    assert len(pairs) > 100
    for x, y in pairs:
        wild = not (left[x] or right[x]) or not (left[y] or right[y])
        assert key[x] == key[y] and (wild or 0 < left[x] == left[y] or 0 < right[x] == right[y])


def test_phrases_too_short_to_go_move_no_bytes(spark, tmp_path, monkeypatch):
    rng = random.Random(6)
    prose = lambda n: "".join(rng.choices("abcdefgh", k=n))
    phrases, passage = [prose(24) for _ in range(5)], prose(70)
    docs = [(i, "".join(prose(60) + rng.choice(phrases) for _ in range(6))) for i in range(40)] + [(50, prose(30) + passage + prose(30)), (51, passage + prose(40))]
    monkeypatch.setattr(sd, "stored", lambda df, tag, f=sd.stored: met.setdefault(tag, f(df, tag)))
    met = {}
    got = {r.doc_id: r.n_removed for r in sd.digest(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {i: n for i, n in got.items() if n} == {51: 70}
    moved = met["runs"].filter("not copy").groupBy("doc_id").count().collect()
    assert {r.doc_id for r in moved} <= {50, 51} and len(moved)
