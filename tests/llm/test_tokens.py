import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from episodica.llm import packing, token_store, tokens
from episodica.llm.common import new_folder

ODD = [None, "", " \n", "a <|endoftext|>b", "İstanbul x", "don't, 'sable x'. a$., !? A.B. ß É é a\xa0b\x85c\x1cd it's, ok. 12.5, ²³.", "ΣΑΣ. ΟΔΟΣ, x", "日本語 テスト。", "^ a^b ^^", "word, " * 3000]


def ids_of(encoder, text):
    return encoder.tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def split(encoder, texts):
    ids, offsets = encoder.encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])]


def test_chunks_give_the_ids_of_whole_texts():
    rng = random.Random(1)
    letters = list("aAéÉzZ09.,;!?'\"_- \n\t$%<|sStTmdlrve^") + ["\xa0", "ß", "İ", "ſ", "́", "Σ", "²", "\x1f", " "]
    texts = ODD + ["".join(rng.choices(letters, k=rng.randint(1, 40))) for _ in range(3000)]
    encoder = tokens.Encoder(tokens.vocabulary_path(), cache=500)
    for _ in range(2):
        assert split(encoder, texts) == [ids_of(encoder, t) for t in texts]
    assert encoder.encode(pa.array([], pa.string()))[1].tolist() == [0]


def documents(spark):
    rows = [(k, t, 1, "x") for k, t in enumerate(ODD)] + [(None, "no id", 0, ""), (2, "again", 0, ""), (2, "again", 0, "")]
    return spark.createDataFrame(rows, "doc_id long, text string, piece int, path string")


def test_store_round_trip(spark):
    docs, folder = documents(spark), new_folder(spark, "tokens")
    token_store.encode_documents(docs, folder, shard_bytes=200)
    encoder = tokens.Encoder(tokens.vocabulary_path())
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    got = sorted(token_store.read_documents(spark, folder, with_ids=True).collect(), key=lambda r: r.start)
    start = 0
    assert [r.doc_id for r in got] == [i for i, _ in rows]
    for r, (_, text) in zip(got, rows):
        ids = ids_of(encoder, text)
        assert (r.start, r.n_tokens, r.ids, r.ids_crc32) == (start, len(ids), ids, zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    store, place = pafs.FileSystem.from_uri(folder)
    names = [f.path for f in store.get_file_info(pafs.FileSelector(place)) if f.path.endswith(".tok")]
    assert len(names) > 3
    (held,) = [f.path for f in store.get_file_info(pafs.FileSelector(place)) if f.path.endswith(".zdict")]
    reader = token_store.ShardReader(store.open_input_file(names[0]), store.open_input_stream(held).read())
    assert reader.document(len(reader) - 1).tolist() == list(reader.scan())[-1][1].tolist()
    with pytest.raises(ValueError, match="dictionary"):
        token_store.ShardReader(store.open_input_file(names[0]), b"another")
    empty = new_folder(spark, "none")
    token_store.encode_documents(docs.limit(0), empty)
    assert token_store.read_documents(spark, empty).isEmpty()


def check_plan(counts, capacity):
    patterns = packing.plan(counts, capacity)
    used: dict = {}
    for pattern, times in patterns:
        assert sum(pattern) <= capacity and times > 0
        for x in pattern:
            used[x] = used.get(x, 0) + times
    assert used == {k: v for k, v in counts.items() if v}
    return sum(times for _, times in patterns)


def best_fit_decreasing(counts, capacity):
    gaps: list = []
    for x in sorted((k for k, v in counts.items() for _ in range(v)), reverse=True):
        fits = [g for g in range(len(gaps)) if gaps[g] >= x]
        if fits:
            gaps[min(fits, key=lambda g: gaps[g])] -= x
        else:
            gaps.append(capacity - x)
    return len(gaps)


def test_plan_is_whole_and_tight():
    rng = random.Random(6)
    for _ in range(60):
        capacity = rng.choice([10, 37, 100])
        counts = {rng.randint(1, capacity): rng.randint(1, 9) for _ in range(rng.randint(1, 15))}
        assert check_plan(counts, capacity) <= best_fit_decreasing(counts, capacity) + 1
    assert check_plan({10: 4095 * 10**9}, 4096) and check_plan({}, 4096) == 0 and check_plan({4096: 7, 1: 1}, 4096) == 8


def test_packing(spark):
    docs = documents(spark).union(spark.createDataFrame([(50, "long words here, " * 4000, 0, "")], "doc_id long, text string, piece int, path string"))
    got = packing.pack_documents(docs).collect()
    encoder = tokens.Encoder(tokens.vocabulary_path())
    want = sorted((str(r.doc_id), k, s, len(ids[s : s + 4096]), zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes())) for r in docs.collect() for ids in [ids_of(encoder, r.text)] for k, s in enumerate(range(0, len(ids), 4096)))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by: dict = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by) == -(-sum(r.length for r in got) // 4096)
    assert packing.pack_documents(docs.limit(0)).isEmpty()
    pieces = packing.token_pieces(docs, tokens.vocabulary_path(), with_ids=True)
    assert pieces.filter(F.size("ids") != F.col("length")).isEmpty()
