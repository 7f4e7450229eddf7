"""Every registered query of this subpackage on a folder of small tables with nulls, repeats and clashing columns."""

import random
import zlib

import __spark_entry__
import numpy as np
import pytest
from test_collocations import brute as brute_phrases
from test_simhash import brute_components, brute_fingerprint
from test_substring_dedup import brute as brute_spans
from test_whitening import plain as plain_whitening

from episodica.llm import tokens

RNG = random.Random(11)
STEMS = {"aa": ["kal", "mor", "tun", "sil", "vek"], "bb": ["öst", "ügr", "äln", "ßar", "wöh"]}
#: Names that the operators use themselves, as further columns of the input.
CLASHES = "leaks spans of of_text own own_id own_text its its_h th n m at fp component_id score rejected lang_pred spread salt number base rank first h copy start length".split()


def prose(lang, n):
    return " ".join("".join(RNG.choices(STEMS[lang], k=RNG.randint(1, 3))) for _ in range(n))


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    item = "Which of the given stones is the heaviest of them all?"
    docs, labels = [], []
    for k in range(120):
        lang = RNG.choice(list(STEMS))
        words = prose(lang, RNG.randint(30, 60)).split()
        toxic, good = k % 4 == 0, k % 3 > 0
        words = [RNG.choice(["grobianisch", "zyxwortig"]) if toxic and RNG.random() < 0.15 else w for w in words]
        docs.append((k, " ".join(w if good else w.upper() + "!!" for w in words), lang))
        labels.append((k, int(good), int(toxic)))
    docs += [(200, docs[5][1], "aa"), (201, prose("aa", 20) + " " + item + " " + prose("aa", 20), "aa"), (202, None, "aa"), (203, "", None), (204, "123 !!", "bb"), (205, prose("aa", 9000), "aa")]
    docs += [(206, prose("bb", 25), "bb")] * 300
    clash = [f"{c} string" for c in CLASHES]
    table = spark.createDataFrame([(i, t, lang, "s", len(t or ""), *["x"] * len(CLASHES)) for i, t, lang in docs], ", ".join(["doc_id long, text string, lang string, source string, n_chars long", *clash]))
    table.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(*r, "x") for r in labels] + [(None, 1, 1, "x"), (3, None, None, "x")], "doc_id long, quality int, toxic int, text string").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item, 0), (2, None, 0), (3, "zz top", 0)], "item_id long, text string, doc_id int").write.parquet(f"{folder}/benchmark.parquet")
    hot = [0.5] * 8
    vectors = [(k, np.random.default_rng(k).normal(size=8).tolist()) for k in range(400)] + [(400 + k, hot) for k in range(300)]
    spark.createDataFrame([(*v, "x") for v in vectors], "vec_id long, embedding array<double>, list string").write.parquet(f"{folder}/embeddings.parquet")
    spark.createDataFrame([(1, "u", "<p>a<table><tr><td>b<td>c</table>", "x"), (2, None, None, "x")], "page_id long, url string, html string, text string").write.parquet(f"{folder}/pages.parquet")
    return folder, docs, labels, vectors


def ran(spark, tables, name):
    found = __spark_entry__.queries()[name](spark, tables[0])
    return found.columns, found.collect()


def test_all_thirteen_and_the_pipeline_are_registered():
    names = set(__spark_entry__.queries())
    assert {f"op{n}" for n in range(1, 14)} == {x.split("_")[0] for x in names if x.startswith("op") and x[2].isdigit()} and "pipeline" in names


def test_nearest_neighbours(spark, tables):
    _, rows = ran(spark, tables, "op1_nearest_neighbours")
    vectors = tables[3]
    ids, x = np.array([i for i, _ in vectors]), np.array([v for _, v in vectors])
    got, hits = {}, []
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {i for i in range(0, 700, 100)}
    for q, own in got.items():
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(axis=1))
        true = [i for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        hits.append(len({int(ids[i]) for i in true} & {i for _, i, _ in own}) / 10)
        assert [k for k, _, _ in own] == list(range(1, 11)) and all(np.isclose(s, d[ids == i][0]) for _, i, s in own)
        if q >= 400:
            assert [i for _, i, _ in own] == [int(ids[i]) for i in true] and all(s == 0 for *_, s in own)
    assert np.mean(hits) >= 0.9


@pytest.mark.parametrize("name,folds,rest,label", [("op2_toxicity", 4, 2, 2), ("op5_quality", 5, 0, 1)])
def test_scores(spark, tables, name, folds, rest, label):
    columns, rows = ran(spark, tables, name)
    _, docs, labels, _ = tables
    assert {"doc_id", "held_out", "score", "predicted"} <= set(columns) and sorted(r.doc_id for r in rows) == sorted(i for i, _, _ in docs)
    assert all(r.held_out == (crc(r.doc_id, folds) == rest) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[202].score == by[203].score and len({r.score for r in rows if r.doc_id == 206}) == 1
    held = [(by[x[0]].predicted, x[label]) for x in labels if by[x[0]].held_out]
    assert len(held) > 10 and np.mean([a == b for a, b in held]) > 0.85


def test_packing_and_token_store(spark, tables):
    _, docs, _, _ = tables
    encoder = tokens.Encoder(tokens.vocabulary_path())
    ids = lambda t: [*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
    crc_of = lambda own: zlib.crc32(np.array(own, "<u4").tobytes())
    whole = {i: ids(t) for i, t, _ in docs}
    _, pieces = ran(spark, tables, "op3_best_fit_packing")
    expected = sorted((i, k, 4096 * k, len(own[4096 * k : 4096 * (k + 1)]), crc_of(own[4096 * k : 4096 * (k + 1)])) for i, _, _ in docs for own in [whole[i]] for k in range(-(-len(own) // 4096)))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pieces) == expected
    at = {}
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 4096 and len(at) == -(-sum(at.values()) // 4096)
    _, stored = ran(spark, tables, "op10_token_store")
    start = 0
    for r in sorted(stored, key=lambda r: r.start):
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(whole[r.doc_id]), crc_of(whole[r.doc_id]))
        start += r.n_tokens
    order = [r.doc_id for r in sorted(stored, key=lambda r: r.start)]
    assert order == sorted(i for i, _, _ in docs)


def test_pages(spark, tables):
    columns, rows = ran(spark, tables, "op4_html_extraction")
    assert {r.page_id: r.text for r in rows} == {1: "a\n\nb  c", 2: ""} and {"page_id", "url", "text"} == set(columns)


def test_languages(spark, tables):
    _, rows = ran(spark, tables, "op6_language_id")
    _, docs, _, _ = tables
    assert sorted(r.doc_id for r in rows) == sorted(i for i, _, _ in docs) and all(r.held_out == (crc(r.doc_id, 5) == 0) for r in rows)
    by = {r.doc_id: r for r in rows}
    assert {by[k].lang_pred for k in (202, 203, 204)} == {"und"} and np.mean([by[i].lang_pred == lang for i, t, lang in docs[:120]]) > 0.97


def test_leaks(spark, tables):
    _, rows = ran(spark, tables, "op7_benchmark_decontamination")
    assert sorted(map(tuple, rows)) == [(201, 1, 0)]


def test_near_duplicates(spark, tables):
    _, rows = ran(spark, tables, "op8_simhash_near_dedup")
    docs = tables[1]
    marks = [brute_fingerprint(t) for _, t, _ in docs]
    groups = brute_components([i for i, _, _ in docs], marks)
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in rows) == sorted((i, f"{f % (1 << 64):016x}", g) for (i, _, _), f, g in zip(docs, marks, groups))


def test_repeats(spark, tables):
    _, rows = ran(spark, tables, "op9_suffix_array_dedup")
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows), key=str) == brute_spans([(i, t) for i, t, _ in tables[1]], 50)


def test_phrases(spark, tables):
    _, rows = ran(spark, tables, "op11_phrase_collocations")
    assert sorted(map(tuple, rows)) == brute_phrases([(t, lang) for _, t, lang in tables[1]], 30) != []


def test_whitening(spark, tables):
    _, rows = ran(spark, tables, "op12_embedding_whitening")
    n, explained, expected = plain_whitening(tables[3], 8)
    assert len(rows) == 8 * len(tables[3]) and {r.n for r in rows} == {n} and {(r.vec_id, r.deviation) for r in rows} == {(i, x[0][0]) for i, x in expected.items()}
    assert all(np.isclose(abs(r.whitened), abs(expected[r.vec_id][0][1][r.component - 1])) and np.isclose(r.explained, explained[r.component - 1]) for r in rows)


def test_sharding(spark, tables):
    _, rows = ran(spark, tables, "op13_consistent_sharding")
    docs = tables[1]
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in rows) == sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in docs)
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) == set(range(8)) and all(sorted(x) == list(range(len(x))) for x in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_pipeline_with_repeats_and_clashes(spark, tables):
    import corpus_pipeline

    folder, docs = tables[:2]
    found = spark.read.parquet(f"{folder}/documents.parquet")
    columns = found.columns
    for name, stage in corpus_pipeline.STAGES:
        found = corpus_pipeline.stored(stage(spark, found, folder), "test")
        if name != "best-fit packing":
            assert found.columns == columns
        ids = [r.doc_id for r in found.select("doc_id").collect()]
        if name != "language ID" and name != "best-fit packing":
            assert len(ids) == len(set(ids))
    left = {r.doc_id for r in found.collect()}
    assert {202, 203, 204, 200, 201} & left == set() and 206 in left and len(left) > 100


