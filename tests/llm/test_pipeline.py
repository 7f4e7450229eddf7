"""The pipeline against plain versions of its stages on a small corpus."""

import random

import corpus_pipeline
import pyarrow as pa
from test_decontaminate import brute as edit_distance
from test_simhash import brute_components, brute_fingerprint

from episodica.llm import decontaminate, language_id, packing, tokens
from episodica.llm.common import stored


def corpus(spark, folder):
    rng = random.Random(8)
    words = [a + b for a in ("kal", "mor", "tun", "sil", "vek", "dro") for b in ("an", "il", "os", "ut", "er")]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    items = [(k, prose(12)) for k in range(4)]
    passage = prose(14)
    docs = [(k, prose(rng.randint(40, 90))) for k in range(40)]
    docs += [(40 + k, docs[k][1]) for k in range(3)]
    docs += [(43, docs[5][1] + " tail"), (44, prose(30) + " " + items[1][1] + " " + prose(30)), (45, prose(20) + items[2][1][:30] + "x" + items[2][1][31:])]
    docs += [(46 + k, prose(30) + " " + passage + " " + prose(20)) for k in range(3)]
    docs += [(49, None), (50, ""), (51, "1234 !!"), (52, "kalan")]
    table = spark.createDataFrame([(i, t, "aa", f"s{i % 3}", len(t) if t else 0) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    table.coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    return items


def removed(rows, width=50):
    first = {}
    for i, t in rows:
        raw = t.encode()
        for k in range(len(raw) - width + 1):
            first[raw[k : k + width]] = min(first.get(raw[k : k + width], i), i)
    out = []
    for i, t in rows:
        raw = t.encode()
        keep = [True] * len(raw)
        for k in range(len(raw) - width + 1):
            if first[raw[k : k + width]] < i:
                keep[k : k + width] = [False] * width
        out.append((i, bytes(b for b, k in zip(raw, keep) if k).decode(errors="ignore")))
    return out


def test_stages_match_plain_versions(spark, tmp_path):
    folder = str(tmp_path)
    items = corpus(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, folder), "stage")
        kept.append(sorted((r.doc_id, r.text) for r in docs.collect()) if "text" in docs.columns else docs.collect())
        assert docs.columns == columns or name == "best-fit packing"
    start = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect())
    model = language_id.train(spark.read.parquet(f"{folder}/documents.parquet"))
    flags = language_id.predict(model, pa.array([t for _, t in start], pa.string()))[2]
    one = [x for x, gone in zip(start, flags) if not gone]
    assert kept[0] == one and {i for i, _ in start} - {i for i, _ in one} == {49, 50, 51}
    ids = [i for i, _ in one]
    groups = brute_components(ids, [brute_fingerprint(t) for _, t in one])
    two = [x for x, g in zip(one, groups) if x[0] == g]
    assert kept[1] == two and not {40, 41, 42} & {i for i, _ in two}
    three = sorted(removed(two))
    assert kept[2] == three and three != two
    flat = lambda t: decontaminate.normalized(pa.array([t], pa.string()))[0].as_py()
    leaks = lambda t: any(edit_distance(flat(u), flat(t)) <= int(decontaminate.RATE * len(flat(u))) for _, u in items)
    four = [(i, t) for i, t in three if not leaks(t)]
    assert kept[3] == four and {i for i, _ in three} - {i for i, _ in four} >= {44, 45}
    encoder = tokens.Encoder(tokens.vocabulary_path())
    lengths = {i: len(encoder.tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in four}
    assert {r.doc_id: r.length for r in kept[4]} == lengths and len({r.sequence_id for r in kept[4]}) == -(-sum(lengths.values()) // packing.CAPACITY)
    whole = sorted(map(tuple, corpus_pipeline.run(spark, folder).drop("sequence_id", "offset").collect()))
    assert whole == sorted(map(tuple, docs.drop("sequence_id", "offset").collect()))


def test_every_stage_takes_an_empty_table(spark, tmp_path):
    corpus(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).isEmpty()
