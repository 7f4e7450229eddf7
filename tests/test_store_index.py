"""The store's index: what a batch reads doesn't grow with the store, conflicts are refused, and failures are mended."""

import hashlib

import pytest

from episodica.sources import batch, store

BODY = "tenant_id string, domain string, day string, content_sha256 string, body string"


def row(k, body=None, day="2026-01-01"):
    return ("t", "d", day, hashlib.sha256(str(k).encode()).hexdigest(), body or f'{{"k": {k}}}')


def table(spark, rows):
    return spark.createDataFrame(list(rows), BODY)


def test_a_batch_reads_its_prefixes_and_no_body(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    one = table(spark, [row(7)])
    seen = []
    for size in (40, 200, 800):
        store.put(table(spark, map(row, range(10_000 * size, 10_000 * size + size))), root)
        store.put(one, root)
        seen.append(len(store.known(spark, root, one).inputFiles()))
    assert max(seen) <= store.MOST_FILES  # of 256 folders one is read, whose files are kept few
    asked = []
    monkeypatch.setattr(store, "read", lambda spark, root, what, f=store.read: asked.append(what) or f(spark, root, what))
    plans = []
    monkeypatch.setattr(store, "stored", lambda df, tag, f=store.stored: plans.append(df._jdf.queryExecution().optimizedPlan().toString() + str(df.inputFiles())) or f(df, tag))
    store.put(table(spark, [row(7), row("new")]), root)
    assert "/bodies/" not in plans[0] and "/bodies_index/" in plans[0]
    assert spark.read.parquet(f"{root}/bodies").count() == 40 + 200 + 800 + 2


def test_conflicts_are_refused(spark, tmp_path):
    root = str(tmp_path)
    store.put(table(spark, map(row, range(20))), root)
    with pytest.raises(store.ConflictError, match="another body"):
        store.put(table(spark, [row(3, "{}"), row(99)]), root)
    with pytest.raises(store.ConflictError, match="two bodies"):
        store.put(table(spark, [row(98), row(98, "{}")]), root)
    store.put(table(spark, [row(3), row(97), row(97)]), root)
    assert spark.read.parquet(f"{root}/bodies").count() == 21 and store.exists(spark, root, "t", "d", row(97)[3]) and not store.exists(spark, root, "t", "x", row(97)[3])


def test_folders_with_many_files_are_put_together(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    monkeypatch.setattr(store, "MOST_FILES", 2)
    monkeypatch.setattr(store, "compact", lambda *a, f=store.compact: f(*a, most=2))
    monkeypatch.setattr(store, "PREFIX", 1)
    same = [k for k in range(200) if row(k)[3][0] == "a"][:6]
    for n, k in enumerate(same):
        store.put(table(spark, [row(k, day=f"2026-01-0{n + 1}")]), root)
    held = store.known(spark, root, table(spark, [row(same[0])]))
    assert held.count() == 6 and len(held.inputFiles()) <= 3
    assert [store.get(spark, root, "t", "d", row(k)[3]) for k in [*same, 999]] == [*(row(k)[4] for k in same), None]


def test_an_index_is_made_for_what_lacks_it(spark, tmp_path):
    root = str(tmp_path)
    table(spark, map(row, range(5))).write.partitionBy(*store.PARTS).parquet(f"{root}/bodies")
    store.put(table(spark, map(row, range(8))), root)
    assert spark.read.parquet(f"{root}/bodies").count() == 8 and store.exists(spark, root, "t", "d", row(2)[3])
    table(spark, [row(50)]).write.mode("append").partitionBy(*store.PARTS).parquet(f"{root}/bodies")  # a failure before the index
    assert not store.exists(spark, root, "t", "d", row(50)[3])
    store.reindex(spark, root)
    assert store.exists(spark, root, "t", "d", row(50)[3])


def test_a_record_that_comes_very_often_is_accepted_once(spark):
    rows = spark.range(3000).selectExpr("'t' tenant_id", "if(id % 3 = 0, 'other', 'harness_run') source_format", "if(id < 2900, '{\"a\": 1}', '{') raw", "id position")
    out = batch.ingest(rows)
    counts = {tuple(r)[:2]: r["count"] for r in out.groupBy("status", "rule").count().collect()}
    assert sum(counts.values()) == 3000 and {s for s, _ in counts} == {"quarantined"}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window [" in x]
    assert len(windows) == 2 and "_copy" in windows[1] and "CASE WHEN" in plan
