import pytest
from pyspark.sql import functions as F

from episodica.operators import splits
from episodica.sources import store

ROW = "trajectory_id string, tenant_id string, domain string, task_id string, split string, actor_model string, actor_mode string, harness_version string, reward double, success boolean, steps_used int, content_sha256 string, error_types array<string>, created_at string"


def row(k, **other):
    held = dict(trajectory_id=f"e{k}", tenant_id="t", domain="d", task_id=str(k), split="train", actor_model="m", actor_mode="think", harness_version="1", reward=1.0, success=True, steps_used=3, content_sha256=f"h{k}", error_types=["timeout"] if k % 2 else [], created_at=f"2026-0{1 + k % 3}-05")
    return tuple((held | other)[f.split()[0]] for f in ROW.split(", "))


def table(spark, *rows):
    return spark.createDataFrame(list(rows), ROW).withColumn("created_at", F.col("created_at").cast("timestamp"))


def test_metadata_is_written_once_in_months(spark, tmp_path):
    root = str(tmp_path)
    assert store.select_metadata(spark, root) is None
    store.put_metadata(table(spark, *map(row, range(6))), root)
    store.put_metadata(table(spark, *map(row, range(4, 8))), root)
    assert sorted(r.trajectory_id for r in store.select_metadata(spark, root).collect()) == [f"e{k}" for k in range(8)]
    held = store.select_metadata(spark, root, ["2026-02"], "timeout")
    assert sorted(r.trajectory_id for r in held.collect()) == ["e1", "e7"]
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan or "PartitionFilters: [(month" in plan, plan


@pytest.mark.parametrize("other", [{"reward": None}, {"split": "dev"}, {"actor_mode": "maybe"}, {"steps_used": -1}, {"content_sha256": "h0"}, {"trajectory_id": "e0", "content_sha256": "x"}])
def test_broken_rows_refuse_the_batch(spark, tmp_path, other):
    with pytest.raises(store.ConstraintError):
        store.put_metadata(table(spark, row(0), row(9, **other)), str(tmp_path))
    assert store.select_metadata(spark, str(tmp_path)) is None


def test_unknown_references(spark, tmp_path):
    known = spark.createDataFrame([("other",)], "tenant_id string")
    with pytest.raises(store.ConstraintError, match="refers:tenant_id"):
        store.put_metadata(table(spark, row(0)), str(tmp_path), tenants=known)


def test_bodies_come_back(spark, tmp_path):
    bodies = spark.createDataFrame([("t", "d", "2026-01-01", "h1", "{}")], "tenant_id string, domain string, day string, content_sha256 string, body string")
    store.put(bodies, str(tmp_path))
    assert store.get(spark, str(tmp_path), "t", "d", "h1") == "{}" and store.get(spark, str(tmp_path), "t", "d", "h2") is None


def test_split_table(spark, tmp_path):
    root, split = str(tmp_path), splits.build_split("d", [str(k) for k in range(20)], 8, 6, 3)
    assert splits.get_split(spark, root, split.sha256) is None
    for _ in range(2):
        splits.insert_split(spark, split, root)
    assert splits.get_split(spark, root, split.sha256) == split and spark.read.parquet(f"{root}/splits").count() == 1
    bad = {"sha256": "x", "domain": "d", "strategy": "s", "seed": 1, "train": ["a"], "test": ["a"], "notes": None}
    with pytest.raises(ValueError, match="halves_disjoint"):
        splits.insert_raw(spark, bad, root)
    splits.insert_raw(spark, bad | {"test": ["b"]}, root)
    with pytest.raises(ValueError):
        splits.get_split(spark, root, "x")
