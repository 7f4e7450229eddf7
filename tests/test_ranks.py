"""Distributed numbers against plain ones."""

import random

import pytest
from pyspark.sql import functions as F

from episodica.operators.ranks import numbered

RNG = random.Random(2)


@pytest.mark.parametrize("by", [["g", "h"], ["g"], []])
def test_equal_to_plain_numbers(spark, by):
    rows = [("hot", "x", k) for k in range(4000)] + [(RNG.choice("abcde"), RNG.choice("xy"), 10_000 + k) for k in range(500)] + [(None, "x", 20_000 + k) for k in range(300)] + [("zz", None, 30_000)]
    table = spark.createDataFrame(RNG.sample(rows, len(rows)), "g string, h string, o long").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = numbered(table, by, ["o"], "n")
        got = [tuple(r) for r in found.select("g", "h", "o", "n").collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found.columns == ["g", "h", "o", "n"]
    seen, expected = {}, []
    for g, h, o in sorted(rows, key=lambda r: r[2]):
        key = {2: (g, h), 1: (g,), 0: ()}[len(by)]
        seen[key] = seen.get(key, 0) + 1
        expected.append((g, h, o, seen[key]))
    assert sorted(got, key=lambda r: r[2]) == expected


def test_no_rows(spark):
    none = spark.createDataFrame([], "g string, o long")
    assert numbered(none, ["g"], ["o"], "n").collect() == numbered(none, [], ["o"], "n").collect() == []


def test_windows_hold_a_group_within_a_range_at_most(spark):
    table = spark.range(100).select(F.lit("g").alias("g"), F.col("id").alias("o"))
    plan = numbered(table, ["g"], ["o"], "n")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window " in line]
    of_rows = [line for line in windows if "min(_at" in line]
    assert len(of_rows) == 1 and "windowspecdefinition(_part" in of_rows[0] and len(windows) == 3  # the others are over a row a range
