"""Schema drift on a small history with every kind of change."""

import json

from episodica.operators import drift


def test_changes_from_group_to_group(spark):
    weeks = {
        "1": [{"a": 1, "b": {"c": "x"}, "d": [1, {"e": True}]}, {"a": 2, "b": {"c": "x"}}],
        "2": [{"a": "1", "b": {"c": None}, "d": [1, 2]}, {"a": 2, "b": {"c": "x"}, "d": []}],
        "3": [{"a": 2.5, "z": {"y": {"x": {"w": {"deep": 1}}}}}, None],
    }
    rows = [(w, json.dumps(r) if r is not None else "{no json", "x") for w, own in weeks.items() for r in own]
    fields = drift.field_kinds(spark.createDataFrame(rows, "week string, raw string, path string").repartition(3), "week", "raw")
    got = {(r.week, r.path): (r.kinds, r.required) for r in fields.collect()}
    assert got["1", "$.d[]"] == ("number|object", False) and got["1", "$.d[].e"] == ("boolean", False) and got["2", "$.a"] == ("number|string", True)
    assert ("3", "$.z.y.x.w") in got and ("3", "$.z.y.x.w.deep") not in got and got["3", "$.a"] == ("number", False)
    changes = sorted(tuple(r) for r in drift.drift(fields, "week").filter("week < '3'").collect())
    assert changes == [("2", "$.a", "kinds changed: number > number|string"), ("2", "$.b.c", "kinds changed: string > null|string"), ("2", "$.d", "became required"), ("2", "$.d[]", "kinds changed: number|object > number"), ("2", "$.d[].e", "removed")]
    later = {(r.path, r.change) for r in drift.drift(fields, "week").filter("week = '3'").collect()}
    assert ("$.a", "became optional") in later and ("$.d[]", "removed") in later and ("$.z.y", "added") in later


def test_no_records(spark):
    none = spark.createDataFrame([], "week string, raw string")
    fields = drift.field_kinds(none, "week", "raw")
    assert fields.collect() == [] and drift.drift(fields, "week").collect() == []
