"""Nested redaction and envelopes against the plain functions for one record and one batch."""

import json
import random

from pyspark.sql import functions as F

from episodica.operators import redact, redact_records
from episodica.schema import SCHEMA_DDL
from episodica.sources import batch, envelopes

RNG = random.Random(4)
PIECES = ["write to a.b@example.org", "or c@d.example.com", "card 4111 1111 1111 1111", "call 555-123-4567 now", 'a "quoted" \\ back', "ünï\ncödé", "", "a.b@example.org again"]


def text():
    return " ".join(RNG.sample(PIECES, RNG.randint(1, 3)))


def value(depth):
    kind = RNG.randrange(6 if depth else 3)
    if kind < 2:
        return text()
    if kind == 2:
        return RNG.choice([1, True, None, 2.5])
    return {RNG.choice("abcxyz") + str(k): value(depth - 1) for k in range(3)} if kind < 5 else [value(depth - 1) for _ in range(3)]


def record(k):
    step = lambda i: {"index": i, "observation": {"kind": "m", "text": text()}, "output": {"text": text(), "reasoning_text": RNG.choice([None, text()])}, "action": {"kind": "tool_call", "text": RNG.choice([None, text()]), "arguments": RNG.choice([None, {"q": value(3), "b": value(2)}]), "arguments_raw": text()}, "result": RNG.choice([None, {"status": "ok", "text": text()}])}
    return {"trajectory_id": f"e{k}", "steps": [step(i) for i in range(RNG.randint(0, 4))]}


def test_equal_to_the_plain_walk_of_a_record(spark):
    bodies = [json.dumps(record(k), ensure_ascii=False) for k in range(60)]
    typed = spark.createDataFrame([(k, b) for k, b in enumerate(bodies)], "k long, raw string").select("k", F.from_json("raw", SCHEMA_DDL).alias("t")).select("k", "t.*")
    found = redact_records.redact_trajectories(typed)
    assert found.columns == typed.columns
    got = {r.k: r for r in found.select("k", F.to_json("steps").alias("steps"), "redaction").collect()}
    for k, body in enumerate(bodies):
        expected = json.loads(redact.redact_record(body))
        held = json.loads(got[k].steps)
        assert len(held) == len(expected["steps"]) and got[k].redaction.counts == expected["redaction"]["counts"] and got[k].redaction.applied
        for mine, plain in zip(held, expected["steps"]):
            for part, leaf in redact_records.PATHS:
                assert (mine.get(part) or {}).get(leaf) == (plain.get(part) or {}).get(leaf), (k, part, leaf)


def test_envelopes_are_judged_like_one_batch(spark):
    one = {"source_format": "harness_run", "body": {"a": 1}}
    bodies = [
        json.dumps({"tenant_id": "t", "records": [one, one]}), json.dumps({"tenant_id": "t", "records": []}), "{", "[]", "7", '"x"', "null", json.dumps({"tenant_id": 1, "records": []}), json.dumps({"tenant_id": "t"}), json.dumps({"tenant_id": "t", "records": [], "more": 1}),
        json.dumps({"tenant_id": "t", "records": {}}), json.dumps({"tenant_id": "t", "records": [one, 5]}), json.dumps({"tenant_id": "t", "records": [{"source_format": "x"}]}), json.dumps({"tenant_id": "t", "records": [{"source_format": 3, "body": {}}]}),
        json.dumps({"tenant_id": "t", "records": [one | {"body": []}]}), json.dumps({"tenant_id": "t", "records": [one] * 6}), json.dumps({"tenant_id": "t" * 500, "records": []}),
    ]
    table = spark.createDataFrame([*enumerate(bodies), (99, None)], "envelope long, body string")
    found = envelopes.admitted(table, 400, 5).cache()
    got = {r.envelope: (r.status, r.n_records) for r in found.collect()}
    for k, body in enumerate(bodies):
        status, _, rows = batch.admit(spark, body.encode(), 400, 5)
        assert got[k] == (status, rows.count() if rows is not None else None), body
    assert got[99] == (400, None)
    rows = envelopes.records(found, 5).collect()
    assert [(r.envelope, r.tenant_id, r.source_format, json.loads(r.raw), r.position) for r in rows] == [(0, "t", "harness_run", {"a": 1}, 0), (0, "t", "harness_run", {"a": 1}, 1)]
