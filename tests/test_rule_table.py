"""Validation against a plain walk of the parsed JSON, over records with faults at random places."""

import copy
import json
import random
import re

from pyspark.sql import functions as F

from episodica.sources import batch

RNG = random.Random(8)
SHA = "a" * 64


def sound():
    tokens = dict(input_total=1, input_cached=None, output_visible=2, output_tool_args=0, output_reasoning=0)
    step = lambda k: dict(index=k, observation=dict(kind="m", text="t", meta={}), output=dict(text="", reasoning_text=None, reasoning_token_count=3), action=dict(kind="tool_call", name="f", arguments={"a": 1}), result=dict(status="ok", error_type=None, text="x"), tokens=dict(tokens), latency_ms=4, cost_usd=0.5)
    return dict(
        schema_version="trajectory/1.0", trajectory_id="e", tenant_id="t", domain="d", task_id="k", split="train", seed=1, started_at="2026-01-01T00:00:00Z", ended_at="2026-01-01T00:01:00Z",
        actor=dict(model="m", mode="think", mode_flag={}, decoding=dict(temperature=0.5, top_p=1, max_tokens=None)), harness=dict(name="h", version="1", system_prompt_sha256=SHA, tools_sha256=SHA, max_steps=9, user_simulator=dict(model="u", version="2")),
        steps=[step(0), step(1)], outcome=dict(reward=1.0, success=True, termination="done", steps_used=2, step_cap_hit=False), totals=dict(output_tokens=4, output_reasoning_tokens=None, input_tokens=2, input_cached_tokens=0, turns=2, cost_usd=None),
        labels=dict(error_types=["x"], stall_runs=[dict(start=0, end=1, action="a", length=2, period=None)], annotator=None), redaction=dict(applied=True, policy_version="1", counts={"EMAIL": 2}), provenance=dict(source="s", source_run_id=None, content_sha256=SHA), normalization_warnings=["w"],
    )


def at(x, path):
    for k in path.split("."):
        if not isinstance(x, dict) or k not in x:
            return False, None
        x = x[k]
    return True, x


def is_kind(x, kind):
    whole = isinstance(x, int) and not isinstance(x, bool)
    return {
        "string": isinstance(x, str), "bool": isinstance(x, bool), "int": whole, "count": whole and x >= 0, "number": whole or isinstance(x, float), "object": isinstance(x, dict), "array": isinstance(x, list),
        "sha256": isinstance(x, str) and re.fullmatch("[0-9a-f]{64}", x) is not None, "strings": isinstance(x, list) and all(isinstance(y, str) for y in x), "ints": isinstance(x, dict) and all(isinstance(y, int) and not isinstance(y, bool) for y in x.values()),
    }[kind]


def breaks(x, fields, nested, own=()):
    """Broken fields of an object: kinds with their marks, then unknown keys."""
    out = set()
    for path, kind in fields:
        there, value = at(x, path)
        allowed = (not there and kind[-1] in "?!") or (there and value is None and kind[-1] in "?*")
        if not allowed and not (there and is_kind(value, kind.rstrip("?!*"))):
            out.add(path)
    for path, known in nested.items():
        value = at(x, path)[1]
        if isinstance(value, dict) and set(value) - set(known):
            out.add(path)
    if own and set(x) - set(own):
        out.add("")
    return out


def plain(r, whole):
    out = {("schema_invalid", f) for f in breaks(r, batch.TOP_FIELDS, batch.NESTED)}
    out |= {("schema_invalid", f) for f in batch.WHOLE if breaks(r, [(f, "object" if whole else "object!")], {})}
    for path, fields in batch.PARTS.items():
        part = at(r, path)[1]
        if isinstance(part, dict):
            out |= {("schema_invalid", f"{path}.{f}") for f in breaks(part, fields, {})}
    steps = at(r, "steps")[1] if isinstance(at(r, "steps")[1], list) else []
    stalls = at(r, "labels.stall_runs")[1] if isinstance(at(r, "labels.stall_runs")[1], list) else []
    reward = at(r, "outcome.reward")[1]
    rules = {
        ("reward_present", "outcome.reward"): not is_kind(reward, "number"),
        ("step_contiguity", "steps"): any(not isinstance(s, dict) or s.get("index") != k for k, s in enumerate(steps)),
        ("token_keys_present", "steps.tokens"): any(breaks(s, [(f"tokens.{k}", "count*") for k in batch.TOKEN_KEYS], {"tokens": batch.TOKEN_KEYS}) for s in steps),
        ("actor_mode_valid", "actor.mode"): at(r, "actor.mode")[1] not in ("think", "no_think"),
        ("system_prompt_hash_present", "harness.system_prompt_sha256"): not is_kind(at(r, "harness.system_prompt_sha256")[1], "sha256"),
        ("schema_invalid", "schema_version"): at(r, "schema_version") not in ((True, "trajectory/1.0"), (False, None)),
        ("schema_invalid", "labels.stall_runs"): any(not isinstance(s, dict) or breaks(s, batch.STALL_FIELDS, {}, [k for k, _ in batch.STALL_FIELDS]) for s in stalls),
        ("schema_invalid", "split"): at(r, "split")[1] not in batch.SPLITS,
        ("schema_invalid", "steps"): any(breaks(s, batch.STEP_FIELDS, batch.STEP_NESTED, batch.STEP_KEYS) or (isinstance(s.get("result"), dict) and breaks(s, [("result.status", "string")], {})) or at(s, "action.kind")[1] not in batch.ACTION_KINDS for s in steps),
        ("schema_invalid", "ended_at"): not all(isinstance(r.get(k), str) and re.match("2026", r[k]) for k in ("started_at", "ended_at")) or r["ended_at"] < r["started_at"],
    }
    return out | {k for k, broken in rules.items() if broken}


def places(x, path=()):
    for k in x if isinstance(x, dict) else range(len(x)) if isinstance(x, list) else ():
        yield (*path, k)
        yield from places(x[k], (*path, k))


def faulty():
    r = copy.deepcopy(sound())
    for _ in range(RNG.choice([1, 1, 2, 3])):
        spots = [p for p in places(r) if p[-1] not in ("started_at", "ended_at")]
        *way, last = RNG.choice(spots)
        inner = r
        for k in way:
            inner = inner[k]
        match RNG.randrange(4):
            case 0 if isinstance(inner, dict):
                del inner[last]
            case 1 if isinstance(inner, dict):
                inner["odd"] = 1
            case _ if isinstance(inner[last], dict) and way == ["steps"]:
                pass
            case _:
                inner[last] = RNG.choice([None, "text", -1, 5, True, 0.25, {}, [], {"z": "q"}, ["q"], [1]])
    return r


def test_equal_to_a_plain_walk(spark):
    records = [sound(), *[faulty() for _ in range(500)]]
    records = [r for r in records if all(isinstance(s, dict) for s in (r.get("steps") if isinstance(r.get("steps"), list) else []))]
    table = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(records)], "k long, raw string").withColumn("v", F.try_parse_json("raw"))
    for whole in (True, False):
        got = {r.k: {(b.rule, b.field) for b in r.broken} for r in table.select("k", batch.violations("v", whole).alias("broken")).collect()}
        assert got[0] == set()
        for k, record in enumerate(records):
            # unknown keys of the record itself are dropped with a warning, not refused
            assert got[k] == plain(record, whole), json.dumps(record)
