"""Answers worked out by hand, and laws the operators keep."""

import hashlib
import json
import math
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from episodica import schema
from episodica.functions import canonical, observation, redaction, stats
from episodica.functions.profiles import PROFILES, domains, profile
from episodica.operators import contrast, corpus, errors, ngrams, quality, redact, registry, splits, stalls
from episodica.sources import batch, instructions, store
from episodica.streaming import ingest as stream


def steps_of(spark, runs):
    rows = [(t, k, a, o) for t, acts in runs.items() for k, (a, o) in enumerate(acts)]
    return spark.createDataFrame(rows, "trajectory_id string, idx long, action string, obs string")


def episodes_of(spark, rewards, **more):
    return spark.createDataFrame([Row(trajectory_id=t, reward=float(r), step_cap_hit=False, **more) for t, r in rewards.items()])


LOOKS = [("look", "same")] * 20
DOORS = [("open", "a"), ("close", "b")] * 4
MOVES = [(f"go {k}", f"room {k}") for k in range(5)]


def test_ngram_cap_and_short_episodes(spark):
    steps, episodes = steps_of(spark, {"a": LOOKS, "b": MOVES[:1]}), episodes_of(spark, {"a": 1, "b": float("nan")})
    rows = {tuple(r.ngram): r for r in ngrams.ngram_report(steps, episodes, min_count=1).collect()}
    assert rows[("look",)]["count"] == 5 and rows[("look",)].lift == 1.0 and ("go 0", "go 1") not in rows
    wide = ngrams.ngram_report(steps, episodes, per_episode=1000, min_count=1).filter(F.size("ngram") == 1).orderBy(F.desc("count")).first()
    assert wide["count"] == 20
    assert ngrams.ngram_report(steps, episodes, per_episode=0).isEmpty()


def test_stalls(spark):
    steps = steps_of(spark, {"look": LOOKS, "doors": DOORS, "moves": MOVES, "none": [("x", None), ("x", None)]})
    got = {r.trajectory_id: r for r in stalls.stall_report(steps, episodes_of(spark, dict.fromkeys(("look", "doors", "moves", "empty"), 0))).collect()}
    (look,), (doors,) = got["look"].runs, got["doors"].runs
    assert (look.start, look.end, look.length, look.kind, look.action) == (0, 19, 20, "repeat_action", "look")
    assert (doors.start, doors.end, doors.length, doors.period, doors.action) == (0, 7, 8, 2, "open|close")
    assert not got["moves"].stalled and not got["empty"].stalled and got["empty"].longest == 0
    assert stalls.stall_rate(stalls.stall_report(steps, episodes_of(spark, dict.fromkeys(("look", "doors", "moves", "empty"), 0)))).first().stall_rate == 0.5
    assert stalls.stall_runs(steps, whitelist=("look",)).filter("trajectory_id = 'look'").isEmpty()


def scan(actions, p):
    """Left-to-right search for cycles of one period."""
    out, i = [], 0
    while i + 2 * p <= len(actions):
        e = i
        while e + p < len(actions) and actions[e] == actions[e + p]:
            e += 1
        if e - i >= p:
            if len(set(actions[i : i + p])) > 1:
                out.append((i, e + p - 1))
            i = e + p
        else:
            i += 1
    return out


def test_cycles_match_a_scan(spark):
    rng = random.Random(3)
    runs = {f"t{k}": [(rng.choice("ab"), "o") for _ in range(rng.randint(0, 24))] for k in range(120)}
    got = {}
    for r in stalls.cycle_runs(steps_of(spark, runs)).collect():
        got.setdefault((r.trajectory_id, r.period), []).append((r.start, r.end))
    expected = {(t, p): found for t, acts in runs.items() for p in (2, 3, 4) if (found := scan([a for a, _ in acts], p))}
    assert {k: sorted(v) for k, v in got.items()} == expected


def test_statistics(spark):
    assert math.isclose(stats.fisher(0, 8, 13, 1), 14 / 497420) and stats.fisher(0, 0, 0, 0) == 1.0
    assert stats.mcnemar(0, 10) == 0.001953125 and stats.mcnemar(0, 0) == 1.0
    assert math.isclose(stats.fisher(30_000, 30_100, 29_900, 30_050), stats.fisher(29_900, 30_050, 30_000, 30_100), rel_tol=1e-6)
    one = spark.range(1)
    w = one.select(stats.wilson_interval(F.lit(50), F.lit(100)).alias("w")).first().w
    assert math.isclose(w.low, 0.4038, abs_tol=1e-4) and math.isclose(w.high, 0.5962, abs_tol=1e-4)
    with pytest.raises(Exception, match="interval"):
        one.select(stats.wilson_interval(F.lit(5), F.lit(0))).collect()
    cases = {(0.567, 0.713, 0.787): ("ok", 1.507), (0.325, 0.350, 0.408): ("gap_too_small", None), (0.827, 0.773, 0.980): ("gap_nonpositive", None), (0.883, 0.933, 0.933): ("ok", 1.0)}
    for (no, think, skill), (status, value) in cases.items():
        g = one.select(stats.gap_recovery(F.lit(no), F.lit(think), F.lit(skill)).alias("g")).first().g
        assert g.status == status and (g.value is None if value is None else math.isclose(g.value, value, abs_tol=1e-3))
    assert one.select(stats.token_reduction(F.lit(3723), F.lit(952))).first()[0] > 3.9 and one.select(stats.token_reduction(F.lit(1), F.lit(0))).first()[0] is None
    with pytest.raises(Exception, match="undefined"):
        one.filter("id > 5").select(F.lit(1.0).alias("r")).agg(stats.success_rate(F.col("r"))).collect()


def test_bootstrap_repeats_a_plain_loop(spark):
    deltas = [0.5, -0.25, 1.0, 0.0]
    rows = spark.createDataFrame(list(enumerate(deltas)), "task_id long, delta double")
    rng = random.Random(9)
    means = sorted(sum(deltas[rng.randrange(4)] for _ in range(4)) / 4 for _ in range(200))
    at = lambda p: means[int(p * 199)] * (1 - (p * 199) % 1) + means[int(p * 199) + 1] * ((p * 199) % 1)
    got = stats.bootstrap_delta(rows, 200, 9).first()
    assert math.isclose(got.low, at(0.025)) and math.isclose(got.high, at(0.975)) and got.point == 0.3125
    wide = stats.bootstrap_delta_distributed(rows, 400, 9).first()
    assert wide.low < 0.3125 < wide.high
    base = spark.createDataFrame([("a", 0.0), ("b", 1.0)], "task_id string, reward double")
    with pytest.raises(Exception, match="only one condition"):
        stats.paired_deltas(base, base.filter("task_id = 'a'")).collect()


def test_contrast(spark):
    rows = [Row(trajectory_id=f"{m}{k}", task_id=f"t{k}", mode=m, reward=float(m == "think"), error=m != "think", always=True) for k in range(10) for m in ("think", "no_think")]
    episodes = spark.createDataFrame(rows)
    flags = {"error": F.col("error"), "always": F.col("always")}
    (paired,) = contrast.paired_contrast(episodes, flags).collect()
    assert (paired.predicate, paired.n_win, paired.n_loss, paired.p_value, paired.evidence) == ("error", 0, 10, 0.001953125, ["t0", "t1", "t2"])
    (plain,) = contrast.unpaired_contrast(episodes, flags).collect()
    assert plain.lift == -1.0 and plain.significant and plain.evidence == ["no_think0", "no_think1", "no_think2"]
    wins = episodes.filter("reward > 0")
    assert contrast.unpaired_contrast(wins, flags).isEmpty() and contrast.contrast_header(wins).first().status == "degenerate_no_contrast"
    assert contrast.contrast_header(wins, paired=True).first().status == "degenerate_no_pairs"


def detector_rows(spark):
    schema_ = "trajectory_id string, idx long, n_steps long, step_cap_hit boolean, kind string, tool string, arguments map<string,string>, observation string, result_status string, error_type string"
    row = lambda t, i, n, cap, args, obs, status=None, err=None: (t, i, n, cap, "tool_call", "find_user_id_by_email", args, obs, status, err)
    return spark.createDataFrame(
        [
            row("a", 0, 2, False, {"email": "user@example.com"}, "hello", "error", "not_found"),
            row("a", 1, 2, False, {"email": "real@shop.com"}, "I am real@shop.com", "ok"),
            row("b", 0, 1, True, None, "x", "error", ""),
            row("c", 0, 1, False, {"email": "  "}, "x"),
        ],
        schema_,
    )


def test_errors(spark):
    events = errors.error_events(detector_rows(spark), profile=profile("tau2_retail"))
    got = sorted(map(tuple, events.collect()))
    assert got == [("a", 0, "fabricated_auth_argument"), ("a", 0, "not_found"), ("b", 0, "step_cap_hit"), ("b", 0, "tool_error")]
    report = errors.with_evidence(errors.error_frequency(events, episodes_of(spark, dict.fromkeys("abcd", 0))), events).collect()
    assert [(r.error_type, r.trajectories_with, r.trajectory_rate, r.share_of_all_errors) for r in report] == [(t, 1, 0.25, 0.25) for t in ("fabricated_auth_argument", "not_found", "step_cap_hit", "tool_error")]
    assert report[0].evidence == [Row(trajectory_id="a", step_index=0)]
    assert [tuple(r) for r in errors.error_cooccurrence(events).orderBy("left_type").collect()] == [("fabricated_auth_argument", "not_found", 1), ("step_cap_hit", "tool_error", 1)]


SYMBOLS = [
    ("go to fridge 1", "go to <recep>"), ("take apple 1 from countertop 2", "take <obj> from <recep>"), ("cool tomato 1 with fridge 1", "cool <obj> with <recep>"), ("look", "look"),
    ("  INVENTORY ", "inventory"), ("dance wildly", "text:dance"), ("", "noop"), (None, "noop"), ("!!", "noop"), ("put in", "put in"), ("open", "open"), ("golf", "text:golf"),
]


def test_symbols(spark):
    rows = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(SYMBOLS)], "k int, text string")
    none = F.lit(None)
    got = rows.select("k", canonical.action_symbol(F.lit("text_action"), none.cast("string"), none.cast("map<string,variant>"), F.col("text"), profile("alfworld")).alias("s")).orderBy("k").collect()
    assert [r.s for r in got] == [s for _, s in SYMBOLS]
    tools = [('{"email": "user@example.com"}', "email:placeholder_like"), ('{"email": "<EMAIL_3>", "n": 1}', "email:email_present,n:int"), ('{"x": 1.0, "y": [1], "z": {}, "w": null, "b": true, "h": 99999999999999999999}', "b:bool,h:int,w:null,x:float,y:list,z:dict,email:email_absent"), ('{"email": 5}', "email:email_absent")]
    held = spark.createDataFrame([(k, a) for k, (a, _) in enumerate(tools)], "k int, a string").withColumn("m", F.try_variant_get(F.parse_json("a"), "$", "map<string, variant>"))
    got = held.select("k", canonical.tool_symbol(F.lit("find_user_id_by_email"), F.col("m"), profile("tau2_retail")).alias("s")).orderBy("k").collect()
    assert [r.s for r in got] == [f"tool:find_user_id_by_email({s})" for _, s in tools]
    assert canonical.calls("a.b(c())\nf(x)(y)\n(lambda: 1)()") == "code:a.b+c+f" and canonical.calls("x =") == "code:unparsed" and canonical.calls("x = 1") == "code:none" and canonical.calls("f()().g()") == "code:<expr>.g+f"
    assert domains() == sorted(PROFILES) and profile("new").domain == "default"


def test_observations(spark):
    texts = ["Step 3 of 40. You see a box", "step 12  of 40. you see  a box", "You see a box", "t = 5 [ 1 / 2 ] 12 ms You see a box"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r[0] for r in rows.select(observation.normalize_observation(F.col("t"))).collect()} == {"you see a box"}
    odd = spark.createDataFrame([("a . b",)], "t string")
    assert odd.select(observation.normalize_observation(F.col("t"))).first()[0] == "a\x01 b" and odd.select(observation.normalize_observation(F.col("t"), tidy="fixed")).first()[0] == "a. b"


SPANS = [
    ("Write to ann@shop.example or BOB.Lee+x@Mail.ORG now", ["ann@shop.example", "BOB.Lee+x@Mail.ORG"], False), ("card 4111 1111 1111 1111 ok", ["4111 1111 1111 1111"], False), ("card 4111-1111-1111-1112 bad", ["4111-1111-1111"], False),
    ("ssn 123-45-6789", ["123-45-6789"], False), ("ssn 000-12-3456 and 666-12-3456 and 912-12-3456", [], False), ("call +1 (555) 123-4567 please", ["+1 (555) 123-4567"], False), ("iban GB82WEST12345698765432", ["GB82WEST12345698765432"], False),
    ("order 8471629503", [], False), ("number 8471629503", ["8471629503"], True), ("v1.2.3 on 2026-01-02 for 19.99", [], False), (None, [], False), ("", [], False), ("é 555-123-4567 ü a@b.co", ["555-123-4567", "a@b.co"], False),
]


def test_spans(spark):
    for strict in (False, True):
        rows = spark.createDataFrame([(k, t) for k, (t, _, s) in enumerate(SPANS) if s == strict], "k int, t string")
        got = rows.select("k", "t", redaction.find_spans(F.col("t"), redaction.Policy(strict)).alias("s")).collect()
        for r in got:
            assert [x.value for x in r.s] == SPANS[r.k][1], r
            assert all(r.t[x.start : x.end] == x.value for x in r.s)
            own = redact.Numbering(redaction.Policy(strict))
            own.text(r.t or "")
            assert [v for _, v in own.names] == list(dict.fromkeys(SPANS[r.k][1]))


def test_records_are_redacted_in_depth(spark):
    body = record(steps__0__action={"kind": "tool_call", "name": "f", "arguments": {"z": ["c@x.org"], "a": {"k": "b@x.org", "n": 1}}}, steps__0__result={"status": "ok", "text": "c@x.org"})
    rows = spark.createDataFrame([(json.dumps(body),), (None,)], "body string")
    got = [r[0] for r in rows.select(redact.redact_records(F.col("body"))).collect()]
    held = json.loads(next(x for x in got if x))
    assert held["steps"][0]["action"]["arguments"] == {"a": {"k": "<EMAIL_1>", "n": 1}, "z": ["<EMAIL_2>"]} and held["steps"][0]["result"]["text"] == "<EMAIL_2>"
    assert held["redaction"] == {"applied": True, "policy_version": "redaction/1.0", "counts": {"EMAIL": 3}} and None in got


def test_redaction_keeps_values_apart(spark):
    texts = spark.createDataFrame([("e", 0, "mail b@x.org"), ("e", 1, "b@x.org or a@x.org, not 4111 1111 1111 1111"), ("f", 0, "a@x.org"), ("f", 1, None), ("g", 0, "none")], "episode string, ord int, text string")
    got = {(r.episode, r.ord): r.redacted for r in redact.redact_texts(texts).collect()}
    assert got == {("e", 0): "mail <EMAIL_1>", ("e", 1): "<EMAIL_1> or <EMAIL_2>, not <CREDIT_CARD_1>", ("f", 0): "<EMAIL_1>", ("f", 1): None, ("g", 0): "none"}
    again = texts.join(spark.createDataFrame([(e, o, t) for (e, o), t in got.items()], "episode string, ord int, r string"), ["episode", "ord"]).select("episode", "ord", F.col("r").alias("text"))
    assert {(r.episode, r.ord): r.redacted for r in redact.redact_texts(again).collect()} == got
    nested = spark.createDataFrame([("e", [{"observation": "b@x.org", "result": None}, {"observation": "hi", "result": "a@x.org b@x.org"}])], "id string, steps array<struct<observation: string, result: string>>")
    row = redact.redact_episodes(nested, ["observation", "result"]).first()
    assert [(s.observation, s.result) for s in row.steps] == [("<EMAIL_1>", None), ("hi", "<EMAIL_2> <EMAIL_1>")] and row.redaction.counts == {"EMAIL": 3}
    found = spark.createDataFrame([("c", "a"), ("c", "a"), ("c", "z")], "case string, text string")
    score = redact.span_recall(found, spark.createDataFrame([("c", "a"), ("c", "b")], "case string, text string")).first()
    assert (score.recall, score.precision) == (0.5, 1 / 3)


def test_splits(spark, tmp_path):
    pool = [f"task_{k:03d}" for k in range(100)]
    one = splits.build_split("d", pool, 50, 50, 1)
    assert one == splits.build_split("d", pool[::-1] * 2, 50, 50, 1) and one.sha256 != splits.build_split("d", pool, 50, 50, 20260801).sha256
    assert one.sha256 == splits.build_split("d", pool, 50, 50, 1, notes="other").sha256 and not set(one.train) & set(one.test)
    with pytest.raises(ValueError):
        splits.build_split("d", pool[:3], 2, 2, 1)
    path = splits.write_split(one, str(tmp_path))
    assert splits.load_split(path) == one and splits.write_split(one, str(tmp_path)) == path
    with pytest.raises(ValueError):
        splits.Split("d", "x", 0, ("a",), ("b",), sha256="0" * 64).verify()
    halves = splits.hash_split(spark.createDataFrame([(t,) for t in pool], "task_id string"), 30, 20, 7).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in halves} == {"train": 30, "test": 20}


def corpus_rows(spark):
    rows = []
    for k in range(6):
        for m in ("think", "no_think"):
            body = json.dumps({"b": 1e-4, "outcome": {"reward": 1.0, "success": True, "termination": "é"}})
            rows.append((f"{m}-{k}", "d", "m", f"t{k}", m, m == "think" or k % 2 == 0, body))
    return spark.createDataFrame(rows, "trajectory_id string, domain string, model string, task_id string, mode string, success boolean, body string")


def test_corpus(spark, tmp_path):
    split = splits.split_from_upstream("d", ["t0", "t1", "t2", "t3"], ["t4", "t5"])
    held = corpus.build_corpus(corpus_rows(spark), split, str(tmp_path / "a"), "d", "m", "paired")
    again = corpus.build_corpus(corpus_rows(spark).repartition(3), split, str(tmp_path / "b"), "d", "m", "paired")
    assert held["merkle_root"] == again["merkle_root"] and held["counts"] == {"tasks": 4, "trajectories": 8, "trajectories_no_think": 4, "trajectories_think": 4}
    assert json.loads((tmp_path / "a" / "pass_rates.json").read_text())["no_think"] == {"episodes": 4, "pass_rate": 0.5}
    values = [r[0] for r in spark.read.parquet(str(tmp_path / "a" / "trajectories")).select("value").collect()]
    assert all('"reward"' not in v and '"success"' not in v and "é" in v and "0.0001" in v for v in values)
    with pytest.raises(corpus.CorpusError):
        corpus.build_corpus(corpus_rows(spark), split, str(tmp_path / "a"), "d", "m")
    bad = splits.Split("d", "x", 0, ("t0", "t4"), ("t5",))
    object.__setattr__(bad, "test", ("t4", "t5"))
    object.__setattr__(bad, "sha256", bad.digest())
    with pytest.raises((corpus.CorpusError, ValueError)):
        corpus.build_corpus(corpus_rows(spark), bad, str(tmp_path / "c"), "d", "m")
    assert not (tmp_path / "c").exists() and not [p for p in tmp_path.iterdir() if p.name.startswith(".staging")]
    with pytest.raises(corpus.ContaminationError):
        corpus.refuse_contamination(corpus_rows(spark).select("task_id"), spark.createDataFrame([("t4",)], "task_id string"))
    outcomes = {f"t{k:02d}": k < 20 for k in range(40)}
    picked, _ = corpus.select_tasks(outcomes, "failure_weighted", 20, 11)
    assert sum(not outcomes[t] for t in picked) > 10
    assert corpus.select_tasks(outcomes, "random_n", 99, 1)[1] and len(corpus.select_tasks(outcomes, "stratified_by_outcome", 10, 1)[0]) == 10


def record(**more):
    step = {"index": 0, "observation": {"kind": "m", "text": "x"}, "output": {"text": ""}, "action": {"kind": "noop"}, "result": None, "tokens": dict.fromkeys(schema.TOKEN_KEYS, 1)}
    out = {
        "schema_version": "trajectory/1.0", "trajectory_id": "t", "tenant_id": "x", "domain": "d", "task_id": "k", "split": "train", "seed": 1, "started_at": "2026-01-01T00:00:00Z", "ended_at": "2026-01-01T00:01:00Z",
        "actor": {"model": "m", "mode": "think"}, "harness": {"name": "h", "version": "1", "system_prompt_sha256": "a" * 64, "max_steps": 5}, "steps": [step],
        "outcome": {"reward": 0.0, "success": False, "termination": "end", "steps_used": 1, "step_cap_hit": False}, "provenance": {"source": "s", "content_sha256": "b" * 64},
    }
    for path, value in more.items():
        node = out
        *parts, last = path.split("__")
        for p in parts:
            node = node[int(p)] if isinstance(node, list) else node[p]
        if value is KeyError:
            node.pop(last)
        else:
            node[last] = value
    return out


BROKEN = [
    *[(record(outcome__reward=v), "reward_present") for v in (None, "", "null", "None", "NaN", [], {})], (record(outcome__reward=KeyError), "reward_present"), (record(outcome__reward=True), "reward_present"),
    (record(steps__0__index=1), "step_contiguity"), (record(steps__0__tokens__input_total=KeyError), "token_keys_present"), (record(steps__0__tokens__input_total=-1), "token_keys_present"), (record(actor__mode="x"), "actor_mode_valid"),
    (record(harness__system_prompt_sha256="zz"), "system_prompt_hash_present"), (record(seed=1.0), "schema_invalid"), (record(seed="1"), "schema_invalid"), (record(actor__extra=1), "schema_invalid"), (record(ended_at="2025-01-01T00:00:00Z"), "schema_invalid"),
    (record(steps__0__action__kind="fly"), "schema_invalid"), (record(split="dev"), "schema_invalid"), (record(outcome__reward=None, actor__mode="x"), "reward_present"),
]
SOUND = [record(), record(outcome__reward=1), record(steps=[]), record(steps__0__tokens__input_total=None)]


def test_ingest(spark, tmp_path):
    raws = [(json.dumps(r), "harness_run", rule) for r, rule in BROKEN] + [(json.dumps(r), "harness_run", None) for r in SOUND]
    raws += [("{", "harness_run", "malformed_payload"), (json.dumps(record()).replace("0.0", "NaN"), "harness_run", "malformed_payload"), ("[1]", "harness_run", "malformed_payload"), (json.dumps(record()), "csv", "unknown_source_format")]
    rows = spark.createDataFrame([("tenant", f, r, k) for k, (r, f, _) in enumerate(raws)], "tenant_id string, source_format string, raw string, position long")
    got = {r.position: r.rule for r in batch.normalize(rows).select("position", "rule").collect()}
    assert got == {k: rule for k, (_, _, rule) in enumerate(raws)}
    small = batch.normalize(rows.limit(1), max_bytes=10).first()
    assert small.rule == "size_cap"
    twice = spark.createDataFrame([("tenant", "harness_run", json.dumps(record() | {"odd": 1}), k) for k in range(2)] + [("tenant", "harness_run", json.dumps(BROKEN[0][0]), k) for k in (2, 3)], rows.schema)
    results = batch.ingest(twice)
    assert batch.outcome_counts(results).first().asDict() == {"accepted": 1, "duplicate": 1, "quarantined": 2}
    typed = batch.trajectories(results.filter("status = 'accepted'")).first()
    assert typed.tenant_id == "tenant" and typed.normalization_warnings == ["dropped unknown top-level field: odd"] and typed.content_sha256 == hashlib.sha256(json.dumps(record() | {"odd": 1}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert batch.metadata(batch.trajectories(results.filter("status = 'accepted'"))).first().stalled is False
    artifact = spark.createDataFrame([("k", "test")], "task_id string, split string")
    assert batch.ingest(twice, splits=artifact).filter("rule = 'split_matches_artifact'").count() == 2
    for body, status in ((b"", 400), (b"[]", 422), (b'{"tenant_id": 1, "records": []}', 422), (b"\xff", 400), (json.dumps({"tenant_id": "t", "records": [{"source_format": "x", "body": {}}] * 3}).encode(), 413)):
        assert batch.admit(spark, body, max_records=2)[0] == status
    assert batch.admit(spark, b"x" * 9, max_bytes=8)[0] == 413 and batch.registered_formats() == ["harness_run"]
    bodies = results.filter("status = 'accepted'").select("tenant_id", "domain", F.lit("2026-01-01").cast("date").alias("day"), "content_sha256", F.col("raw").alias("body"))
    store.put(bodies, str(tmp_path / "s"))
    store.put(bodies, str(tmp_path / "s"))
    assert store.read(spark, str(tmp_path / "s"), "bodies").count() == 1
    with pytest.raises(store.ConflictError):
        store.put(bodies.withColumn("body", F.lit("other")), str(tmp_path / "s"))


def test_stream(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for name in ("a", "b"):
        (source / f"{name}.json").write_text("\n".join(map(json.dumps, [record(), BROKEN[0][0], record(seed=int(name, 16))])) + "\n")
        stream.write_stream(stream.read_stream(spark, str(source), "tenant", "harness_run"), root, str(tmp_path / "cp")).awaitTermination()
    assert store.read(spark, root, "bodies").count() == 3 and store.read(spark, root, "quarantine").count() == 2


def test_quality(spark):
    empty = spark.createDataFrame([], "reward double, contiguous boolean, steps long, complete_steps long, content_sha256 string, success boolean")
    assert all(r.passed for r in quality.quality_report(empty).collect())
    seen = []
    rows = spark.createDataFrame([(1.0, True, 2, 1, "h", True), (0.0, False, 2, 2, "h", False)], empty.schema)
    quality.quality_report(rows, submitted=4, redaction_recall=0.5, on_breach=seen.append)
    assert {b["check"] for b in seen} == {"normalization_success_rate", "step_contiguity", "token_accounting_completeness", "duplicate_rate", "redaction_recall"}


def test_registry_is_byte_stable(spark):
    steps = steps_of(spark, {"a": LOOKS, "b": DOORS, "c": MOVES}).withColumn("n_steps", F.lit(5)).withColumns(
        {"step_cap_hit": F.lit(False), "kind": F.lit("noop"), "tool": F.lit(None).cast("string"), "arguments": F.lit(None).cast("map<string,string>"), "observation": F.col("obs"), "result_status": F.when(F.col("idx") == 1, "error"), "error_type": F.lit("bad")}
    )
    rows = spark.createDataFrame([("a", "t1", "think", 1.0, False, 20, ["bad"]), ("b", "t1", "no_think", 0.0, True, 8, []), ("c", "t2", "think", 1.0, False, 5, ["bad", "worse"])], "trajectory_id string, task_id string, mode string, reward double, step_cap_hit boolean, n_steps long, error_types array<string>")
    held = registry.Corpus("default", "no_think_only", "0" * 64, steps, rows)
    registry.assert_byte_stable(held)
    reports = {r.name: json.loads(registry.serialize(r)) for r in registry.run_all(held)}
    assert sorted(reports) == registry.registered_analyzers() and reports["stalls"]["status"] == "stall_rate=0.666667"


def test_schema_changes():
    old = {"properties": {"a": {"enum": ["x", "y"]}, "b": {"$ref": "#/$defs/B"}, "c": {"type": "array", "items": {"properties": {"d": {}}}}}, "required": ["a"], "$defs": {"B": {"properties": {"e": {}}}}}
    new = {"properties": {"a": {"enum": ["x"]}, "b": {"properties": {}}, "c": {"type": "array", "items": {"properties": {}}}, "n": {}}, "required": ["a", "b", "n"]}
    assert schema.breaking_changes(old, old) == [] and schema.breaking_changes(old, new) == ["enum narrowed at a: lost ['y']", "optional property became required: b", "property removed: b.e", "new required property: n"]
    assert "property removed: c[].d" in schema.breaking_changes(old, new, items=True)
    assert schema.schema_filename("trajectory/1.0") == "trajectory-1.0.json"


def test_instructions(spark, tmp_path):
    (tmp_path / "P_1_2.md").write_text("do\nthis")
    (row,) = instructions.scan(spark, str(tmp_path)).collect()
    assert (row.version, row.text) == ("P/1.2", "do\nthis") and row.sha256 == hashlib.sha256(b"do\nthis").hexdigest()
    held = instructions.Registry(spark, str(tmp_path / "r"))
    name = held.register(row.version, row.text, row.sha256, "me")
    assert held.register(row.version, row.text, row.sha256, "me") == name and held.load("P/1.2") == "do\nthis" and held.versions() == ["P/1.2"] and held.audit_records(name).count() == 1
    with pytest.raises(instructions.InstructionConflict):
        held.register("P/1.2", "other", hashlib.sha256(b"other").hexdigest(), "me")
