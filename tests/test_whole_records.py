"""Records against the reference's strict model, a break at a time."""

import copy
import json

from episodica.sources import batch
from test_engine import record

WHOLE = {
    "actor__decoding": {"temperature": 0.0, "top_p": 1, "max_tokens": None}, "redaction": {"applied": True, "policy_version": "p", "counts": {"EMAIL": 2}},
    "totals": {"output_tokens": 1, "output_reasoning_tokens": None, "input_tokens": 0, "input_cached_tokens": 0, "turns": 1},
}
STALL = {"start": 0, "end": 2, "action": "a", "length": 3, "period": None}
SIMULATOR = {"model": "m", "version": "1"}
#: Each breaks the reference's strict record in one place.
NOT_WHOLE = [
    {"totals": KeyError}, {"redaction": KeyError}, {"actor__decoding": KeyError}, {"totals": None}, {"totals__turns": None}, {"totals__turns": -1}, {"totals__input_tokens": KeyError}, {"totals__input_tokens": "1"}, {"totals__odd": 1}, {"totals__cost_usd": "1"},
    {"redaction__applied": 1}, {"redaction__policy_version": KeyError}, {"redaction__counts": {"EMAIL": "2"}}, {"redaction__counts": None}, {"actor__decoding__top_p": KeyError}, {"actor__decoding__temperature": "0"}, {"actor__decoding__odd": 1}, {"actor__mode_flag": None},
    {"outcome__steps_used": -1}, {"provenance__content_sha256": KeyError}, {"provenance__content_sha256": "b" * 63}, {"provenance__content_sha256": "b" * 64 + "\n"}, {"provenance__source_run_id": 1}, {"harness__tools_sha256": "zz"}, {"schema_version": "trajectory/2.0"},
    {"harness__user_simulator": {"model": "m"}}, {"harness__user_simulator": SIMULATOR | {"odd": 1}}, {"labels": None}, {"labels": {"error_types": [1]}}, {"labels": {"stall_runs": [STALL | {"start": -1}]}}, {"labels": {"stall_runs": [STALL | {"odd": 1}]}}, {"labels": {"stall_runs": ["x"]}},
    {"steps__0__result": {}}, {"steps__0__result": {"status": 1}}, {"steps__0__latency_ms": -1}, {"steps__0__output__reasoning_token_count": -1}, {"steps__0__output__odd": 1}, {"steps__0__action__arguments": []}, {"steps__0__observation__meta": None}, {"normalization_warnings": [None]},
]
STILL_WHOLE = [
    {}, {"harness__user_simulator": SIMULATOR}, {"labels": {}}, {"labels": {"error_types": ["x"], "stall_runs": [STALL], "annotator": None}}, {"steps__0__result": {"status": "ok", "error_type": None}}, {"steps__0__latency_ms": 0}, {"schema_version": KeyError},
    {"steps__0__action__arguments": {"a": [1]}}, {"normalization_warnings": ["w"]}, {"redaction__counts": KeyError}, {"totals__cost_usd": 0.5}, {"harness__tools_sha256": "a" * 64},
]


def test_whole_records(spark):
    made = lambda more: json.dumps(record(**{k: v for k, v in (copy.deepcopy(WHOLE) | more).items() if v is not KeyError or k not in WHOLE}))
    cases = [(more, "schema_invalid") for more in NOT_WHOLE] + [(more, None) for more in STILL_WHOLE]
    rows = spark.createDataFrame([("t", "harness_run", made(more), k) for k, (more, _) in enumerate(cases)], "tenant_id string, source_format string, raw string, position long")
    got = {r.position: r.rule for r in batch.normalize(rows, whole=True).select("position", "rule").collect()}
    assert [(cases[k][0], rule) for k, rule in sorted(got.items())] == cases
    loose = {r.position for r in batch.normalize(rows).filter("rule is null").select("position").collect()}
    assert loose == {0, 1, 2} | set(range(len(NOT_WHOLE), len(cases)))
