"""The trajectory record: its Spark schema, required keys, and a compatibility check of JSON schemas."""

from __future__ import annotations

import json

from pyspark.sql import types as T

VERSION = "trajectory/1.0"
MODES = ("think", "no_think")
SPLITS = ("train", "test", "unassigned")
ACTION_KINDS = ("tool_call", "text_action", "code_execution", "noop")
TOKEN_KEYS = ("input_total", "input_cached", "output_visible", "output_tool_args", "output_reasoning")

#: Kinds of leaf: name -> SQL type of a value, test of the variant's own type. '?' may be null or missing.
DDL = """struct<
  schema_version: string, trajectory_id: string, tenant_id: string, domain: string, task_id: string, split: string, seed: bigint,
  started_at: string, ended_at: string,
  actor: struct<model: string, mode: string, mode_flag: variant, decoding: struct<temperature: double, top_p: double, max_tokens: bigint>>,
  harness: struct<name: string, version: string, system_prompt_sha256: string, tools_sha256: string, max_steps: bigint,
    user_simulator: struct<model: string, version: string>>,
  steps: array<struct<index: bigint,
    observation: struct<kind: string, text: string, meta: variant>,
    output: struct<text: string, reasoning_text: string, reasoning_token_count: bigint>,
    action: struct<kind: string, name: string, arguments: variant, arguments_raw: string, text: string, canonical: string>,
    result: struct<status: string, error_type: string, text: string>,
    tokens: struct<input_total: bigint, input_cached: bigint, output_visible: bigint, output_tool_args: bigint, output_reasoning: bigint>,
    latency_ms: bigint, cost_usd: double>>,
  outcome: struct<reward: double, success: boolean, termination: string, steps_used: bigint, step_cap_hit: boolean>,
  totals: struct<output_tokens: bigint, output_reasoning_tokens: bigint, input_tokens: bigint, input_cached_tokens: bigint, turns: bigint, cost_usd: double>,
  labels: struct<error_types: array<string>, stall_runs: array<struct<start: bigint, end: bigint, action: string, length: bigint, period: bigint>>, annotator: string>,
  redaction: struct<applied: boolean, policy_version: string, counts: map<string, bigint>>,
  provenance: struct<source: string, source_run_id: string, content_sha256: string>,
  normalization_warnings: array<string>>"""
SCHEMA_DDL = " ".join(DDL.split())
TOP_LEVEL = ("schema_version", "trajectory_id", "tenant_id", "domain", "task_id", "split", "seed", "started_at", "ended_at", "actor", "harness", "steps", "outcome", "totals", "labels", "redaction", "provenance", "normalization_warnings")


def trajectory_schema() -> T.StructType:
    return T._parse_datatype_string(SCHEMA_DDL)


def schema_filename(version: str) -> str:
    return version.replace("/", "-") + ".json"


def serialized(schema: T.StructType) -> str:
    """Byte-stable text of a schema."""
    return json.dumps(json.loads(schema.json()), sort_keys=True, indent=2) + "\n"


def _target(root: dict, node: dict) -> dict:
    ref = node.get("$ref", "")
    found = root.get("$defs", {}).get(ref.rpartition("/")[2]) if isinstance(ref, str) and ref.startswith("#/$defs/") else None
    return found if isinstance(found, dict) else node


def _members(node: dict) -> set | None:
    if isinstance(node.get("enum"), list):
        return set(node["enum"])
    return {node["const"]} if node.get("const") is not None else None


def breaking_changes(old: dict, new: dict, items: bool = False) -> list[str]:
    """Differences of JSON schemas under which an old record may fail: properties removed or newly required, enums narrowed.

    items also looks into array items, and reports changed types.
    """
    out: list[str] = []

    def walk(a: dict, b: dict, path: str, above: tuple) -> None:
        a, b = _target(old, a), _target(new, b)
        if (id(a), id(b)) in above:
            return
        above = (*above, (id(a), id(b)))
        had, has = (x["properties"] if isinstance(x.get("properties"), dict) else {} for x in (a, b))
        must, musts = (set(x["required"]) if isinstance(x.get("required"), list) else set() for x in (a, b))
        for name in sorted(had):
            where = f"{path}.{name}" if path else name
            if name not in has:
                out.append(f"property removed: {where}")
                continue
            if name in musts - must:
                out.append(f"optional property became required: {where}")
            x, y = _target(old, had[name]), _target(new, has[name])
            before, after = _members(x), _members(y)
            if before is not None and after is not None and before - after:
                out.append(f"enum narrowed at {where}: lost {sorted(map(str, before - after))}")
            if items and x.get("type") and y.get("type") and x["type"] != y["type"]:
                out.append(f"type changed at {where}: {x['type']} to {y['type']}")
            if x.get("properties"):
                walk(x, y, where, above)
            if items and isinstance(x.get("items"), dict) and isinstance(y.get("items"), dict):
                walk(x["items"], y["items"], f"{where}[]", above)
        for name in sorted(musts - must - set(had)):
            out.append(f"new required property: {path}.{name}" if path else f"new required property: {name}")

    walk(old, new, "", ())
    return out


PUBLISHED = {VERSION: trajectory_schema}
