"""Batches of raw records: admission, validation without repair, dedup and quarantine."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import ACTION_KINDS, MODES, SCHEMA_DDL, SPLITS, TOKEN_KEYS, TOP_LEVEL, VERSION

MAX_BATCH_BYTES = 32 * 1024 * 1024
MAX_BATCH_RECORDS = 1000
MAX_RECORD_BYTES = 8 * 1024 * 1024
#: In order of the damage a silent repair would do.
SEVERITY = ("reward_present", "step_contiguity", "token_keys_present", "actor_mode_valid", "system_prompt_hash_present", "schema_invalid")
HEX64 = r"^[0-9a-f]{64}\z"

#: From a parsed record to its warnings, an array<string> column.
Mapper = Callable[[Column], Column]
_MAPPERS: dict[str, Mapper] = {}


def register_mapper(source_format: str) -> Callable[[Mapper], Mapper]:
    def add(mapper: Mapper) -> Mapper:
        if source_format in _MAPPERS:
            raise RuntimeError(f"a mapper for {source_format!r} is registered already")
        _MAPPERS[source_format] = mapper
        return mapper

    return add


def registered_formats() -> list[str]:
    return sorted(_MAPPERS)


def keys(v: Column, path: str = "$") -> Column:
    """Key names of a variant object, sorted; empty for anything else."""
    return F.array_sort(F.coalesce(F.map_keys(F.try_variant_get(v, path, "map<string, variant>")), F.array().cast("array<string>")))


@register_mapper("harness_run")
def map_harness_run(v: Column) -> Column:
    """Top-level keys outside the record are dropped, each with a warning."""
    unknown = F.array_except(keys(v), F.array(*map(F.lit, TOP_LEVEL)))
    return F.transform(unknown, lambda k: F.concat(F.lit("dropped unknown top-level field: "), k))


def admit(spark, body: bytes, max_bytes: int = MAX_BATCH_BYTES, max_records: int = MAX_BATCH_RECORDS) -> tuple[int, str, DataFrame | None]:
    """(status, detail, rows): 413 over a cap, 400 for no JSON, 422 for another envelope, else 200 and tenant_id, source_format, raw, position."""
    if len(body) > max_bytes:
        return 413, f"body of {len(body)} bytes; the cap is {max_bytes}", None
    try:
        held = json.loads(body)
    except ValueError:
        return 400, "the body isn't JSON", None
    ok = isinstance(held, dict) and set(held) == {"tenant_id", "records"} and isinstance(held["tenant_id"], str) and isinstance(held["records"], list)
    if not ok or not all(isinstance(r, dict) and set(r) == {"source_format", "body"} and isinstance(r["source_format"], str) and isinstance(r["body"], dict) for r in held["records"]):
        return 422, "expected tenant_id and records of source_format and body", None
    if len(held["records"]) > max_records:
        return 413, f"{len(held['records'])} records; the cap is {max_records}", None
    rows = [(held["tenant_id"], r["source_format"], json.dumps(r["body"]), k) for k, r in enumerate(held["records"])]
    return 200, "", spark.createDataFrame(rows, "tenant_id string, source_format string, raw string, position long")


def read_lines(spark, path: str, tenant_id: str, source_format: str) -> DataFrame:
    """One record's JSON a line, as rows for `normalize`."""
    rows = spark.read.text(path).withColumnRenamed("value", "raw")
    return rows.select(F.lit(tenant_id).alias("tenant_id"), F.lit(source_format).alias("source_format"), "raw", F.monotonically_increasing_id().alias("position"))


def canonical_hash(raw: Column) -> Column:
    """sha256 of the record with sorted keys, compact and ASCII-escaped, as Python writes it."""
    def one(s: str | None) -> str | None:
        try:
            return hashlib.sha256(json.dumps(json.loads(s), sort_keys=True, separators=(",", ":")).encode()).hexdigest()
        except (TypeError, ValueError):
            return hashlib.sha256((s or "").encode()).hexdigest()

    def run(s: pd.Series) -> pd.Series:
        return s.map(one)

    return F.pandas_udf(run, "string")(raw)


def canonical_hash_native(raw: Column) -> Column:
    """Without Python: of the variant's text, whose keys are sorted; other hashes than canonical_hash."""
    return F.sha2(F.coalesce(F.to_json(F.try_parse_json(raw)), raw), 256)


#: path, kind; a '?' after the kind allows null and missing, '!' missing only, '*' null only. Fields of a missing or null object aren't looked at.
TOP_FIELDS = (
    ("schema_version", "string!"), ("trajectory_id", "string"), ("tenant_id", "string"), ("domain", "string"), ("task_id", "string"), ("split", "string"), ("seed", "int"), ("started_at", "string"), ("ended_at", "string"),
    ("actor", "object"), ("actor.model", "string"), ("actor.mode_flag", "object!"), ("harness", "object"), ("harness.name", "string"), ("harness.version", "string"), ("harness.max_steps", "int"), ("harness.tools_sha256", "sha256?"),
    ("harness.user_simulator", "object?"), ("steps", "array"), ("outcome", "object"), ("outcome.success", "bool"), ("outcome.termination", "string"), ("outcome.steps_used", "count"), ("outcome.step_cap_hit", "bool"),
    ("labels", "object!"), ("labels.error_types", "strings!"), ("labels.stall_runs", "array!"), ("labels.annotator", "string?"), ("provenance", "object"), ("provenance.source", "string"), ("provenance.source_run_id", "string?"),
    ("provenance.content_sha256", "sha256"), ("normalization_warnings", "strings!"),
)
#: Objects whose fields are held to their kinds wherever the object is there.
PARTS = {
    "harness.user_simulator": (("model", "string"), ("version", "string")),
    "actor.decoding": (("temperature", "number"), ("top_p", "number"), ("max_tokens", "int?")),
    "totals": (("output_tokens", "count*"), ("output_reasoning_tokens", "count*"), ("input_tokens", "count*"), ("input_cached_tokens", "count*"), ("turns", "count"), ("cost_usd", "number?")),
    "redaction": (("applied", "bool"), ("policy_version", "string"), ("counts", "ints!")),
}
#: Of these objects the reference wants every one.
WHOLE = ("actor.decoding", "totals", "redaction")
STEP_FIELDS = (
    ("index", "count"), ("observation", "object"), ("observation.kind", "string"), ("observation.text", "string"), ("observation.meta", "object!"), ("output", "object"), ("output.text", "string"), ("output.reasoning_text", "string?"),
    ("output.reasoning_token_count", "count?"), ("action", "object"), ("action.kind", "string"), ("action.name", "string?"), ("action.arguments", "object?"), ("action.arguments_raw", "string?"), ("action.text", "string?"), ("action.canonical", "string?"),
    ("result", "object?"), ("result.error_type", "string?"), ("result.text", "string?"), ("latency_ms", "count?"), ("cost_usd", "number?"),
)
STALL_FIELDS = (("start", "count"), ("end", "count"), ("action", "string"), ("length", "count"), ("period", "int?"))
#: Known keys of nested objects; others are an error.
NESTED = {
    "actor": ("model", "mode", "mode_flag", "decoding"), "harness": ("name", "version", "system_prompt_sha256", "tools_sha256", "max_steps", "user_simulator"),
    "outcome": ("reward", "success", "termination", "steps_used", "step_cap_hit"), "provenance": ("source", "source_run_id", "content_sha256"), "labels": ("error_types", "stall_runs", "annotator"),
    **{path: tuple(k for k, _ in fields) for path, fields in PARTS.items()},
}
STEP_KEYS = ("index", "observation", "output", "action", "result", "tokens", "latency_ms", "cost_usd")
STEP_NESTED = {
    "observation": ("kind", "text", "meta"), "output": ("text", "reasoning_text", "reasoning_token_count"), "action": ("kind", "name", "arguments", "arguments_raw", "text", "canonical"), "result": ("status", "error_type", "text"),
}


#: A row for each rule that a value's kind decides. also: types allowed besides; within: looked at only where this path is an object;
#: known: the only keys allowed (wanted is `keys`).
RULE = "array<struct<severity: int, rule: string, field: string, path: string, wanted: string, also: array<string>, within: string, known: array<string>>>"


def _rule(field: str, path: str, kind: str, within: str | None = None, known: tuple = ()) -> dict:
    also = {"?": ["VOID", "MISSING"], "!": ["MISSING"], "*": ["VOID"]}.get(kind[-1], [])
    return dict(severity=SEVERITY.index("schema_invalid"), rule="schema_invalid", field=field, path="$." + path if path else "$", wanted=kind.rstrip("?!*"), also=also, within=within and "$." + within, known=list(known))


def _record_rules(whole: bool) -> list[dict]:
    return [
        *[_rule(p, p, k) for p, k in TOP_FIELDS],
        *[_rule(p, p, "object" if whole else "object!") for p in WHOLE],
        *[_rule(f"{path}.{p}", f"{path}.{p}", k, path) for path, fields in PARTS.items() for p, k in fields],
        *[_rule(path, path, "keys", known=known) for path, known in NESTED.items()],
    ]


STEP_RULES = [
    *[_rule("steps", p, k) for p, k in STEP_FIELDS], _rule("steps", "result.status", "string", "result"), _rule("steps", "", "keys", known=STEP_KEYS),
    *[_rule("steps", path, "keys", known=known) for path, known in STEP_NESTED.items()],
]
TOKEN_RULES = [*[_rule("steps.tokens", f"tokens.{k}", "count*") for k in TOKEN_KEYS], _rule("steps.tokens", "tokens", "keys", known=TOKEN_KEYS)]
STALL_RULES = [*[_rule("labels.stall_runs", p, k) for p, k in STALL_FIELDS], _rule("labels.stall_runs", "", "keys", known=tuple(k for k, _ in STALL_FIELDS))]


def _table(rules: list[dict]) -> str:
    return "from_json('" + json.dumps(rules).replace("'", "\\'") + f"', '{RULE}')"


def _kind(v: str, path: str) -> str:
    """The type of what lies at the path, as SQL; MISSING where nothing does."""
    return f"coalesce(schema_of_variant(try_variant_get({v}, {path}, 'variant')), 'MISSING')"


_NUMBER = "(x.k in ('BIGINT', 'DOUBLE', 'FLOAT') or startswith(x.k, 'DECIMAL'))"
_WHOLE = r"(schema_of_variant(y) = 'BIGINT' or schema_of_variant(y) rlike '^DECIMAL[(][0-9]+,0[)]$')"


def _broken(v: str, rules: list[dict]) -> str:
    """The rows of RULE that the value v breaks, as SQL; what can't be told is broken. x.r is a row, x.k the type of its value."""
    get = lambda kind: f"try_variant_get({v}, x.r.path, '{kind}')"
    tests = {
        "string": "x.k = 'STRING'", "object": "startswith(x.k, 'OBJECT')", "count": f"x.k = 'BIGINT' and {get('bigint')} >= 0", "int": "x.k = 'BIGINT'", "number": _NUMBER, "bool": "x.k = 'BOOLEAN'", "array": "startswith(x.k, 'ARRAY')", "any": "true",
        "keys": f"size(array_except(coalesce(map_keys({get('map<string, variant>')}), array()), x.r.known)) = 0", "sha256": f"x.k = 'STRING' and {get('string')} rlike '^[0-9a-f]{{64}}\\\\z'",
        "strings": f"startswith(x.k, 'ARRAY') and forall({get('array<variant>')}, y -> coalesce(schema_of_variant(y) = 'STRING', false))", "ints": f"startswith(x.k, 'OBJECT') and forall(map_values({get('map<string, variant>')}), y -> coalesce({_WHOLE}, false))",
    }
    ok = " ".join(f"when '{wanted}' then {test}" for wanted, test in tests.items())
    looked = f"(x.r.within is null or startswith({_kind(v, 'x.r.within')}, 'OBJECT'))"
    kinds = f"transform({_table(rules)}, r -> struct(r as r, {_kind(v, 'r.path')} as k))"
    return f"filter({kinds}, x -> {looked} and not (coalesce(case x.r.wanted {ok} end, false) or array_contains(x.r.also, x.k)))"


def violations(v: str = "v", whole: bool = False) -> Column:
    """array<struct(severity, rule, field)> of every broken rule of a parsed record, the column named v.

    Rules of a value's kind are rows of a table that one expression goes through, for the record, its steps and its stalls; the others
    have expressions of their own. whole: a record without one of the objects in WHOLE breaks the schema, as in the reference;
    otherwise only those that are there are checked. Written as SQL, since so many column objects take longer to build than to run.
    """
    rule = lambda name, field, broken: f"if(coalesce({broken}, true), struct({SEVERITY.index(name)} as severity, '{name}' as rule, '{field}' as field), null)"
    at = lambda path, kind="string", x=v: f"try_variant_get({x}, '$.{path}', '{kind}')"
    one_of = lambda path, values, x=v: f"coalesce({at(path, x=x)} in ({', '.join(repr(k) for k in values)}), false)"
    any_broken = lambda x, rules: f"size({_broken(x, rules)}) > 0"
    listed = lambda path: f"coalesce({at(path, 'array<variant>')}, array())"
    steps, stalls = listed("steps"), listed("labels.stall_runs")
    start, end = (f"try_cast({at(k)} as timestamp)" for k in ("started_at", "ended_at"))
    own = [
        rule("reward_present", "outcome.reward", f"not exists(array({_kind(v, chr(39) + '$.outcome.reward' + chr(39))}), k -> {_NUMBER.replace('x.k', 'k')}) or {at('outcome.reward', 'double')} is null or isnan({at('outcome.reward', 'double')})"),
        rule("step_contiguity", "steps", f"exists(transform({steps}, (s, i) -> coalesce({at('index', 'double', 's')} <> i or {_kind('s', chr(39) + '$.index' + chr(39))} = 'STRING', true)), wrong -> wrong)"),
        rule("token_keys_present", "steps.tokens", f"exists({steps}, s -> {any_broken('s', TOKEN_RULES)})"),
        rule("actor_mode_valid", "actor.mode", f"not {one_of('actor.mode', MODES)}"),
        rule("system_prompt_hash_present", "harness.system_prompt_sha256", f"not coalesce({at('harness.system_prompt_sha256')} rlike '^[0-9a-f]{{64}}\\\\z', false)"),
        rule("schema_invalid", "schema_version", f"coalesce({at('schema_version')}, '{VERSION}') <> '{VERSION}'"),
        rule("schema_invalid", "labels.stall_runs", f"exists({stalls}, s -> {any_broken('s', STALL_RULES)})"),
        rule("schema_invalid", "split", f"not {one_of('split', SPLITS)}"),
        rule("schema_invalid", "steps", f"exists({steps}, s -> {any_broken('s', STEP_RULES)} or not {one_of('action.kind', ACTION_KINDS, 's')})"),
        rule("schema_invalid", "ended_at", f"{start} is null or {end} is null or {end} < {start}"),
    ]
    of_table = f"transform({_broken(v, _record_rules(whole))}, x -> struct(x.r.severity as severity, x.r.rule as rule, x.r.field as field))"
    return F.expr(f"array_sort(concat(array_compact(array({', '.join(own)})), {of_table}))")


def normalize(rows: DataFrame, splits: DataFrame | None = None, max_bytes: int = MAX_RECORD_BYTES, whole: bool = False) -> DataFrame:
    """rows (tenant_id, source_format, raw) with v (the parsed record), warnings, rule, detail and field_path; rule is null for a sound record.

    Nothing is repaired: what breaks several rules names the worst, with up to five in the detail. splits
    (task_id, split) must agree with the record's own split; tasks it doesn't hold are admitted. whole: see `violations`.
    """
    parsed = rows.withColumn("v", F.try_parse_json("raw"))
    warnings = F.array().cast("array<string>")
    for source_format, mapper in sorted(_MAPPERS.items()):
        warnings = F.when(F.col("source_format") == source_format, mapper(F.col("v"))).otherwise(warnings)
    mapped = parsed.withColumn("warnings", warnings)
    known = F.coalesce(F.col("source_format").isin(*_MAPPERS), F.lit(False))
    is_object = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    checked = mapped.withColumn("broken", F.when(known & is_object, violations("v", whole)))
    worst = F.try_element_at("broken", F.lit(1))
    listed = F.array_join(F.transform(F.slice("broken", 1, 5), lambda b: F.concat(b["field"], F.lit(": "), b["rule"])), "; ")
    rule = (
        F.when(~known, "unknown_source_format").when(~is_object, "malformed_payload").when(F.octet_length("raw") > max_bytes, "size_cap").when(F.size("broken") > 0, worst["rule"])
    )
    out = checked.withColumns({"rule": rule, "field_path": F.when(rule == worst["rule"], worst["field"]), "detail": F.when(rule == worst["rule"], listed).otherwise(rule)}).drop("broken")
    if splits is None:
        return out
    held = F.broadcast(splits.select(F.col("task_id").alias("_task"), F.col("split").alias("_split")))  # task ids of a split: thousands
    joined = out.join(held, F.try_variant_get("v", "$.task_id", "string") == F.col("_task"), "left")
    differs = F.col("rule").isNull() & F.col("_split").isNotNull() & (F.try_variant_get("v", "$.split", "string") != F.col("_split"))
    return joined.withColumns({"rule": F.when(differs, "split_matches_artifact").otherwise(F.col("rule")), "field_path": F.when(differs, "split").otherwise(F.col("field_path")), "detail": F.when(differs, F.concat(F.lit("the split artifact says "), "_split")).otherwise(F.col("detail"))}).drop("_task", "_split")


#: Copies of one record are first looked at in so many parts, so that no task gets all of them.
COPY_PARTS = 256


def ingest(rows: DataFrame, store: DataFrame | Callable[[DataFrame], DataFrame | None] | None = None, splits: DataFrame | None = None, hashed: Callable[[Column], Column] = canonical_hash, whole: bool = False) -> DataFrame:
    """rows with content_sha256, domain and status: accepted, duplicate or quarantined. Positions differ.

    store: (tenant_id, domain, content_sha256) of records accepted before, or a function that finds them among a table of these keys
    (store.known reads an index for it); only those count for duplicates, besides earlier sound copies in the batch. Quarantined records
    are never duplicates. whole: see `violations`. A record may come any number of times: the first copy of each part of its copies
    is found before the first of all.
    """
    with_hash = rows.withColumn("content_sha256", hashed(F.col("raw")))
    out = normalize(with_hash, splits, whole=whole).withColumn("domain", F.coalesce(F.try_variant_get("v", "$.domain", "string"), F.lit("unknown")))
    key = ["tenant_id", "domain", "content_sha256"]
    held = store(out.select(*key)) if callable(store) else store
    if held is not None:
        out = out.join(held.select(*key).distinct().withColumn("_held", F.lit(True)), key, "left")
    else:
        out = out.withColumn("_held", F.lit(None).cast("boolean"))
    out = out.withColumns({"_sound": F.col("rule").isNull(), "_copy": F.pmod(F.xxhash64("position"), F.lit(COPY_PARTS)) + 1})
    first_in = lambda *parts: F.row_number().over(Window.partitionBy(*key, "_sound", *parts).orderBy("position")) == 1
    out = out.withColumn("_first", first_in("_copy"))
    first = F.col("_first") & first_in(F.when(F.col("_first"), 0).otherwise(F.col("_copy")))
    status = F.when(F.col("_held"), "duplicate").when(~F.col("_sound"), "quarantined").when(first, "accepted").otherwise("duplicate")
    return out.withColumn("status", status).drop("_held", "_sound", "_copy", "_first")


def outcome_counts(results: DataFrame) -> DataFrame:
    return results.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("accepted", "duplicate", "quarantined")])


def body_key(tenant: Column, domain: Column, sha: Column, day: Column) -> Column:
    return F.concat_ws("/", tenant, domain, F.date_format(day, "yyyy-MM-dd"), F.concat(sha, F.lit(".json")))


def quarantine_key(tenant: Column, domain: Column, sha: Column, day: Column) -> Column:
    return F.concat_ws("/", F.lit("_quarantine"), body_key(tenant, domain, sha, day))


def trajectories(accepted: DataFrame) -> DataFrame:
    """Sound records as typed rows; the batch's tenant replaces the record's own."""
    typed = accepted.select("tenant_id", "content_sha256", "warnings", F.from_json("raw", SCHEMA_DDL).alias("t"))
    return typed.select("content_sha256", "t.*", F.col("tenant_id").alias("_tenant"), F.col("warnings").alias("_warnings")).withColumn("tenant_id", F.col("_tenant")).withColumn(
        "normalization_warnings", F.concat(F.coalesce("normalization_warnings", F.array().cast("array<string>")), "_warnings")
    ).drop("_tenant", "_warnings")


def metadata(typed: DataFrame) -> DataFrame:
    """The flat row kept for each episode."""
    return typed.select(
        "trajectory_id", "tenant_id", "domain", "task_id", "split", "seed", F.col("actor.model").alias("actor_model"), F.col("actor.mode").alias("actor_mode"), F.col("harness.name").alias("harness_name"),
        F.col("harness.version").alias("harness_version"), F.col("outcome.reward").alias("reward"), F.col("outcome.success").alias("success"), F.col("outcome.termination").alias("termination"),
        F.col("outcome.steps_used").alias("steps_used"), F.col("outcome.step_cap_hit").alias("step_cap_hit"), F.col("totals.output_tokens").alias("output_tokens"), F.col("totals.output_reasoning_tokens").alias("output_reasoning_tokens"),
        F.col("totals.cost_usd").cast("decimal(12,6)").alias("cost_usd"), F.col("labels.error_types").alias("error_types"), (F.coalesce(F.size("labels.stall_runs"), F.lit(0)) > 0).alias("stalled"), "content_sha256", F.col("started_at").try_cast("timestamp").alias("started_at"),
    )
