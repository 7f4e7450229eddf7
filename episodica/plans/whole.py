"""Queries over whole envelopes, nested records and the kinds of their fields, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import drift, redact_records
from ..sources import envelopes
from ..sources import tables as t
from . import redacted

BYTES, RECORDS = 5000, 75


def _envelopes(spark, sf_dir):
    """A user's events as one batch. By user some envelopes are cut off, lack their tenant, hold one key more, or a record without its body."""
    events = t.table(spark, sf_dir, "events")
    k = F.col("user_id") % 11
    body = F.when((k == 5) & (F.col("event_id") % 2 == 0), '"text"').otherwise(F.col("props"))
    one = F.concat(F.lit('{"source_format": "'), "event_type", F.lit('", "body": '), body, F.lit("}"))
    lists = events.select("user_id", F.struct("event_id", one.alias("one")).alias("e")).groupBy("user_id").agg(F.array_sort(F.collect_list("e")).alias("e"))
    inner = F.array_join(F.transform("e", lambda e: e["one"]), ", ")
    tenant = F.when(k == 3, "").when(k == 4, '"tenant_id": 7, ').otherwise('"tenant_id": "t", ')
    text = F.concat(F.lit("{"), tenant, F.when(k == 6, '"more": 1, ').otherwise(""), F.lit('"records": ['), inner, F.lit("]}"))
    return lists.select(F.col("user_id").alias("envelope"), F.when(k == 2, F.substring(text, 1, 500)).otherwise(text).alias("body"))


def ingest_envelopes(spark, sf_dir):
    """Envelopes by status, and the records of those admitted: how many, of how many formats, and the sum of their k."""
    found = envelopes.admitted(_envelopes(spark, sf_dir), BYTES, RECORDS)
    rows = envelopes.records(found, RECORDS).groupBy("envelope").agg(F.count(F.lit(1)).alias("n"), F.sum(F.get_json_object("raw", "$.k").cast("long")).alias("k"), F.collect_set("source_format").alias("formats"), F.count_distinct("position").alias("places"))
    both = found.select("envelope", "status").join(rows, "envelope", "left")
    return both.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("records"), F.sum("k").alias("k"), F.sum(F.size("formats")).alias("formats"), F.sum("places").alias("places"))


ENVELOPES = f"""with one as (select user_id, event_id, user_id % 11 as k, concat('{{"source_format": "', event_type, '", "body": ', case when user_id % 11 = 5 and event_id % 2 = 0 then '"text"' else props end, '}}') as one from events),
text as (select user_id, any_value(k) as k, concat('{{', case when any_value(k) = 3 then '' when any_value(k) = 4 then '"tenant_id": 7, ' else '"tenant_id": "t", ' end, case when any_value(k) = 6 then '"more": 1, ' else '' end, '"records": [', string_agg(one, ', ' order by event_id), ']}}') as body from one group by 1),
env as (select user_id, case when k = 2 then body[1:500] else body end as body from text),
parsed as (select user_id, strlen(body) as size, case when json_valid(body) then body::json end as j from env),
seen as (select *, list_sort(json_keys(j)) as keys, json_extract(j, '$.records[*]') as recs from parsed),
judged as (select user_id, recs, case when size > {BYTES} then 413 when j is null then 400
  when not coalesce(keys = ['records', 'tenant_id'] and json_type(j, '$.tenant_id') = 'VARCHAR' and json_type(j, '$.records') = 'ARRAY' and len(list_filter(recs, lambda r: not (list_sort(json_keys(r)) = ['body', 'source_format'] and json_type(r, '$.source_format') = 'VARCHAR' and json_type(r, '$.body') = 'OBJECT'))) = 0, false) then 422
  when len(recs) > {RECORDS} then 413 else 200 end as status from seen),
rows as (select user_id, status, unnest(case when status = 200 then recs else [null::json] end) as r from judged),
per as (select user_id, status, count(r) as n, sum((r->>'$.body.k')::bigint) as k, count(distinct r->>'$.source_format') as formats from rows group by 1, 2)
select status::int as status, count(*) as n, sum(nullif(n, 0))::bigint as records, sum(k)::bigint as k, sum(case when n > 0 then formats end)::bigint as formats, sum(nullif(n, 0))::bigint as places from per group by 1"""

#: Where a step's texts are, in order; the fifth and sixth lie within nested arguments.
PLACES = ("observation.text", "output.text", "output.reasoning_text", "action.text", "action.arguments.a.t", "action.arguments.z[0]", "action.arguments_raw", "result.text")


def _nested(spark, sf_dir):
    """Conversations as typed records: a step's texts are its turn's and the turn's before, at places that change by turn."""
    rows = t.table(spark, sf_dir, "conversations")
    before = F.coalesce(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(""))
    rows = rows.withColumn("before", before)
    at = lambda k: F.when(F.col("turn") % 8 == k, F.col("text")).when((F.col("turn") + 3) % 8 == k, F.col("before")).otherwise("")
    arguments = F.parse_json(F.to_json(F.struct(F.col("turn").alias("n"), F.array(at(5), F.lit("1")).alias("z"), F.struct(at(4).alias("t"), F.lit(True).alias("f")).alias("a"))))
    step = F.struct(
        F.col("turn").alias("index"), F.struct(at(0).alias("text")).alias("observation"), F.struct(at(1).alias("text"), at(2).alias("reasoning_text")).alias("output"),
        F.struct(at(3).alias("text"), arguments.alias("arguments"), at(6).alias("arguments_raw")).alias("action"), F.struct(at(7).alias("text")).alias("result"),
    )
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.to_json(step).alias("step")))).alias("steps")).select("conv_id", F.transform("steps", lambda s: F.from_json(s["step"], STEP)).alias("steps"))


STEP = "index long, observation struct<text: string>, output struct<text: string, reasoning_text: string>, action struct<text: string, arguments: variant, arguments_raw: string>, result struct<text: string>"


def redact_nested(spark, sf_dir):
    """Every text of a record after redaction, nested arguments among them, by its place; values are numbered through the record."""
    found = redact_records.redact_trajectories(_nested(spark, sf_dir)).select("conv_id", F.explode("steps").alias("s"))
    inside = lambda path: F.try_variant_get("s.action.arguments", path, "string")
    texts = [inside("$.a.t") if ".a.t" in p else inside("$.z[0]") if "z[0]" in p else F.col(f"s.{p}") for p in PLACES]
    return found.select("conv_id", F.col("s.index").alias("turn"), F.posexplode(F.array(*texts)).alias("place", "text")).select("conv_id", "turn", F.col("place").cast("int").alias("place"), F.sha2("text", 256).alias("sha256"))


_NESTED = """select conv_id as ep, turn * 8 + p as ord, case when turn % 8 = p then text when (turn + 3) % 8 = p then before else '' end as text
from (select conv_id, turn, text, coalesce(lag(text) over (partition by conv_id order by turn), '') as before from conversations) cross join (select unnest(range(8)) as p)"""
NESTED = f"with {redacted.spans(_NESTED)}, {redacted.REDACTED} select ep as conv_id, ord // 8 as turn, (ord % 8)::int as place, sha256(redacted) as sha256 from redacted"

def schema_drift(spark, sf_dir):
    """What changes in the properties of events from week to week: by week k is a text in part, renamed, repeated in a list, or beside a nested object."""
    events = t.table(spark, sf_dir, "events")
    n = F.regexp_extract("props", "([0-9]+)", 1)
    week = F.date_format(F.date_trunc("week", F.col("ts").cast("timestamp")), "yyyy-MM-dd")
    turn, odd = F.pmod(F.datediff(F.date_trunc("week", F.col("ts").cast("timestamp")), F.lit("2020-01-06").cast("date")) / 7, F.lit(5)).cast("int"), F.col("event_id") % 2 == 1
    raw = (
        F.when(turn == 1, F.when(odd, F.format_string('{"k": "%s"}', n)).otherwise(F.col("props"))).when(turn == 2, F.format_string('{"j": %s, "m": {"a": {"b": %s}}}', n, n))
        .when(turn == 3, F.when(odd, F.format_string('{"k": [%s, {"c": true}]}', n)).otherwise(F.substring("props", 1, 3))).otherwise(F.col("props"))
    )
    rows = events.select(week.alias("week"), raw.alias("raw"))
    return drift.drift(drift.field_kinds(rows, "week", "raw"), "week")


DRIFT = r"""with e as (select event_id, props, regexp_extract(props, '([0-9]+)', 1) as n, strftime(date_trunc('week', ts), '%Y-%m-%d') as week, (date_diff('day', date '2020-01-06', date_trunc('week', ts)::date) // 7) % 5 as turn from events),
r as (select week, event_id, case when turn = 1 then case when event_id % 2 = 1 then concat('{"k": "', n, '"}') else props end when turn = 2 then concat('{"j": ', n, ', "m": {"a": {"b": ', n, '}}}')
  when turn = 3 then case when event_id % 2 = 1 then concat('{"k": [', n, ', {"c": true}]}') else props[1:3] end else props end as raw from e),
tot as (select week, count(*) as total from r group by 1),
nodes as (select r.week, r.event_id, regexp_replace(t.fullkey, '\[[0-9]+\]', '[]', 'g') as path,
  case t.type when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'NULL' then 'null' when 'OBJECT' then 'object' when 'ARRAY' then 'array' else 'number' end as kind
  from (select * from r where json_valid(raw)) r, json_tree(r.raw::json) t where t.fullkey <> '$'),
f as (select week, path, string_agg(distinct kind, '|' order by kind) as kinds, count(distinct event_id) as n from nodes group by 1, 2),
g as (select f.week, path, kinds, n = total as required from f join tot using (week)),
w as (select week as was, lead(week) over (order by week) as now from (select distinct week from g)),
o as (select now, path, kinds as a, required as ra from g join w on g.week = w.was where now is not null), p as (select now, path, kinds as b, required as rb from g join w on g.week = w.now),
j as (select coalesce(o.now, p.now) as week, coalesce(o.path, p.path) as path, a, ra, b, rb from o full join p on o.now = p.now and o.path = p.path)
select week, path, unnest(list_filter([case when a is null then 'added' end, case when b is null then 'removed' end, case when a <> b then concat('kinds changed: ', a, ' > ', b) end, case when not ra and rb then 'became required' end, case when ra and not rb then 'became optional' end], lambda x: x is not null)) as change from j"""

QUERIES = {"ingest_envelopes": ingest_envelopes, "redact_nested": redact_nested, "schema_drift": schema_drift}
ORACLES = {"ingest_envelopes": ENVELOPES, "redact_nested": NESTED, "schema_drift": DRIFT}
