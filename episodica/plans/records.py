"""Queries over documents, conversations, parts and event properties, with their SQL.

Patterns with word boundaries run over texts whose other characters than ASCII are read as x, since
engines differ on what a word character is.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import canonical, observation, redaction
from ..functions.profiles import PROFILES, RECEPTACLES, VERBS
from ..operators import corpus, quality, redact, splits
from ..sources import batch
from ..sources import tables as t
from .views import EVENTS



def ascii_text():
    return F.regexp_replace("text", r"[^\x00-\x7F]", "x")


ASCII_SQL = r"regexp_replace(text, '[^\x00-\x7F]', 'x', 'g')"


def _texts(spark, sf_dir):
    return t.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("episode"), F.lit(0).alias("ord"), ascii_text().alias("text"))


def _matches(detector):
    def query(spark, sf_dir):
        rows = _texts(spark, sf_dir).select("episode", F.posexplode(redaction.matches(F.col("text"), detector)).alias("n", "s"))
        return rows.select(F.col("episode").alias("doc_id"), F.col("n").cast("bigint").alias("n"), F.col("s.value").alias("value"), F.length("s.value").alias("size"))

    return query


def _pattern(detector) -> str:
    return detector[1].replace("'", "''")


def _matches_sql(detector) -> str:
    digits = "regexp_replace(v, '[ -]', '', 'g')"
    luhn = f"""list_reduce(list_transform(range(1, len({digits}) + 1), lambda i: case when i % 2 = 0 then
      (case when 2 * substr(reverse({digits}), i, 1)::int > 9 then 2 * substr(reverse({digits}), i, 1)::int - 9 else 2 * substr(reverse({digits}), i, 1)::int end) else substr(reverse({digits}), i, 1)::int end), lambda a, b: a + b) % 10 = 0"""
    valid = {None: "true", "card": f"case when len({digits}) between 13 and 19 then {luhn} else false end", "phone": r"len(regexp_replace(v, '\D', '', 'g')) between 10 and 15"}[detector[3]]
    return f"""with m as (select doc_id, unnest(regexp_extract_all({ASCII_SQL}, '{_pattern(detector)}')) as v, generate_subscripts(regexp_extract_all({ASCII_SQL}, '{_pattern(detector)}'), 1) as k from documents),
ok as (select * from m where {valid})
select doc_id, row_number() over (partition by doc_id order by k) - 1 as n, v as value, cast(len(v) as int) as size from ok"""


def redact_spans(spark, sf_dir):
    """All spans of the default policy, overlaps resolved, over the texts as they are."""
    docs = t.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("episode"), F.lit(0).alias("ord"), "text")
    return redact.text_spans(docs).select(F.col("episode").alias("doc_id"), "start", "end", "cls", "value")


def _source_spans(spark, sf_dir):
    """A source's documents are one episode; all detectors over the texts as they are, overlaps resolved."""
    return redact.text_spans(t.table(spark, sf_dir, "documents").select(F.col("source").alias("episode"), F.col("doc_id").alias("ord"), "text"))


def placeholder_index_all(spark, sf_dir):
    """Numbers of all values by class; placeholder_index has the part of it that SQL can follow."""
    return redact.placeholder_index(_source_spans(spark, sf_dir)).withColumnRenamed("episode", "source")


def redact_counts_all(spark, sf_dir):
    """Counts of all classes; redact_counts has the part of it that SQL can follow."""
    return redact.redaction_counts(_source_spans(spark, sf_dir)).withColumnRenamed("episode", "source")


def redact_documents(spark, sf_dir):
    docs = t.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.sha2(redaction.redact_text(F.col("text")), 256).alias("sha256"))


def redact_conversations(spark, sf_dir):
    """Turns of a conversation share their placeholders."""
    turns = t.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("episode"), F.col("turn").alias("ord"), "text")
    return redact.redact_texts(turns).select(F.col("episode").alias("conv_id"), F.col("ord").alias("turn"), F.sha2("redacted", 256).alias("sha256"))


#: A source's documents are one episode; e-mail addresses only, so that SQL can follow.
def _emails(spark, sf_dir):
    docs = t.table(spark, sf_dir, "documents").select(F.col("source").alias("episode"), F.col("doc_id").alias("ord"), ascii_text().alias("text"))
    return docs.select("episode", "ord", F.explode(redaction.matches(F.col("text"), redaction.EMAIL)).alias("s")).select("episode", "ord", "s.start", "s.cls", "s.value")


def placeholder_index(spark, sf_dir):
    return redact.placeholder_index(_emails(spark, sf_dir)).select(F.col("episode").alias("source"), "value", "number")


def redact_counts(spark, sf_dir):
    return redact.redaction_counts(_emails(spark, sf_dir)).select(F.col("episode").alias("source"), "n", "distinct_values")


EMAILS = f"""e as (select source, doc_id, unnest(regexp_extract_all({ASCII_SQL}, '{_pattern(redaction.EMAIL)}')) as value, generate_subscripts(regexp_extract_all({ASCII_SQL}, '{_pattern(redaction.EMAIL)}'), 1) as k from documents)"""


def classify_email(spark, sf_dir):
    """Classes of the addresses in documents and of some words beside them."""
    rows = _emails(spark, sf_dir).select("value").distinct()
    more = t.table(spark, sf_dir, "part").select(F.concat(F.element_at(F.split("p_name", " "), 1), F.lit("@example.com")).alias("value")).union(t.table(spark, sf_dir, "nation").select("n_name"))
    return rows.union(more).distinct().select("value", canonical.classify_email(F.col("value")).alias("class"))


CLASSES = f"""with {EMAILS}, v as (select value from e union select concat(string_split(p_name, ' ')[1], '@example.com') from part union select n_name from nation)
select value, case when trim(value) = '' then 'email_absent' when not regexp_matches(trim(value), '(?i)^[^@\\s]+@[^@\\s]+\\.[a-z]{{2,}}$') then 'placeholder_like'
  when split_part(lower(trim(value)), '@', 2) in ({", ".join(f"'{x}'" for x in canonical.PLACEHOLDER_DOMAINS)}) or split_part(lower(trim(value)), '@', 1) in ({", ".join(f"'{x}'" for x in canonical.PLACEHOLDER_LOCALS)}) then 'placeholder_like'
  else 'email_present' end as class from v"""


def observation_normalize(spark, sf_dir):
    """Event rows as a harness might print them."""
    events = t.table(spark, sf_dir, "events")
    text = F.concat(F.lit("Step "), F.col("event_id").cast("string"), F.lit(" of 40. You see "), "event_type", F.lit(" ,  took "), F.floor("value").cast("bigint").cast("string"), F.lit("ms [ 3/7 ] . Done\t!"))
    return events.select("event_id", observation.normalize_observation(text).alias("observation"), observation.observation_fingerprint(text).alias("fingerprint"))


def _normalized_sql(text: str) -> str:
    for p in observation.VOLATILE:
        text = f"regexp_replace({text}, '{p}', '', 'gi')"
    text = f"regexp_replace({text}, '\\s+', ' ', 'g')"
    text = f"regexp_replace({text}, '\\s+([.,;:!?])', chr(1), 'g')"
    return f"lower(trim(regexp_replace({text}, '^[\\s.,;:!?()\\[\\]-]+', '')))"


_OBS = "concat('Step ', event_id::varchar, ' of 40. You see ', event_type, ' ,  took ', floor(value)::bigint::varchar, 'ms [ 3/7 ] . Done', chr(9), '!')"
NORMALIZED = f"select event_id, {_normalized_sql(_OBS)} as observation, sha256({_normalized_sql(_OBS)}) as fingerprint from events"

def canonical_text(spark, sf_dir):
    """Part names as commands of the household vocabulary, with a verb put before."""
    parts = t.table(spark, sf_dir, "part")
    verb = F.element_at(F.array(*map(F.lit, VERBS)), (F.col("p_partkey") % len(VERBS) + 1).cast("int"))
    place = F.element_at(F.array(*map(F.lit, RECEPTACLES)), (F.col("p_partkey") % len(RECEPTACLES) + 1).cast("int"))
    text = F.when(F.col("p_partkey") % 5 == 0, F.col("p_name")).otherwise(F.concat(verb, F.lit(" "), "p_name", F.lit(" to "), place, F.lit(" 1")))
    return parts.select("p_partkey", canonical.action_symbol(F.lit("text_action"), F.lit(None).cast("string"), F.lit(None).cast("map<string,variant>"), text, PROFILES["alfworld"]).alias("symbol"))


_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
CANONICAL = f"""with p as (select p_partkey, case when p_partkey % 5 = 0 then p_name else concat({_LIST(VERBS)}[p_partkey % {len(VERBS)} + 1], ' ', p_name, ' to ', {_LIST(RECEPTACLES)}[p_partkey % {len(RECEPTACLES)} + 1], ' 1') end as text from part),
tok as (select p_partkey, regexp_extract_all(lower(text), '[a-z0-9_]+') as w from p),
vb as (select *, case {" ".join(f"when array_to_string(w, ' ') || ' ' like '{v} %' then '{v}'" for v in sorted(VERBS, key=lambda v: -len(v.split())))} end as verb from tok),
rest as (select *, w[len(string_split(verb, ' ')) + 1:] as r from vb where verb is not null),
flat as (select p_partkey, verb, unnest(r) as x, generate_subscripts(r, 1) as k from rest),
seg as (select *, x in ('from','with','in','on','to','at') as con, sum((x in ('from','with','in','on','to','at'))::int) over (partition by p_partkey order by k) as s from flat),
grp as (select p_partkey, verb, s, con, min(k) as k, case when con then min(x) when bool_or(x in ({", ".join(f"'{x}'" for x in RECEPTACLES)})) then '<recep>' else '<obj>' end as out from seg group by p_partkey, verb, s, con),
sym as (select p_partkey, verb, string_agg(out, ' ' order by k) as tail from grp group by 1, 2)
select v.p_partkey, case when len(v.w) = 0 then 'noop' when v.verb is null then concat('text:', v.w[1]) when s.tail is null then v.verb else concat(v.verb, ' ', s.tail) end as symbol from vb v left join sym s using (p_partkey)"""


def code_symbols(spark, sf_dir):
    """Invented cells: calls of dotted names in Python source."""
    parts = t.table(spark, sf_dir, "part")
    source = F.concat(F.lit("import pandas as pd\nx = pd."), F.regexp_replace("p_type", "[^A-Za-z]", "_"), F.lit("(open('"), "p_name", F.lit("').read())\nprint(x"), F.when(F.col("p_size") % 7 == 0, "").otherwise(")"))
    return parts.select("p_partkey", canonical.code_symbol(source).alias("symbol"))


def tool_symbols(spark, sf_dir):
    """Event properties as tool arguments."""
    events = t.table(spark, sf_dir, "events")
    arguments = F.try_variant_get(F.try_parse_json("props"), "$", "map<string, variant>")
    return events.select("event_id", canonical.action_symbol(F.lit("tool_call"), F.col("event_type"), arguments, F.lit(None).cast("string"), PROFILES["tau2_retail"]).alias("symbol"))


TOOLS = """select event_id, concat('tool:', event_type, '(', (select string_agg(concat(k, ':', case json_type(props, '$.' || k) when 'UBIGINT' then 'int' when 'BIGINT' then 'int' when 'DOUBLE' then 'float' when 'VARCHAR' then 'str' when 'BOOLEAN' then 'bool' else 'null' end), ',' order by k) from (select unnest(json_keys(props)) as k)), ',email:email_absent)') as symbol from events"""


def props_validate(spark, sf_dir):
    """Which rule a property record breaks: no JSON, no k, or k no whole number."""
    events = t.table(spark, sf_dir, "events")
    raw = F.when(F.col("event_id") % 11 == 0, F.substring("props", 1, 4)).when(F.col("event_id") % 13 == 0, F.regexp_replace("props", '"k"', '"j"')).when(F.col("event_id") % 17 == 0, F.regexp_replace("props", r"(\d+)", '"$1"')).otherwise(F.col("props"))
    v = F.try_parse_json(raw)
    kind = canonical.type_name(F.try_variant_get(v, "$.k", "variant"))
    rule = F.when(v.isNull(), "malformed_payload").when(F.try_variant_get(v, "$.k", "variant").isNull(), "missing").when(kind != "int", "wrong_type").otherwise("ok")
    return events.select(rule.alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


PROPS = r"""with r as (select case when event_id % 11 = 0 then substr(props, 1, 4) when event_id % 13 = 0 then replace(props, '"k"', '"j"') when event_id % 17 = 0 then regexp_replace(props, '(\d+)', '"\1"', 'g') else props end as raw from events)
select case when not json_valid(raw) then 'malformed_payload' when json_type(try_cast(raw as json), '$.k') is null then 'missing' when json_type(try_cast(raw as json), '$.k') not in ('UBIGINT', 'BIGINT') then 'wrong_type' else 'ok' end as rule, count(*) as n from r group by 1"""


def dedup_content(spark, sf_dir):
    """The first document of each content, by its hash."""
    docs = t.table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_sha256"))
    return docs.groupBy("content_sha256").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


def duplicate_rate(spark, sf_dir):
    rows = t.table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("content_sha256"))
    return quality.duplicate_rate(rows).select("n", "duplicates", F.round("rate", 9).alias("rate"))


def step_contiguity(spark, sf_dir):
    return quality.contiguity(t.conversation_steps(spark, sf_dir))


CONTIGUITY = "select conv_id as trajectory_id, count(*) as n_steps, min(turn) = 0 and max(turn) = count(*) - 1 and count(distinct turn) = count(*) as contiguous from conversations group by 1"


def _quality_rows(spark, sf_dir):
    steps = quality.contiguity(t.conversation_steps(spark, sf_dir)).withColumnRenamed("n_steps", "steps")
    per = t.table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("trajectory_id")).agg(F.count_if(F.length("text") > 40).alias("complete_steps"), F.max(F.when(F.col("turn") == 0, F.sha2("text", 256))).alias("content_sha256"), F.max("turn").cast("double").alias("reward"), (F.max("turn") > 4).alias("success"))
    return steps.join(per, "trajectory_id")


def quality_report(spark, sf_dir):
    rows = quality.quality_report(_quality_rows(spark, sf_dir), submitted=None, redaction_recall=0.99)
    return rows.select("check", F.round("value", 9).alias("value"), "threshold", "comparison", "passed", "action")


QUALITY = """with e as (select conv_id, count(*) as steps, count(*) filter (len(text) > 40) as complete, max(case when turn = 0 then sha256(text) end) as h, max(turn) > 4 as success, min(turn) = 0 and max(turn) = count(*) - 1 and count(distinct turn) = count(*) as contiguous from conversations group by 1),
v as (select 'normalization_success_rate' as "check", 1.0::double as value, 0.99 as threshold, '>' as comparison, 'alert' as action
union all select 'reward_presence', 1.0, 1.0, '>=', 'quarantine' union all select 'step_contiguity', avg(contiguous::int), 1.0, '>=', 'quarantine' from e
union all select 'token_accounting_completeness', sum(complete) / sum(steps), 0.999, '>', 'alert' from e union all select 'duplicate_rate', (count(*) - count(distinct h)) / count(*), 0.001, '<', 'alert' from e
union all select 'redaction_recall', 0.99, 0.98, '>', 'block_corpus_creation' union all select 'corpus_class_balance', avg(success::int), null, 'report_only', 'report_only' from e)
select "check", round(value, 9) as value, threshold::double as threshold, comparison, case comparison when '>' then value > threshold when '>=' then value >= threshold when '<' then value < threshold else true end as passed, action from v"""


def token_completeness(spark, sf_dir):
    """Null in a part makes the total null; never zero."""
    rows = t.table(spark, sf_dir, "events")
    part = lambda k: F.when(F.col("event_id") % k != 0, F.floor("value").cast("bigint"))
    tokens = F.struct(*[part(k).alias(n) for n, k in (("output_visible", 7), ("output_tool_args", 11), ("output_reasoning", 13))])
    out = rows.select("user_id", tokens.alias("t")).withColumns({"total": quality.output_total(F.col("t")), "complete": quality.tokens_complete(F.col("t"), ("output_visible", "output_tool_args", "output_reasoning"))})
    return out.groupBy("user_id").agg(F.count_if("complete").alias("complete"), F.count(F.lit(1)).alias("steps"), F.sum("total").alias("known_total"))


TOKENS = """with s as (select user_id, case when event_id % 7 <> 0 then floor(value)::bigint end as a, case when event_id % 11 <> 0 then floor(value)::bigint end as b, case when event_id % 13 <> 0 then floor(value)::bigint end as c from events)
select user_id, count(*) filter (a is not null and b is not null and c is not null) as complete, count(*) as steps, cast(sum(a + b + c) as bigint) as known_total from s group by 1"""

SEED = 20260801


def split_hash_assign(spark, sf_dir):
    return splits.hash_split(t.table(spark, sf_dir, "customer"), 60, 40, SEED, "c_custkey")


_SPLIT = f"""hs as (select task_id, row_number() over (order by k, task_id) as r from (select distinct c_custkey::varchar as task_id, sha256('{SEED}:' || c_custkey::varchar) as k from customer))"""


def split_disjoint(spark, sf_dir):
    """Sources of all documents as splits, one by language and last digits of the id: those met an even number of times train, those met a multiple of three times test."""
    docs = t.table(spark, sf_dir, "documents").filter("lang is not null and source is not null")
    met = docs.groupBy(F.concat_ws("-", "lang", (F.col("doc_id") % 50).cast("string")).alias("sha256"), "source").agg(F.count(F.lit(1)).alias("n"))
    halves = {half: F.collect_list(F.when(F.col("n") % k == 0, F.col("source"))).alias(half) for half, k in (("train", 2), ("test", 3))}
    return splits.constraint_violations(met.groupBy("sha256").agg(*halves.values()))


DISJOINT = """with met as (select concat(lang, '-', doc_id % 50) as detail, source, count(*) as n from documents where lang is not null and source is not null group by 1, 2),
s as (select detail, count(*) filter (n % 2 = 0) as train, count(*) filter (n % 3 = 0) as test, count(*) filter (n % 6 = 0) as shared from met group by 1)
select 'halves_non_empty' as rule, detail from s where train = 0 or test = 0 union all select 'halves_disjoint', detail from s where shared > 0"""


def _event_half(episodes, which, seed):
    """Tasks of a half: six tenths of all tasks, by their hash, train."""
    halves = splits.hash_halves(episodes, 6, seed)
    return halves.filter(F.col("split") == which).select(F.col("task_id").cast("bigint").alias("task_id"))


def _event_train(spark, sf_dir):
    episodes = t.event_episodes(t.event_steps(spark, sf_dir))
    return episodes, _event_half(episodes, "train", SEED)


def _half_sql(which: str, seed: int) -> str:
    """Tasks of a half, as a query over episodes."""
    return f"""(select task_id from (select task_id, row_number() over (order by sha256('{seed}:' || task_id), task_id) <= count(*) over () * 6 // 10 as train from (select distinct task_id from episodes)) where {'' if which == 'train' else 'not '}train)"""


def corpus_eligible(spark, sf_dir):
    episodes, train = _event_train(spark, sf_dir)
    rows, _ = corpus.composed(corpus.eligible(episodes, train), "paired")
    return rows.select("trajectory_id", "task_id", "mode")


ELIGIBLE = f"""with {EVENTS}, el as (select * from episodes where task_id in {_half_sql('train', SEED)}), ok as (select task_id from el group by 1 having count(distinct mode) = 2) select trajectory_id, task_id, mode from el where task_id in (select task_id from ok)"""


def corpus_pass_rates(spark, sf_dir):
    episodes, train = _event_train(spark, sf_dir)
    return corpus.pass_rates(corpus.eligible(episodes, train))


PASS_RATES = f"with {EVENTS} select mode, round_even(avg(success::int), 6) as pass_rate, count(*) as episodes from episodes where task_id in {_half_sql('train', SEED)} group by 1"


def corpus_contamination(spark, sf_dir):
    """Train tasks of one split that are test tasks of another."""
    episodes, train = _event_train(spark, sf_dir)
    return corpus.contamination(train, _event_half(episodes, "test", SEED + 1))


def task_outcome(spark, sf_dir):
    return corpus.task_outcomes(t.event_episodes(t.event_steps(spark, sf_dir)))


OUTCOMES = "oc as (select task_id, coalesce(arg_min(success, trajectory_id) filter (mode = 'no_think'), bool_or(success)) as success from episodes group by 1)"
U = f"((('0x' || substr(sha256('{SEED}:' || task_id::varchar), 1, 12))::bigint + 0.5::double) / (1::bigint << 48))"


def _sampled(sampler, size):
    return lambda spark, sf_dir: sampler(task_outcome(spark, sf_dir), size, SEED)


STRATIFIED = f"""with {EVENTS}, {OUTCOMES}, n as (select count(*) filter (success) as won, count(*) filter (not success) as lost from oc),
q as (select won, lost, least(won, round_even(40 * won / (won + lost), 0)::bigint) as w0 from n), q2 as (select least(lost, 40 - w0) as nl, won from q), q3 as (select nl, least(won, 40 - nl) as nw from q2)
select task_id from (select task_id, success, row_number() over (partition by success order by {U}, task_id) as r from oc) cross join q3 where r <= case when success then nw else nl end"""


def merkle_root(spark, sf_dir):
    return corpus.merkle_root(t.table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("sha256")))


def ingest_conversations(spark, sf_dir):
    """Conversations as whole records of which some break a rule or come twice; counts by status and rule.

    Those that break the schema end before they start, have no totals, or a negative number of steps used.
    """
    first = t.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    number, third = F.col("conv_id") % 10, F.floor(F.col("conv_id") / 10) % 3
    four = lambda k: (number == 4) & (third == k)
    turns = F.size("turns")
    totals = F.struct((turns * 2).alias("output_tokens"), F.lit(0).alias("output_reasoning_tokens"), turns.alias("input_tokens"), F.lit(0).alias("input_cached_tokens"), turns.alias("turns"))
    tokens = F.expr("named_struct('input_total', 1L, 'input_cached', 0L, 'output_visible', 2L, 'output_tool_args', 0L, 'output_reasoning', 0L)")
    step = lambda s: F.struct((s["turn"] + F.when(number == 3, 1).otherwise(0)).alias("index"), F.struct(F.lit("message").alias("kind"), s["text"].alias("text")).alias("observation"), F.struct(F.lit("").alias("text")).alias("output"), F.struct(F.lit("noop").alias("kind")).alias("action"), tokens.alias("tokens"))
    record = F.to_json(
        F.struct(
            F.lit("trajectory/1.0").alias("schema_version"), F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("trajectory_id"), F.lit("body").alias("tenant_id"), F.lit("chat").alias("domain"), F.col("conv_id").cast("string").alias("task_id"), F.lit("unassigned").alias("split"),
            F.lit(0).alias("seed"), F.lit("2026-01-01T00:00:00Z").alias("started_at"), F.when(four(0), "2025-01-01T00:00:00Z").otherwise("2026-01-01T00:01:00Z").alias("ended_at"),
            F.struct(F.lit("m").alias("model"), F.when(number == 5, "maybe").otherwise("think").alias("mode"), F.struct(F.lit(0.0).alias("temperature"), F.lit(1.0).alias("top_p")).alias("decoding")).alias("actor"),
            F.struct(F.lit("h").alias("name"), F.lit("1").alias("version"), F.when(number == 6, "none").otherwise(F.sha2(F.lit("p"), 256)).alias("system_prompt_sha256"), F.lit(9).alias("max_steps")).alias("harness"),
            F.transform("turns", step).alias("steps"), F.struct(F.when(number != 7, 1.0).alias("reward"), F.lit(True).alias("success"), F.lit("done").alias("termination"), F.when(four(1), -1).otherwise(turns).alias("steps_used"), F.lit(False).alias("step_cap_hit")).alias("outcome"),
            F.when(~four(2), totals).alias("totals"), F.struct(F.lit(False).alias("applied"), F.lit(redaction.POLICY_VERSION).alias("policy_version")).alias("redaction"),
            F.struct(F.lit("t").alias("source"), F.sha2(F.lit("x"), 256).alias("content_sha256")).alias("provenance"),
        )
    )
    rows = first.select(F.lit("tenant").alias("tenant_id"), F.when(number == 8, "other").otherwise("harness_run").alias("source_format"), F.when(number == 9, F.substring(record, 1, 50)).otherwise(record).alias("raw"), F.col("conv_id").alias("position"))
    results = batch.ingest(rows.union(rows.filter("position % 20 = 0").withColumn("position", F.col("position") + 1_000_000)), whole=True)
    return results.groupBy("status", F.coalesce("rule", F.lit("-")).alias("rule")).agg(F.count(F.lit(1)).alias("n"))


INGEST = """with c as (select distinct conv_id from conversations), r as (select case conv_id % 10 when 3 then 'step_contiguity' when 4 then 'schema_invalid' when 5 then 'actor_mode_valid' when 6 then 'system_prompt_hash_present' when 7 then 'reward_present' when 8 then 'unknown_source_format' when 9 then 'malformed_payload' else '-' end as rule from c)
select case when rule = '-' then 'accepted' else 'quarantined' end as status, rule, count(*) as n from r group by all
union all select 'duplicate', '-', count(*) from c where conv_id % 20 = 0 having count(*) > 0"""

QUERIES = {
    "redact_spans_email": _matches(redaction.EMAIL), "redact_spans_card": _matches(redaction.CREDIT_CARD), "redact_spans_phone": _matches(redaction.PHONE), "redact_spans": redact_spans, "redact_documents": redact_documents, "redact_conversations": redact_conversations,
    "placeholder_index": placeholder_index, "redact_counts": redact_counts, "placeholder_index_all": placeholder_index_all, "redact_counts_all": redact_counts_all, "classify_email": classify_email, "observation_normalize": observation_normalize, "canonical_text": canonical_text, "code_symbols": code_symbols, "tool_symbols": tool_symbols, "props_validate": props_validate,
    "dedup_content": dedup_content, "duplicate_rate": duplicate_rate, "step_contiguity": step_contiguity, "quality_report": quality_report, "token_completeness": token_completeness, "split_hash_assign": split_hash_assign, "split_disjoint": split_disjoint, "corpus_eligible": corpus_eligible,
    "corpus_pass_rates": corpus_pass_rates, "corpus_contamination": corpus_contamination, "task_outcome": task_outcome, "sample_random_n": _sampled(corpus.sample_random, 40), "sample_stratified": _sampled(corpus.sample_stratified, 40), "sample_failure_weighted": _sampled(corpus.sample_failure_weighted, 40),
    "merkle_root": merkle_root, "ingest_conversations": ingest_conversations,
}

ORACLES = {
    "redact_spans_email": _matches_sql(redaction.EMAIL), "redact_spans_card": _matches_sql(redaction.CREDIT_CARD), "redact_spans_phone": _matches_sql(redaction.PHONE),
    "placeholder_index": f"with {EMAILS}, f as (select source, value, min((doc_id, k)) as first from e group by 1, 2) select source, value, cast(row_number() over (partition by source order by first) as int) as number from f",
    "redact_counts": f"with {EMAILS} select source, count(*) as n, count(distinct value) as distinct_values from e group by 1",
    "classify_email": CLASSES, "observation_normalize": NORMALIZED, "canonical_text": CANONICAL, "tool_symbols": TOOLS, "props_validate": PROPS,
    "dedup_content": "select sha256(text) as content_sha256, min(doc_id) as doc_id, count(*) as copies from documents group by 1",
    "duplicate_rate": "select count(*) as n, count(*) - count(distinct text) as duplicates, round((count(*) - count(distinct text)) / count(*), 9) as rate from documents",
    "step_contiguity": CONTIGUITY, "quality_report": QUALITY, "token_completeness": TOKENS,
    "split_hash_assign": f"with {_SPLIT} select task_id, case when r <= 60 then 'train' else 'test' end as split from hs where r <= 100",
    "split_disjoint": DISJOINT, "corpus_eligible": ELIGIBLE, "corpus_pass_rates": PASS_RATES,
    "corpus_contamination": f"with {EVENTS} select task_id from {_half_sql('train', SEED)} where task_id in {_half_sql('test', SEED + 1)}",
    "task_outcome": f"with {EVENTS}, {OUTCOMES} select * from oc",
    "sample_random_n": f"with {EVENTS}, {OUTCOMES} select task_id from oc order by {U}, task_id limit 40", "sample_stratified": STRATIFIED,
    "sample_failure_weighted": f"with {EVENTS}, {OUTCOMES} select task_id from oc order by -ln({U}) / case when success then 1.0 else 2.0 end, task_id limit 40",
    "merkle_root": "select sha256(string_agg(h, chr(10) order by h)) as merkle_root from (select sha256(text) as h from documents)",
    "ingest_conversations": INGEST,
}
