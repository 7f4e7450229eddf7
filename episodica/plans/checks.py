"""Queries for what the other catalogues don't reach: detectors of arguments, orders of reports, rendering, keys, schemas, splits."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import profiles, redaction, stats
from ..operators import constraints, contrast, corpus, errors, ngrams, quality, redact, splits, stalls
from ..schema import breaking_changes, schema_filename
from ..sources import batch
from ..sources import tables as t
from .episodes import FREQUENCY, NGRAMS, REPEATS, CYCLES, MERGED, UNPAIRED, _events, _predicates, _rates
from .records import _half_sql
from .views import ERRORS, EVENTS

SEED = 20260801
#: Conversations as episodes: an assistant's turn is a tool call with the turn's first and last word, the other turns are observed.
CHAT = profiles.Profile("chat", sensitive={"*": ("first",), "lookup": ("last",)})


def _chat_steps(spark, sf_dir):
    rows = t.table(spark, sf_dir, "conversations")
    words = F.split(F.trim("text"), r"\s+")
    call = F.col("role") == "assistant"
    return rows.select(
        F.col("conv_id").alias("trajectory_id"), F.col("turn").alias("idx"), F.count(F.lit(1)).over(Window.partitionBy("conv_id")).alias("n_steps"), F.lit(False).alias("step_cap_hit"),
        F.when(call, "tool_call").otherwise("noop").alias("kind"), F.when(F.col("turn") % 4 == 1, "lookup").otherwise("other").alias("tool"),
        F.when(call, F.create_map(F.lit("first"), F.element_at(words, 1), F.lit("last"), F.element_at(words, -1))).alias("arguments"),
        F.when(call, "").otherwise(F.col("text")).alias("observation"), F.lit("ok").alias("result_status"), F.lit(None).cast("string").alias("error_type"),
    )


def fabricated_arguments(spark, sf_dir):
    """How often each step names a word that nothing observed so far held."""
    events = errors.error_events(_chat_steps(spark, sf_dir), profile=CHAT)
    return events.groupBy("trajectory_id", "step_index", "error_type").agg(F.count(F.lit(1)).alias("n"))


FABRICATED = r"""with s as (select conv_id, turn, role, string_split_regex(regexp_replace(text, '^ +| +$', '', 'g'), '\s+') as w,
  string_agg(case when role = 'assistant' then '' else text end, ' ') over (partition by conv_id order by turn) as seen from conversations),
v as (select conv_id, turn, w[1] as value, seen from s where role = 'assistant' union all select conv_id, turn, w[len(w)], seen from s where role = 'assistant' and turn % 4 = 1)
select conv_id as trajectory_id, turn as step_index, 'fabricated_auth_argument' as error_type, count(*) as n from v where trim(value) <> '' and not contains(seen, value) group by 1, 2"""


def error_frequency_ranked(spark, sf_dir):
    """Rows of the report in its order."""
    steps, episodes = _events(spark, sf_dir)
    rows = errors.error_frequency(errors.error_events(t.event_detector_steps(steps)), episodes)
    order = Window.orderBy(F.desc("share_of_all_errors"), "error_type")
    return rows.select(F.row_number().over(order).alias("place"), "error_type", "occurrences")


RANKED = f"with f as ({FREQUENCY}) select cast(row_number() over (order by occurrences desc, error_type) as int) as place, error_type, occurrences from f"


def ngram_top(spark, sf_dir):
    """The report's first rows: n-grams by |lift|, count and gram."""
    rows = ngrams.ngram_report(*_events(spark, sf_dir))
    order = Window.orderBy(F.round(F.abs("lift"), 9).desc(), F.desc("count"), F.array_join("ngram", " "))
    return rows.select(F.row_number().over(order).alias("place"), F.array_join("ngram", " ").alias("ngram"), "count").filter("place <= 25")


TOP = f"with g as ({NGRAMS}) select cast(row_number() over (order by abs(lift) desc, count desc, ngram) as int) as place, ngram, count from g qualify row_number() over (order by abs(lift) desc, count desc, ngram) <= 25"


def contrast_ranked(spark, sf_dir):
    """Predicates in the report's order, and those that no episode varies in left out (`always` and `never` are dropped)."""
    own = _predicates() | {"always": F.lit(True), "never": F.lit(False)}
    rows = contrast.unpaired_contrast(_events(spark, sf_dir)[1], own)
    order = Window.orderBy(F.round("p_adjusted", 9), F.round(F.abs("lift"), 9).desc(), "predicate")
    return rows.select(F.row_number().over(order).alias("place"), "predicate", "n_win", "n_loss")


CONTRAST = f"with c as ({UNPAIRED}) select cast(row_number() over (order by p_adjusted, abs(lift) desc, predicate) as int) as place, predicate, n_win, n_loss from c"


def contrast_status(spark, sf_dir):
    """Why a contrast has no rows: all episodes, those won, those of one mode, none."""
    episodes = _events(spark, sf_dir)[1]
    cases = {"all": (episodes, False), "won": (episodes.filter("success"), False), "paired": (episodes, True), "one_mode": (episodes.filter("mode = 'think'"), True), "none": (episodes.filter("false"), False)}
    out = None
    for name, (rows, paired) in cases.items():
        one = contrast.contrast_header(rows, paired).select(F.lit(name).alias("case"), "wins", "losses", "status")
        out = one if out is None else out.unionByName(one)
    return out


STATUS = f"""with {EVENTS}, th as (select * from episodes where mode = 'think' qualify row_number() over (partition by task_id order by trajectory_id desc) = 1),
p as (select reward > 0 as win from th where task_id in (select task_id from episodes where mode = 'no_think')),
c as (select 'all' as "case", count(*) filter (reward > 0) as wins, count(*) filter (not reward > 0) as losses from episodes
union all select 'won', count(*) filter (reward > 0), count(*) filter (not reward > 0) from episodes where success
union all select 'paired', count(*) filter (win), count(*) filter (not win) from p
union all select 'one_mode', 0, 0 union all select 'none', 0, 0)
select "case", wins, losses, case when "case" in ('paired', 'one_mode') then case when wins + losses = 0 then 'degenerate_no_pairs' else 'ok' end when wins = 0 or losses = 0 then 'degenerate_no_contrast' else 'ok' end as status from c"""


def stall_defaults(spark, sf_dir):
    """Stalls of at least three repeats, the default, in the report's order by episode."""
    rows = stalls.stall_report(*_events(spark, sf_dir))
    return rows.select("trajectory_id", "stalled", "longest", F.transform(F.coalesce("runs", F.array()), lambda r: F.concat_ws(":", r["start"], r["kind"], r["action"])).alias("r")).select("trajectory_id", "stalled", "longest", F.array_join("r", " ").alias("runs"))


STALLS = f"""with {EVENTS}, {REPEATS.format(least=3)}, {CYCLES}, {MERGED}
select e.trajectory_id, count(m.start) > 0 as stalled, cast(coalesce(max(m.length), 0) as bigint) as longest, coalesce(string_agg(concat(m.start, ':', m.kind, ':', m.action), ' ' order by m.start, m."end", m.kind, m.action) filter (m.start is not null), '') as runs
from episodes e left join merged m using (trajectory_id) group by 1"""


def gap_rendered(spark, sf_dir):
    """Recovered gaps under the default least gap, as a report shows them; and one that is worth dividing by."""
    rows = _rates(spark, sf_dir).select("event_type", F.round("s_no", 9).alias("a"), F.round("s_think", 9).alias("b"), F.round("s_skill", 9).alias("c"))
    wide = rows.select(F.concat("event_type", F.lit("+")).alias("event_type"), "a", (F.col("a") + 0.25).alias("b"), "c")
    back = rows.select(F.concat("event_type", F.lit("-")).alias("event_type"), "a", (F.col("a") - 0.25).alias("b"), "c")
    every = rows.unionByName(wide).unionByName(back).withColumn("g", stats.gap_recovery(F.col("a"), F.col("b"), F.col("c")))
    return every.select("event_type", "g.status", stats.render_gap(F.col("g")).alias("shown"))


RENDERED = f"""with {EVENTS}, r as (select s.event_type, round(avg(success::int) filter (s.mode = 'no_think'), 9) as a, round(avg(success::int) filter (s.mode = 'think'), 9) as b, round(avg(success::int), 9) as c from steps s join episodes e using (trajectory_id) group by 1),
x as (select * from r union all select event_type || '+', a, a + 0.25, c from r union all select event_type || '-', a, a - 0.25, c from r)
select event_type, case when b - a <= 0 then 'gap_nonpositive' when b - a < 0.05 then 'gap_too_small' else 'ok' end as status,
  case when b - a <= 0 then format('not reportable (think/no-think gap is not positive: {{:+.3f}}; the reasoning mode did not help)', b - a)
    when b - a < 0.05 then format('not reportable (think/no-think gap of {{:.3f}} is below the 0.05 reporting threshold)', b - a) else format('{{:.1f}}%', 100 * ((c - a) / (b - a))) end as shown from x"""


def interval_flags(spark, sf_dir):
    """Whether the interval of a brand's share of large parts excludes zero and holds the share of all."""
    parts = t.table(spark, sf_dir, "part")
    all_ = F.broadcast(parts.agg(F.avg((F.col("p_size") > 40).cast("double")).alias("share")))
    rows = parts.groupBy("p_brand").agg(F.count_if(F.col("p_size") > 40).alias("k"), F.count(F.lit(1)).alias("n")).crossJoin(all_).withColumn("i", stats.wilson_interval(F.col("k"), F.col("n")))
    return rows.select("p_brand", "k", "n", stats.excludes_zero(F.col("i")).alias("above_zero"), stats.contains(F.col("i"), F.col("share")).alias("holds_all"))


_Z = "1.959963984540054::double"
FLAGS = f"""with a as (select avg((p_size > 40)::int) as share from part), r as (select p_brand, count(*) filter (p_size > 40) as k, count(*) as n, {_Z} as z from part group by 1),
i as (select *, (k / n + z*z/(2*n) - z*sqrt(k/n*(1-k/n)/n + z*z/(4.0*n*n))) / (1 + z*z/n) as lo, (k / n + z*z/(2*n) + z*sqrt(k/n*(1-k/n)/n + z*z/(4.0*n*n))) / (1 + z*z/n) as hi from r)
select p_brand, k, n, greatest(0.0, lo) > 0 as above_zero, greatest(0.0, lo) <= share and share <= least(1.0, hi) as holds_all from i cross join a"""


def reasoning_premium(spark, sf_dir):
    """Tokens of think episodes over those of no_think ones, by whether they were won."""
    rows = _events(spark, sf_dir)[1].groupBy("success").agg(F.avg(F.when(F.col("mode") == "think", F.col("tokens"))).alias("a"), F.avg(F.when(F.col("mode") == "no_think", F.col("tokens"))).alias("b"))
    return rows.select("success", F.round(stats.reasoning_premium(F.col("a"), F.col("b")), 9).alias("premium"))


PREMIUM = f"with {EVENTS}, m as (select success, avg(tokens) filter (mode = 'think') as a, avg(tokens) filter (mode = 'no_think') as b from episodes group by 1) select success, case when b > 0 then round(a / b, 9) end as premium from m"


def quality_breaches(spark, sf_dir):
    """The checks a breach hook is told of: half of what was submitted is missing, and recall is low."""
    rows = t.table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderkey") % 5 > 0, F.col("o_totalprice")).alias("reward"), (F.col("o_orderkey") % 7 > 0).alias("contiguous"), F.lit(2).alias("steps"), F.when(F.col("o_orderkey") % 3 > 0, 2).otherwise(1).alias("complete_steps"),
        F.sha2(F.col("o_custkey").cast("string"), 256).alias("content_sha256"), (F.col("o_orderstatus") == "F").alias("success"))
    told: list[dict] = []
    quality.quality_report(rows, submitted=2 * rows.count(), redaction_recall=0.5, on_breach=told.append)
    return spark.createDataFrame([(b["check"], round(b["value"], 9), b["action"]) for b in told], "check string, value double, action string")


BREACHES = """with o as (select *, count(*) over () as n from orders), v as (
select 'normalization_success_rate' as "check", 0.5::double as value, 'alert' as action union all select 'reward_presence', avg((o_orderkey % 5 > 0)::int), 'quarantine' from o union all select 'step_contiguity', avg((o_orderkey % 7 > 0)::int), 'quarantine' from o
union all select 'token_accounting_completeness', sum(case when o_orderkey % 3 > 0 then 2 else 1 end) / (2 * count(*)), 'alert' from o union all select 'duplicate_rate', (count(*) - count(distinct o_custkey)) / count(*), 'alert' from o
union all select 'redaction_recall', 0.5, 'block_corpus_creation')
select "check", round(value, 9) as value, action from v"""


def span_recall(spark, sf_dir):
    """Recall and precision of the e-mail detector against what stands around an @ between white space."""
    docs = t.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case"), F.regexp_replace("text", r"[^\x00-\x7F]", "x").alias("text"))
    found = docs.select("case", F.explode(redaction.matches(F.col("text"), redaction.EMAIL)).alias("s")).select("case", F.col("s.value").alias("text"))
    expected = docs.select("case", F.explode(F.split("text", r"\s+")).alias("text")).filter(F.contains("text", F.lit("@")))
    return redact.span_recall(found, expected).select(F.round("recall", 9).alias("recall"), F.round("precision", 9).alias("precision"))


RECALL = r"""with d as (select doc_id, regexp_replace(text, '[^\x00-\x7F]', 'x', 'g') as text from documents),
f as (select doc_id, v, count(*) as f from (select doc_id, unnest(regexp_extract_all(text, '{}')) as v from d) group by 1, 2),
e as (select doc_id, v, count(*) as e from (select doc_id, unnest(string_split_regex(text, '\s+')) as v from d) where contains(v, '@') group by 1, 2),
b as (select coalesce(f, 0) as f, coalesce(e, 0) as e from f full join e using (doc_id, v))
select round(sum(least(f, e)) / sum(e), 9) as recall, round(sum(least(f, e)) / sum(f), 9) as precision from b""".replace("{}", redaction.EMAIL[1])


def corpus_no_think(spark, sf_dir):
    """Corpora of no_think episodes alone: those of one domain and model on the train half of a hash split of all tasks."""
    episodes = _events(spark, sf_dir)[1].withColumns({"domain": F.when(F.col("has_purchase"), "shop").otherwise("look"), "model": F.when(F.col("n_steps") > 5, "long").otherwise("short"), "task_id": F.col("task_id").cast("string")})
    half = splits.hash_halves(episodes, 6, SEED).filter("split = 'train'")
    rows, _ = corpus.composed(corpus.eligible(episodes, half, "shop", "long"), "no_think_only")
    return rows.select("trajectory_id", "task_id", "success")


NO_THINK = f"with {EVENTS} select trajectory_id, task_id::varchar as task_id, success from episodes where mode = 'no_think' and has_purchase and n_steps > 5 and task_id in {_half_sql('train', SEED)}"


def visible_rewards(spark, sf_dir):
    """What an episode's outcome shows when rewards are hidden."""
    rows = _events(spark, sf_dir)[1].select("trajectory_id", F.struct("reward", "success", F.col("n_steps").alias("steps_used"), "step_cap_hit").alias("outcome"))
    return corpus.strip_per_task_rewards(rows).select("trajectory_id", F.to_json("outcome").alias("outcome"))


VISIBLE = f"""with {EVENTS} select trajectory_id, concat('{{"steps_used":', n_steps, ',"step_cap_hit":', step_cap_hit, '}}') as outcome from episodes"""


def store_keys(spark, sf_dir):
    """Where bodies and refused bodies of orders would lie."""
    rows = t.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("tenant"), F.coalesce(F.nullif("o_orderstatus", F.lit("P")), F.lit("unknown")).alias("domain"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("sha"), F.col("o_orderdate").cast("date").alias("day"))
    args = [F.col(c) for c in ("tenant", "domain", "sha", "day")]
    return rows.select("o_orderkey", batch.body_key(*args).alias("body"), batch.quarantine_key(*args).alias("quarantine"))


_KEY = "concat(o_orderpriority, '/', coalesce(nullif(o_orderstatus, 'P'), 'unknown'), '/', strftime(o_orderdate::date, '%Y-%m-%d'), '/', sha256(o_orderkey::varchar), '.json')"
KEYS = f"select o_orderkey, {_KEY} as body, '_quarantine/' || {_KEY} as quarantine from orders"


def content_hash(spark, sf_dir):
    """Records of parts by their canonical JSON: keys in another order and other spacing give the same address."""
    parts = t.table(spark, sf_dir, "part").select("p_partkey", "p_size", F.regexp_replace("p_name", "[^a-z ]", "").alias("name"))
    raw = F.when(F.col("p_partkey") % 2 == 0, F.format_string('{"name": "%s", "size": %d}', "name", "p_size")).otherwise(F.format_string('{"size":%d , "name":"%s"}', "p_size", "name"))
    return parts.select("p_partkey", batch.canonical_hash(raw).alias("content_sha256"))


HASHES = """select p_partkey, sha256(concat('{"name":"', regexp_replace(p_name, '[^a-z ]', '', 'g'), '","size":', p_size, '}')) as content_sha256 from part"""


def profile_domains(spark, sf_dir):
    """The vocabulary each domain is read by; unknown domains get the default one."""
    names = [*profiles.domains(), "unheard_of"]
    rows = [(n, profiles.profile(n).domain, len(profiles.profile(n).verbs), sorted(profiles.profile(n).sensitive.get("*", ()))) for n in names]
    return spark.createDataFrame(rows, "asked string, domain string, verbs int, sensitive array<string>").select("asked", "domain", "verbs", F.array_join("sensitive", ",").alias("sensitive"))


DOMAINS = """select * from (values ('alfworld', 'alfworld', 15, ''), ('tau2_retail', 'tau2_retail', 0, 'email'), ('tau2_telecom', 'tau2_telecom', 0, 'email'), ('ssb_verified', 'ssb_verified', 0, ''), ('default', 'default', 0, ''), ('unheard_of', 'default', 0, ''))
v(asked, domain, verbs, sensitive)"""


def schema_changes(spark, sf_dir):
    """What breaks between two invented schemas made of the nations: every third property is gone, every fourth is newly required."""
    names = sorted(r[0].replace(" ", "_") for r in t.table(spark, sf_dir, "nation").select("n_name").collect())
    old = {"properties": {n: {"type": "string", "enum": ["a", "b"]} for n in names}, "required": names[:5]}
    kept = [n for k, n in enumerate(names) if k % 3]
    new = {"properties": {n: {"type": "string", "enum": ["a", "b"] if k % 2 else ["b", "c"]} for k, n in enumerate(names) if n in kept}, "required": names[:5] + [n for k, n in enumerate(names) if k % 4 == 0 and n in kept] + ["added"]}
    return spark.createDataFrame([(c,) for c in breaking_changes(old, new)], "change string")


CHANGES = """with n as (select replace(n_name, ' ', '_') as n, row_number() over (order by replace(n_name, ' ', '_')) - 1 as k from nation)
select 'property removed: ' || n as change from n where k % 3 = 0 union all select 'optional property became required: ' || n from n where k % 3 <> 0 and k % 4 = 0 and k >= 5
union all select 'enum narrowed at ' || n || ': lost [''a'']' from n where k % 3 <> 0 and k % 2 = 0 union all select 'new required property: added'"""


def schema_files(spark, sf_dir):
    """File names of schema versions."""
    rows = [(v, schema_filename(v)) for v in (f"{r[0].lower()}/{k}.0" for k, r in enumerate(t.table(spark, sf_dir, "region").select("r_name").orderBy("r_regionkey").collect()))]
    return spark.createDataFrame(rows, "version string, file string")


FILES = "select lower(r_name) || '/' || r_regionkey || '.0' as version, lower(r_name) || '-' || r_regionkey || '.0.json' as file from region"

def _records(spark, sf_dir, size: int = 0):
    """A record for each conversation: tenant_id, source_format, raw, position. Faults go by conv_id % 9 (none: 0, 7, 8)."""
    turns = t.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("turns"))
    fault = F.col("conv_id") % 9
    tokens = F.struct(F.lit(1).alias("input_total"), F.when(fault != 1, 0).alias("input_cached"), F.lit(2).alias("output_visible"), F.lit(0).alias("output_tool_args"), F.lit(0).alias("output_reasoning"))
    step = lambda s, k: F.struct(k.alias("index"), F.struct(F.lit("message").alias("kind"), s["text"].alias("text")).alias("observation"), F.struct(F.lit("").alias("text")).alias("output"), F.struct(F.lit("noop").alias("kind")).alias("action"), tokens.alias("tokens"))
    n = F.size("turns")
    record = F.struct(
        F.lit("trajectory/1.0").alias("schema_version"), F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("trajectory_id"), F.lit("own").alias("tenant_id"), F.lit("chat").alias("domain"), F.col("conv_id").cast("string").alias("task_id"), F.lit("train").alias("split"), F.lit(3).alias("seed"),
        F.lit("2026-01-01T00:00:00Z").alias("started_at"), F.lit("2026-01-01T00:01:00Z").alias("ended_at"), F.struct(F.lit("m").alias("model"), F.when(fault == 5, "maybe").otherwise("think").alias("mode"), F.struct(F.lit(0.0).alias("temperature"), F.lit(1.0).alias("top_p")).alias("decoding")).alias("actor"),
        F.struct(F.lit("h").alias("name"), F.lit("1").alias("version"), F.sha2(F.lit("p"), 256).alias("system_prompt_sha256"), F.lit(9).alias("max_steps")).alias("harness"), F.transform("turns", step).alias("steps"),
        F.struct(F.when(fault != 5, 0.5).alias("reward"), F.lit(True).alias("success"), F.lit("done").alias("termination"), n.alias("steps_used"), F.lit(False).alias("step_cap_hit")).alias("outcome"),
        F.struct((2 * n).alias("output_tokens"), F.lit(0).alias("output_reasoning_tokens"), n.alias("input_tokens"), F.lit(0).alias("input_cached_tokens"), n.alias("turns")).alias("totals"),
        F.struct(F.lit(False).alias("applied"), F.lit(redaction.POLICY_VERSION).alias("policy_version")).alias("redaction"), F.struct(F.lit("t").alias("source"), F.sha2(F.lit("x"), 256).alias("content_sha256")).alias("provenance"),
        F.when(fault == 2, 1).alias("zeal"), F.when(fault == 2, 2).alias("extra"), F.when(fault == 3, F.repeat(F.lit("x"), size)).alias("padding"),
    )
    return turns.select(F.lit("tenant").alias("tenant_id"), F.lit("harness_run").alias("source_format"), F.to_json(record).alias("raw"), F.col("conv_id").alias("position"))


def ingest_details(spark, sf_dir):
    """The worst rule a record breaks, its field, up to five broken rules, and warnings: token keys, unknown fields, size, split, several at once."""
    rows = _records(spark, sf_dir, 200_000)
    halves = rows.select(F.col("position").cast("string").alias("task_id"), F.when(F.col("position") % 9 == 4, "test").otherwise("train").alias("split"))
    out = batch.normalize(rows, halves, max_bytes=150_000, whole=True)
    return out.select("position", F.coalesce("rule", F.lit("-")).alias("rule"), F.coalesce("field_path", F.lit("-")).alias("field_path"), F.when(F.col("position") % 9 == 5, F.col("detail")).otherwise("-").alias("detail"), F.array_join("warnings", "; ").alias("warnings"))


DETAILS = """select distinct conv_id as position, case conv_id % 9 when 1 then 'token_keys_present' when 3 then 'size_cap' when 4 then 'split_matches_artifact' when 5 then 'reward_present' else '-' end as rule,
  case conv_id % 9 when 1 then 'steps.tokens' when 4 then 'split' when 5 then 'outcome.reward' else '-' end as field_path, case conv_id % 9 when 5 then 'outcome.reward: reward_present; actor.mode: actor_mode_valid' else '-' end as detail,
  case conv_id % 9 when 2 then 'dropped unknown top-level field: extra; dropped unknown top-level field: zeal' when 3 then 'dropped unknown top-level field: padding' else '' end as warnings from conversations"""


def ingest_store(spark, sf_dir):
    """Outcomes against a store that holds every third sound record; broken records are never duplicates."""
    rows = _records(spark, sf_dir)
    sound = batch.ingest(rows, whole=True).filter("status = 'accepted'")
    held = sound.filter("position % 3 = 0").select("tenant_id", "domain", "content_sha256")
    return batch.outcome_counts(batch.ingest(rows, held, whole=True))


STORE = """with c as (select distinct conv_id from conversations)
select count(*) filter (conv_id % 9 not in (1, 5) and conv_id % 3 <> 0) as accepted, count(*) filter (conv_id % 9 not in (1, 5) and conv_id % 3 = 0) as duplicate, count(*) filter (conv_id % 9 in (1, 5)) as quarantined from c"""


def metadata_rows(spark, sf_dir):
    """The flat row of each accepted record, under the batch's tenant."""
    accepted = batch.ingest(_records(spark, sf_dir), whole=True).filter("status = 'accepted'")
    rows = batch.metadata(batch.trajectories(accepted))
    return rows.select("trajectory_id", "tenant_id", "domain", "task_id", "split", "seed", "actor_model", "actor_mode", "reward", "success", "termination", "steps_used", "step_cap_hit", "output_tokens", "stalled")


METADATA = """select 'c' || conv_id as trajectory_id, 'tenant' as tenant_id, 'chat' as domain, conv_id::varchar as task_id, 'train' as split, 3::bigint as seed, 'm' as actor_model, 'think' as actor_mode, 0.5::double as reward, true as success, 'done' as termination,
  count(*) as steps_used, false as step_cap_hit, 2 * count(*) as output_tokens, false as stalled from conversations where conv_id % 9 not in (1, 5) group by conv_id"""

def constraint_violations(spark, sf_dir):
    """Orders as metadata rows of which some break a rule: no reward, odd splits and modes, negative steps, unknown tenants and domains, repeated content."""
    k = F.col("o_orderkey")
    rows = t.table(spark, sf_dir, "orders").select(
        k.cast("string").alias("trajectory_id"), F.concat(F.lit("t"), (F.col("o_custkey") % 7).cast("string")).alias("tenant_id"), F.when(k % 29 == 0, "nowhere").otherwise("shop").alias("domain"), F.col("o_custkey").cast("string").alias("task_id"),
        F.when(k % 31 == 0, "dev").when(k % 37 > 0, "train").alias("split"), F.lit("m").alias("actor_model"), F.when(k % 41 == 0, "maybe").otherwise("think").alias("actor_mode"), F.lit("1").alias("harness_version"), F.when(k % 43 > 0, 1.0).alias("reward"), F.lit(True).alias("success"),
        F.when(k % 47 == 0, -1).otherwise(3).alias("steps_used"), F.floor(k / 2).cast("string").alias("content_sha256"),
    )
    tenants = spark.createDataFrame([(f"t{i}",) for i in range(6)], "tenant_id string")
    found = constraints.violations(rows, tenants, spark.createDataFrame([("shop",)], "domain string"))
    return found.select("rule", F.col("trajectory_id").cast("bigint").alias("o_orderkey"))


BROKEN = """with o as (select o_orderkey as k, o_custkey % 7 as tenant, k % 29 = 0 as nowhere, k // 2 as content from orders),
again as (select tenant, nowhere, content from o group by all having count(*) > 1)
select 'refers:tenant_id' as rule, k as o_orderkey from o where tenant = 6 union all select 'refers:domain', k from o where nowhere union all select 'one_of:split', k from o where k % 31 = 0 union all select 'not_null:split', k from o where k % 31 <> 0 and k % 37 = 0
union all select 'one_of:actor_mode', k from o where k % 41 = 0 union all select 'not_null:reward', k from o where k % 43 = 0 union all select 'not_negative:steps_used', k from o where k % 47 = 0 union all select 'unique:content', k from o semi join again using (tenant, nowhere, content)"""

QUERIES = {
    "fabricated_arguments": fabricated_arguments, "error_frequency_ranked": error_frequency_ranked, "ngram_top": ngram_top, "contrast_ranked": contrast_ranked, "contrast_status": contrast_status, "stall_defaults": stall_defaults,
    "gap_rendered": gap_rendered, "interval_flags": interval_flags, "reasoning_premium": reasoning_premium, "quality_breaches": quality_breaches, "span_recall": span_recall, "corpus_no_think": corpus_no_think,
    "visible_rewards": visible_rewards, "store_keys": store_keys, "content_hash": content_hash, "profile_domains": profile_domains, "schema_changes": schema_changes, "schema_files": schema_files,
    "ingest_details": ingest_details, "ingest_store": ingest_store, "metadata_rows": metadata_rows, "constraint_violations": constraint_violations,
}

ORACLES = {
    "fabricated_arguments": FABRICATED, "error_frequency_ranked": RANKED, "ngram_top": TOP, "contrast_ranked": CONTRAST, "contrast_status": STATUS, "stall_defaults": STALLS,
    "gap_rendered": RENDERED, "interval_flags": FLAGS, "reasoning_premium": PREMIUM, "quality_breaches": BREACHES, "span_recall": RECALL, "corpus_no_think": NO_THINK,
    "visible_rewards": VISIBLE, "store_keys": KEYS, "content_hash": HASHES, "profile_domains": DOMAINS, "schema_changes": CHANGES, "schema_files": FILES,
    "ingest_details": DETAILS, "ingest_store": STORE, "metadata_rows": METADATA, "constraint_violations": BROKEN,
}
