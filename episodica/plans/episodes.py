"""Queries over episodes made of events and documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats
from ..operators import contrast, errors, ngrams, stalls
from ..sources import tables as t
from .views import ERRORS, EVENTS, log_choose


def _events(spark, sf_dir):
    steps = t.event_steps(spark, sf_dir)
    return steps, t.event_episodes(steps)


def ngram_report(spark, sf_dir):
    rows = ngrams.ngram_report(*_events(spark, sf_dir))
    return rows.select(F.array_join("ngram", " ").alias("ngram"), "n", "count", "doc_freq", "count_in_wins", "count_in_losses", F.round("lift", 9).alias("lift"))


NGRAMS = f"""with {EVENTS},
g as (
  select trajectory_id, action as ngram, 1 as n from steps
  union all select trajectory_id, concat(action, ' ', lead(action) over w), 2 from steps window w as (partition by trajectory_id order by idx)
  union all select trajectory_id, concat(action, ' ', lead(action) over w, ' ', lead(action, 2) over w), 3 from steps window w as (partition by trajectory_id order by idx)),
ok as (select * from g where len(string_split(trim(ngram), ' ')) = n),
per as (select trajectory_id, ngram, n, least(count(*), 5) as c from ok group by all),
tot as (select count(*) filter (reward > 0) as wins, count(*) filter (not reward > 0) as losses from episodes)
select ngram, cast(n as int) as n, cast(sum(c) as bigint) as count, count(*) as doc_freq, count(*) filter (reward > 0) as count_in_wins, count(*) filter (not reward > 0) as count_in_losses,
  round(coalesce(count(*) filter (reward > 0) / nullif(any_value(wins), 0), 0) - coalesce(count(*) filter (not reward > 0) / nullif(any_value(losses), 0), 0), 9) as lift
from per join episodes using (trajectory_id) cross join tot group by ngram, n having sum(c) >= 3"""


def action_sequence(spark, sf_dir):
    rows = ngrams.action_sequences(t.event_steps(spark, sf_dir))
    return rows.select("trajectory_id", F.array_join("actions", " ").alias("actions"))


SEQUENCE = f"with {EVENTS} select trajectory_id, string_agg(action, ' ' order by idx) as actions from steps group by 1"


def _error_events(spark, sf_dir):
    steps, episodes = _events(spark, sf_dir)
    return errors.error_events(t.event_detector_steps(steps)), episodes


def error_frequency(spark, sf_dir):
    rows = errors.error_frequency(*_error_events(spark, sf_dir))
    return rows.select("error_type", "trajectories_with", F.round("trajectory_rate", 9).alias("trajectory_rate"), "occurrences", F.round("share_of_all_errors", 9).alias("share_of_all_errors"))


FREQUENCY = f"""with {EVENTS}, {ERRORS}
select error_type, count(distinct trajectory_id) as trajectories_with, round(count(distinct trajectory_id) / (select count(*) from episodes), 9) as trajectory_rate,
  count(*) as occurrences, round(count(*) / (select count(*) from err), 9) as share_of_all_errors from err group by 1"""


def error_cooccurrence(spark, sf_dir):
    return errors.error_cooccurrence(_error_events(spark, sf_dir)[0])


COOCCURRENCE = f"""with {EVENTS}, {ERRORS}, d as (select distinct * from err)
select l.error_type as left_type, r.error_type as right_type, count(*) as steps from d l join d r using (trajectory_id, step_index) where l.error_type < r.error_type group by 1, 2"""


def error_evidence_topk(spark, sf_dir):
    return errors.error_evidence(_error_events(spark, sf_dir)[0])


EVIDENCE = f"""with {EVENTS}, {ERRORS}
select error_type, trajectory_id, step_index, cast(row_number() over (partition by error_type order by trajectory_id, step_index) as int) as rank from err
qualify row_number() over (partition by error_type order by trajectory_id, step_index) <= 5"""


def stall_repeat_runs(spark, sf_dir):
    return stalls.repeat_runs(t.event_steps(spark, sf_dir), 2).drop("period")


REPEATS = """rep0 as (select *, case when lag(action) over w = action and lag(obs) over w = obs then 0 else 1 end as new from steps window w as (partition by trajectory_id order by idx)),
rep1 as (select *, sum(new) over (partition by trajectory_id order by idx) as island from rep0),
rep as (select trajectory_id, min(idx) as start, max(idx) as "end", any_value(action) as action, count(*) as length, 'repeat_action' as kind, null::int as period from rep1 group by trajectory_id, island having count(*) >= {least})"""


def _cycles_sql(p: int) -> str:
    pattern = ", ".join(f"lead(action, {k}) over w" if k else "action" for k in range(p))
    return f"""m{p} as (select *, coalesce(lead(action, {p}) over w = action and lead(obs, {p}) over w = obs, false) as hit, [{pattern}] as pat from steps window w as (partition by trajectory_id order by idx)),
i{p} as (select *, idx - sum(hit::int) over (partition by trajectory_id order by idx) as island from m{p}),
s{p} as (select trajectory_id, min(idx) as s, max(idx) + 1 as e from i{p} where hit group by trajectory_id, island),
l{p} as (select trajectory_id, list({{'s': s, 'e': e}} order by s) as isl from s{p} group by 1),
f{p} as (select trajectory_id, unnest(list_reduce(isl, lambda a, x: case when x.e - greatest(x.s, a.at) >= {p}
    then {{'at': x.e + {p}, 'runs': list_append(a.runs, {{'start': greatest(x.s, a.at), 'length': x.e - greatest(x.s, a.at) + {p}}})}} else a end,
    {{'at': 0::bigint, 'runs': []::struct("start" bigint, length bigint)[]}}).runs) as r from l{p}),
c{p} as (select f.trajectory_id, f.r.start as start, f.r.start + f.r.length - 1 as "end", array_to_string(m.pat, '|') as action, f.r.length as length, 'cycle' as kind, {p} as period
  from f{p} f join m{p} m on m.trajectory_id = f.trajectory_id and m.idx = f.r.start where len(list_distinct(m.pat)) > 1)"""


CYCLES = ",\n".join(map(_cycles_sql, (2, 3, 4)))
ALL_CYCLES = " union all ".join(f"select * from c{p}" for p in (2, 3, 4))
MERGED = f"""allruns as (select * from rep union all {ALL_CYCLES}),
merged as (select * exclude (before) from (select *, max("end") over (partition by trajectory_id order by start, length desc, case when kind = 'repeat_action' then 0 else 1 end, action
  rows between unbounded preceding and 1 preceding) as before from allruns) where before is null or before < "end")"""


def stall_cycle_runs(spark, sf_dir):
    return stalls.cycle_runs(t.event_steps(spark, sf_dir))


def stall_merge(spark, sf_dir):
    return stalls.stall_runs(t.event_steps(spark, sf_dir), 2)


def stall_report(spark, sf_dir):
    rows = stalls.stall_report(*_events(spark, sf_dir), 2)
    return rows.select("trajectory_id", "step_cap_hit", "stalled", "longest", F.coalesce(F.size("runs"), F.lit(0)).cast("bigint").alias("n_runs"))


def stall_rate(spark, sf_dir):
    return stalls.stall_rate(stalls.stall_report(*_events(spark, sf_dir), 2)).select(F.round("stall_rate", 9).alias("stall_rate"), "stalled", "trajectories")


STALLS = f"with {EVENTS}, {REPEATS.format(least=2)}, {CYCLES}, {MERGED}"
REPORT = f"""{STALLS}
select e.trajectory_id, e.step_cap_hit, count(m.start) > 0 as stalled, cast(coalesce(max(m.length), 0) as bigint) as longest, count(m.start) as n_runs
from episodes e left join merged m using (trajectory_id) group by 1, 2"""


def _predicates():
    return {f"has_{k}": F.col(f"has_{k}") for k in ("error", "purchase", "signup")} | {"step_cap_hit": F.col("step_cap_hit"), "long_episode": F.col("n_steps") >= 20}


def _rounded(rows):
    return rows.select("predicate", *[F.round(c, 9).alias(c) for c in ("p_given_win", "p_given_loss", "lift", "p_value", "p_adjusted")], "n_win", "n_loss", "significant", "test_used", F.array_join("evidence", ",").alias("evidence"))


def contrast_unpaired(spark, sf_dir):
    return _rounded(contrast.unpaired_contrast(_events(spark, sf_dir)[1], _predicates()))


def contrast_documents(spark, sf_dir):
    docs = t.document_episodes(spark, sf_dir)
    flags = {f"lang:{x}": F.col("lang") == x for x in ("de", "en", "es", "fr")} | {"toxic": F.col("toxic"), "long": F.col("n_chars") >= 4000}
    return _rounded(contrast.unpaired_contrast(docs, flags))


def contrast_paired(spark, sf_dir):
    return _rounded(contrast.paired_contrast(_events(spark, sf_dir)[1], _predicates()))


PREDICATES_SQL = ["has_error", "has_purchase", "has_signup", "step_cap_hit"]
MELT = " union all ".join([f"select trajectory_id, task_id, mode, reward > 0 as win, '{p}' as predicate, {p} as hit from episodes" for p in PREDICATES_SQL] + ["select trajectory_id, task_id, mode, reward > 0, 'long_episode', n_steps >= 20 from episodes"])
BH = """bh0 as (select *, row_number() over (order by p_value, predicate) as r, count(*) over () as m from tested),
bh as (select *, least(1.0, min(p_value * m / r) over (order by p_value, predicate rows between current row and unbounded following)) as p_adjusted from bh0)
select predicate, round(p_given_win, 9) as p_given_win, round(p_given_loss, 9) as p_given_loss, round(p_given_win - p_given_loss, 9) as lift, round(p_value, 9) as p_value, round(p_adjusted, 9) as p_adjusted,
  n_win, n_loss, p_adjusted <= 0.10 as significant, test_used, evidence from bh"""
_LOGP = f"{log_choose('a + b', 'k')} + {log_choose('c + d', 'a + c - k')} - {log_choose('a + b + c + d', 'a + c')}"
FISHER = f"""cnt as (select predicate, count(*) filter (win and hit) as a, count(*) filter (win and not hit) as b, count(*) filter (not win and hit) as c, count(*) filter (not win and not hit) as d from long group by 1),
kept as (select * from cnt where a + b > 0 and c + d > 0 and a + c > 0 and b + d > 0),
tab as (select *, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) as k from kept),
lp as (select *, {_LOGP} as logp from tab),
obs as (select predicate, logp as own from lp where k = a),
fis as (select predicate, least(1.0, sum(exp(logp)) filter (logp <= own + 1e-7)) as p_value from lp join obs using (predicate) group by 1),
ev as (select predicate, string_agg(cast(trajectory_id as varchar), ',' order by win desc, trajectory_id) as evidence from (select * from long where hit qualify row_number() over (partition by predicate order by win desc, trajectory_id) <= 3) group by 1),
tested as (select predicate, a / (a + b) as p_given_win, c / (c + d) as p_given_loss, a as n_win, c as n_loss, p_value, 'fisher_exact' as test_used, evidence from kept join fis using (predicate) left join ev using (predicate)),
{BH}"""
UNPAIRED = f"with {EVENTS}, long as ({MELT}), {FISHER}"
DOCUMENTS = f"""with d as (select doc_id as trajectory_id, lang, n_chars, quality, toxic from documents join labels using (doc_id)),
long as (select trajectory_id, quality > 0 as win, u.predicate, u.hit from d, lateral (values ('lang:de', lang = 'de'), ('lang:en', lang = 'en'), ('lang:es', lang = 'es'), ('lang:fr', lang = 'fr'), ('toxic', toxic = 1), ('long', n_chars >= 4000)) u(predicate, hit)), {FISHER}"""
PAIRED = f"""with {EVENTS}, long as ({MELT}),
last as (select * from long qualify row_number() over (partition by task_id, mode, predicate order by trajectory_id desc) = 1),
p as (select x.task_id, predicate, x.hit as t, y.hit as n from last x join last y using (task_id, predicate) where x.mode = 'think' and y.mode = 'no_think'),
cnt as (select predicate, count(*) as pairs, count(*) filter (t) as it, count(*) filter (n) as inn, count(*) filter (t and not n) as b, count(*) filter (n and not t) as c from p group by 1),
kept as (select * from cnt where b + c > 0),
mc as (select predicate, least(1.0, sum(2 * exp(lgamma(b + c + 1) - lgamma(k + 1) - lgamma(b + c - k + 1) - (b + c) * ln(2)))) as p_value from (select *, unnest(range(0, least(b, c) + 1)) as k from kept) group by 1),
ev as (select predicate, string_agg(cast(task_id as varchar), ',' order by task_id) as evidence from (select * from p where t <> n qualify row_number() over (partition by predicate order by task_id) <= 3) group by 1),
tested as (select predicate, it / pairs as p_given_win, inn / pairs as p_given_loss, b as n_win, c as n_loss, p_value, 'mcnemar_exact' as test_used, evidence from kept join mc using (predicate) left join ev using (predicate)),
{BH}"""


def bh_adjust(spark, sf_dir):
    """Invented p-values of brands, adjusted."""
    rows = t.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("predicate")).agg((F.sum("p_size") % 997 / 997).alias("p_value"))
    return stats.benjamini_hochberg(rows, "p_value", "predicate").select("predicate", F.round("p_value", 9).alias("p_value"), F.round("p_adjusted", 9).alias("p_adjusted"), "significant")


BH_ADJUST = """with tested as (select p_brand as predicate, sum(p_size) % 997 / 997 as p_value from part group by 1),
bh0 as (select *, row_number() over (order by p_value, predicate) as r, count(*) over () as m from tested)
select predicate, round(p_value, 9) as p_value, round(least(1.0, min(p_value * m / r) over w), 9) as p_adjusted, least(1.0, min(p_value * m / r) over w) <= 0.10 as significant from bh0
window w as (order by p_value, predicate rows between current row and unbounded following)"""


def wilson_by_group(spark, sf_dir):
    orders = t.table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("k"), F.count(F.lit(1)).alias("n"))
    return orders.withColumn("i", stats.wilson_interval(F.col("k"), F.col("n"))).select("o_orderpriority", "k", "n", F.round("i.low", 9).alias("low"), F.round("i.high", 9).alias("high"))


_Z = "1.959963984540054::double"
WILSON = f"""select o_orderpriority, k, n, round(greatest(0.0, (p + z*z/(2*n) - z*sqrt(p*(1-p)/n + z*z/(4.0*n*n))) / (1 + z*z/n)), 9) as low, round(least(1.0, (p + z*z/(2*n) + z*sqrt(p*(1-p)/n + z*z/(4.0*n*n))) / (1 + z*z/n)), 9) as high
from (select o_orderpriority, count(*) filter (o_orderstatus = 'F') as k, count(*) as n, count(*) filter (o_orderstatus = 'F') / count(*) as p, {_Z} as z from orders group by 1)"""


def percentile_ci(spark, sf_dir):
    found = stats.exact_percentiles(t.table(spark, sf_dir, "events"), "event_type", "value", (0.025, 0.975))
    low, high = (F.round(F.max(F.when(F.col("percent") == p, F.col("value"))), 6) for p in (0.025, 0.975))
    return found.groupBy("event_type").agg(low.alias("low"), high.alias("high"))


PERCENTILE = "select event_type, round(quantile_cont(value, 0.025), 6) as low, round(quantile_cont(value, 0.975), 6) as high from events group by 1"


def paired_task_delta(spark, sf_dir):
    episodes = _events(spark, sf_dir)[1]
    held = episodes.groupBy("task_id").agg(F.count_distinct("mode").alias("modes")).filter("modes = 2")
    both = episodes.join(held, "task_id", "left_semi")
    deltas = stats.paired_deltas(both.filter("mode = 'no_think'"), both.filter("mode = 'think'"))
    return deltas.select("task_id", F.round("delta", 9).alias("delta"))


DELTA = f"""with {EVENTS}, m as (select task_id, avg(reward) filter (mode = 'think') as t, avg(reward) filter (mode = 'no_think') as b from episodes group by 1)
select task_id, round(t - b, 9) as delta from m where t is not null and b is not null"""


def bootstrap_ci(spark, sf_dir):
    found = stats.bootstrap_delta_distributed(paired_task_delta(spark, sf_dir), seed=11)
    return found.select(*[F.round(c, 9).alias(c) for c in found.columns])


BOOTSTRAP = f"with deltas as ({DELTA}), {stats.bootstrap_sql('deltas', seed=11)}"


def _rates(spark, sf_dir):
    """Per event type the three rates of a condition, from disjoint weeks."""
    rows = t.event_steps(spark, sf_dir).join(_events(spark, sf_dir)[1].select("trajectory_id", "success"), "trajectory_id")
    part = lambda c: F.avg(F.when(c, F.col("success").cast("double")))
    return rows.groupBy("event_type").agg(part(F.col("mode") == "no_think").alias("s_no"), part(F.col("mode") == "think").alias("s_think"), F.avg(F.col("success").cast("double")).alias("s_skill"))


def gap_recovery(spark, sf_dir):
    rows = _rates(spark, sf_dir).withColumn("g", stats.gap_recovery(F.col("s_no"), F.col("s_think"), F.col("s_skill"), 0.001))
    return rows.select("event_type", F.round("g.value", 6).alias("value"), "g.status", F.round("g.numerator", 9).alias("numerator"), F.round("g.denominator", 9).alias("denominator"))


GAP = f"""with {EVENTS}, r as (select s.event_type, avg(success::int) filter (s.mode = 'no_think') as a, avg(success::int) filter (s.mode = 'think') as b, avg(success::int) as c from steps s join episodes e using (trajectory_id) group by 1)
select event_type, case when b - a >= 0.001 then round((c - a) / (b - a), 6) end as value, case when b - a <= 0 then 'gap_nonpositive' when b - a < 0.001 then 'gap_too_small' else 'ok' end as status, round(c - a, 9) as numerator, round(b - a, 9) as denominator from r"""


def token_reduction(spark, sf_dir):
    rows = _events(spark, sf_dir)[1].groupBy("task_id").agg(F.avg(F.when(F.col("mode") == "think", F.col("tokens"))).alias("a"), F.avg(F.when(F.col("mode") == "no_think", F.col("tokens"))).alias("b"))
    return rows.select("task_id", F.round(stats.token_reduction(F.col("a"), F.col("b")), 9).alias("reduction"))


REDUCTION = f"with {EVENTS}, m as (select task_id, avg(tokens) filter (mode = 'think') as a, avg(tokens) filter (mode = 'no_think') as b from episodes group by 1) select task_id, case when b > 0 then round(a / b, 9) end as reduction from m"


def success_rate(spark, sf_dir):
    return _events(spark, sf_dir)[1].groupBy("mode").agg(F.round(stats.success_rate(F.col("reward")), 9).alias("success_rate"))


SUCCESS = f"with {EVENTS} select mode, round(avg((reward > 0)::int), 9) as success_rate from episodes group by 1"

QUERIES = {
    "ngram_report": ngram_report, "action_sequence": action_sequence, "error_frequency": error_frequency, "error_cooccurrence": error_cooccurrence, "error_evidence_topk": error_evidence_topk,
    "stall_repeat_runs": stall_repeat_runs, "stall_cycle_runs": stall_cycle_runs, "stall_merge": stall_merge, "stall_report": stall_report, "stall_rate": stall_rate,
    "contrast_unpaired": contrast_unpaired, "contrast_documents": contrast_documents, "contrast_paired": contrast_paired, "bh_adjust": bh_adjust, "wilson_by_group": wilson_by_group, "percentile_ci": percentile_ci,
    "paired_task_delta": paired_task_delta, "bootstrap_ci": bootstrap_ci, "gap_recovery": gap_recovery, "token_reduction": token_reduction, "success_rate": success_rate,
}

ORACLES = {
    "ngram_report": NGRAMS, "action_sequence": SEQUENCE, "error_frequency": FREQUENCY, "error_cooccurrence": COOCCURRENCE, "error_evidence_topk": EVIDENCE,
    "stall_repeat_runs": f"with {EVENTS}, {REPEATS.format(least=2)} select * exclude (period) from rep",
    "stall_cycle_runs": f"with {EVENTS}, {CYCLES} {ALL_CYCLES}",
    "stall_merge": f"{STALLS} select * from merged", "stall_report": REPORT,
    "stall_rate": f"with r as ({REPORT}) select round(avg(stalled::int), 9) as stall_rate, count(*) filter (stalled) as stalled, count(*) as trajectories from r",
    "contrast_unpaired": UNPAIRED, "contrast_documents": DOCUMENTS, "contrast_paired": PAIRED, "bh_adjust": BH_ADJUST, "wilson_by_group": WILSON, "percentile_ci": PERCENTILE, "bootstrap_ci": BOOTSTRAP,
    "paired_task_delta": DELTA, "gap_recovery": GAP, "token_reduction": REDUCTION, "success_rate": SUCCESS,
}
