"""The views of sources.tables as SQL common table expressions."""

EVENTS = """
ev0 as (
  select event_id, ts, user_id, event_type, value, cast(date_trunc('week', ts) as date) as week from events),
ev1 as (
  select *, concat(cast(user_id as varchar), '-', strftime(week, '%Y%m%d')) as trajectory_id,
    case when (date_diff('day', date '1970-01-05', week) // 7) % 2 = 1 then 'think' else 'no_think' end as mode from ev0),
steps as (
  select trajectory_id, user_id as task_id, mode,
    row_number() over (partition by trajectory_id order by ts, event_id) - 1 as idx,
    event_type as action, cast(cast(floor(value / 25) as bigint) as varchar) as obs, value, event_type,
    count(*) over (partition by trajectory_id) as n_steps from ev1),
episodes as (
  select trajectory_id, min(task_id) as task_id, min(mode) as mode, count(*) as n_steps, count(*) >= 25 as step_cap_hit,
    sum(cast(value as decimal(18,6))) > 50 * count(*) as success,
    case when sum(cast(value as decimal(18,6))) > 50 * count(*) then 1.0 else 0.0 end as reward,
    cast(sum(cast(floor(value) as bigint)) as bigint) as tokens,
    bool_or(event_type = 'error') as has_error, bool_or(event_type = 'purchase') as has_purchase, bool_or(event_type = 'signup') as has_signup
  from steps group by trajectory_id)"""

ERRORS = """
err as (
  select trajectory_id, idx as step_index,
    case when value < 10 then 'tool_error' when value < 50 then 'not_found' else 'timeout' end as error_type
  from steps where event_type = 'error'
  union all
  select trajectory_id, idx, 'step_cap_hit' from steps where n_steps >= 25 and idx = n_steps - 1)"""


def log_choose(n: str, k: str) -> str:
    return f"(lgamma({n} + 1) - lgamma({k} + 1) - lgamma(({n}) - ({k}) + 1))"
