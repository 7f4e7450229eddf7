"""Error events by an ordered taxonomy of detectors, and how often each occurs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.profiles import DEFAULT, Profile

EVIDENCE = 5
#: A detector takes the profile and returns an array<string> column over detector_steps.
Detector = Callable[[Profile], Column]
NONE = "array<string>"


def tool_error(profile: Profile) -> Column:
    """A failed result: its error type, or tool_error where that is missing or empty."""
    kind = F.coalesce(F.nullif(F.col("error_type"), F.lit("")), F.lit("tool_error"))
    return F.when(F.col("result_status") == "error", F.array(kind)).otherwise(F.array().cast(NONE))


def _sensitive(profile: Profile) -> Column:
    """The sensitive argument names of a step's tool."""
    names = F.array(*map(F.lit, profile.sensitive.get("*", ()))).cast(NONE)
    for tool, own in profile.sensitive.items():
        if tool != "*":
            names = F.when(F.col("tool") == tool, F.array_union(names, F.array(*map(F.lit, own)))).otherwise(names)
    return names


def _value(name: Column) -> Column:
    """A step's argument of that name, null where it is blank."""
    value = F.element_at("arguments", name)
    return F.when(F.trim(value) != "", value)


def fabricated_auth_argument(profile: Profile) -> Column:
    """One event for each sensitive argument whose text no observation up to this step held."""
    late = lambda v: F.coalesce(F.element_at("first_seen", v), F.lit(2**62)) > F.col("seen_size")
    made_up = F.filter(_sensitive(profile), lambda k: _value(k).isNotNull() & late(_value(k)))
    events = F.transform(made_up, lambda k: F.lit("fabricated_auth_argument"))
    return F.when((F.col("kind") == "tool_call") & F.col("arguments").isNotNull(), F.coalesce(events, F.array().cast(NONE))).otherwise(F.array().cast(NONE))


def step_cap_hit(profile: Profile) -> Column:
    """Once, on the last step of an episode that ran out of steps."""
    return F.when(F.col("step_cap_hit") & (F.col("idx") == F.col("n_steps") - 1), F.array(F.lit("step_cap_hit"))).otherwise(F.array().cast(NONE))


TAXONOMY: tuple[tuple[str, Detector], ...] = (("tool_error", tool_error), ("fabricated_auth_argument", fabricated_auth_argument), ("step_cap_hit", step_cap_hit))
TAXONOMY_VERSION = "taxonomy/1.0"


def with_context(steps: DataFrame, profile: Profile) -> DataFrame:
    """steps with what their sensitive arguments are held against.

    All observations of an episode, joined by spaces, are searched once for each different value: first_seen maps it to
    where its first occurrence ends, and seen_size is how far the observations up to and with a step reach.
    """
    said = F.coalesce("observation", F.lit(""))
    reach = F.sum(F.length(said).cast("bigint") + 1).over(Window.partitionBy("trajectory_id").orderBy("idx")) - 1
    values = F.array_compact(F.transform(_sensitive(profile), _value))
    own = steps.select("trajectory_id", F.struct("idx", said.alias("said")).alias("at"), F.coalesce(values, F.array().cast(NONE)).alias("values"))
    episodes = own.groupBy("trajectory_id").agg(F.array_sort(F.collect_list("at")).alias("ats"), F.array_distinct(F.flatten(F.collect_list("values"))).alias("values")).filter(F.size("values") > 0)
    whole = episodes.select("trajectory_id", "values", F.array_join(F.transform("ats", lambda x: x["said"]), " ").alias("whole"))
    ends = F.transform("values", lambda v: F.when(F.position(v, F.col("whole")) > 0, (F.position(v, F.col("whole")) - 1 + F.length(v)).cast("bigint")))
    found = whole.select(F.col("trajectory_id").alias("of"), F.map_from_arrays("values", ends).alias("first_seen"))
    return steps.withColumn("seen_size", reach).join(found, F.col("trajectory_id") == F.col("of"), "left").drop("of")


def error_events(steps: DataFrame, taxonomy=TAXONOMY, profile: Profile = DEFAULT) -> DataFrame:
    """(trajectory_id, step_index, error_type), a row per event, detectors in taxonomy order.

    steps: trajectory_id, idx, n_steps, step_cap_hit, kind, tool, arguments map<string,string> of string values,
    observation, result_status, error_type. Observations are gathered only where a detector needs them.
    """
    needed = profile.sensitive and any(d is fabricated_auth_argument for _, d in taxonomy)
    rows = with_context(steps, profile) if needed else steps.withColumns({"seen_size": F.lit(0).cast("bigint"), "first_seen": F.lit(None).cast("map<string,bigint>")})
    return rows.select("trajectory_id", F.col("idx").alias("step_index"), F.explode(F.concat(*[d(profile) for _, d in taxonomy])).alias("error_type"))


def error_frequency(events: DataFrame, episodes: DataFrame) -> DataFrame:
    """Per type: episodes with it, their share, occurrences and their share of all events; most frequent first."""
    totals = F.broadcast(episodes.agg(F.count(F.lit(1)).alias("trajectories")).crossJoin(events.agg(F.count(F.lit(1)).alias("events"))))
    once = events.groupBy("error_type", "trajectory_id").agg(F.count(F.lit(1)).alias("n"))
    rows = once.groupBy("error_type").agg(F.count(F.lit(1)).alias("trajectories_with"), F.sum("n").alias("occurrences")).crossJoin(totals)
    return rows.select(
        "error_type", "trajectories_with", (F.col("trajectories_with") / F.col("trajectories")).alias("trajectory_rate"), "occurrences", (F.col("occurrences") / F.col("events")).alias("share_of_all_errors")
    ).orderBy(F.desc("share_of_all_errors"), "error_type")


def error_cooccurrence(events: DataFrame) -> DataFrame:
    """Steps on which both of two types occur, for each pair of types in order."""
    per = events.groupBy("trajectory_id", "step_index").agg(F.array_sort(F.collect_set("error_type")).alias("types")).filter(F.size("types") > 1)
    pairs = F.flatten(F.transform("types", lambda a, i: F.transform(F.slice("types", i + 2, F.size("types")), lambda b: F.struct(a.alias("left_type"), b.alias("right_type")))))
    return per.select(F.explode(pairs).alias("p")).groupBy("p.left_type", "p.right_type").agg(F.count(F.lit(1)).alias("steps"))


def error_evidence(events: DataFrame, most: int = EVIDENCE) -> DataFrame:
    """The first events of each type, by episode and step."""
    by = Window.partitionBy("error_type").orderBy("trajectory_id", "step_index")
    return events.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= most)


def with_evidence(report: DataFrame, events: DataFrame, most: int = EVIDENCE) -> DataFrame:
    own = error_evidence(events, most).groupBy("error_type").agg(F.array_sort(F.collect_list(F.struct("rank", "trajectory_id", "step_index"))).alias("e"))
    picked = own.select("error_type", F.transform("e", lambda x: F.struct(x["trajectory_id"].alias("trajectory_id"), x["step_index"].alias("step_index"))).alias("evidence"))
    return report.join(picked, "error_type", "left").orderBy(F.desc("share_of_all_errors"), "error_type")
