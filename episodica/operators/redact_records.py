"""Redaction of whole records, nested tool arguments included, in column functions: a record is one row, and nothing is shuffled.

The JSON of arguments is cut into its string values and what stands between them, keys included. Values are redacted like any
text and put back where they were, so nesting of any depth is followed in the order of the text, in which keys are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import redaction as r

#: Of a step: where strings are, in the order that numbers values; `arguments` is a variant, the others are texts.
PATHS = (("observation", "text"), ("output", "text"), ("output", "reasoning_text"), ("action", "text"), ("action", "arguments"), ("action", "arguments_raw"), ("result", "text"))
NESTED = ("action", "arguments")
#: A string with the colon after it, if it is a key; or what stands between strings. Possessive, so long strings need no stack.
TOKEN = r'"(?:[^"\\]++|\\.)*+"(?:\s*+:)?|[^"]++'
EMPTY = "array<struct<at: int, text: string, literal: string>>"


def _tokens(value: Column, at: int) -> Column:
    """Segments of a variant's JSON: `text` of string values, `literal` of what stays."""
    def one(token: Column) -> Column:
        is_value = F.startswith(token, F.lit('"')) & ~F.endswith(token, F.lit(":"))
        text = F.when(is_value, F.from_json(F.concat(F.lit("["), token, F.lit("]")), "array<string>")[0])
        return F.struct(F.lit(at).alias("at"), text.alias("text"), F.when(~is_value, token).alias("literal"))

    return F.transform(F.regexp_extract_all(F.to_json(value), F.lit(TOKEN), 0), one)


def _segments(step: Column) -> Column:
    """All strings of a step in order, each with the place in PATHS it belongs to."""
    parts = []
    for at, path in enumerate(PATHS):
        value = step[path[0]][path[1]]
        one = _tokens(value, at) if path == NESTED else F.array(F.struct(F.lit(at).alias("at"), value.alias("text"), F.lit(None).cast("string").alias("literal")))
        parts.append(F.when(value.isNotNull(), one).otherwise(F.array().cast(EMPTY)))
    return F.concat(*parts)


def _quoted(text: Column) -> Column:
    inside = F.to_json(F.array(text))
    return F.substring(inside, F.lit(2), F.length(inside) - 2)


def redact_trajectories(episodes: DataFrame, policy: r.Policy = r.DEFAULT) -> DataFrame:
    """episodes (typed records, see batch.trajectories) with the strings of all steps redacted and `redaction` set.

    Values are numbered by class through the episode, by their first place in the order of steps, PATHS and, within arguments, the
    text. Null fields and other JSON values stay as they are, so do keys; null steps are no steps.
    """
    own = F.transform(F.coalesce("steps", F.array()), lambda s: F.transform(_segments(s), lambda x: F.struct(x["at"].alias("at"), x["text"].alias("text"), x["literal"].alias("literal"), F.when(r.may_hold(x["text"], policy), r.find_spans(x["text"], policy)).alias("spans"))))
    found = episodes.withColumn("_own", own)
    every = F.flatten(F.transform(F.flatten("_own"), lambda x: F.coalesce(x["spans"], F.array().cast("array<struct<start: int, end: int, cls: string, value: string>>"))))
    found = found.withColumn("_every", every)
    classes = sorted({d[0] for d in policy.detectors})
    of = lambda c: F.filter("_every", lambda s: s["cls"] == c)
    found = found.withColumn("_names", F.struct(*[F.array_distinct(F.transform(of(c), lambda s: s["value"])).alias(c) for c in classes]))
    counts = F.filter(F.array(*[F.struct(F.lit(c).alias("key"), F.size(of(c)).cast("bigint").alias("value")) for c in classes]), lambda e: e["value"] > 0)

    def number(s: Column) -> Column:
        out = F.lit(0)
        for c in classes:
            out = F.when(s["cls"] == c, F.array_position(F.col("_names")[c], s["value"])).otherwise(out)
        return out

    mark = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), r.placeholder(s["cls"], number(s)).alias("placeholder"))
    clean = lambda x: F.when(x["spans"].isNull(), x["text"]).otherwise(r.replaced(x["text"], F.transform(x["spans"], mark)))

    put_back = lambda x: F.struct(x["at"].alias("at"), F.when(x["at"] == PATHS.index(NESTED), F.coalesce(x["literal"], _quoted(clean(x)))).otherwise(clean(x)).alias("text"))
    found = found.withColumn("_clean", F.transform("_own", lambda segments: F.transform(segments, put_back)))

    def texts_at(segments: Column, at: int) -> Column:
        return F.transform(F.filter(segments, lambda x: x["at"] == at), lambda x: x["text"])

    def rebuilt(pair: Column) -> Column:
        step, segments, out = pair["step"], pair["clean"], pair["step"]
        for parent in dict.fromkeys(path[0] for path in PATHS):
            part = step[parent]
            for at, path in enumerate(PATHS):
                if path[0] == parent:
                    mine = texts_at(segments, at)
                    new = F.parse_json(F.array_join(mine, "")) if path == NESTED else F.get(mine, F.lit(0))
                    part = part.withField(path[1], F.when(step[parent][path[1]].isNotNull(), new))
            out = out.withField(parent, F.when(step[parent].isNotNull(), part))
        return out

    steps = F.transform(F.arrays_zip(F.col("steps").alias("step"), F.col("_clean").alias("clean")), rebuilt)
    noted = F.struct(F.lit(True).alias("applied"), F.lit(policy.version).alias("policy_version"), F.map_from_entries(counts).alias("counts"))
    return found.withColumns({"steps": F.when(F.col("steps").isNotNull(), steps), "redaction": noted}).drop("_own", "_every", "_names", "_clean")
