"""Redaction of episodes: placeholders that stay the same for a value through an episode."""

from __future__ import annotations

import json
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import redaction as r
from .ranks import numbered

#: Where texts of a step stand, in the order that numbers values.
PATHS = ("observation", "output", "reasoning", "action", "arguments", "arguments_raw", "result")


def text_spans(texts: DataFrame, policy: r.Policy = r.DEFAULT) -> DataFrame:
    """(episode, ord, start, end, cls, value), a row per span. texts: episode, ord (a sortable place), text."""
    held = texts.filter(r.may_hold(F.col("text"), policy))
    return held.select("episode", "ord", F.explode(r.find_spans(F.col("text"), policy)).alias("s")).select("episode", "ord", "s.*")


def placeholder_index(spans: DataFrame) -> DataFrame:
    """(episode, cls, value, number): by first appearance within episode and class, however many values an episode has."""
    first = spans.groupBy("episode", "cls", "value").agg(F.min(F.struct("ord", "start")).alias("first"))
    placed = first.select("episode", "cls", F.col("first.ord").alias("_ord"), F.col("first.start").alias("_start"), "value")
    return numbered(placed, ["episode", "cls"], ["_ord", "_start"], "number").select("episode", "cls", "value", F.col("number").cast("int").alias("number"))


def redaction_counts(spans: DataFrame) -> DataFrame:
    """(episode, cls, n, distinct_values): every occurrence counts in n."""
    return spans.groupBy("episode", "cls").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("value").alias("distinct_values"))


def redact_texts(texts: DataFrame, policy: r.Policy = r.DEFAULT) -> DataFrame:
    """texts with `redacted` in place of text, numbered through each episode."""
    spans = text_spans(texts, policy)
    marked = spans.join(placeholder_index(spans), ["episode", "cls", "value"])
    one = F.struct("start", "end", r.placeholder(F.col("cls"), F.col("number")).alias("placeholder"))
    per = marked.groupBy("episode", "ord").agg(F.array_sort(F.collect_list(one)).alias("spans"))
    joined = texts.join(per, ["episode", "ord"], "left")
    return joined.select("episode", "ord", F.when(F.col("spans").isNull(), F.col("text")).otherwise(r.replaced(F.col("text"), F.col("spans"))).alias("redacted"))


def redact_episodes(episodes: DataFrame, paths: list[str], policy: r.Policy = r.DEFAULT) -> DataFrame:
    """episodes (a row each, `steps` an array of structs whose string fields `paths` hold text in traversal order) redacted in place.

    Adds redaction: struct(applied, policy_version, counts). No shuffle: an episode is one row. All strings
    of all steps are numbered together.
    """
    spans_of = lambda s: F.array(*[r.find_spans(s[p], policy) for p in paths])
    found = episodes.withColumn("_spans", F.transform("steps", spans_of))
    every = F.flatten(F.flatten(F.col("_spans")))
    classes = sorted({d[0] for d in policy.detectors})
    for c in classes:
        found = found.withColumn(f"_{c}", F.array_distinct(F.transform(_of(every, c), lambda s: s["value"])))

    def number(s: Column) -> Column:
        out = F.lit(0)
        for c in classes:
            out = F.when(s["cls"] == c, F.array_position(F.col(f"_{c}"), s["value"])).otherwise(out)
        return out

    mark = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), r.placeholder(s["cls"], number(s)).alias("placeholder"))

    def step(pair: Column) -> Column:
        own = pair["step"]
        for k, p in enumerate(paths):
            own = own.withField(p, F.when(own[p].isNotNull(), r.replaced(own[p], F.transform(F.get(pair["spans"], F.lit(k)), mark))))
        return own

    steps = F.transform(F.arrays_zip(F.col("steps").alias("step"), F.col("_spans").alias("spans")), step)
    counts = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(c).alias("key"), F.size(_of(every, c)).cast("bigint").alias("value")) for c in classes]), lambda e: e["value"] > 0))
    out = found.withColumn("redaction", F.struct(F.lit(True).alias("applied"), F.lit(policy.version).alias("policy_version"), counts.alias("counts")))
    return out.withColumn("steps", steps).drop("_spans", *[f"_{c}" for c in classes])


def _of(spans: Column, cls: str) -> Column:
    return F.filter(spans, lambda s: s["cls"] == cls)


def span_recall(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(recall, precision) of found against expected spans, both (case, text), matched as multisets per case."""
    n = lambda df, name: df.groupBy("case", "text").agg(F.count(F.lit(1)).alias(name))
    both = n(found, "f").join(n(expected, "e"), ["case", "text"], "full_outer").fillna(0)
    hit = F.sum(F.least("f", "e"))
    one = lambda total: F.coalesce(F.try_divide(hit, F.sum(total)), F.lit(1.0))
    return both.agg(one("e").alias("recall"), one("f").alias("precision"))


#: Of a step in a record: where strings are, in the order that numbers values; arguments may be nested.
RECORD_PATHS = (("observation", "text"), ("output", "text"), ("output", "reasoning_text"), ("action", "text"), ("action", "arguments"), ("action", "arguments_raw"), ("result", "text"))


def _accepts(validator: str | None, text: str) -> bool:
    digits = re.sub(r"\D" if validator == "phone" else "[ -]", "", text)
    if validator == "phone":
        return 10 <= len(digits) <= 15
    if validator == "us_ssn":
        return len(digits) == 9 and digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"
    if validator == "card":
        doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0
    return True


class Numbering:
    """Placeholders of one episode, for records whose strings lie in nested JSON."""

    def __init__(self, policy: r.Policy = r.DEFAULT):
        self.detectors = [(re.compile(p), cls, order, validator) for cls, p, order, validator in policy.detectors]
        self.names: dict[tuple[str, str], str] = {}
        self.counts: Counter = Counter()

    def _name(self, cls: str, value: str) -> str:
        self.counts[cls] += 1
        own = sum(c == cls for c, _ in self.names)
        return self.names.setdefault((cls, value), f"<{cls}_{own + 1}>")

    def text(self, text: str) -> str:
        hits = [(m.start(), -len(m[0]), order, cls, m[0]) for p, cls, order, validator in self.detectors for m in p.finditer(text) if _accepts(validator, m[0])]
        out, at = "", 0
        for start, size, _, cls, value in sorted(hits):
            if start >= at:
                out, at = out + text[at:start] + self._name(cls, value), start - size
        return out + text[at:]

    def value(self, x):
        """Strings within lists and objects, keys in order; keys themselves stay."""
        if isinstance(x, str):
            return self.text(x)
        if isinstance(x, dict):
            return {k: self.value(x[k]) for k in sorted(x)}
        return [self.value(v) for v in x] if isinstance(x, list) else x


def redact_record(body: str, policy: r.Policy = r.DEFAULT) -> str:
    """A trajectory's JSON with all personal data of its steps replaced and its redaction noted."""
    held, own = json.loads(body), Numbering(policy)
    for step in held.get("steps") or []:
        for part, leaf in RECORD_PATHS:
            if (step.get(part) or {}).get(leaf) is not None:
                step[part][leaf] = own.value(step[part][leaf])
    held["redaction"] = {"applied": True, "policy_version": policy.version, "counts": dict(sorted(own.counts.items()))}
    return json.dumps(held, ensure_ascii=False)


def redact_records(bodies: Column, policy: r.Policy = r.DEFAULT) -> Column:
    """redact_record over a column of JSON texts; nested arguments are beyond column functions."""
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else redact_record(b, policy))

    return F.pandas_udf(run, "string")(bodies)
