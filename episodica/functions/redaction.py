"""Personal data in text: detectors, validators and non-overlapping spans, as columns."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

POLICY_VERSION = "redaction/1.0"

#: Class, pattern, priority, validator.
EMAIL = ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", 0, None)
CREDIT_CARD = ("CREDIT_CARD", r"\b(?:\d[ -]?){12,18}\d\b", 1, "card")
US_SSN = ("US_SSN", r"\b\d{3}-\d{2}-\d{4}\b", 2, "us_ssn")
PHONE = ("PHONE", r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\b\d{2,4}[ .-])\d{2,4}[ .-]\d{2,6}\b", 3, "phone")
IBAN = ("IBAN", r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b", 4, None)
STRICT_PHONE = ("PHONE", r"\b\d{10,15}\b", 5, "phone")


@dataclass(frozen=True)
class Policy:
    """strict_phone also takes bare runs of 10 to 15 digits for phone numbers."""

    strict_phone: bool = False
    version: str = POLICY_VERSION

    @property
    def detectors(self) -> tuple:
        return (EMAIL, CREDIT_CARD, US_SSN, PHONE, IBAN, *((STRICT_PHONE,) if self.strict_phone else ()))


DEFAULT = Policy()
TELECOM = Policy(strict_phone=True)


def luhn(digits: Column) -> Column:
    """Whether the digits' Luhn sum ends in 0."""
    places = F.filter(F.split(F.reverse(digits), ""), lambda d: d != "")
    doubled = F.transform(places, lambda d, i: F.when(i % 2 == 1, d.cast("int") * 2).otherwise(d.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda s, v: s + F.when(v > 9, v - 9).otherwise(v)) % 10 == 0


def valid_card(text: Column) -> Column:
    digits = F.regexp_replace(text, "[ -]", "")
    return F.length(digits).between(13, 19) & luhn(digits)


def valid_us_ssn(text: Column) -> Column:
    digits = F.regexp_replace(text, "[ -]", "")
    area, group, serial = F.substring(digits, 1, 3), F.substring(digits, 4, 2), F.substring(digits, 6, 4)
    return (F.length(digits) == 9) & ~area.isin("000", "666") & ~area.startswith("9") & (group != "00") & (serial != "0000")


def valid_phone(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"\D", "")).between(10, 15)


VALIDATORS = {None: lambda text: F.lit(True), "card": valid_card, "us_ssn": valid_us_ssn, "phone": valid_phone}


def matches(text: Column, detector: tuple) -> Column:
    """Spans of one detector that its validator accepts; a refused match keeps its characters from the next.

    The start of a match is the length of all gaps up to it and all matches before it.
    """
    name, pattern, priority, validator = detector
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern, -1)
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, size: int, priority: int, cls: string, value: string>>").alias("spans"))

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["gap"])
        size = F.length(pair["hit"])
        span = F.struct(start.alias("start"), (-size).alias("size"), F.lit(priority).alias("priority"), F.lit(name).alias("cls"), pair["hit"].alias("value"))
        return F.struct((start + size).alias("at"), F.when(VALIDATORS[validator](pair["hit"]), F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("hit"))
    return F.when(F.size(found) > 0, F.aggregate(pairs, empty, step, lambda a: a["spans"])).otherwise(empty["spans"])


def may_hold(text: Column, policy: Policy = DEFAULT) -> Column:
    """False for texts in which no detector's pattern matches: one search in place of one for each detector and its gaps.

    Addresses hold an @, and every other class two digits with no more than a space or dash between, which is cheap to see.
    """
    likely = F.contains(text, F.lit("@")) | F.rlike(text, F.lit("[0-9][ -]?[0-9]"))
    return F.when(likely, F.rlike(text, F.lit("|".join(f"(?:{d[1]})" for d in policy.detectors)))).otherwise(F.lit(False))


def find_spans(text: Column, policy: Policy = DEFAULT) -> Column:
    """array<struct(start, end, cls, value)> from left to right: of overlapping spans the earlier, then longer, then of lower priority number."""
    text = F.coalesce(text, F.lit(""))
    every = F.array_sort(reduce(F.concat, [matches(text, d) for d in policy.detectors]))
    empty = F.struct(F.lit(-1).alias("at"), F.array().cast("array<struct<start: int, end: int, cls: string, value: string>>").alias("spans"))

    def step(acc: Column, s: Column) -> Column:
        end = s["start"] - s["size"]
        span = F.struct(s["start"].alias("start"), end.alias("end"), s["cls"].alias("cls"), s["value"].alias("value"))
        return F.when(s["start"] >= acc["at"], F.struct(end.alias("at"), F.array_append(acc["spans"], span).alias("spans"))).otherwise(acc)

    return F.aggregate(every, empty, step, lambda a: a["spans"])


def placeholder(cls: Column, number: Column) -> Column:
    return F.concat(F.lit("<"), cls, F.lit("_"), number.cast("string"), F.lit(">"))


def numbered(spans: Column) -> Column:
    """spans with a placeholder each: values of a class are numbered by first appearance in the array."""
    def mark(s: Column) -> Column:
        own = F.array_distinct(F.transform(F.filter(spans, lambda x: x["cls"] == s["cls"]), lambda x: x["value"]))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), placeholder(s["cls"], F.array_position(own, s["value"])).alias("placeholder"))

    return F.transform(spans, mark)


def replaced(text: Column, marked: Column) -> Column:
    """text with each (start, end, placeholder) put in."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        return F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), s["placeholder"]).alias("out"))

    return F.aggregate(marked, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def redact_text(text: Column, policy: Policy = DEFAULT) -> Column:
    """One text as an episode of its own."""
    return F.when(may_hold(text, policy), replaced(text, numbered(find_spans(text, policy)))).otherwise(text)
