"""Observations without what changes from step to step."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .profiles import DEFAULT, Profile

#: Counters, times and durations that every harness may print.
VOLATILE = (
    r"\bstep\s+\d+(\s+of\s+\d+)?\b",
    r"\bturn\s+\d+(\s+of\s+\d+)?\b",
    r"\bt\s*=\s*\d+\b",
    r"\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?Z?\b",
    r"\b\d+\s*ms\b",
    r"\[\s*\d+\s*/\s*\d+\s*\]",
)
#: What stands for a mark after white space; the corpora to compare with hold this very character.
MARK = "\u0001"


def normalize_observation(text: Column, profile: Profile = DEFAULT, tidy: str = "mark") -> Column:
    """Volatile parts out, white space single, lower case. tidy 'fixed' keeps the mark that follows white space."""
    for pattern in (*VOLATILE, *profile.volatile):
        text = F.regexp_replace(text, "(?iuU)" + pattern, "")
    text = F.regexp_replace(text, r"(?U)\s+", " ")
    text = F.regexp_replace(text, r"\s+([.,;:!?])", "$1" if tidy == "fixed" else MARK)
    text = F.regexp_replace(text, r"^[\s.,;:!?()\[\]-]+", "")
    return F.lower(F.trim(text))


def observation_fingerprint(text: Column, profile: Profile = DEFAULT) -> Column:
    return F.sha2(normalize_observation(text, profile), 256)
