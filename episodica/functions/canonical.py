"""Actions as stable symbols."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .profiles import DEFAULT, Profile

NOOP = "noop"
MOST_CALLS = 8
#: Reserved domains and generic local parts.
PLACEHOLDER_DOMAINS = ("example.com", "example.org", "example.net", "test.com", "email.com", "domain.com")
PLACEHOLDER_LOCALS = ("user", "customer", "test", "example", "email", "your_email", "youremail", "name")
#: Python's white space, which str.strip drops.
BLANK = r"[\s\x1c-\x1f\x85\p{Z}]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def classify_email(value: Column) -> Column:
    """email_absent, placeholder_like or email_present, of a string."""
    text = strip(value)
    low = F.lower(text)
    odd = F.split_part(low, F.lit("@"), F.lit(2)).isin(*PLACEHOLDER_DOMAINS) | F.split_part(low, F.lit("@"), F.lit(1)).isin(*PLACEHOLDER_LOCALS)
    return (
        F.when(F.coalesce(text, F.lit("")) == "", "email_absent")
        .when(text.rlike(r"^<EMAIL_\d+>$"), "email_present")
        .when(~text.rlike(rf"(?iu)^[^@\s\x1c-\x1f\x85\p{{Z}}]+@[^@\s\x1c-\x1f\x85\p{{Z}}]+\.[a-z]{{2,}}$"), "placeholder_like")
        .when(odd, "placeholder_like")
        .otherwise("email_present")
    )


def type_name(value: Column) -> Column:
    """null, bool, int, float, str, list or dict, of a variant."""
    kind = F.schema_of_variant(value)
    scale = F.regexp_extract(kind, r"^DECIMAL\((\d+),(\d+)\)", 2)
    precision = F.regexp_extract(kind, r"^DECIMAL\((\d+),", 1).try_cast("int")
    return (
        F.when(value.isNull() | (kind == "VOID"), "null")
        .when(kind == "BOOLEAN", "bool")
        .when(kind == "BIGINT", "int")
        .when(kind == "STRING", "str")
        .when(kind.startswith("ARRAY"), "list")
        .when(kind.startswith("OBJECT"), "dict")
        .when((scale == "0") & (precision > 18), "int")
        .when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), "float")
        .otherwise("unknown")
    )


def tool_symbol(name: Column, arguments: Column, profile: Profile = DEFAULT) -> Column:
    """tool:name(argument:class,...): present arguments by name, then absent sensitive ones; arguments is map<string, variant>."""
    tool = F.when(F.coalesce(name, F.lit("")) == "", "unknown").otherwise(name)
    held = F.coalesce(arguments, F.create_map().cast("map<string, variant>"))
    common = F.array(*map(F.lit, profile.sensitive.get("*", ()))).cast("array<string>")
    sensitive = common
    for own, names in profile.sensitive.items():
        if own != "*":
            sensitive = F.when(tool == own, F.array_union(common, F.array(*map(F.lit, names)))).otherwise(sensitive)

    def present(key: Column) -> Column:
        value = F.element_at(held, key)
        text = F.try_variant_get(value, "$", "string")
        as_email = F.when(type_name(value) == "str", classify_email(text)).otherwise("email_absent")
        classed = F.array_contains(sensitive, key) & F.array_contains(F.array(*map(F.lit, profile.classified)).cast("array<string>"), key)
        return F.concat(key, F.lit(":"), F.when(classed, as_email).otherwise(type_name(value)))

    absent = F.transform(F.array_sort(F.array_except(sensitive, F.map_keys(held))), lambda k: F.concat(k, F.lit(":"), F.when(k.isin(*(profile.classified or ("",))), "email_absent").otherwise("null")))
    parts = F.concat(F.transform(F.array_sort(F.map_keys(held)), present), absent)
    return F.concat(F.lit("tool:"), tool, F.lit("("), F.array_join(parts, ","), F.lit(")"))


def text_symbol(text: Column, profile: Profile = DEFAULT) -> Column:
    """The verb and the kinds of its slots, by the profile's words; an unknown verb keeps the head word."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9_]+)"), 1)
    line = F.concat(F.array_join(tokens, " "), F.lit(" "))
    verb = F.lit(None).cast("string")
    for v in sorted(profile.verbs, key=lambda v: len(v.split())):
        verb = F.when(line.startswith(v + " "), v).otherwise(verb)
    rest = F.slice(tokens, F.size(F.split(verb, " ")) + 1, F.greatest(F.size(tokens), F.lit(1)))
    empty = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("slot"))

    def closed(acc: Column) -> Column:
        return F.when(acc["slot"] == "", acc["out"]).otherwise(F.array_append(acc["out"], acc["slot"]))

    def step(acc: Column, token: Column) -> Column:
        joins = token.isin(*profile.connectives) if profile.connectives else F.lit(False)
        slot = F.when((acc["slot"] == "<recep>") | (token.isin(*profile.receptacles) if profile.receptacles else F.lit(False)), "<recep>").otherwise("<obj>")
        return F.when(joins, F.struct(F.array_append(closed(acc), token).alias("out"), F.lit("").alias("slot"))).otherwise(F.struct(acc["out"].alias("out"), slot.alias("slot")))

    slots = F.aggregate(rest, empty, step, closed)
    return (
        F.when(F.coalesce(F.size(tokens), F.lit(0)) <= 0, NOOP)
        .when(verb.isNull(), F.concat(F.lit("text:"), F.try_element_at(tokens, F.lit(1))))
        .otherwise(F.array_join(F.concat(F.array(verb), slots), " "))
    )


def calls(source: str | None) -> str:
    """code:name+name of the functions a Python source calls, sorted, a few at most."""
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError):
        return "code:unparsed"
    names = set()
    for node in ast.walk(tree):
        if isinstance(node, ast.Call):
            target, path = node.func, []
            while isinstance(target, ast.Attribute):
                path.insert(0, target.attr)
                target = target.value
            if isinstance(target, ast.Name):
                names.add(".".join([target.id, *path]))
            elif path:
                names.add(".".join(["<expr>", *path]))
    return "code:" + ("+".join(sorted(names)[:MOST_CALLS]) or "none")


def _calls(source: pd.Series) -> pd.Series:
    return source.map(calls)


def code_symbol(source: Column) -> Column:
    return F.pandas_udf(_calls, "string")(source)


def action_symbol(kind: Column, name: Column, arguments: Column, text: Column, profile: Profile = DEFAULT) -> Column:
    """One symbol for any kind of action; name and arguments are of tool calls, text of the others."""
    own = (
        F.when(kind == "tool_call", tool_symbol(name, arguments, profile))
        .when(kind == "text_action", text_symbol(text, profile))
        .when(kind == "code_execution", code_symbol(F.when(kind == "code_execution", text)))
        .when(kind == "noop", NOOP)
        .otherwise(F.concat(F.lit("unknown:"), kind))
    )
    return F.lower(strip(own))
