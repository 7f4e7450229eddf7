"""SQL of the redaction queries over texts as they are.

What a word boundary is differs between engines: here letters and digits beyond ASCII are word characters, there they aren't. A
match can neither hold such a character nor begin or end inside the run of word characters around it, so the SQL masks these
runs, at equal length, before it searches. (A local part that begins with a mark right after such a letter isn't followed.)
"""

from __future__ import annotations

from ..functions.redaction import CREDIT_CARD, DEFAULT, EMAIL, PHONE, US_SSN, Policy

_DIGITS = "regexp_replace(hit, '[ -]', '', 'g')"
_LUHN = f"""list_reduce(list_transform(range(1, len({_DIGITS}) + 1), lambda i: case when i % 2 = 0 and 2 * substr(reverse({_DIGITS}), i, 1)::int > 9 then 2 * substr(reverse({_DIGITS}), i, 1)::int - 9
  when i % 2 = 0 then 2 * substr(reverse({_DIGITS}), i, 1)::int else substr(reverse({_DIGITS}), i, 1)::int end), lambda a, b: a + b) % 10 = 0"""
VALID = {
    None: "true",
    "card": f"case when len({_DIGITS}) between 13 and 19 then {_LUHN} else false end",
    "us_ssn": f"len({_DIGITS}) = 9 and substr({_DIGITS}, 1, 3) not in ('000', '666') and substr({_DIGITS}, 1, 1) <> '9' and substr({_DIGITS}, 4, 2) <> '00' and substr({_DIGITS}, 6, 4) <> '0000'",
    "phone": r"len(regexp_replace(hit, '\D', '', 'g')) between 10 and 15",
}
assert {d[3] for d in (EMAIL, CREDIT_CARD, US_SSN, PHONE)} <= set(VALID)


def spans(source: str, policy: Policy = DEFAULT) -> str:
    """Common table expressions src (ep, ord, text) and span (ep, ord, start, "end", cls, value): overlaps are resolved from left to right."""
    of = lambda d: f"""select ep, ord, text, '{d[0]}' as cls, {d[2]} as priority, '{d[3] or ''}' as validator, regexp_extract_all(t, '{d[1]}') as hits, string_split_regex(t, '{d[1]}') as gaps from masked"""
    valid = " ".join(f"when validator = '{name}' then {sql}" for name, sql in VALID.items() if name)
    return rf"""src as ({source}),
masked as (select ep, ord, text, array_to_string(list_transform(regexp_extract_all(regexp_replace(regexp_replace(text, '[^\x00-\x7F\p{{L}}\p{{Nd}}]', chr(2), 'g'), '[^\x00-\x7F]', chr(1), 'g'), '[A-Za-z0-9_\x01]+|[^A-Za-z0-9_\x01]+'),
  lambda w: case when contains(w, chr(1)) then repeat(chr(1), len(w)) else w end), '') as t from src where text is not null),
found as ({" union all ".join(map(of, policy.detectors))}),
one as (select ep, ord, text, cls, priority, validator, unnest(hits) as hit, unnest(gaps[1:len(hits)]) as gap, generate_subscripts(hits, 1) as n from found where len(hits) > 0),
placed as (select *, cast(sum(len(gap) + len(hit)) over (partition by ep, ord, cls, priority order by n) - len(hit) as bigint) as s from one),
sound as (select * from placed where case {valid} else true end),
listed as (select ep, ord, any_value(text) as text, list({{'s': s, 'n': len(hit), 'c': cls}} order by s, len(hit) desc, priority) as l from sound group by 1, 2),
taken as (select ep, ord, text, unnest(list_reduce(l, lambda a, x: case when x.s >= a.at then {{'at': x.s + x.n, 'runs': list_append(a.runs, {{'s': x.s, 'n': x.n, 'c': x.c}})}} else a end,
  {{'at': 0::bigint, 'runs': []::struct(s bigint, n bigint, c varchar)[]}}).runs) as r from listed),
span as (select ep, ord, text, cast(r.s as int) as start, cast(r.s + r.n as int) as "end", r.c as cls, substr(text, r.s + 1, r.n) as value from taken)"""


#: (ep, cls, value, number): numbers by first appearance within an episode and class.
NUMBERS = """first as (select ep, cls, value, min({'o': ord, 's': start}) as f from span group by 1, 2, 3),
numbers as (select ep, cls, value, cast(row_number() over (partition by ep, cls order by f) as int) as number from first)"""
#: (ep, ord, redacted) of every text.
REDACTED = f"""{NUMBERS},
marked as (select s.*, concat('<', cls, '_', number, '>') as placeholder, lag("end", 1, 0) over (partition by ep, ord order by start) as before from span s join numbers using (ep, cls, value)),
put as (select ep, ord, string_agg(substr(text, before + 1, start - before) || placeholder, '' order by start) as head, max("end") as last_end from marked group by 1, 2),
redacted as (select ep, ord, case when head is null then text else head || substr(text, last_end + 1) end as redacted from src left join put using (ep, ord))"""

DOCUMENTS = "select doc_id as ep, 0 as ord, text from documents"
SOURCES = "select source as ep, doc_id as ord, text from documents"
TURNS = "select conv_id as ep, turn as ord, text from conversations"

ORACLES = {
    "redact_spans": f"""with {spans(DOCUMENTS)} select ep as doc_id, start, "end", cls, value from span""",
    "redact_documents": f"with {spans(DOCUMENTS)}, {REDACTED} select ep as doc_id, sha256(redacted) as sha256 from redacted",
    "redact_conversations": f"with {spans(TURNS)}, {REDACTED} select ep as conv_id, ord as turn, sha256(redacted) as sha256 from redacted",
    "placeholder_index_all": f"with {spans(SOURCES)}, {NUMBERS} select ep as source, cls, value, number from numbers",
    "redact_counts_all": f"with {spans(SOURCES)} select ep as source, cls, count(*) as n, count(distinct value) as distinct_values from span group by 1, 2",
}
