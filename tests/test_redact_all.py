"""Placeholders and counts of a source's documents against a plain walk over them."""

import re
from collections import Counter

from episodica.functions import redaction
from episodica.operators.redact import _accepts
from episodica.plans import catalog

TEXTS = [
    ("a", 1, "Müller jörg.x@bücher.de, über anna@böse.example.com; écrire à zoé.b@mail.example.fr ou z.b@mail.example.fr."),
    ("a", 2, "z.b@mail.example.fr called +49 (30) 1234 5678, card 4111 1111 1111 1111, no card 4111 1111 1111 1112, SSN 123-45-6789 not 000-45-6789."),
    ("b", 3, "IBAN DE44500105175407324931 und 555-123-4567, 123-45-6789, 5500-0000-0000-0004 é4111111111111111 4111111111111111é"),
    ("b", 4, "card inside an address: 4111111111111111@pay.example.com; 555-123-4567 again, again 555-123-4567"),
    ("a", 0, "last in this list, first in order: 555-123-4567 ñ a.b@c.example.org"), ("c", 5, None), ("c", 6, "nothing"),
]


def plain():
    names, counts = {}, Counter()
    for source, _, text in sorted(TEXTS, key=lambda r: r[1]):
        hits = [(m.start(), -len(m[0]), order, cls, m[0]) for cls, p, order, check in redaction.DEFAULT.detectors for m in re.finditer(p, text or "") if _accepts(check, m[0])]
        at = 0
        for start, size, _, cls, value in sorted(hits):
            if start >= at:
                own = names.setdefault((source, cls), {})
                own.setdefault(value, len(own) + 1)
                counts[source, cls] += 1
                at = start - size
    return names, counts


def test_all_classes_over_unchanged_text(spark, tmp_path):
    spark.createDataFrame(TEXTS, "source string, doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    names, counts = plain()
    assert {cls for _, cls in names} == {"EMAIL", "CREDIT_CARD", "US_SSN", "PHONE", "IBAN"}
    got = catalog.QUERIES["placeholder_index_all"](spark, str(tmp_path)).select("source", "cls", "value", "number").collect()
    assert sorted(map(tuple, got)) == sorted((*k, v, n) for k, own in names.items() for v, n in own.items())
    got = catalog.QUERIES["redact_counts_all"](spark, str(tmp_path)).select("source", "cls", "n", "distinct_values").collect()
    assert sorted(map(tuple, got)) == sorted((*k, n, len(names[k])) for k, n in counts.items())
