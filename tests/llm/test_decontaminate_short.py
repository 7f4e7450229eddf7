import random

import pyarrow as pa

from episodica.llm import decontaminate as dc


def flat(text):
    return dc.normalized(pa.array([text], pa.string()))[0].as_py()


def test_short_items_count_without_edits_and_between_words():
    rng = random.Random(3)
    items = [(1, "ZZ top!"), (2, "yes"), (3, "é"), (4, "so so"), (5, "..."), (6, "")]
    matcher = dc.Matcher(items)
    words = ["zz", "top", "topp", "yes", "yess", "so", "é", "aé", "o"]
    for _ in range(300):
        text = " ".join(rng.choices(words, k=rng.randint(0, 6)))
        expected = [(i, 0) for i, t in items if flat(t) and f" {flat(t)} " in f" {text} "]
        assert matcher.match(text) == expected, text


def test_short_and_long_items_share_an_automaton():
    long = "a question of more than four and twenty letters"
    matcher = dc.Matcher([(1, long), (2, "of more")])
    assert matcher.match(flat("x " + long + " y")) == [(1, 0), (2, 0)]
    assert matcher.match(flat(long.replace("twenty", "twent"))) == [(1, 1), (2, 0)]
    assert matcher.match("off more") == []


def test_blocks_give_the_same_and_names_cannot_clash(spark):
    items = [(k, f"item number {k} " + "abcdefgh " * (k % 5)) for k in range(40)]
    docs = [(k, f"before item number {k} " + "abcdefgh " * (k % 5) + "after", "x") for k in range(40)] + [(99, "nothing", "x")]
    table = spark.createDataFrame(docs, "doc_id long, text string, leaks string")
    held = spark.createDataFrame(items, "item_id long, text string")
    got = [sorted((r.doc_id, sorted((x.item_id, x.distance) for x in r.leaks)) for r in dc.leaks(table, held, table.columns, block=block).collect()) for block in (dc.BLOCK, 1500)]
    assert got[0] == got[1] and all((k, 0) in dict(got[0])[k] for k in range(40)) and dict(got[0])[99] == []
    left = dc.clean(table, held)
    assert left.columns == table.columns and [tuple(r) for r in left.collect()] == [(99, "nothing", "x")]
