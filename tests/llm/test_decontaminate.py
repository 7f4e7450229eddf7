import random

from pyspark.sql import functions as F

from episodica.llm import decontaminate as dc


def brute(pattern, text):
    """Least edit distance of the pattern to a part of the text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != c), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_distance_matches_the_full_table():
    rng = random.Random(4)
    for _ in range(300):
        p = "".join(rng.choices("abc ", k=rng.randint(1, 90)))
        t = "".join(rng.choices("abc ", k=rng.randint(0, 120)))
        assert dc.Pattern(p, 0.1).distance(t) == brute(p, t)


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        k = rng.randrange(len(out))
        rng.choice([lambda: out.__setitem__(k, "q"), lambda: out.pop(k), lambda: out.insert(k, "z")])()
    return "".join(out)


def test_matches_brute_force(spark):
    rng = random.Random(5)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu") for b in ("sa", "re", "no", "xi", "po")]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    items = [(k, prose(rng.randint(8, 40))) for k in range(12)] + [(90, "short"), (91, None), (92, ""), (93, prose(20))]
    items.append((94, items[-1][1].upper() + "!"))
    docs = [(None, prose(50)), (1, None), (2, ""), (3, "x " * 40_000 + items[0][1])]
    for k in range(4, 28):
        item = items[rng.randrange(12)][1]
        docs.append((k, prose(30) + ". " + edited(rng, item, rng.randint(0, 12)) + " -- " + prose(30)))
    docs.append((28, items[15][1]))
    table = spark.createDataFrame([(i, t, 1, []) for i, t in docs], "doc_id long, text string, item_id int, leaks array<int>")
    held = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id int, text string, doc_id int")
    for block in (dc.BLOCK, 500):
        got = {(r.doc_id, r.item_id, r.distance) for r in dc.leaks(table.drop("leaks"), held, ["doc_id"], block=block).select("doc_id", F.explode("leaks").alias("x")).select("doc_id", "x.*").collect()}
        import pyarrow as pa

        flat = lambda t: dc.normalized(pa.array([t or ""], pa.string()))[0].as_py()
        expected = set()
        for i, t in docs:
            for j, u in items:
                p = flat(u)
                if len(p) >= dc.LEAST and len(flat(t)) < 5000 and (d := brute(p, flat(t))) <= int(dc.RATE * len(p)):
                    expected.add((i, j, d))
        assert {x for x in got if x[0] != 3} == expected and (3, 0, 0) in got


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert dc.leaks(docs, items, ["doc_id"]).first()["leaks"] == []
    assert dc.leaks(docs.limit(0), items, ["doc_id"]).isEmpty()
