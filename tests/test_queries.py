"""Every query of the engine against its SQL on the same tables."""

import os

import pytest

from episodica.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    plain = lambda v: float(v) if not isinstance(v, (bool, str, int, type(None))) and hasattr(v, "__float__") else v
    return sorted(repr([plain(r[k]) for k in order]) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sql, name):
    found = catalog.QUERIES[name](spark, DATA)
    got = found.collect()
    if name not in catalog.ORACLES:
        assert got
        return
    expected = sql.sql(catalog.ORACLES[name])
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows_of(found.columns, got) == rows_of(expected.columns, expected.fetchall())


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
