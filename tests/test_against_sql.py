"""Every registered query against its SQL, on the smallest test tables."""

import importlib

import duckdb
import pytest

entry = importlib.import_module("__spark_entry__")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def sql(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)

    def shown(v):
        return "~" if v is None else repr(float(v)) if isinstance(v, float) else str(v)

    return sorted(tuple(shown(row[i]) for i in order) for row in values)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, data, name):
    df = QUERIES[name](spark, data)
    got = df.collect()
    if name not in ORACLES:
        assert got
        return
    result = sql.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, got) == rows(names, result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
