import os

import pytest

import __spark_entry__ as entry
from marlstone.plans import registry

FOLDER = "/root/testdata/sf0.001"


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(registry.QUERIES) >= 40
    assert "llm" not in str([m for m in vars(registry)])


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
@pytest.mark.parametrize("name", [n for n in registry.ORACLE])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for f in os.listdir(FOLDER):
        connection.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    made = registry.QUERIES[name](spark, FOLDER)
    expected = connection.sql(registry.ORACLE[name])
    columns = sorted(expected.columns)
    assert sorted(made.columns) == columns

    def plain(x):
        return round(x, 6) if isinstance(x, float) else x

    a = sorted((tuple(plain(r[c]) for c in columns) for r in made.collect()), key=repr)
    b = sorted((tuple(map(plain, r)) for r in connection.sql(f"SELECT {', '.join(columns)} FROM ({registry.ORACLE[name]})").fetchall()), key=repr)
    assert a == b


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 10 and [r["rank"] for r in rows] == list(range(1, 11))
