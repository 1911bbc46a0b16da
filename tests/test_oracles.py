"""Every query program against its SQL oracle, and the registry's rules."""

import re

import duckdb
import pytest

from sceneloom import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = {q.name: q for q in registry.list_queries()}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    fix = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(fix(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.oracle])
def test_query_equals_oracle(spark, db, name):
    got = QUERIES[name].build(spark, SF)
    want = db.sql(QUERIES[name].oracle)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if not q.oracle])
def test_query_without_oracle_runs(spark, name):
    first, again = (sorted(map(tuple, QUERIES[name].build(spark, SF).collect()), key=repr) for _ in range(2))
    assert first == again and first


def test_registry():
    assert len(QUERIES) >= 90
    patterns = {p for q in QUERIES.values() for p in q.pattern.split("+")}
    assert patterns >= {f"P{i:02d}" for i in range(1, 41) if i != 38}
    assert all(re.fullmatch(r"[a-z][a-z0-9_]*", n) and q.families for n, q in QUERIES.items())
    assert registry.list_queries(pattern="P22") and registry.list_queries(family="counting")
    with pytest.raises(ValueError):
        registry.query("filtered_mean", "P08")(lambda s, d: None)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
