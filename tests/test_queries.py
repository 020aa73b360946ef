"""Every catalogue query that has SQL returns the rows that DuckDB returns."""

import math

import duckdb
import pytest

from quipu.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def text(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v:.9g}"
        return str(v)

    return sorted(tuple(text(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", list(catalogue.SQL))
def test_same_rows_as_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = duck.execute(catalogue.SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


def test_every_query_has_sql_but_the_folds():
    assert set(catalogue.QUERIES) - set(catalogue.SQL) == {"offer_clusters", "fulltext_spanish", "tariff_detection", "file_digests"}


def test_longest_prefix_is_not_a_nested_loop(spark):
    plan = catalogue.QUERIES["join_longest_prefix"](spark, SF)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
