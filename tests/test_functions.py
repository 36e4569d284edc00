"""Every function of the inventory, each group's query against DuckDB on the same tables."""

import duckdb
import pytest

from millrace.engine import Engine
from millrace.front.dialects import UnsupportedSQL
from millrace.functions.rules import apply
from millrace.plans import function_queries
from millrace.plans.catalogue import TABLES, engine

SF = "/root/testdata/sf0.001"


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def eng(spark):
    return engine(spark, SF)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", function_queries.texts())
def test_equals_duckdb(eng, duck, name):
    source, sql, oracle = function_queries.texts()[name]
    got = sorted((tuple(map(plain, r)) for r in eng.sql(sql, source).collect()), key=str)
    assert got == sorted((tuple(map(plain, r)) for r in duck.sql(oracle).fetchall()), key=str)


def test_a_rule_takes_exactly_its_arguments():
    assert apply("f({0})", ["a"]) == "f(a)" and apply("f({0})", ["a", "b"]) is None and apply("f({1})", ["a"]) is None
    assert apply("g({0}, {1:})", ["a", "b", "c"]) == "g(a, b, c)"
    assert apply({1: "one({0})", None: "many({*})"}, ["a", "b", "c"]) == "many(a, b, c)"


@pytest.mark.parametrize(
    ("dialect", "call"),
    [("bigquery", "FARM_FINGERPRINT('a')"), ("mysql", "WEEK(DATE '2024-01-01', 5)"), ("postgres", "array_length(a, 3)"), ("clickhouse", "multiIf(a, 1, b, 2)"), ("tsql", "HASHBYTES('MD2', 'a')")],
)
def test_calls_without_a_right_form_are_refused(spark, dialect, call):
    with pytest.raises(UnsupportedSQL):
        Engine(spark).to_spark(f"SELECT {call}", dialect)
