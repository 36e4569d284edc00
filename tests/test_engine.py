import random
import re
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.engine import Engine
from millrace.front.dialects import UnsupportedSQL
from millrace.operators.joins import asof_join, positional_join, range_join
from millrace.operators.match_recognize import match_recognize
from millrace.operators.relational import distinct_on, limit_by, reservoir, top_with_ties, with_fill
from millrace.plans import analysis, corpus
from millrace.plans.catalogue import TABLES, engine, texts
from millrace.streaming.windows import sessions, windowed

SF = "/root/testdata/sf0.001"
SOME = "sql_flagship sql_asof_left sql_asof_join sql_positional sql_groups_frame sql_exclude_current sql_distinct_on sql_qualify sql_union_by_name sql_limit_percent sql_string_agg sql_array_agg sql_quantified_all sql_star_rename sql_pivot sql_tsql_top_ties sql_oracle_keep sql_clickhouse_limit_by sql_mysql_group_concat sql_postgres_ordinality sql_window_inherit sql_lists sql_structs_maps sql_regex_functions".split()


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def eng(spark):
    return engine(spark, SF)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SOME)
def test_equals_duckdb(eng, duck, name):
    source, sql, oracle = texts()[name]
    got = sorted((tuple(map(plain, r)) for r in eng.sql(sql, source).collect()), key=str)
    assert got == sorted((tuple(map(plain, r)) for r in duck.sql(oracle).fetchall()), key=str)


def test_connect_by(eng):
    source, sql, _ = texts()["sql_oracle_connect_by"]
    assert sorted(map(tuple, eng.sql(sql, source).collect())) == [(1, 1, "/1", 1), (2, 2, "/1/2", 1), (3, 2, "/1/3", 1), (4, 3, "/1/2/4", 1)]


def test_keep_counts_all_ties(spark):
    rows = [(1, 5, 9.0), (1, 8, 9.0), (1, 7, 9.0), (1, 1, 2.0), (1, 3, 2.0), (2, 4, 1.0), (2, 6, None), (2, None, None)]
    for rows_ in (rows, rows[::-1]):
        spark.createDataFrame(rows_, "g int, x bigint, p double").repartition(3).createOrReplaceTempView("kept")
        keep = "KEEP (DENSE_RANK {} ORDER BY p{})".format
        items = [
            f"MAX(x) {keep('LAST', '')}", f"MIN(x) {keep('LAST', '')}", f"MAX(x) {keep('FIRST', '')}", f"MIN(x) {keep('FIRST', '')}", f"MAX(x) {keep('LAST', ' NULLS FIRST')}", f"MAX(x) {keep('FIRST', ' DESC')}",
            f"SUM(x) {keep('LAST', '')}", f"COUNT(*) {keep('LAST', '')}", f"COUNT(x) {keep('LAST', '')}", f"AVG(x) {keep('FIRST', '')}", f"MIN(x) {keep('FIRST', ', x DESC')}",
        ]
        sql = f"SELECT g, {', '.join(f'{x} AS c{i}' for i, x in enumerate(items))} FROM kept GROUP BY g"
        # Oracle's nulls rank last in ascending and first in descending order
        assert sorted(map(tuple, Engine(spark).sql(sql, "oracle").collect())) == [(1, 8, 5, 3, 1, 8, 8, 20, 3, 3, 2.0, 3), (2, 6, 6, 4, 4, 4, 6, 6, 2, 1, 4.0, 4)]
        over = f"SELECT DISTINCT g, MAX(x) {keep('LAST', '')} OVER (PARTITION BY g) AS a FROM kept"
        assert sorted(map(tuple, Engine(spark).sql(over, "oracle").collect())) == [(1, 8), (2, 6)]


def test_aggregates_hold_few_values(spark, tmp_path):
    """Quantiles of large groups keep values near the quantile, first rows only as many as asked for, lengths of lists no list."""
    con = duckdb.connect()
    con.sql(f"""copy (select i % 3 as g, case when i % 50 > 0 then (hash(i) % 100003)::double / 8 end as x, (hash(i + 7) % 20)::int as few, i as k, ((hash(i + 9) % 9999) / 100)::decimal(9, 2) as d
        from range(90000) r(i) union all select 9, i, i, i, i from range(5) r(i) union all select null, null, 1, null, 2) to '{tmp_path}/sized.parquet' (format parquet)""")
    con.sql(f"create view sized as select * from '{tmp_path}/sized.parquet'")
    e = Engine(spark, "duckdb").register(str(tmp_path), ["sized"])
    shares = [0, 0.0004, 0.3, 0.5, 0.9, 0.9995, 1]
    items = [f"quantile_{kind}({c}, {p}) AS {kind}{c}{i}" for i, p in enumerate(shares) for kind, c in (("cont", "x"), ("disc", "d"), ("cont", "few"), ("disc", "x"), ("disc", "k"))]
    items += ["median(x) AS m", "quantile_cont(x, 0.2) FILTER (WHERE k > 70000) AS f", "len(list(x)) AS n", "len(list(k) FILTER (WHERE k > 5)) AS nf"]
    items += [f"array_to_string(arg_{m}(k, x + k / 1e7, 4), ',') AS {m}4" for m in ("max", "min")]
    for tail in (" GROUP BY g", "", " WHERE k > 100 GROUP BY g HAVING median(x) > 0 ORDER BY median(x)"):
        sql = f"SELECT {'g, ' if 'GROUP' in tail else ''}{', '.join(items)} FROM sized{tail}"
        text = e.to_spark(sql)[0]
        assert "collect_list" not in text and "__q.__b0" in text
        flat = lambda rows: sorted((tuple(round(float(v), 6) if isinstance(v, (int, float, Decimal)) else v or 0 for v in r) for r in rows), key=str)
        got, want = flat(e.sql(sql).collect()), flat(con.sql(sql).fetchall())
        assert not [(name, x, y) for a, b in zip(got, want, strict=True) for name, x, y in zip(con.sql(sql).columns, a, b, strict=True) if x != y]
    odd = spark.createDataFrame([(float(v),) for v in ["nan", "inf", "-inf"]], "x double").crossJoin(spark.range(4000)).select("x")
    odd.createOrReplaceTempView("odd")
    got = e.sql("SELECT quantile_disc(x, 0.1) AS a, quantile_disc(x, 0.5) AS b, quantile_disc(x, 0.9) AS c FROM odd").first()
    assert str(tuple(got)) == "(-inf, inf, nan)"


def test_row_level_writes(spark):
    e = Engine(spark)
    spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string").createOrReplaceTempView("w")
    spark.createDataFrame([(2, "B"), (9, "N")], "k int, v string").createOrReplaceTempView("ws")
    rows = lambda: sorted((tuple(r) for r in spark.table("w").collect()), key=str)
    e.sql("UPDATE w SET v = 'x' WHERE k = 1")
    assert rows() == [(1, "x"), (2, "b"), (3, None)]
    e.sql("MERGE INTO w USING ws ON w.k = ws.k WHEN MATCHED THEN UPDATE SET v = ws.v WHEN NOT MATCHED THEN INSERT (k, v) VALUES (ws.k, ws.v)")
    assert rows() == [(1, "x"), (2, "B"), (3, None), (9, "N")]
    e.sql("DELETE FROM w WHERE v = 'x'")
    assert rows() == [(2, "B"), (3, None), (9, "N")]


def test_copy_and_select_into(spark, tmp_path):
    e = Engine(spark, "duckdb")
    e.sql(f"COPY (SELECT 1 AS a UNION ALL SELECT 2) TO '{tmp_path}/x.parquet' (FORMAT parquet)")
    assert e.sql(f"SELECT sum(a) AS s FROM '{tmp_path}/x.parquet'").first().s == 3
    e.sql("SELECT 5 AS z INTO t5", "tsql")
    assert spark.table("t5").first().z == 5


def test_dataframe_joins(spark):
    left = spark.createDataFrame([(1, 5), (1, 9), (2, 1), (None, 4)], "k int, t int")
    right = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (2, 2, "c"), (None, 1, "n")], "k int, t int, v string")
    got = {(r.k, r.t): r.v for r in asof_join(left, right, "t", "t", [("k", "k")]).collect()}
    assert got == {(1, 5): "a", (1, 9): "b", (2, 1): None, (None, 4): None}
    strict = {(r.k, r.t): r.v for r in asof_join(left, right, "t", "t", [("k", "k")], op=">").collect()}
    assert strict[1, 5] is None
    pos = positional_join(spark.range(5).repartition(1), spark.range(3).select(F.col("id").alias("b"))).collect()
    assert len(pos) == 5
    iv = spark.createDataFrame([(0, 10), (8, 30)], "lo int, hi int")
    assert range_join(spark.range(0, 40, 9), iv, "id", "lo", "hi", 7.0).count() == sum(lo <= x <= hi for x in range(0, 40, 9) for lo, hi in ((0, 10), (8, 30)))


def test_relational_operators(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(10)], "a int, k int")
    assert {(r.k, r.a) for r in distinct_on(df, ["k"], [F.desc("a")]).collect()} == {(0, 9), (1, 7), (2, 8)}
    assert top_with_ties(df, 2, ["k"]).count() == 4
    assert limit_by(df, 2, ["k"], [F.asc("a")]).count() == 6
    assert with_fill(spark.createDataFrame([(1, "x")], "id long, v string"), "id", 0, 4).count() == 4
    assert reservoir(df, 4).count() == 4


def test_match_recognize(spark):
    prices = [10, 8, 6, 9, 12, 11, 13]
    df = spark.createDataFrame([(1, i, p) for i, p in enumerate(prices)], "s int, t int, p int")
    out = match_recognize(df, ["s"], ["t"], {"DOWN": "p < prev_p", "UP": "p > prev_p"}, "DOWN+ UP+").orderBy("t").collect()
    assert [(r.t, r.match_number, r.classifier) for r in out] == [(1, 1, "DOWN"), (2, 1, "DOWN"), (3, 1, "UP"), (4, 1, "UP"), (5, 2, "DOWN"), (6, 2, "UP")]


def test_match_recognize_runs_over_batches(spark):
    """Many partitions share a task's batches, and a partition may reach over several of them."""
    rng = random.Random(5)
    rows = [(g if g else None, t, rng.choice([None, *range(6)])) for g, size in enumerate([3, 1, 40, 2, 2, 17, 1, 5, 90]) for t in range(size)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "s int, t int, p int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for pattern, skip in (("DOWN+ UP+", True), ("DOWN+ UP+", False), ("DOWN* UP??", True), ("^ UP | DOWN $", True), ("UP{2,3}", False)):
            out = match_recognize(df, ["s"], ["t"], {"DOWN": "p < prev_p", "UP": "p > prev_p"}, pattern, skip)
            assert "FlatMapGroups" not in out._jdf.queryExecution().toString()
            rx, want = re.compile(re.sub(r"\s", "", pattern.replace("DOWN", "D").replace("UP", "U"))), set()
            for g in {r[0] for r in rows}:
                p = [r[2] for r in rows if r[0] == g]
                signs = "." + "".join("." if a is None or b is None or a == b else "D" if b < a else "U" for a, b in zip(p, p[1:], strict=False))
                at = number = 0
                while at < len(signs) and (m := rx.search(signs, at)):
                    number += m.end() > m.start()
                    want |= {(g, i, p[i], number, i - m.start() + 1, "DOWN" if signs[i] == "D" else "UP") for i in range(*m.span())}
                    at = m.end() if skip and m.end() > m.start() else m.start() + 1
            got = [tuple(r) for r in out.collect()]
            assert len(got) == len(want) and set(got) == want
        whole = match_recognize(df.where("s = 8"), [], ["t"], {"DOWN": "p < prev_p"}, "DOWN", columns={"p"})
        assert whole.columns == ["p", "match_number", "match_row", "classifier"] and whole.count() > 9
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_windows(spark):
    ev = spark.read.parquet(f"{SF}/events.parquet")
    w = windowed(ev, "ts", "1 day", None, ["event_type"], [F.count("*").alias("n")])
    assert w.agg(F.sum("n")).first()[0] == 1000
    assert sessions(ev, "ts", "1 hour", ["user_id"], [F.count("*").alias("n")]).agg(F.sum("n")).first()[0] == 1000


def test_stream(spark, tmp_path):
    ev = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    ev.write.parquet(f"{tmp_path}/in")
    stream = windowed(spark.readStream.schema(ev.schema).parquet(f"{tmp_path}/in"), "ts", "1 day", None, ["event_type"], [F.count("*").alias("n")], "1 hour")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("streamed").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("streamed").agg(F.sum("n")).first()[0] == 1000


def test_types_by_catalyst(spark):
    schema = {"orders": [("customer_id", "bigint", True), ("amount", "decimal(10,2)", False)]}
    r = analysis.analyze("SELECT customer_id, sum(amount) AS s FROM orders GROUP BY 1", "duckdb", schema, spark)
    assert r.types == [("customer_id", "bigint", True), ("s", "decimal(20,2)", True)]


def test_corpus(spark):
    df = spark.createDataFrame([("q1", "SELECT TOP 2 a FROM t"), ("q2", "SELECT FROM"), ("q3", None)], "id string, sql string")
    got = {r.id: (r.transpiled, bool(r.transpiled_error)) for r in corpus.transpile_column(df, "sql", "tsql").collect()}
    assert got["q1"][0] == "SELECT `a` FROM `t` LIMIT 2" and got["q2"] == (None, True) and got["q3"] == (None, False)
    assert corpus.token_rows(df.filter("id = 'q1'"), "sql", "tsql").count() == 6
    edges = corpus.lineage_edges(df.filter("id = 'q1'"), "sql", "tsql").collect()
    assert [(e.out_col, e.src_table, e.src_col) for e in edges] == [("a", "t", "a")]


def test_python_functions(spark):
    e = Engine(spark, "mysql")
    r = e.sql("""SELECT JSON_SET('{"a":1}', '$.b', 'x') AS s, JSON_REMOVE('{"a":1,"b":[1,2]}', '$.b[0]') AS r, JSON_ARRAY_APPEND('{"a":[1]}', '$.a', 'y') AS p""").first()
    assert (r.s, r.r, r.p) == ('{"a":1,"b":"x"}', '{"a":1,"b":[2]}', '{"a":[1,"y"]}')
    assert e.sql("SELECT JAROWINKLER_SIMILARITY('MARTHA', 'MARHTA') AS j", "snowflake").first().j == 96  # an integer of 0 to 100 there
    assert spark.sql("SELECT * FROM sql_tokens('SELECT 1', 'duckdb')").count() == 2
    assert [tuple(x) for x in spark.sql("SELECT * FROM sql_lineage('SELECT a + 1 AS b FROM t', 'duckdb')").collect()] == [("b", "t", "a")]


def test_multi_insert(spark):
    e = Engine(spark, "oracle")
    for t in ("small", "large", "rest"):
        spark.sql(f"DROP TABLE IF EXISTS mi_{t}")
        e.sql(f"CREATE TABLE mi_{t} (k INT)", "duckdb")
    rows = "SELECT id AS k FROM (VALUES (1), (5), (50), (500)) AS t(id)"
    got = lambda t: sorted(r.k for r in spark.table(f"mi_{t}").collect())
    e.sql(f"INSERT ALL WHEN k < 100 THEN INTO mi_small (k) VALUES (k) WHEN k > 10 THEN INTO mi_large (k) VALUES (k + 1) ELSE INTO mi_rest (k) VALUES (k) {rows}")
    assert (got("small"), got("large"), got("rest")) == ([1, 5, 50], [51, 501], [])
    e.sql(f"INSERT FIRST WHEN k < 10 THEN INTO mi_small (k) VALUES (k) WHEN k < 100 THEN INTO mi_large (k) VALUES (k) ELSE INTO mi_rest (k) VALUES (k) {rows}")
    assert (got("small"), got("large"), got("rest")) == ([1, 1, 5, 5, 50], [50, 51, 501], [500])
    for t in ("small", "large", "rest"):
        spark.sql(f"DROP TABLE mi_{t}")


def test_functions_of_its_own(spark):
    e = Engine(spark)
    e.sql("CREATE OR REPLACE FUNCTION plus_two(x INT) RETURNS INT LANGUAGE SQL AS $$ SELECT x + 2 $$", "postgres")
    e.sql("CREATE MACRO twice(a) AS a * 2", "duckdb")
    assert tuple(e.sql("SELECT plus_two(3), twice(4)", "duckdb").first()) == (5, 8.0)


def test_positions_of_tables_gather_only_partition_counts(eng):
    plan = eng.sql("SELECT n_name, r_name FROM nation POSITIONAL JOIN region", "duckdb")._jdf.queryExecution().executedPlan().toString().splitlines()
    below = [plan[i + 1] for i, line in enumerate(plan) if "SinglePartition" in line]
    assert len(below) == 2 and all("HashAggregate(keys=[__part" in line for line in below)


@pytest.mark.parametrize("sql", ["SELECT 1 FROM a, b WHERE a.x(+) = b.x(+)", "SELECT 1 FROM a, b WHERE a.x(+) = b.x AND b.y(+) = a.y"])
def test_marked_joins_that_make_no_sense(spark, sql):
    with pytest.raises(UnsupportedSQL):
        Engine(spark).to_spark(sql, "oracle")


def test_partitions_side_by_side(spark):
    spark.range(0, 1000, 1, 7).selectExpr("id AS a").createOrReplaceTempView("left_seven")
    spark.range(0, 900, 1, 3).selectExpr("id AS b").createOrReplaceTempView("right_three")
    got = Engine(spark, "duckdb").sql("SELECT a, b FROM left_seven POSITIONAL JOIN right_three").collect()
    assert sorted((r.a, r.b) for r in got if r.b is not None) == [(i, i) for i in range(900)] and len(got) == 1000
