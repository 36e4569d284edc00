import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.front import builder as b
from millrace.front import nodes as n
from millrace.front.dialects import DIALECTS, UnknownDialect, UnsupportedSQL, dialect
from millrace.front.lexer import SQLSyntaxError, tokenize
from millrace.front.parser import parse, parse_expr, parse_one
from millrace.front.tools import apply_edits, context_at, edit_for, gap_before, parse_tolerant, source_slice
from millrace.front.types import parse_type
from millrace.front.writer import format_sql, generate, transpile
from millrace.functions.dates import to_java
from millrace.plans import analysis as a
from millrace.plans.catalogue import texts
from millrace.plans.lower import to_spark


def test_dialect_names():
    assert len(DIALECTS) == 34
    assert dialect("postgres") is dialect("PGSQL, version=15") is DIALECTS["postgresql"]
    with pytest.raises(UnknownDialect):
        dialect("nothing")


@pytest.mark.parametrize("name", texts())
def test_round_trip(name):
    source, sql, _ = texts()[name]
    once = [generate(s, source) for s in parse(sql, source)]
    assert [generate(parse_one(text, source), source) for text in once] == once
    assert [generate(s, source) for s in parse(format_sql(sql, source), source)] == once


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_tolerant_never_raises_and_tokens_cover_the_text(sql):
    r = parse_tolerant(sql, "duckdb")
    assert "".join(gap_before(r.tokens, sql, k) + t.text for k, t in enumerate(r.tokens)) == sql
    context_at(sql, len(sql))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("select from where ( ) , a b 1 'x' join on group by order limit case when then end = + * union all with as".split()), max_size=14))
def test_tolerant_on_words(words):
    parse_tolerant(" ".join(words))


def test_precedence():
    x = parse_expr("a or b and c")
    assert isinstance(x, n.Bin) and x.op == "OR" and x.right.op == "AND"
    q = parse_one("select 1 except select 2 except select 3").body
    assert q.op == "EXCEPT" and isinstance(q.left, n.SetOp)
    q = parse_one("select 1 union select 2 intersect select 3").body
    assert q.op == "UNION" and q.right.op == "INTERSECT"


def test_errors_have_places():
    with pytest.raises(SQLSyntaxError) as e:
        parse("select a,\n from t where")
    assert e.value.line == 2


@pytest.mark.parametrize(
    ("sql", "source", "want"),
    [
        ("SELECT a ISNULL FROM t", "duckdb", "SELECT (`a` IS NULL) FROM `t`"),
        ("SELECT 5 ^ 2", "postgres", "SELECT power(5, 2)"),
        ("SELECT 5 ^ 2", "mysql", "SELECT (5 ^ 2)"),
        ('SELECT "a b" FROM t', "postgres", "SELECT `a b` FROM `t`"),
        ("SELECT log(x) FROM t", "duckdb", "SELECT log10(`x`) FROM `t`"),
        ("SELECT a FROM t ORDER BY a DESC", "oracle", "SELECT `a` FROM `t` ORDER BY `a` DESC NULLS FIRST"),
        ("SELECT a FROM t ORDER BY a", "mysql", "SELECT `a` FROM `t` ORDER BY `a` ASC NULLS FIRST"),
        ("SELECT x[1] FROM t", "duckdb", "SELECT try_element_at(`x`, 1) FROM `t`"),
        ("SELECT x[1] FROM t", "spark", "SELECT get(`x`, 1) FROM `t`"),
        ("SELECT 'it''s \\ x'", "duckdb", "SELECT 'it\\'s \\\\ x'"),
        ("SELECT CAST(x AS FLOAT) FROM t", "snowflake", "SELECT CAST(`x` AS DOUBLE) FROM `t`"),
        ("SELECT STRUCT(1 AS a)", "bigquery", "SELECT named_struct('a', 1)"),
    ],
)
def test_lowering(sql, source, want):
    assert to_spark(sql, source) == want


@pytest.mark.parametrize("sql", ["SELECT * FROM t FOR SYSTEM_TIME AS OF x", "SELECT a ?| b FROM t", "CALL f()", "SELECT x::geometry_z FROM t"])
def test_unsupported_is_said(sql):
    with pytest.raises((UnsupportedSQL, SQLSyntaxError)):
        to_spark(sql, "postgres")


def test_types():
    assert str(parse_type("DECIMAL(10, 2)[]")) == "array<decimal(10,2)>"
    assert parse_type("STRUCT<a INT, b ARRAY<STRING>>").spark() == "STRUCT<`a`: INT, `b`: ARRAY<STRING>>"
    assert parse_type("map(varchar, double)").spark() == "MAP<STRING, DOUBLE>"
    assert parse_type("timestamp with time zone").kind == "timestamptz"
    with pytest.raises(SQLSyntaxError):
        parse_type("int nonsense")


def test_date_patterns():
    assert to_java("%Y-%m-%dT%H:%M", "strftime") == "yyyy-MM-dd'T'HH:mm"
    assert to_java("YYYY-MM-DD HH24:MI:SS", "oracle") == "yyyy-MM-dd HH:mm:ss"
    with pytest.raises(UnsupportedSQL):
        to_java("%Q", "strftime")


def test_builder():
    q = b.select("a", b.count_star().as_("n")).from_("t").where(b.col("x") > 3, b.col("y").is_null()).group_by("a").having("count(*) > 1").order_by(b.col("n").desc()).limit(5)
    assert q.sql() == "SELECT a, COUNT(*) AS n FROM t WHERE x > 3 AND y IS NULL GROUP BY a HAVING COUNT(*) > 1 ORDER BY n DESC LIMIT 5"
    assert b.select("a").from_("t").limit(3).sql("tsql") == "SELECT TOP 3 a FROM t"
    assert b.case().when("a > 1", "x").else_("y").sql() == "CASE WHEN a > 1 THEN 'x' ELSE 'y' END"
    base = b.select("a").from_("t")
    base.where("a = 1")
    assert base.sql() == "SELECT a FROM t"
    assert b.update("t", a=1).where("b = 2").sql() == "UPDATE t SET a = 1 WHERE b = 2"
    assert b.insert_into("t", "a").values([1], [2]).sql() == "INSERT INTO t (a) VALUES (1), (2)"
    assert b.row_number().over(["a"], ["b desc"]).sql() == "ROW_NUMBER() OVER (PARTITION BY a ORDER BY b DESC)"


def test_visitor_and_edits():
    sql = "select a, b from t where a > 1"
    tree = parse_one(sql)
    names = n.find_all(tree, n.Name)
    assert [source_slice(sql, x) for x in names] == ["a", "b", "a"]
    assert apply_edits(sql, [edit_for(x, "z") for x in names if x.parts == ["a"]]) == "select z, b from t where z > 1"
    with pytest.raises(ValueError):
        apply_edits(sql, [edit_for(names[0], "x"), edit_for(names[0], "y")])
    seen = []
    n.walk(tree, lambda x: (seen.append(type(x).__name__), n.SKIP if isinstance(x, n.Bin) else None)[1])
    assert "Bin" in seen and seen.count("Name") == 2


def test_context():
    assert context_at("select ", 7).kind == "projection"
    assert context_at("select a from ", 14).kind == "relation"
    assert context_at("select t. from t", 9).qualifier == "t"
    assert context_at("select 'ab", 9).kind != "relation"
    assert context_at("", 0).kind == "statement"


def test_comments_survive_formatting():
    out = format_sql("select a -- why\nfrom t; -- end", "duckdb")
    assert "-- why" in out and "-- end" in out


def test_text_to_text():
    assert transpile("SELECT TOP 3 [a] FROM t", "tsql", "postgres") == ["SELECT \"a\" FROM t LIMIT 3"]
    assert transpile("SELECT a FROM t LIMIT 3", "postgres", "tsql") == ["SELECT TOP 3 a FROM t"]
    assert transpile("SELECT `a b` FROM t LIMIT 2", "mysql", "duckdb") == ['SELECT "a b" FROM t LIMIT 2']


@pytest.mark.parametrize(
    ("source", "target", "sql", "want"),
    [
        ("snowflake", "postgres", "NVL(a, 1)", "COALESCE(a, 1)"), ("snowflake", "postgres", "DATEADD(day, 1, b)", "b + INTERVAL '1 DAY'"), ("snowflake", "bigquery", "DATEADD(day, 1, b)", "DATE_ADD(b, INTERVAL 1 DAY)"),
        ("mysql", "snowflake", "DATE_ADD(b, INTERVAL 2 MONTH)", "DATEADD(MONTH, 2, b)"), ("tsql", "mysql", "DATEDIFF(day, a, b)", "TIMESTAMPDIFF(DAY, a, b)"), ("bigquery", "duckdb", "DATE_DIFF(b, a, DAY)", "DATE_DIFF('day', a, b)"),
        ("tsql", "postgres", "IIF(a > 1, 2, 3)", "CASE WHEN a > 1 THEN 2 ELSE 3 END"), ("mysql", "snowflake", "IF(a, 2, 3)", "IFF(a, 2, 3)"), ("tsql", "duckdb", "LEN(a)", "LENGTH(a)"), ("duckdb", "tsql", "LENGTH(a)", "LEN(a)"),
        ("tsql", "postgres", "CHARINDEX('x', a)", "STRPOS(a, 'x')"), ("postgres", "mysql", "STRPOS(a, 'x')", "LOCATE('x', a)"), ("tsql", "postgres", "GETDATE()", "CURRENT_TIMESTAMP"),
        ("mysql", "postgres", "GROUP_CONCAT(a ORDER BY b SEPARATOR '|')", "STRING_AGG(a, '|' ORDER BY b)"), ("snowflake", "mysql", "LISTAGG(a, '|') WITHIN GROUP (ORDER BY b)", "GROUP_CONCAT(a ORDER BY b SEPARATOR '|')"),
        ("postgres", "snowflake", "STRING_AGG(a, ',' ORDER BY b)", "LISTAGG(a, ',') WITHIN GROUP (ORDER BY b)"), ("spark", "postgres", "COLLECT_LIST(a)", "ARRAY_AGG(a)"), ("snowflake", "bigquery", "TRY_CAST(a AS INT)", "SAFE_CAST(a AS INT)"),
    ],
)
def test_calls_in_the_targets_words(source, target, sql, want):
    assert transpile(f"SELECT {sql} FROM t", source, target) == [f"SELECT {want} FROM t"]


def test_analysis():
    r = a.analyze("with c as (select a, b + 1 as d from t) select c.d as x, count(*) as n, 5, cast(d as int) from c group by 1", "duckdb")
    assert [p.kind for p in r.projections] == ["identity", "function", "literal", "cast"]
    assert r.ctes == ["c"] and r.aggregates and not r.windows and r.relations[0]["kind"] == "cte"


def test_lineage_and_events():
    sql = "with c as (select a, b + 1 as d from t) select d * 2 as x, a from c union all select z, y from u"
    assert sorted((x.source, x.name) for x in a.lineage(sql, "x").leaves()) == [("t", "b"), ("u", "z")]
    assert a.source_tables(sql) == ["t", "u"]
    facet = a.column_facet("select a, a + b as c from t")
    kinds = {k: v["inputFields"][0]["transformations"][0]["subtype"] for k, v in facet["fields"].items()}
    assert kinds == {"a": "IDENTITY", "c": "TRANSFORMATION"}
    assert '"COMPLETE"' in a.run_event("select a from t", "out")


def test_validation():
    codes = lambda sql, **k: {i.code for i in a.validate(sql, **k)}
    assert codes("select 1 union select 1, 2") == {"SEMANTIC_SET_ARITY"}
    assert codes("with a as (select 1), a as (select 2) select * from a") == {"SEMANTIC_DUPLICATE_CTE"}
    assert codes("select 1 as x, 2 as x") == {"SEMANTIC_DUPLICATE_PROJECTION_ALIAS"}
    schema = {"t": [("a", "int", True)], "u": [("a", "int", True)]}
    assert codes("select b from t", schema=schema) == {"SCHEMA_UNKNOWN_COLUMN"}
    assert codes("select a from t, u", schema=schema) == {"SEMANTIC_AMBIGUOUS_COLUMN"}
    assert codes("select 1 from v", schema=schema) == {"SCHEMA_UNKNOWN_TABLE"}
    assert codes("select from") == {"E005"}


def test_tokens_have_spans():
    sql = "select  a -- x\n from t"
    for t in tokenize(sql, comments=True):
        assert sql[t.start : t.end] == t.text


def test_built_trees_that_lack_something():
    from millrace.front import nodes as n

    codes = lambda tree: [i.code for i in a.validate(tree)]
    assert codes(n.Delete(n.Table([]), None, None)) == ["SEMANTIC_DELETE_TARGET"]
    assert codes(n.Insert(["t"], [], None, False)) == ["SEMANTIC_MISSING_QUERY"]
    assert codes(n.Query(None)) == ["SEMANTIC_MISSING_QUERY"]
    assert codes(n.Query(n.Select([n.Alias(None, "x")]))) == ["SEMANTIC_MISSING_PROJECTION"]
    assert codes(n.Query(n.Select([n.Lit("number", "1")], n.Derived(None, "d")))) == ["SEMANTIC_MISSING_QUERY"]
    assert codes(parse_one("SELECT 1", "duckdb")) == []
