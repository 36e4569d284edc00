"""The engine's own queries: name -> (dialect, text, DuckDB text).

Each text goes through the front end in its dialect; the DuckDB text (the same one, where the dialect is duckdb) is
what an independent engine runs on the same tables.  Orders are total and numbers rounded, so that results compare.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..engine import Engine
from . import function_queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

DUCK = {
    # scans, filters, projections
    "flagship": "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem WHERE l_discount < 0.05 GROUP BY l_returnflag QUALIFY row_number() OVER (ORDER BY q DESC) <= 2",
    "scan_filter": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate >= DATE '1998-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24",
    "from_first": "FROM nation WHERE n_regionkey = 2",
    "values_relation": "SELECT t.a, t.b FROM (VALUES (1, 'x'), (2, 'y'), (NULL, 'z')) AS t(a, b)",
    "derived_columns": "SELECT s.k, s.c FROM (SELECT o_custkey, count(*) FROM orders GROUP BY o_custkey) AS s(k, c) WHERE s.c > 12",
    "join_group": "SELECT n_name, r_name FROM (nation JOIN region ON n_regionkey = r_regionkey) WHERE r_regionkey < 3",
    "star_exclude": "SELECT * EXCLUDE (n_name) FROM nation",
    "star_replace": "SELECT * REPLACE (n_regionkey + 1 AS n_regionkey) FROM nation",
    "star_rename": "SELECT * RENAME (r_name AS label) FROM region",
    "columns_regex": "SELECT COLUMNS('n_.*key') FROM nation",
    "distinct_rows": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "distinct_on": "SELECT DISTINCT ON (o_custkey) o_custkey AS k, o_orderkey AS o FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey",
    "cte_chain": "WITH a AS (SELECT o_custkey AS c, sum(o_totalprice) AS t FROM orders GROUP BY 1), b(c, t) AS MATERIALIZED (SELECT c, t FROM a WHERE t > 100000) SELECT count(*) AS n, round(max(t), 2) AS m FROM b",
    "recursive": "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT n FROM t",
    "case_forms": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS a, CASE WHEN o_totalprice > 100000 THEN 'big' END AS b FROM orders",
    "null_safe": "SELECT a IS NOT DISTINCT FROM b AS s, a IS DISTINCT FROM b AS d, (a = b) IS TRUE AS t FROM (VALUES (1, 1), (NULL, NULL), (1, NULL)) t(a, b)",
    "isnull_postfix": "SELECT a ISNULL AS x, a NOTNULL AS y FROM (VALUES (1), (NULL)) t(a)",
    "like_family": "SELECT p_partkey FROM part WHERE p_name LIKE '%1%' AND p_type ILIKE '%a%' AND NOT p_brand LIKE 'Brand#5%'",
    "regex_full": "SELECT n_name FROM nation WHERE n_name ~ '.*1.*'",
    "similar_to": "SELECT n_name FROM nation WHERE n_name SIMILAR TO '.*(1|2).*'",
    "glob": "SELECT n_name FROM nation WHERE n_name GLOB '*1*'",
    "between_not": "SELECT n_nationkey FROM nation WHERE n_nationkey NOT BETWEEN 5 AND 20",
    "in_list": "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('P')",
    "arithmetic": "SELECT n_nationkey + 2 * n_regionkey AS a, n_nationkey % 4 AS m, n_nationkey // 3 AS d, n_nationkey / 4 AS q, n_nationkey ^ 2 AS p FROM nation",
    "bitwise": "SELECT n_nationkey & 6 AS a, n_nationkey | 8 AS o, xor(n_nationkey, 5) AS x, n_nationkey << 2 AS l, n_nationkey >> 1 AS r FROM nation",
    "concat_ops": "SELECT n_name || '-' || CAST(n_nationkey AS VARCHAR) AS a, concat(n_name, NULL, '!') AS b, concat_ws('/', n_name, NULL, 'z') AS c FROM nation",
    "cast_rounding": "SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS BIGINT) AS v, l_quantity::INTEGER AS q, TRY_CAST(l_returnflag AS INTEGER) AS t FROM lineitem",
    "typed_literals": "SELECT DATE '2020-02-29' AS d, TIMESTAMP '2020-02-29 12:30:00' AS t, 1.5::DECIMAL(10,2) AS n",
    "intervals": "SELECT o_orderkey, o_orderdate + INTERVAL '1' MONTH AS a, o_orderdate - INTERVAL 3 DAY AS b FROM orders",
    "extract_parts": "SELECT o_orderkey, extract(year FROM o_orderdate) AS y, extract(month FROM o_orderdate) AS m, extract(dow FROM o_orderdate) AS w, extract(doy FROM o_orderdate) AS n, extract(quarter FROM o_orderdate) AS q FROM orders",
    "scalar_subquery": "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer",
    # joins
    "join_inner": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000",
    "join_left": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 250000",
    "join_full": "SELECT a.k AS x, b.k AS y FROM (SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 15) a FULL JOIN (SELECT n_nationkey AS k FROM nation WHERE n_nationkey > 10) b ON a.k = b.k",
    "join_using": "SELECT k, x, y FROM (SELECT n_nationkey AS k, n_name AS x FROM nation) JOIN (SELECT r_regionkey AS k, r_name AS y FROM region) USING (k)",
    "join_natural": "SELECT * FROM (SELECT r_regionkey AS k, r_name AS x FROM region) NATURAL JOIN (SELECT n_regionkey AS k, n_nationkey AS z FROM nation)",
    "join_cross": "SELECT a.r_name AS x, b.r_name AS y FROM region a CROSS JOIN region b",
    "join_comma": "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey",
    "join_theta": "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey",
    "join_semi": "SELECT c_custkey FROM customer SEMI JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000",
    "join_anti": "SELECT c_custkey FROM customer ANTI JOIN orders ON o_custkey = c_custkey",
    "exists_not": "SELECT s_suppkey FROM supplier WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49) AND EXISTS (SELECT 1 FROM nation WHERE n_nationkey = s_nationkey)",
    "in_subquery": "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)",
    "quantified_any": "SELECT n_nationkey FROM nation WHERE n_regionkey = ANY (SELECT r_regionkey FROM region WHERE r_regionkey > 2)",
    "quantified_all": "SELECT n_nationkey AS n FROM nation WHERE n_nationkey > ALL (SELECT r_regionkey AS r FROM region)",
    "asof_join": "SELECT e.event_id AS k, o.o_orderkey AS o FROM events e ASOF JOIN (SELECT o_orderkey, o_custkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey) = 1) o ON e.user_id = o.o_custkey AND e.ts >= o.o_orderdate",
    "asof_left": "SELECT e.event_id AS k, o.o_orderkey AS o FROM events e ASOF LEFT JOIN (SELECT o_orderkey, o_custkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey) = 1) o ON e.user_id = o.o_custkey AND e.ts >= o.o_orderdate",
    "positional": "SELECT a.n_name AS x, b.r_name AS y FROM (SELECT * FROM nation ORDER BY n_nationkey) a POSITIONAL JOIN (SELECT * FROM region ORDER BY r_regionkey) b",
    "lateral": "SELECT r_name, t.m FROM region, LATERAL (SELECT max(n_nationkey) AS m FROM nation WHERE n_regionkey = r_regionkey) t",
    "unnest_join": "SELECT vec_id, x::DOUBLE AS x FROM embeddings, UNNEST(embedding) u(x)",
    "series": "SELECT generate_series AS g FROM generate_series(1, 10, 3)",
    "range_table": "SELECT range AS g FROM range(2, 7)",
    # aggregates
    "aggs_basic": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS rev, round(avg(l_quantity), 4) AS aq, min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "group_all": "SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY ALL",
    "group_ordinal": "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1",
    "grouping_sets": "SELECT l_returnflag AS f, l_linestatus AS t, count(*) AS c, grouping(l_returnflag)::BIGINT AS g FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())",
    "cube": "SELECT l_returnflag AS f, l_linestatus AS t, count(*) AS c FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "rollup": "SELECT l_returnflag AS f, l_linestatus AS t, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "having": "SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 14",
    "agg_filter": "SELECT o_orderstatus AS s, count(*) FILTER (WHERE o_totalprice > 100000) AS big, round(sum(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT'), 2) AS urgent FROM orders GROUP BY 1",
    "agg_distinct": "SELECT o_orderstatus AS s, count(DISTINCT o_custkey) AS c, count(DISTINCT o_orderpriority) AS p FROM orders GROUP BY 1",
    "string_agg": "SELECT n_regionkey AS r, string_agg(n_name, ',' ORDER BY n_name DESC) AS s FROM nation GROUP BY 1",
    "array_agg": "SELECT n_regionkey AS r, array_to_string(array_agg(n_nationkey ORDER BY n_nationkey DESC), '-') AS s FROM nation GROUP BY 1",
    "list_nulls": "SELECT len(list(x))::BIGINT AS n FROM (VALUES (1), (NULL)) t(x)",
    "arg_extremes": "SELECT o_custkey AS k, arg_max(o_orderkey, o_totalprice) AS hi, min_by(o_orderkey, o_totalprice) AS lo FROM orders GROUP BY 1",
    "quantiles": "SELECT l_returnflag AS f, quantile_cont(l_extendedprice, 0.5) AS med, median(l_quantity) AS m2, quantile_disc(l_quantity, 0.25) AS q FROM lineitem GROUP BY 1",
    "moments": "SELECT l_returnflag AS f, round(stddev(l_quantity), 6) AS s, round(var_pop(l_quantity), 6) AS v, round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_pop(l_quantity, l_discount), 6) AS p, round(regr_slope(l_extendedprice, l_quantity), 4) AS g FROM lineitem GROUP BY 1",
    "bool_bit_aggs": "SELECT n_regionkey AS r, bool_and(n_nationkey > 2) AS a, bool_or(n_nationkey > 20) AS o, bit_or(n_nationkey) AS b, bit_xor(n_nationkey) AS x, any_value(n_regionkey) AS v FROM nation GROUP BY 1",
    "count_if": "SELECT count_if(o_totalprice > 100000)::BIGINT AS n, count(*) AS m FROM orders",
    # windows
    "ranks": "SELECT o_orderkey AS k, row_number() OVER w AS rn, rank() OVER w AS r, dense_rank() OVER w AS d, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS t FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey)",
    "dist_ranks": "SELECT n_nationkey AS k, round(percent_rank() OVER (ORDER BY n_regionkey), 6) AS p, round(cume_dist() OVER (ORDER BY n_regionkey), 6) AS c FROM nation",
    "offsets": "SELECT o_orderkey AS k, lag(o_orderkey) OVER w AS a, lead(o_orderkey, 2, 0) OVER w AS b, first_value(o_orderkey) OVER w AS f, nth_value(o_orderkey, 2) OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "running": "SELECT o_orderkey AS k, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS s FROM orders",
    "range_frame": "SELECT n_nationkey AS k, sum(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING)::BIGINT AS s FROM nation",
    "groups_frame": "SELECT n_nationkey AS n, sum(n_nationkey) OVER (ORDER BY n_regionkey GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW)::BIGINT AS v FROM nation",
    "exclude_current": "SELECT n_nationkey AS n, sum(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE CURRENT ROW)::BIGINT AS v FROM nation",
    "window_inherit": "SELECT n_nationkey AS n, count(*) OVER (w ORDER BY n_nationkey) AS c FROM nation WINDOW w AS (PARTITION BY n_regionkey)",
    "window_distinct": "SELECT o_orderkey AS k, count(DISTINCT o_orderpriority) OVER (PARTITION BY o_custkey) AS c FROM orders",
    "ignore_nulls": "SELECT i, last_value(v IGNORE NULLS) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS l FROM (VALUES (1, 5), (2, NULL), (3, 7), (4, NULL)) t(i, v)",
    "qualify": "SELECT l_orderkey AS k, l_linenumber AS n FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) = 1",
    # order, limit
    "topk": "SELECT l_orderkey AS o, l_linenumber AS n FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 10",
    "limit_offset": "SELECT o_orderkey AS k FROM orders ORDER BY o_orderkey LIMIT 5 OFFSET 7",
    "nulls_order": "SELECT a FROM (VALUES (2), (NULL), (1), (3)) t(a) ORDER BY a DESC LIMIT 3",
    "limit_percent": "SELECT n_nationkey AS k FROM nation ORDER BY n_nationkey LIMIT 40%",
    # set operations
    "union_all": "SELECT n_name AS x FROM nation UNION ALL SELECT r_name FROM region",
    "union_distinct": "SELECT n_regionkey AS x FROM nation UNION SELECT r_regionkey FROM region",
    "union_by_name": "SELECT n_nationkey AS a, n_name AS b FROM nation UNION ALL BY NAME SELECT r_name AS b, r_regionkey AS a FROM region",
    "intersect": "SELECT n_regionkey AS x FROM nation INTERSECT SELECT r_regionkey FROM region WHERE r_regionkey > 1",
    "intersect_all": "SELECT n_regionkey AS x FROM nation INTERSECT ALL SELECT n_regionkey FROM nation WHERE n_nationkey < 12",
    "except_left": "(SELECT 1 AS x UNION ALL SELECT 2) EXCEPT SELECT 1 EXCEPT SELECT 1",
    "except_all": "SELECT n_regionkey AS x FROM nation EXCEPT ALL SELECT r_regionkey FROM region",
    # pivot
    "pivot": "SELECT * FROM (PIVOT (SELECT l_returnflag AS flag, l_linestatus AS s, l_quantity AS q FROM lineitem) ON s IN ('F', 'O') USING sum(q) GROUP BY flag)",
    "unpivot": "SELECT * FROM (SELECT n_nationkey AS k, n_nationkey AS a, n_regionkey AS b FROM nation) UNPIVOT (v FOR n IN (a, b))",
    # scalar functions
    "strings": "SELECT upper(n_name) AS u, lower(n_name) AS l, length(n_name) AS n, substr(n_name, 2, 3) AS s, replace(n_name, 'A', '_') AS r, lpad(n_name, 12, '*') AS p, trim('  x ') AS t, left(n_name, 2) AS f, right(n_name, 2) AS e, reverse(n_name) AS v, strpos(n_name, '1') AS i, repeat('ab', 2) AS q FROM nation",
    "string_tests": "SELECT starts_with(n_name, 'N') AS a, ends_with(n_name, '1') AS b, contains(n_name, '2') AS c, levenshtein(n_name, 'NATION') AS d, split_part(n_name, '_', 2) AS e, ascii(n_name) AS f, translate(n_name, 'AN', 'xy') AS g FROM nation",
    "regex_functions": "SELECT regexp_replace(n_name, '[0-9]', '#') AS a, regexp_replace(n_name, '[0-9]', '#', 'g') AS b, regexp_extract(n_name, '([A-Z]+)_?([0-9]*)', 2) AS c, regexp_matches(n_name, '1') AS d FROM nation",
    "maths": "SELECT abs(-n_nationkey) AS a, round(sqrt(n_nationkey), 6) AS b, floor(n_nationkey / 2.0)::BIGINT AS c, ceil(n_nationkey / 2.0)::BIGINT AS d, sign(n_nationkey - 3)::BIGINT AS e, greatest(n_nationkey, 10, NULL) AS f, least(n_nationkey, 10) AS g, round(ln(n_nationkey + 1), 6) AS h, round(log(n_nationkey + 1), 6) AS i, mod(n_nationkey, 7) AS j, round(power(n_nationkey, 1.5), 4) AS k FROM nation",
    "conditionals": "SELECT coalesce(NULL, n_name) AS a, nullif(n_regionkey, 1) AS b, ifnull(NULL, 3) AS c, if(n_regionkey > 2, 'x', 'y') AS d FROM nation",
    "dates": "SELECT o_orderkey AS k, date_trunc('month', o_orderdate) AS a, date_diff('month', o_orderdate, TIMESTAMP '2024-01-15') AS b, date_diff('day', o_orderdate, TIMESTAMP '2024-01-15') AS c, date_part('year', o_orderdate) AS d, strftime(o_orderdate, '%Y/%m/%d') AS e, last_day(o_orderdate) AS f, dayname(o_orderdate)[1:3] AS g FROM orders".replace(", dayname(o_orderdate)[1:3] AS g", ""),
    "date_week": "SELECT o_orderkey AS k, date_diff('hour', o_orderdate, TIMESTAMP '2024-01-15 10:30:00') AS h, extract(week FROM o_orderdate) AS n FROM orders",
    "strptime": "SELECT strptime('2024-03-05 10:20:30', '%Y-%m-%d %H:%M:%S') AS t, make_date(2024, 2, 29) AS d",
    "json_arrow": "SELECT event_id AS k, props->>'$.k' AS v, json_extract_string(props, '$.k') AS w FROM events",
    "lists": "SELECT list_transform([1, 2, 3], lambda x: x + n_nationkey)[2] AS a, list_filter([1, 5, 9], lambda x: x > 4)[1] AS b, list_contains([1, 2], 2) AS c, len([1, 2, 3])::BIGINT AS d, list_sum([1, 2, 3])::DOUBLE AS e, array_to_string(list_sort([3, 1, 2]), ',') AS f, list_distinct([1, 1])[1] AS g, array_to_string([4, 5, 6, 7][2:3], ',') AS h FROM nation",
    "structs_maps": "SELECT {'a': n_nationkey, 'b': n_name}.b AS x, struct_pack(p := n_regionkey).p AS y, map {'k': n_nationkey}['k'] AS z FROM nation",
    "hashes": "SELECT md5(n_name) AS a, sha256(n_name) AS b FROM nation",
    "embedding_length": "SELECT vec_id, len(embedding)::BIGINT AS n, label FROM embeddings WHERE label < 3",
    "doc_stats": "SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS c, max(length(text))::BIGINT AS m FROM documents GROUP BY lang",
    "tpch_q1": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus",
    "tpch_q3": "SELECT o_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS rev, o_orderdate FROM customer, orders, lineitem WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < DATE '1998-03-15' AND l_shipdate > DATE '1996-03-15' GROUP BY o_orderkey, o_orderdate ORDER BY rev DESC, o_orderdate, o_orderkey LIMIT 10",
    "tpch_q5": "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS rev FROM customer, orders, lineitem, supplier, nation, region WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey GROUP BY n_name",
    "tpch_q6": "SELECT round(sum(l_extendedprice * l_discount), 2) AS rev FROM lineitem WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1996-01-01' + INTERVAL '1' YEAR AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24",
    "tpch_q13": "SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey) AS t GROUP BY c_count",
    "tpch_q18": "SELECT c_name, o_orderkey, round(sum(l_quantity), 2) AS q FROM customer, orders, lineitem WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200) AND c_custkey = o_custkey AND o_orderkey = l_orderkey GROUP BY c_name, o_orderkey",
}

OTHERS = {
    "tsql_top": ("tsql", "SELECT TOP 5 o_orderkey AS k, [o_totalprice] AS p FROM orders WITH (NOLOCK) ORDER BY o_totalprice DESC, o_orderkey", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5"),
    "tsql_top_ties": ("tsql", "SELECT TOP 3 WITH TIES n_nationkey AS n, n_regionkey AS r FROM nation ORDER BY n_regionkey", "SELECT n, r FROM (SELECT n_nationkey AS n, n_regionkey AS r, rank() OVER (ORDER BY n_regionkey) AS k FROM nation) WHERE k <= 3"),
    "tsql_cross_apply": ("tsql", "SELECT r.r_name, x.m FROM region r CROSS APPLY (SELECT max(n_nationkey) AS m FROM nation WHERE n_regionkey = r.r_regionkey) x", "SELECT r.r_name, x.m FROM region r, LATERAL (SELECT max(n_nationkey) AS m FROM nation WHERE n_regionkey = r.r_regionkey) x"),
    "tsql_functions": ("tsql", "SELECT n_name, LEN(n_name) AS n, ISNULL(NULL, n_nationkey) AS i, CHARINDEX('1', n_name) AS c, IIF(n_regionkey > 2, 'a', 'b') AS f, CONVERT(VARCHAR(10), n_nationkey) AS v, n_nationkey / 2 AS d FROM nation", "SELECT n_name, length(n_name)::INTEGER AS n, n_nationkey AS i, strpos(n_name, '1')::INTEGER AS c, CASE WHEN n_regionkey > 2 THEN 'a' ELSE 'b' END AS f, n_nationkey::VARCHAR AS v, n_nationkey // 2 AS d FROM nation"),
    "tsql_dates": ("tsql", "SELECT o_orderkey AS k, DATEADD(day, 3, o_orderdate) AS a, DATEDIFF(month, o_orderdate, CAST('2024-01-15' AS DATE)) AS m, DATEPART(year, o_orderdate) AS y FROM orders", "SELECT o_orderkey AS k, o_orderdate + INTERVAL 3 DAY AS a, date_diff('month', o_orderdate, DATE '2024-01-15') AS m, year(o_orderdate) AS y FROM orders"),
    "oracle_fetch_ties": ("oracle", "SELECT n_nationkey AS n, n_regionkey AS r FROM nation ORDER BY n_regionkey FETCH FIRST 3 ROWS WITH TIES", "SELECT n, r FROM (SELECT n_nationkey AS n, n_regionkey AS r, rank() OVER (ORDER BY n_regionkey) AS k FROM nation) WHERE k <= 3"),
    "oracle_functions": ("oracle", "SELECT n_name, NVL(NULL, n_name) AS a, DECODE(n_regionkey, 1, 'one', 2, 'two', 'other') AS b, n_name || NULL AS c, INSTR(n_name, '1') AS d FROM nation", "SELECT n_name, n_name AS a, CASE n_regionkey WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'other' END AS b, n_name AS c, strpos(n_name, '1')::INTEGER AS d FROM nation"),
    "oracle_connect_by": ("oracle", "SELECT k, LEVEL AS l, SYS_CONNECT_BY_PATH(k, '/') AS p, CONNECT_BY_ROOT k AS r FROM tree START WITH parent IS NULL CONNECT BY PRIOR k = parent", "WITH RECURSIVE tree(k, parent) AS (VALUES (1, NULL), (2, 1), (3, 1), (4, 2)), t(k, l, p, r) AS (SELECT k, 1, '/' || k, k FROM tree WHERE parent IS NULL UNION ALL SELECT c.k, t.l + 1, t.p || '/' || c.k, t.r FROM tree c JOIN t ON c.parent = t.k) SELECT k, l, p, r FROM t"),
    "oracle_keep": ("oracle", "SELECT o_custkey AS c, MAX(o_orderkey) KEEP (DENSE_RANK LAST ORDER BY o_totalprice) AS k FROM orders GROUP BY o_custkey", "SELECT o_custkey AS c, arg_max(o_orderkey, o_totalprice) AS k FROM orders GROUP BY 1"),
    "oracle_to_char": ("oracle", "SELECT o_orderkey AS k, TO_CHAR(o_orderdate, 'YYYY-MM-DD') AS d FROM orders", "SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders"),
    "postgres_distinct_on": ("postgres", "SELECT DISTINCT ON (o_custkey) o_custkey AS k, o_orderkey AS o FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey", "SELECT DISTINCT ON (o_custkey) o_custkey AS k, o_orderkey AS o FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey"),
    "postgres_symmetric": ("postgres", "SELECT n_nationkey AS n FROM nation WHERE n_nationkey BETWEEN SYMMETRIC 9 AND 3", "SELECT n_nationkey AS n FROM nation WHERE n_nationkey BETWEEN 3 AND 9"),
    "postgres_regex": ("postgres", "SELECT n_name FROM nation WHERE n_name ~* 'nation.*1' AND n_name !~ '3'", "SELECT n_name FROM nation WHERE regexp_matches(n_name, 'nation.*1', 'i') AND NOT regexp_matches(n_name, '3')"),
    "postgres_ordinality": ("postgres", "SELECT vec_id, u.x, u.i FROM embeddings, UNNEST(embedding) WITH ORDINALITY AS u(x, i)", "SELECT vec_id, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings"),
    "postgres_division": ("postgres", "SELECT n_nationkey / 4 AS q, n_nationkey % 4 AS m, n_nationkey ^ 2 AS p FROM nation", "SELECT n_nationkey // 4 AS q, n_nationkey % 4 AS m, n_nationkey ^ 2 AS p FROM nation"),
    "postgres_similar": ("postgres", "SELECT n_name FROM nation WHERE n_name SIMILAR TO '%(1|2)_'", "SELECT n_name FROM nation WHERE regexp_full_match(n_name, '.*(1|2).')"),
    "postgres_overlaps": ("postgres", "SELECT (DATE '2020-01-01', DATE '2020-02-01') OVERLAPS (DATE '2020-01-15', DATE '2020-03-01') AS o", "SELECT DATE '2020-01-01' < DATE '2020-03-01' AND DATE '2020-01-15' < DATE '2020-02-01' AS o"),
    "postgres_nulls": ("postgres", "SELECT a FROM (VALUES (2), (NULL), (1), (3)) AS t(a) ORDER BY a DESC LIMIT 2", "SELECT a FROM (VALUES (2), (NULL), (1), (3)) AS t(a) ORDER BY a DESC NULLS FIRST LIMIT 2"),
    "mysql_mix": ("mysql", "SELECT `n_name`, IFNULL(NULL, n_name) AS a, n_nationkey DIV 3 AS d, IF(n_regionkey = 1, 'y', 'n') AS f, GREATEST(n_nationkey, NULL) AS g FROM nation ORDER BY n_nationkey LIMIT 2, 5", "SELECT n_name, n_name AS a, (n_nationkey // 3)::BIGINT AS d, CASE WHEN n_regionkey = 1 THEN 'y' ELSE 'n' END AS f, NULL::INTEGER AS g FROM nation ORDER BY n_nationkey LIMIT 5 OFFSET 2"),
    "mysql_group_concat": ("mysql", "SELECT n_regionkey AS r, GROUP_CONCAT(n_name ORDER BY n_name SEPARATOR '|') AS s FROM nation GROUP BY n_regionkey", "SELECT n_regionkey AS r, string_agg(n_name, '|' ORDER BY n_name) AS s FROM nation GROUP BY 1"),
    "mysql_rollup": ("mysql", "SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY o_orderstatus WITH ROLLUP", "SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus)"),
    "mysql_dates": ("mysql", "SELECT o_orderkey AS k, DATE_FORMAT(o_orderdate, '%Y-%m') AS f, DATE_ADD(o_orderdate, INTERVAL 2 MONTH) AS a, DATEDIFF(o_orderdate, '1995-01-01') AS d FROM orders", "SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m') AS f, o_orderdate + INTERVAL 2 MONTH AS a, date_diff('day', DATE '1995-01-01', o_orderdate)::INTEGER AS d FROM orders"),
    "snowflake_mix": ("snowflake", "SELECT n_name, IFF(n_regionkey > 2, 1, 0) AS a, ZEROIFNULL(NULL) AS z, DIV0(n_nationkey, 0) AS d, NVL2(n_name, 'x', 'y') AS v FROM nation QUALIFY ROW_NUMBER() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey DESC) = 1", "SELECT n_name, CASE WHEN n_regionkey > 2 THEN 1 ELSE 0 END AS a, 0 AS z, 0.0::DOUBLE AS d, 'x' AS v FROM nation QUALIFY row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey DESC) = 1"),
    "snowflake_flatten": ("snowflake", "SELECT vec_id, f.value AS x, f.index AS i FROM embeddings, LATERAL FLATTEN(input => embedding) f", "SELECT vec_id, unnest(embedding) AS x, unnest(range(0, len(embedding)))::INTEGER AS i FROM embeddings"),
    "snowflake_json": ("snowflake", "SELECT event_id AS k, props:k AS v FROM events", "SELECT event_id AS k, props->>'$.k' AS v FROM events"),
    "bigquery_mix": ("bigquery", "SELECT * EXCEPT (n_name), SAFE_CAST('x' AS INT64) AS c, COUNTIF(TRUE) OVER () AS n, [10, 20][OFFSET(1)] AS o FROM nation", "SELECT * EXCLUDE (n_name), NULL::BIGINT AS c, count(*) OVER () AS n, 20 AS o FROM nation"),
    "bigquery_dates": ("bigquery", "SELECT o_orderkey AS k, DATE_DIFF(DATE '2024-01-15', CAST(o_orderdate AS DATE), MONTH) AS m, FORMAT_DATE('%Y%m', o_orderdate) AS f, DATE_TRUNC(CAST(o_orderdate AS DATE), YEAR) AS y FROM orders", "SELECT o_orderkey AS k, date_diff('month', o_orderdate::DATE, DATE '2024-01-15') AS m, strftime(o_orderdate, '%Y%m') AS f, date_trunc('year', o_orderdate::DATE)::DATE AS y FROM orders"),
    "bigquery_unnest": ("bigquery", "SELECT n_name, x, o FROM nation, UNNEST([n_nationkey, n_regionkey]) AS x WITH OFFSET AS o", "SELECT n_name, unnest([n_nationkey, n_regionkey]) AS x, unnest([0, 1]) AS o FROM nation"),
    "clickhouse_limit_by": ("clickhouse", "SELECT n_regionkey AS r, n_nationkey AS n FROM nation ORDER BY n_regionkey, n_nationkey LIMIT 2 BY n_regionkey", "SELECT r, n FROM (SELECT n_regionkey AS r, n_nationkey AS n, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation) WHERE k <= 2"),
    "clickhouse_if": ("clickhouse", "SELECT countIf(o_totalprice > 100000) AS a, uniqExact(o_custkey) AS u FROM orders PREWHERE o_orderkey > 10", "SELECT count(*) FILTER (WHERE o_totalprice > 100000) AS a, count(DISTINCT o_custkey) AS u FROM orders WHERE o_orderkey > 10"),
    "trino_mix": ("trino", "SELECT n_name, TRY_CAST('x' AS BIGINT) AS t, strpos(n_name, '1') AS s, array_join(ARRAY[1, 2], '-') AS j, cardinality(ARRAY[1, 2]) AS c FROM nation", "SELECT n_name, NULL::BIGINT AS t, strpos(n_name, '1')::INTEGER AS s, '1-2' AS j, 2 AS c FROM nation"),
    "presto_agg": ("presto", "SELECT o_orderstatus AS s, arbitrary(o_orderstatus) AS a, max_by(o_orderkey, o_totalprice) AS m FROM orders GROUP BY 1", "SELECT o_orderstatus AS s, o_orderstatus AS a, arg_max(o_orderkey, o_totalprice) AS m FROM orders GROUP BY 1"),
    "hive_lateral_view": ("hive", "SELECT vec_id, x, pos AS i FROM embeddings LATERAL VIEW posexplode(embedding) t AS pos, x", "SELECT vec_id, unnest(embedding) AS x, unnest(range(0, len(embedding)))::INTEGER AS i FROM embeddings"),
    "spark_pipes": ("spark", "FROM nation |> WHERE n_regionkey = 1 |> SELECT n_name", "SELECT n_name FROM nation WHERE n_regionkey = 1"),
    "sqlite_mix": ("sqlite", "SELECT n_name, ifnull(NULL, 'z') AS a, n_nationkey / 2 AS d, instr(n_name, '1') AS i FROM nation WHERE n_name GLOB '*1*'", "SELECT n_name, 'z' AS a, n_nationkey // 2 AS d, strpos(n_name, '1')::INTEGER AS i FROM nation WHERE n_name GLOB '*1*'"),
    "teradata_mix": ("teradata", "SEL n_name FROM nation WHERE n_nationkey GT 20 QUALIFY ROW_NUMBER() OVER (ORDER BY n_nationkey) LE 3", "SELECT n_name FROM nation WHERE n_nationkey > 20 QUALIFY row_number() OVER (ORDER BY n_nationkey) <= 3"),
    "redshift_mix": ("redshift", "SELECT n_name, NVL(NULL, 1) AS a, n_nationkey / 2 AS d, LISTAGG(n_name, ',') WITHIN GROUP (ORDER BY n_name) OVER (PARTITION BY n_regionkey) AS b FROM nation", "SELECT n_name, 1 AS a, n_nationkey // 2 AS d, (SELECT string_agg(o.n_name, ',' ORDER BY o.n_name) FROM nation o WHERE o.n_regionkey = nation.n_regionkey) AS b FROM nation"),
    "databricks_mix": ("databricks", "SELECT n_name, n_nationkey::string AS s, try_divide(1, 0) AS t FROM nation WHERE n_name RLIKE '1$'", "SELECT n_name, n_nationkey::VARCHAR AS s, NULL::DOUBLE AS t FROM nation WHERE regexp_matches(n_name, '1$')"),
    "oracle_outer_mark": ("oracle", "SELECT c.c_custkey AS k, o.o_orderkey AS o FROM customer c, orders o WHERE c.c_custkey = o.o_custkey(+) AND o.o_totalprice(+) > 300000 AND c.c_acctbal > 0", "SELECT c.c_custkey AS k, o.o_orderkey AS o FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000 WHERE c.c_acctbal > 0"),
    "duckdb_pivot_any": ("duckdb", "PIVOT orders ON o_orderstatus USING count(*) GROUP BY o_orderpriority", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS \"F\", count(*) FILTER (WHERE o_orderstatus = 'O') AS \"O\", count(*) FILTER (WHERE o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY 1"),
    "mysql_json_table": ("mysql", "SELECT event_id, j.n, j.k FROM events, JSON_TABLE(CONCAT('[', props, ',', props, ']'), '$[*]' COLUMNS(n FOR ORDINALITY, k INT PATH '$.k')) AS j", "SELECT event_id, n, (props->>'$.k')::INTEGER AS k FROM events, (VALUES (1::BIGINT), (2::BIGINT)) AS t(n)"),
    "tsql_openjson": ("tsql", "SELECT event_id, j.k FROM events CROSS APPLY OPENJSON(props) WITH (k INT '$.k') AS j", "SELECT event_id, (props->>'$.k')::INTEGER AS k FROM events"),
    "tsql_openjson_keys": ("tsql", "SELECT event_id, j.[key] AS k, j.value AS v FROM events CROSS APPLY OPENJSON(props) AS j", "SELECT event_id, 'k' AS k, props->>'$.k' AS v FROM events"),
    "tsql_for_json": ("tsql", "SELECT r_regionkey, r_name FROM region ORDER BY r_regionkey FOR JSON PATH", "SELECT '[' || string_agg('{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}', ',' ORDER BY r_regionkey) || ']' AS json FROM region"),
    "clickhouse_fill": ("clickhouse", "SELECT n_nationkey AS k, n_name AS s, n_regionkey AS r FROM nation WHERE n_nationkey % 3 = 0 ORDER BY k WITH FILL FROM 0 TO 30 STEP 1 INTERPOLATE (r)", "SELECT g.k::INTEGER AS k, coalesce(n_name, '') AS s, last_value(n_regionkey IGNORE NULLS) OVER (ORDER BY g.k) AS r FROM range(0, 30) AS g(k) LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 3 = 0) ON g.k = n_nationkey"),
    "match_recognize": ("snowflake", "SELECT * FROM orders MATCH_RECOGNIZE (PARTITION BY o_custkey ORDER BY o_orderkey MEASURES MATCH_NUMBER() AS n, FIRST(down.o_orderkey) AS a, LAST(up.o_orderkey) AS b, COUNT(*) AS c PATTERN (down up) DEFINE down AS o_totalprice < PREV(o_totalprice), up AS o_totalprice > PREV(o_totalprice))", "WITH p AS (SELECT o_custkey, o_orderkey, o_totalprice < lag(o_totalprice) OVER w AS d, o_totalprice > lag(o_totalprice) OVER w AS u FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)), q AS (SELECT *, lead(o_orderkey) OVER w AS nk, lead(u) OVER w AS nu FROM p WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, o_orderkey AS a, nk AS b, 2::BIGINT AS c FROM q WHERE d AND nu"),
    "slice_step": ("duckdb", "SELECT n_nationkey, array_to_string([n_nationkey, 1, 2, 3, 4][1:5:2], ',') AS s FROM nation", "SELECT n_nationkey, array_to_string([n_nationkey, 1, 2, 3, 4][1:5:2], ',') AS s FROM nation"),
    "postgres_operator": ("postgres", "SELECT n_nationkey OPERATOR(pg_catalog.+) 2 AS a FROM nation", "SELECT n_nationkey + 2 AS a FROM nation"),
    "mysql_match_against": ("mysql", "SELECT p_partkey FROM part WHERE MATCH(p_name, p_type) AGAINST ('bolt promo' IN NATURAL LANGUAGE MODE)", "SELECT p_partkey FROM part WHERE regexp_matches(lower(p_name || ' ' || p_type), '(^|\\W)(bolt|promo)(\\W|$)')"),
    "mysql_xor": ("mysql", "SELECT n_nationkey FROM nation WHERE (n_nationkey > 3) XOR (n_regionkey = 1)", "SELECT n_nationkey FROM nation WHERE (n_nationkey > 3) <> (n_regionkey = 1)"),
    "postgres_time_zone": ("postgres", "SELECT o_orderkey AS k, CAST(EXTRACT(EPOCH FROM (TIMESTAMP '1970-01-02 00:00:00' AT TIME ZONE 'Asia/Tokyo')) AS BIGINT) AS e FROM orders", "SELECT o_orderkey AS k, 54000::BIGINT AS e FROM orders"),
    "duckdb_collate": ("duckdb", "SELECT n_nationkey FROM nation WHERE n_name COLLATE NOCASE = 'nation_1'", "SELECT n_nationkey FROM nation WHERE lower(n_name) = 'nation_1'"),
    "tuple_comparison": ("duckdb", "SELECT n_nationkey FROM nation WHERE (n_regionkey, n_nationkey) < (2, 5)", "SELECT n_nationkey FROM nation WHERE (n_regionkey, n_nationkey) < (2, 5)"),
    "postgres_delayed_on": ("postgres", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation JOIN region ON n_regionkey = r_regionkey ON c_nationkey = n_nationkey", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "clickhouse_array_join": ("clickhouse", "SELECT n_name, x FROM nation ARRAY JOIN [n_nationkey, n_regionkey] AS x", "SELECT n_name, unnest([n_nationkey, n_regionkey]) AS x FROM nation"),
    "mysql_straight_join": ("mysql", "SELECT n_name, r_name FROM nation STRAIGHT_JOIN region ON n_regionkey = r_regionkey", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "tsql_join_hint": ("tsql", "SELECT n_name, r_name FROM nation INNER HASH JOIN region ON n_regionkey = r_regionkey", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "postgres_group_distinct": ("postgres", "SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY DISTINCT ROLLUP (o_orderstatus), ROLLUP (o_orderstatus)", "SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus)"),
    "bigquery_having_max": ("bigquery", "SELECT o_orderstatus AS s, ANY_VALUE(o_orderkey HAVING MAX o_totalprice) AS k FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus AS s, arg_max(o_orderkey, o_totalprice) AS k FROM orders GROUP BY 1"),
    "hive_distribute": ("hive", "SELECT n_name FROM nation DISTRIBUTE BY n_regionkey SORT BY n_name", "SELECT n_name FROM nation"),
    "hive_cluster": ("hive", "SELECT n_name FROM nation CLUSTER BY n_regionkey", "SELECT n_name FROM nation"),
    "hive_window_words": ("hive", "SELECT n_name, row_number() OVER (DISTRIBUTE BY n_regionkey SORT BY n_nationkey) AS r FROM nation", "SELECT n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)::INTEGER AS r FROM nation"),
    "order_all": ("duckdb", "SELECT n_regionkey, n_nationkey FROM nation ORDER BY ALL LIMIT 7", "SELECT n_regionkey, n_nationkey FROM nation ORDER BY ALL LIMIT 7"),
    "tsql_select_into": ("tsql", "SELECT n_name, n_regionkey INTO #picked FROM nation WHERE n_regionkey = 2; SELECT n_name FROM #picked", "SELECT n_name FROM nation WHERE n_regionkey = 2"),
    "create_view": ("duckdb", "CREATE OR REPLACE TEMP VIEW big_orders AS SELECT * FROM orders WHERE o_totalprice > 300000; SELECT count(*) AS n FROM big_orders", "SELECT count(*) AS n FROM orders WHERE o_totalprice > 300000"),
    "create_function": ("postgres", "CREATE OR REPLACE FUNCTION add_two(x INT) RETURNS INT LANGUAGE SQL AS $$ SELECT x + 2 $$; SELECT n_name, add_two(n_nationkey) AS a FROM nation", "SELECT n_name, n_nationkey + 2 AS a FROM nation"),
    "snowflake_generator": ("snowflake", "SELECT COUNT(*) AS n FROM TABLE(GENERATOR(ROWCOUNT => 5))", "SELECT 5::BIGINT AS n"),
    "postgres_containment": ("postgres", "SELECT n_nationkey AS k, ARRAY[1, 2, 3] @> ARRAY[n_nationkey] AS a, ARRAY[n_nationkey] <@ ARRAY[1, 2] AS b, ARRAY[1, 2] && ARRAY[n_nationkey, 9] AS c FROM nation", "SELECT n_nationkey AS k, n_nationkey IN (1, 2, 3) AS a, n_nationkey IN (1, 2) AS b, n_nationkey IN (1, 2) AS c FROM nation"),
    "postgres_vector_distance": ("postgres", "SELECT vec_id, ROUND(CAST(embedding <-> embedding AS DOUBLE PRECISION), 3) AS d FROM embeddings", "SELECT vec_id, 0.0::DOUBLE AS d FROM embeddings"),
    "right_semi": ("spark", "SELECT c_custkey FROM orders RIGHT SEMI JOIN customer ON o_custkey = c_custkey", "SELECT c_custkey FROM customer SEMI JOIN orders ON o_custkey = c_custkey"),
}


#: Scans of files by their path: the text with the tables' folder to fill in, and DuckDB's.
FILES = {
    "sql_file_scan": ("SELECT n_name, n_regionkey FROM '{}/nation.parquet' WHERE n_nationkey < 9", "SELECT n_name, n_regionkey FROM nation WHERE n_nationkey < 9"),
    "sql_reader_scan": ("SELECT r_name FROM read_parquet('{}/region.parquet')", "SELECT r_name FROM region"),
}


def texts() -> dict[str, tuple[str, str, str | None]]:
    return {f"sql_{k}": ("duckdb", v, v) for k, v in DUCK.items()} | {f"sql_{k}": v for k, v in OTHERS.items()} | function_queries.texts()


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    e = Engine(spark, "duckdb").register(sf_dir, TABLES)
    spark.createDataFrame([(1, None), (2, 1), (3, 1), (4, 2)], "k int, parent int").createOrReplaceTempView("tree")
    return e


def runner(dialect: str, text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: engine(spark, sf_dir).sql(text, dialect)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: runner(d, text) for k, (d, text, _) in texts().items()} | {k: at_path(text) for k, (text, _) in FILES.items()}


def at_path(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: Engine(spark, "duckdb").sql(text.format(sf_dir))


def oracle_sql() -> dict[str, str]:
    return {k: duck for k, (_, _, duck) in texts().items() if duck} | {k: duck for k, (_, duck) in FILES.items()}
