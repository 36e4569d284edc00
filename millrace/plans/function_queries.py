"""Queries that run the functions of the survey's inventory, by class and dialect, over whole tables.

A group is a dialect, a table and lines `call => DuckDB expression`; a line without an arrow is the same text in both.
Column i of a query is the i-th line.
"""

from __future__ import annotations

GROUPS: dict[str, tuple[str, str, str]] = {
    "agg_spark": ("spark", "orders GROUP BY o_orderstatus", """
        o_orderstatus
        approx_count_distinct(o_orderstatus) => 1::BIGINT
        size(collect_list(o_orderkey)) => count(*)::INTEGER
        array_join(sort_array(collect_set(o_orderpriority)), ';') => list_aggregate(list_sort(list(DISTINCT o_orderpriority)), 'string_agg', ';')
        every(o_totalprice > 0) => bool_and(o_totalprice > 0)
        any(o_totalprice > 400000) => bool_or(o_totalprice > 400000)
        bit_and(o_orderkey)
        count_if(o_totalprice > 100000) => count(*) FILTER (WHERE o_totalprice > 100000)
        first(o_orderstatus) => o_orderstatus
        last(o_orderstatus) => o_orderstatus
        percentile_approx(o_orderkey, 0) => min(o_orderkey)
        approx_percentile(o_orderkey, 1) => max(o_orderkey)
        round(percentile_cont(0.25) WITHIN GROUP (ORDER BY o_totalprice), 3) => round(quantile_cont(o_totalprice, 0.25), 3)
        round(stddev_pop(o_totalprice), 2)
        round(stddev_samp(o_totalprice), 2)
        round(variance(o_totalprice) / 1000000, 2)
        round(var_samp(o_totalprice) / 1000000, 2)
        round(var_pop(o_totalprice) / 1000000, 2)
        round(stddev(o_totalprice), 2)
        any_value(o_orderstatus)
        max_by(o_orderkey, o_totalprice)
        min_by(o_orderkey, o_totalprice)
        bool_or(o_orderkey = 1)
        array_size(array_agg(o_orderkey)) => count(*)::INTEGER
        listagg(DISTINCT o_orderstatus, ',') => o_orderstatus
        size(approx_top_k(o_orderstatus)) => 1
    """),
    "agg_snowflake": ("snowflake", "orders GROUP BY o_orderstatus", """
        o_orderstatus
        BITAND_AGG(o_orderkey) => bit_and(o_orderkey)
        BITOR_AGG(o_orderkey) => bit_or(o_orderkey)
        BITXOR_AGG(o_orderkey) => bit_xor(o_orderkey)
        BOOLAND_AGG(o_totalprice > 0) => bool_and(o_totalprice > 0)
        BOOLOR_AGG(o_totalprice > 499000) => bool_or(o_totalprice > 499000)
        BOOLXOR_AGG(o_orderkey = 1) => count(*) FILTER (WHERE o_orderkey = 1) = 1
        ARRAY_SIZE(ARRAY_UNIQUE_AGG(o_orderpriority)) => count(DISTINCT o_orderpriority)::INTEGER
        ROUND(MEDIAN(o_totalprice), 3) => round(median(o_totalprice), 3)
        LISTAGG(DISTINCT o_orderpriority, ',') WITHIN GROUP (ORDER BY o_orderpriority) => string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority)
        APPROXIMATE_JACCARD_INDEX(o_orderpriority, o_orderpriority) => 1.0::DOUBLE
        COUNT_IF(o_custkey > 10) => count(*) FILTER (WHERE o_custkey > 10)
        ANY_VALUE(o_orderstatus) => o_orderstatus
        MAX_BY(o_orderkey, o_totalprice) => arg_max(o_orderkey, o_totalprice)
        MIN_BY(o_orderkey, o_totalprice) => arg_min(o_orderkey, o_totalprice)
        SUM(REGR_VALX(o_custkey, o_orderkey)) => sum(o_orderkey)::BIGINT
        SUM(REGR_VALY(o_custkey, o_orderkey)) => sum(o_custkey)::BIGINT
    """),
    "agg_bigquery": ("bigquery", "orders GROUP BY o_orderstatus", """
        o_orderstatus
        LOGICAL_AND(o_totalprice > 0) => bool_and(o_totalprice > 0)
        LOGICAL_OR(o_totalprice > 499000) => bool_or(o_totalprice > 499000)
        COUNTIF(o_custkey < 20) => count(*) FILTER (WHERE o_custkey < 20)
        ARRAY_LENGTH(ARRAY_CONCAT_AGG([o_orderkey, 1])) => (2 * count(*))::INTEGER
        APPROX_QUANTILES(o_orderkey, 1)[OFFSET(0)] => min(o_orderkey)
        STRING_AGG(DISTINCT o_orderstatus, '-') => o_orderstatus
        ARRAY_LENGTH(ARRAY_AGG(o_orderkey ORDER BY o_orderkey LIMIT 3)) => 3
        BIT_AND(o_orderkey) => bit_and(o_orderkey)
        BIT_OR(o_orderkey) => bit_or(o_orderkey)
        BIT_XOR(o_orderkey) => bit_xor(o_orderkey)
    """),
    "agg_duckdb": ("duckdb", "orders GROUP BY o_orderstatus", """
        o_orderstatus
        arg_max(o_orderkey, o_totalprice)
        arg_min(o_orderkey, o_totalprice)
        array_to_string(arg_max(o_orderkey, o_totalprice, 3), ',')
        array_to_string(arg_min(o_orderkey, o_totalprice, 2), ',')
        approx_quantile(o_orderkey, 0) => min(o_orderkey)
        round(quantile_cont(o_totalprice, 0.3), 3)
        quantile_disc(o_orderkey, 0.3) => quantile_disc(o_orderkey, 0.3)::DOUBLE
        count(DISTINCT o_custkey)
        bool_and(o_totalprice > 0)
        bool_or(o_totalprice > 0)
        round(avg(o_totalprice), 3)
        max(o_orderpriority)
        min(o_orderpriority)
        first(o_orderstatus)
        last(o_orderstatus)
        len(list(o_orderkey)) => count(*)
        string_agg(DISTINCT o_orderstatus, ',')
    """),
    "agg_mixed": ("clickhouse", "orders GROUP BY o_orderstatus", """
        o_orderstatus
        any(o_orderstatus) => o_orderstatus
        anyLast(o_orderstatus) => o_orderstatus
        length(groupArray(o_orderkey)) => count(*)::INTEGER
        length(groupUniqArray(o_orderpriority)) => count(DISTINCT o_orderpriority)::INTEGER
        uniq(o_orderstatus) => 1::BIGINT
        uniq(o_orderstatus, 1) => 1::BIGINT
        uniqExact(o_custkey) => count(DISTINCT o_custkey)
        uniqExact(o_custkey, o_orderpriority) => count(DISTINCT (o_custkey, o_orderpriority))
        sumIf(o_orderkey, o_custkey > 10) => (sum(o_orderkey) FILTER (WHERE o_custkey > 10))::BIGINT
        argMax(o_orderkey, o_totalprice) => arg_max(o_orderkey, o_totalprice)
        argMin(o_orderkey, o_totalprice) => arg_min(o_orderkey, o_totalprice)
        round(quantile(0.25)(o_totalprice), 2) => round(quantile_cont(o_totalprice, 0.25), 2)
        round(quantiles(0.1, 0.9)(o_totalprice)[2], 2) => round(quantile_cont(o_totalprice, 0.9), 2)
    """),
    "agg_tsql": ("tsql", "orders GROUP BY o_orderstatus", """
        o_orderstatus
        COUNT_BIG(o_orderkey) => count(*)
        ROUND(STDEV(o_totalprice), 2) => round(stddev_samp(o_totalprice), 2)
        ROUND(VARP(o_totalprice) / 1000000, 2) => round(var_pop(o_totalprice) / 1000000, 2)
        STRING_AGG(CAST(o_custkey AS VARCHAR(10)), ',') WITHIN GROUP (ORDER BY o_custkey, o_orderkey) => string_agg(o_custkey::VARCHAR, ',' ORDER BY o_custkey, o_orderkey)
    """),
    "agg_trino": ("trino", "orders GROUP BY o_orderstatus", """
        o_orderstatus
        approx_distinct(o_orderstatus) => 1::BIGINT
        approx_percentile(o_orderkey, 0.0) => min(o_orderkey)
        arbitrary(o_orderstatus) => o_orderstatus
        cardinality(array_agg(o_orderkey)) => count(*)::INTEGER
        count_if(o_orderkey > 5) => count(*) FILTER (WHERE o_orderkey > 5)
        every(o_totalprice > 0) => bool_and(o_totalprice > 0)
        round(geometric_mean(o_totalprice), 1) => round(geomean(o_totalprice), 1)
        listagg(DISTINCT o_orderstatus, ',') WITHIN GROUP (ORDER BY o_orderstatus) => o_orderstatus
    """),
    "agg_postgres": ("postgres", "orders GROUP BY o_orderstatus", """
        o_orderstatus
        every(o_totalprice > 0) => bool_and(o_totalprice > 0)
        length(json_agg(o_orderstatus)) > 2 => TRUE
        percentile_disc(0.5) WITHIN GROUP (ORDER BY o_orderkey) => quantile_disc(o_orderkey, 0.5)::DOUBLE
        mode() WITHIN GROUP (ORDER BY o_orderstatus) => o_orderstatus
        string_agg(DISTINCT o_orderstatus, ',') => o_orderstatus
        array_length(array_agg(o_orderkey), 1) => count(*)::INTEGER
        bit_or(o_orderkey)
    """),
    "agg_json": ("mysql", "nation GROUP BY n_regionkey", """
        n_regionkey
        JSON_ARRAYAGG(n_regionkey) => '[' || string_agg(n_regionkey::VARCHAR, ',') || ']'
        JSON_OBJECTAGG(n_name, 1) LIKE '{%}' => TRUE
    """),
    "array_spark": ("spark", "nation", """
        n_nationkey
        array_join(array(n_nationkey, 3), ',') => n_nationkey || ',3'
        array_join(array_append(array(n_nationkey), 9), ',') => n_nationkey || ',9'
        size(array_compact(array(1, NULL, n_nationkey))) => 2
        array_contains(array(1, 2), n_nationkey) => n_nationkey IN (1, 2)
        size(array_distinct(array(1, 1, n_nationkey))) => CASE WHEN n_nationkey = 1 THEN 1 ELSE 2 END
        array_join(array_except(array(1, 2, 3), array(n_nationkey)), ',') => array_to_string(list_filter([1, 2, 3], lambda x: x <> n_nationkey), ',')
        array_join(array_insert(array(5, 6), 1, n_nationkey), ',') => n_nationkey || ',5,6'
        size(array_intersect(array(1, 2), array(n_nationkey))) => (n_nationkey IN (1, 2))::INTEGER
        array_max(array(3, n_nationkey)) => greatest(3, n_nationkey)
        array_min(array(3, n_nationkey)) => least(3, n_nationkey)
        array_position(array(7, n_nationkey), n_nationkey) => CASE WHEN n_nationkey = 7 THEN 1 ELSE 2 END::BIGINT
        array_join(array_prepend(array(1), n_nationkey), ',') => n_nationkey || ',1'
        array_join(array_remove(array(1, n_nationkey), 1), ',') => CASE WHEN n_nationkey = 1 THEN '' ELSE n_nationkey::VARCHAR END
        array_join(array_sort(array(5, n_nationkey, 2)), ',') => array_to_string(list_sort([5, n_nationkey, 2]), ',')
        array_size(array(1, 2)) => 2
        size(slice(array(1, 2, 3), 2, 2)) => 2
        sort_array(array(5, n_nationkey), false)[0] => greatest(5, n_nationkey)
        array_join(transform(array(1, 2), x -> x + n_nationkey), ',') => (n_nationkey + 1) || ',' || (n_nationkey + 2)
        size(filter(array(1, 2, 3), x -> x > n_nationkey)) => len(list_filter([1, 2, 3], lambda x: x > n_nationkey))::INTEGER
        reduce(array(1, 2, 3), n_nationkey, (s, x) -> s + x) => n_nationkey + 6
        array_join(flatten(array(array(1), array(n_nationkey))), ',') => '1,' || n_nationkey
        map_contains_key(map(1, 'a'), n_nationkey) => n_nationkey = 1
        bitmap_bucket_number(n_nationkey * 10000 + 1) => (1 + n_nationkey * 10000 // 32768)::BIGINT
        struct(n_nationkey AS a, 2 AS b).a => n_nationkey
        str_to_map('a:1,b:2', ',', ':')['b'] => '2'
        map_keys(map(n_nationkey, 'a'))[0] => n_nationkey
        array_union(array(1), array(1))[0] => 1
        cardinality(array(1, 2)) => 2
        element_at(array(4, n_nationkey), 2) => n_nationkey
        array_repeat('x', 2)[1] => 'x'
        size(sequence(1, 5)) => 5
    """),
    "array_duckdb": ("duckdb", "nation", """
        n_nationkey
        array_to_string(list_append([n_nationkey, 3], 9), ',')
        array_to_string(array_append([n_nationkey, 3], 9), ',')
        array_to_string(list_prepend(9, [n_nationkey, 3]), ',')
        array_to_string(array_prepend(9, [n_nationkey]), ',')
        array_to_string(list_concat([n_nationkey], [1, 2]), ',')
        array_to_string(array_cat([1], [n_nationkey]), ',')
        array_to_string(array_concat([1], [n_nationkey]), ',')
        list_has_any([n_nationkey, 1], [3, 4])
        list_has_all([n_nationkey, 1], [1])
        array_to_string(list_reverse_sort([n_nationkey, 3, 1]), ',')
        array_to_string(array_reverse_sort([n_nationkey, 3, 1]), ',')
        array_to_string(list_value(n_nationkey, 2), ',')
        list_max([n_nationkey, 3])
        list_min([n_nationkey, 3])
        list_contains([1, 2], n_nationkey)
        list_position([5, n_nationkey], n_nationkey) => CASE WHEN n_nationkey = 5 THEN 1 ELSE 2 END::BIGINT
        array_to_string(list_sort([3, n_nationkey]), ',')
        array_to_string(list_distinct([1, 1]), ',')
        array_to_string(list_transform([1, 2], lambda x: x * n_nationkey), ',')
        array_to_string(list_filter([1, 2, 3], lambda x: x <> n_nationkey), ',')
        list_reduce([1, 2, 3], lambda x, y: x + y)
        array_to_string(list_slice([1, 2, 3], 2, 3), ',')
        array_to_string(flatten([[1], [n_nationkey]]), ',')
        array_to_string(generate_series(1, 3), ',')
        array_to_string(range(1, 3), ',')
        len([1, n_nationkey]) => 2::BIGINT
        array_length([1, n_nationkey]) => 2
        string_split('a-b', '-')[2]
        str_split('a.b', '.')[2]
        string_to_array('a,b', ',')[1]
        str_split_regex('a1b2c', '[0-9]')[3]
        string_split_regex('a1b', '[0-9]')[2]
        list_extract([4, 5], 2)
        struct_extract({'a': n_nationkey, 'b': 2}, 'a')
        list_sum([1, n_nationkey]) => (1 + n_nationkey)::DOUBLE
        array_to_string(list_reverse([1, n_nationkey]), ',')
        list_unique([1, 1, 2]) => 2
        cardinality(map([1], [n_nationkey])) => 1
    """),
    "array_snowflake": ("snowflake", "nation", """
        n_nationkey
        ARRAY_TO_STRING(ARRAY_CONSTRUCT(n_nationkey, 2), ',') => n_nationkey || ',2'
        ARRAY_SIZE(ARRAY_CONSTRUCT_COMPACT(1, NULL, n_nationkey)) => 2
        ARRAY_TO_STRING(ARRAY_CAT(ARRAY_CONSTRUCT(1), ARRAY_CONSTRUCT(n_nationkey)), ',') => '1,' || n_nationkey
        ARRAY_CONTAINS(n_nationkey, ARRAY_CONSTRUCT(1, 2)) => n_nationkey IN (1, 2)
        ARRAY_POSITION(n_nationkey, ARRAY_CONSTRUCT(1, 2)) => CASE n_nationkey WHEN 1 THEN 0 WHEN 2 THEN 1 END::BIGINT
        ARRAY_TO_STRING(ARRAY_INSERT(ARRAY_CONSTRUCT(5, 6), 1, n_nationkey), ',') => '5,' || n_nationkey || ',6'
        ARRAY_TO_STRING(ARRAY_SLICE(ARRAY_CONSTRUCT(4, 5, 6), 1, 3), ',') => '5,6'
        ARRAY_TO_STRING(ARRAY_GENERATE_RANGE(1, 4), ',') => '1,2,3'
        ARRAY_TO_STRING(ARRAY_GENERATE_RANGE(0, 10, 4), ',') => '0,4,8'
        ARRAY_TO_STRING(ARRAY_REMOVE_AT(ARRAY_CONSTRUCT(7, 8, 9), 1), ',') => '7,9'
        ARRAY_TO_STRING(ARRAY_FLATTEN(ARRAY_CONSTRUCT(ARRAY_CONSTRUCT(1), ARRAY_CONSTRUCT(2))), ',') => '1,2'
        ARRAY_TO_STRING(ARRAY_INTERSECTION(ARRAY_CONSTRUCT(1, 2), ARRAY_CONSTRUCT(2)), ',') => '2'
        ARRAY_TO_STRING(ARRAY_APPEND(ARRAY_CONSTRUCT(1), n_nationkey), ',') => '1,' || n_nationkey
        ARRAY_TO_STRING(ARRAY_PREPEND(ARRAY_CONSTRUCT(1), n_nationkey), ',') => n_nationkey || ',1'
        ARRAY_TO_STRING(ARRAY_COMPACT(ARRAY_CONSTRUCT(1, NULL)), ',') => '1'
        ARRAY_TO_STRING(ARRAY_DISTINCT(ARRAY_CONSTRUCT(1, 1)), ',') => '1'
        ARRAY_MAX(ARRAY_CONSTRUCT(3, n_nationkey)) => greatest(3, n_nationkey)
        ARRAY_MIN(ARRAY_CONSTRUCT(3, n_nationkey)) => least(3, n_nationkey)
        ARRAY_TO_STRING(ARRAY_SORT(ARRAY_CONSTRUCT(3, n_nationkey)), ',') => array_to_string(list_sort([3, n_nationkey]), ',')
        GET(ARRAY_CONSTRUCT(n_nationkey, 2), 0) => n_nationkey
        OBJECT_CONSTRUCT('a', n_nationkey)['a'] => n_nationkey
        OBJECT_CONSTRUCT_KEEP_NULL('a', n_nationkey)['a'] => n_nationkey
        OBJECT_INSERT(OBJECT_CONSTRUCT('a', 1), 'b', n_nationkey)['b'] => n_nationkey
        MAP_SIZE(OBJECT_CONSTRUCT('a', n_nationkey)) => 1
        MAP_CONTAINS_KEY('a', OBJECT_CONSTRUCT('a', n_nationkey)) => TRUE
        MAP_SIZE(MAP_DELETE(OBJECT_CONSTRUCT('a', 1, 'b', 2), 'a')) => 1
        MAP_SIZE(MAP_INSERT(OBJECT_CONSTRUCT('a', 1), 'b', 2)) => 2
        ARRAY_TO_STRING(STRTOK_TO_ARRAY('a b', ' '), '-') => 'a-b'
        ARRAY_TO_STRING(SPLIT('a.b', '.'), '-') => 'a-b'
        STRTOK('a-b-c', '-', 2) => 'b'
        ARRAY_TO_STRING(TO_ARRAY(n_nationkey), ',') => n_nationkey::VARCHAR
        ARRAY_TO_STRING(FILTER(ARRAY_CONSTRUCT(1, 2, 3), x -> x > 1), ',') => '2,3'
        ARRAY_TO_STRING(TRANSFORM(ARRAY_CONSTRUCT(1, 2), x -> x + 1), ',') => '2,3'
        REDUCE(ARRAY_CONSTRUCT(1, 2), 0, (a, x) -> a + x) => 3
        ARRAY_TO_STRING(ARRAY_EXCEPT(ARRAY_CONSTRUCT(1, 2), ARRAY_CONSTRUCT(2)), ',') => '1'
    """),
    "array_mixed": ("clickhouse", "nation", """
        n_nationkey
        has([1, 2], n_nationkey) => n_nationkey IN (1, 2)
        arrayMax([3, n_nationkey]) => greatest(3, n_nationkey)
        arrayMin([3, n_nationkey]) => least(3, n_nationkey)
        arrayReverse([1, n_nationkey])[1] => n_nationkey
        arraySlice([1, 2, 3], 2, 2)[1] => 2
        hasAny([1, 2], [n_nationkey]) => n_nationkey IN (1, 2)
        hasAll([1, 2], [n_nationkey]) => n_nationkey IN (1, 2)
        length(splitByString('.', 'a.b')) => 2
        splitByRegexp('[0-9]', 'a1b')[2] => 'b'
        splitByChar('.', 'a.b')[2] => 'b'
        multiIf(n_nationkey = 1, 'one', n_nationkey = 2, 'two', 'more') => CASE n_nationkey WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'more' END
        if(n_nationkey > 1, 'a', 'b') => CASE WHEN n_nationkey > 1 THEN 'a' ELSE 'b' END
        empty(n_name) => FALSE
        notEmpty(n_name) => TRUE
        toString(n_nationkey) => n_nationkey::VARCHAR
        substringIndex('a.b.c', '.', 2) => 'a.b'
        positionUTF8(n_name, 'N') => strpos(n_name, 'N')::INTEGER
        lowerUTF8(n_name) => lower(n_name)
        upperUTF8(n_name) => upper(n_name)
        lengthUTF8(n_name) => length(n_name)::INTEGER
        bitAnd(n_nationkey, 6) => n_nationkey & 6
        bitOr(n_nationkey, 6) => n_nationkey | 6
        bitXor(n_nationkey, 6) => xor(n_nationkey, 6)
        bitNot(n_nationkey) => ~n_nationkey
        bitShiftLeft(n_nationkey, 2) => n_nationkey * 4
        bitShiftRight(n_nationkey, 1) => n_nationkey // 2
        toFloat64(n_nationkey) => n_nationkey::DOUBLE
        replaceAll(n_name, 'N', 'x') => replace(n_name, 'N', 'x')
    """),
    "array_bigquery": ("bigquery", "nation", """
        n_nationkey
        ARRAY_TO_STRING(ARRAY_CONCAT(['a'], ['b']), ',') => 'a,b'
        ARRAY_LENGTH([1, n_nationkey]) => 2
        ARRAY_TO_STRING(ARRAY_REVERSE(['a', 'b']), '') => 'ba'
        ARRAY_LENGTH(GENERATE_ARRAY(1, 10, 3)) => 4
        ARRAY_LENGTH(GENERATE_DATE_ARRAY('2024-01-01', '2024-01-05')) => 5
        ARRAY_LENGTH(GENERATE_DATE_ARRAY(DATE '2024-01-01', DATE '2024-03-01', INTERVAL 1 MONTH)) => 3
        ARRAY_LENGTH(GENERATE_TIMESTAMP_ARRAY('2024-01-01 00:00:00', '2024-01-01 05:00:00', INTERVAL 1 HOUR)) => 6
        SPLIT('a,b')[OFFSET(1)] => 'b'
        SPLIT('a.b', '.')[OFFSET(1)] => 'b'
        [10, 20][SAFE_OFFSET(5)] => NULL::INTEGER
        STRUCT(n_nationkey AS a, 'x' AS b).a => n_nationkey
        [STRUCT(1 AS a), STRUCT(3)][OFFSET(1)].a => 3
        ARRAY_TO_STRING(ARRAY_FILTER(['a', 'b'], x -> x <> 'a'), '') => 'b'
    """),
    "array_trino": ("trino", "nation", """
        n_nationkey
        cardinality(ARRAY[1, n_nationkey]) => 2
        array_join(ARRAY[n_nationkey, 2], ',') => n_nationkey || ',2'
        contains(ARRAY[1, 2], n_nationkey) => n_nationkey IN (1, 2)
        element_at(ARRAY[1, 2], 5) => NULL::INTEGER
        array_position(ARRAY[9, 8], 8) => 2::BIGINT
        cardinality(sequence(1, 4)) => 4
        reduce(ARRAY[1, 2, 3], 0, (s, x) -> s + x, s -> s * 10) => 60
        array_max(transform(ARRAY[1, n_nationkey], x -> x * 2)) => greatest(2, 2 * n_nationkey)
        cardinality(filter(ARRAY[1, 2, 3], x -> x > 1)) => 2
        array_join(array_sort(ARRAY[3, 1, 2]), ',') => '1,2,3'
        array_join(array_distinct(ARRAY[1, 1]), ',') => '1'
        array_join(array_remove(ARRAY[1, 2], 1), ',') => '2'
        array_join(array_intersect(ARRAY[1, 2], ARRAY[2]), ',') => '2'
        array_join(array_except(ARRAY[1, 2], ARRAY[2]), ',') => '1'
        array_join(slice(ARRAY[1, 2, 3], 2, 2), ',') => '2,3'
        array_join(flatten(ARRAY[ARRAY[1], ARRAY[2]]), ',') => '1,2'
    """),
    "string_spark": ("spark", "part", """
        p_partkey
        char_length(p_name) => length(p_name)::INTEGER
        character_length(p_name) => length(p_name)::INTEGER
        octet_length(p_name) => strlen(p_name)::INTEGER
        chr(65 + p_size % 20) => chr(65 + p_size % 20)
        initcap(p_name) => array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ')
        endswith(p_name, 'bolt') => ends_with(p_name, 'bolt')
        startswith(p_name, 'small') => starts_with(p_name, 'small')
        contains(p_name, 'old') => contains(p_name, 'old')
        locate('t', p_name) => strpos(p_name, 't')::INTEGER
        ltrim('  x') => 'x'
        rtrim('x  ') => 'x'
        trim(' x ') => 'x'
        lpad(p_brand, 10, '*') => lpad(p_brand, 10, '*')
        rpad(p_brand, 10, '*') => rpad(p_brand, 10, '*')
        space(3) => '   '
        repeat('ab', 2) => 'abab'
        reverse(p_name)
        substring(p_name, 2, 3)
        substring_index('a.b.c', '.', 2) => 'a.b'
        split(p_name, ' ')[1] => string_split(p_name, ' ')[2]
        split_part(p_name, ' ', 2)
        translate(p_name, 'abc', 'xyz')
        upper(p_name)
        lower(p_name)
        replace(p_name, 'o', '0')
        concat(p_name, '-', p_brand)
        concat_ws('/', p_name, NULL, p_brand)
        ascii(p_name)
        levenshtein(p_name, 'small bolt')::BIGINT => levenshtein(p_name, 'small bolt')
        soundex('Robert') => 'R163'
        format_string('%05d|%s', p_size, p_brand) => printf('%05d|%s', p_size, p_brand)
        overlay('abcdef', 'XY', 3, 2) => 'abXYef'
        position('o' IN p_name) => strpos(p_name, 'o')::INTEGER
        p_name LIKE '%bolt%'
        p_name ILIKE '%BOLT%'
        p_name RLIKE '^[a-c]' => regexp_matches(p_name, '^[a-c]')
        p_name REGEXP 'o.t' => regexp_matches(p_name, 'o.t')
        regexp_like(p_name, 'old') => regexp_matches(p_name, 'old')
        regexp_count(p_name, 'o') => len(regexp_extract_all(p_name, 'o'))::INTEGER
        regexp_substr(p_name, '[a-c]+') => nullif(regexp_extract(p_name, '[a-c]+'), '')
        regexp_extract(p_name, '([a-z]+) ([a-z]+)', 2)
        size(regexp_extract_all(p_name, '[aeiou]', 0)) => len(regexp_extract_all(p_name, '[aeiou]'))::INTEGER
        regexp_replace(p_name, '[aeiou]', '_') => regexp_replace(p_name, '[aeiou]', '_', 'g')
        regexp_instr(p_name, 'd') => strpos(p_name, 'd')::INTEGER
        left(p_name, 3)
        right(p_name, 3)
        nvl(NULL, p_name) => p_name
        nvl2(p_name, 1, 2) => 1
        nullif(p_size, 10)
        coalesce(NULL, p_size) => p_size
        greatest(p_size, 10)
        least(p_size, 10)
        if(p_size > 10, 'a', 'b') => CASE WHEN p_size > 10 THEN 'a' ELSE 'b' END
        equal_null(p_size, p_size) => TRUE
    """),
    "string_mixed": ("tsql", "part", """
        p_partkey
        LEN('ab  ') => 2
        CHARINDEX('o', p_name) => strpos(p_name, 'o')::INTEGER
        REPLICATE('ab', 2) => 'abab'
        STUFF('abcdef', 2, 3, 'XY') => 'aXYef'
        UNICODE('A') => 65
        SPACE(2) => '  '
        IIF(p_size > 10, 'a', 'b') => CASE WHEN p_size > 10 THEN 'a' ELSE 'b' END
        ISNULL(NULL, p_size) => p_size
        CHOOSE(2, 'a', 'b') => 'b'
        SQUARE(p_size) => p_size::DOUBLE * p_size
        CEILING(p_retailprice) => ceil(p_retailprice)::BIGINT
        DATENAME(month, CAST('2024-05-06' AS DATE)) => 'May'
        DATENAME(weekday, CAST('2024-05-06' AS DATE)) => 'Monday'
        DATENAME(year, CAST('2024-05-06' AS DATE)) => '2024'
        DATEFROMPARTS(2024, 5, p_size % 28 + 1) => make_date(2024, 5, p_size % 28 + 1)
        DATETIMEFROMPARTS(2024, 5, 6, 7, 8, 9, 0) => TIMESTAMP '2024-05-06 07:08:09'
        EOMONTH(CAST('2024-02-06' AS DATE)) => DATE '2024-02-29'
        EOMONTH(CAST('2024-02-06' AS DATE), 1) => DATE '2024-03-31'
        DATEADD(month, 1, CAST('2024-01-31' AS DATE)) => DATE '2024-02-29'
        DATEDIFF(day, CAST('2024-01-31' AS DATE), CAST('2024-03-01' AS DATE)) => 30::BIGINT
        DATEPART(month, CAST('2024-05-06' AS DATE)) => 5::BIGINT
        TRY_CONVERT(INT, 'x') => NULL::INTEGER
        LEFT(p_name, 2) => p_name[1:2]
    """),
    "string_duckdb": ("duckdb", "part", """
        p_partkey
        strlen(p_name) => strlen(p_name)::INTEGER
        unicode('A')
        ord('A')
        ends_with(p_name, 't')
        suffix(p_name, 't')
        prefix(p_name, 's')
        starts_with(p_name, 's')
        lcase(p_name)
        ucase(p_name)
        strpos(p_name, 'o')
        instr(p_name, 'o') => strpos(p_name, 'o')::INTEGER
        printf('%d-%s', p_size, p_name)
        regexp_matches(p_name, 'o')
        regexp_full_match(p_name, '[a-z ]+')
        regexp_extract(p_name, '[a-c]+')
        regexp_split_to_array(p_name, ' ')[1]
        levenshtein(p_name, 'bolt')
        editdist3(p_name, 'bolt') => levenshtein(p_name, 'bolt')::INTEGER
        lpad(p_brand, 12, '.')
        repeat(p_brand, 2)
        concat_ws('-', p_brand, p_name)
        left(p_name, 4)
        right(p_name, 4)
        trim(p_name)
        translate(p_name, 'ab', 'xy')
        md5(p_name)
        sha256(p_name)
        sha1(p_name)
        hex(p_size)
        to_base64(encode(p_name))
        CASE WHEN p_name IS NULL THEN 0 ELSE 1 END
        chr(66)
        ascii(p_name)
        p_name LIKE 'b%'
        p_name ILIKE 'B%'
    """),
    "string_snowflake": ("snowflake", "part", """
        p_partkey
        EDITDISTANCE(p_name, 'bolt') => levenshtein(p_name, 'bolt')::INTEGER
        CHARINDEX('o', p_name) => strpos(p_name, 'o')::INTEGER
        STARTSWITH(p_name, 's') => starts_with(p_name, 's')
        ENDSWITH(p_name, 't') => ends_with(p_name, 't')
        INITCAP('ab cd') => 'Ab Cd'
        BASE64_ENCODE('abc') => 'YWJj'
        BASE64_DECODE_STRING('YWJj') => 'abc'
        HEX_ENCODE('abc') => '616263'
        HEX_DECODE_STRING('616263') => 'abc'
        HEX_ENCODE(HEX_DECODE_BINARY('616263')) => '616263'
        HEX_ENCODE(BASE64_DECODE_BINARY('YWJj')) => '616263'
        MD5_HEX(p_name) => md5(p_name)
        SHA1_HEX(p_name) => sha1(p_name)
        SHA2_HEX(p_name, 256) => sha256(p_name)
        SHA2(p_name, 256) => sha256(p_name)
        SHA1(p_name) => sha1(p_name)
        REGEXP_LIKE(p_name, '[a-z]+ [a-z]+') => TRUE
        REGEXP_COUNT(p_name, 'o') => len(regexp_extract_all(p_name, 'o'))::INTEGER
        REGEXP_SUBSTR(p_name, '[a-c]+') => nullif(regexp_extract(p_name, '[a-c]+'), '')
        ARRAY_TO_STRING(REGEXP_SUBSTR_ALL('a1b2', '[0-9]'), ',') => '1,2'
        REGEXP_REPLACE(p_name, '[aeiou]', '') => regexp_replace(p_name, '[aeiou]', '', 'g')
        SPLIT_PART(p_name, ' ', 1) => split_part(p_name, ' ', 1)
        TO_BOOLEAN('true') => TRUE
        TO_DOUBLE('1.5') => 1.5::DOUBLE
        TO_NUMBER('12')::INT => 12
        TO_DECIMAL('12.345', 10, 2)::DOUBLE => 12.35::DOUBLE
        TO_NUMERIC('12')::INT => 12
        TRY_TO_BOOLEAN('x') => NULL::BOOLEAN
        TRY_TO_DOUBLE('x') => NULL::DOUBLE
        TRY_TO_NUMBER('x')::INT => NULL::INTEGER
        TRY_TO_DECIMAL('x')::INT => NULL::INTEGER
        TRY_TO_NUMERIC('7')::INT => 7
        IFF(p_size > 3, 1, 2) => CASE WHEN p_size > 3 THEN 1 ELSE 2 END
        NULLIFZERO(p_size - 10) => nullif(p_size - 10, 0)
        ZEROIFNULL(NULL::INT) => 0
        EQUAL_NULL(p_size, 3) => p_size IS NOT DISTINCT FROM 3
        DIV0(p_size, 0)::DOUBLE => 0.0::DOUBLE
        DIV0NULL(p_size, NULL)::DOUBLE => 0.0::DOUBLE
        BITAND(p_size, 6) => p_size & 6
        BITOR(p_size, 6) => p_size | 6
        BITXOR(p_size, 6) => xor(p_size, 6)
        BITNOT(p_size) => ~p_size
        BITSHIFTLEFT(p_size, 2) => p_size * 4
        BITSHIFTRIGHT(p_size, 2) => p_size // 4
        BOOLAND(p_size > 1, p_size < 30) => p_size > 1 AND p_size < 30
        BOOLOR(p_size < 1, p_size > 30) => p_size < 1 OR p_size > 30
        BOOLNOT(p_size > 10) => NOT p_size > 10
        BOOLXOR(p_size > 10, p_size > 20) => (p_size > 10) <> (p_size > 20)
        SQUARE(p_size) => p_size::DOUBLE * p_size
        ROUND(CBRT(p_size), 6) => round(cbrt(p_size), 6)
        GREATEST_IGNORE_NULLS(p_size, NULL, 3) => greatest(p_size, 3)
        LEAST_IGNORE_NULLS(p_size, NULL, 3) => least(p_size, 3)
        JAROWINKLER_SIMILARITY('MARTHA', 'MARHTA') => 96
        DECODE(p_size, 1, 'a', 'b') => CASE WHEN p_size = 1 THEN 'a' ELSE 'b' END
        NVL(NULL, p_size) => p_size
    """),
    "string_bigquery": ("bigquery", "part", """
        p_partkey
        CONTAINS_SUBSTR(p_name, 'BOLT') => contains(p_name, 'bolt')
        EDIT_DISTANCE(p_name, 'bolt') => levenshtein(p_name, 'bolt')::INTEGER
        REGEXP_CONTAINS(p_name, 'o.t') => regexp_matches(p_name, 'o.t')
        ARRAY_LENGTH(REGEXP_EXTRACT_ALL(p_name, '[aeiou]')) => len(regexp_extract_all(p_name, '[aeiou]'))::INTEGER
        STRPOS(p_name, 'o') => strpos(p_name, 'o')::INTEGER
        STARTS_WITH(p_name, 's') => starts_with(p_name, 's')
        ENDS_WITH(p_name, 't') => ends_with(p_name, 't')
        TO_HEX(SHA256('a')) => sha256('a')
        FROM_HEX('6162') IS NOT NULL => TRUE
        TO_BASE64(CAST('abc' AS BYTES)) => 'YWJj'
        FORMAT('%d-%s', p_size, p_name) => printf('%d-%s', p_size, p_name)
        SAFE_ADD(p_size, 1)::INT64 => (p_size + 1)::BIGINT
        SAFE_SUBTRACT(p_size, 1)::INT64 => (p_size - 1)::BIGINT
        SAFE_MULTIPLY(p_size, 2)::INT64 => (p_size * 2)::BIGINT
        SAFE_DIVIDE(p_size, 0) => NULL::DOUBLE
        DIV(p_size, 4)::INT64 => (p_size // 4)::BIGINT
        IS_NAN(CAST('nan' AS FLOAT64)) => TRUE
        IS_INF(CAST('Infinity' AS FLOAT64)) => TRUE
        LENGTH(GENERATE_UUID()) => 36
        TO_JSON_STRING([1, 2]) => '[1,2]'
        POW(p_size, 2) => p_size::DOUBLE * p_size
        TRUNC(p_retailprice) => trunc(p_retailprice)::BIGINT
        BIT_COUNT(p_size) => bit_count(p_size)::INTEGER
    """),
    "string_others": ("mysql", "part", """
        p_partkey
        LOCATE('o', p_name) => strpos(p_name, 'o')::INTEGER
        INSTR(p_name, 'o') => strpos(p_name, 'o')::INTEGER
        LENGTH('é') => 2
        CHAR_LENGTH('é') => 1
        SUBSTRING_INDEX('a.b.c', '.', 2) => 'a.b'
        IFNULL(NULL, p_size) => p_size
        MID(p_name, 2, 3) => substring(p_name, 2, 3)
        LCASE(p_name) => lower(p_name)
        UCASE(p_name) => upper(p_name)
        FIND_IN_SET('b', 'a,b') => 2
        TRUNCATE(p_retailprice, 1) => floor(p_retailprice * 10) / 10
        SPACE(2) => '  '
        ELT(2, 'a', 'b') => 'b'
        HEX(255) => 'FF'
        SHA2('a', 256) => sha256('a')
        SHA1('a') => sha1('a')
        SHA('a') => sha1('a')
        MD5('a') => md5('a')
        TO_BASE64('abc') => 'YWJj'
        p_name REGEXP 'o' => regexp_matches(p_name, 'o')
        WEEK('2024-01-07') => 1
        WEEK('2024-01-07', 3) => 1
        WEEK('2024-12-30', 0) => 52
        TIMEDIFF('2024-01-02 01:02:03', '2024-01-01 00:00:00') => '25:02:03'
        TIMEDIFF('2024-01-01 00:00:00', '2024-01-01 00:00:59') => '-00:00:59'
        DAYNAME('2024-05-06') => 'Monday'
        MONTHNAME('2024-05-06') => 'May'
        QUARTER('2024-05-06') => 2
        ADDDATE('2024-05-06', 2) => DATE '2024-05-08'
        SUBDATE('2024-05-06', 2) => DATE '2024-05-04'
        STR_TO_DATE('06/05/2024', '%d/%m/%Y') => DATE '2024-05-06'
        UNIX_TIMESTAMP('1970-01-02') => 86400::BIGINT
        FROM_UNIXTIME(86400) => '1970-01-02 00:00:00'
        TIMESTAMPDIFF(MONTH, '2024-01-15', '2024-03-14') => 1::BIGINT
        LAST_DAY('2024-02-03') => DATE '2024-02-29'
        HOUR(MAKETIME(1, 2, 3)) => 1
        CURTIME() IS NOT NULL => TRUE
        CURDATE() = CURRENT_DATE => TRUE
        NOW() IS NOT NULL => TRUE
        SYSDATE() IS NOT NULL => TRUE
        UUID() IS NOT NULL => TRUE
        RAND() < 1 => TRUE
        SCHEMA() IS NOT NULL => TRUE
        USER() IS NOT NULL => TRUE
    """),
    "string_oracle": ("oracle", "part", """
        p_partkey
        INSTR(p_name, 'o') => strpos(p_name, 'o')::INTEGER
        INSTR('abcabc', 'b', 3) => 5
        INSTR('abcabcabc', 'b', 3, 2) => 8
        INSTR('abc', 'b', 1, 2) => 0
        NVL(NULL, p_size) => p_size
        LENGTH('') => NULL::INTEGER
        SUBSTR(p_name, -3) => right(p_name, 3)
        TO_CHAR(DATE '2024-05-06', 'YYYY/MM') => '2024/05'
        TO_DATE('2024-05-06', 'YYYY-MM-DD') => DATE '2024-05-06'
        TRUNC(DATE '2024-05-06', 'MM') => DATE '2024-05-01'
        ADD_MONTHS(DATE '2024-01-31', 1) => DATE '2024-02-29'
        LAST_DAY(DATE '2024-02-03') => DATE '2024-02-29'
        SYSTIMESTAMP IS NOT NULL => TRUE
        SYSDATE IS NOT NULL => TRUE
    """),
    "string_trino": ("trino", "part", """
        p_partkey
        strpos(p_name, 'o') => strpos(p_name, 'o')::INTEGER
        levenshtein_distance(p_name, 'bolt') => levenshtein(p_name, 'bolt')::INTEGER
        regexp_like(p_name, 'o') => regexp_matches(p_name, 'o')
        regexp_extract(p_name, '[a-c]+') => nullif(regexp_extract(p_name, '[a-c]+'), '')
        split(p_name, ' ')[1] => string_split(p_name, ' ')[1]
        to_hex(to_utf8('ab')) => '6162'
        from_utf8(from_hex('6162')) => 'ab'
        to_base64(to_utf8('abc')) => 'YWJj'
        bitwise_and(p_size, 6) => p_size & 6
        bitwise_or(p_size, 6) => p_size | 6
        bitwise_xor(p_size, 6) => xor(p_size, 6)
        json_extract_scalar('{"a": 1}', '$.a') => '1'
        from_iso8601_date('2024-05-06') => DATE '2024-05-06'
        to_unixtime(TIMESTAMP '1970-01-02 00:00:00') => 86400::BIGINT
        date_format(DATE '2024-05-06', '%Y-%m') => '2024-05'
        is_nan(p_retailprice) => FALSE
        truncate(p_retailprice) => trunc(p_retailprice)::BIGINT
        format('%d', p_size) => p_size::VARCHAR
        from_unixtime(86400) IS NOT NULL => TRUE
    """),
    "math_spark": ("spark", "part", """
        p_partkey
        abs(p_size - 20) => abs(p_size - 20)
        ceil(p_retailprice) => ceil(p_retailprice)::BIGINT
        ceiling(p_retailprice) => ceil(p_retailprice)::BIGINT
        floor(p_retailprice) => floor(p_retailprice)::BIGINT
        round(exp(p_size / 10), 5) => round(exp(p_size / 10), 5)
        round(ln(p_size + 1), 6) => round(ln(p_size + 1), 6)
        round(log10(p_size + 1), 6) => round(log10(p_size + 1), 6)
        round(log2(p_size + 1), 6) => round(log2(p_size + 1), 6)
        pow(p_size, 2) => pow(p_size, 2)
        power(p_size, 2) => pow(p_size, 2)
        round(sqrt(p_size), 6)
        round(cbrt(p_size), 6)
        sign(p_size - 20)::INT => sign(p_size - 20)::INTEGER
        mod(p_size, 7) => p_size % 7
        try_add(p_size, 1) => p_size + 1
        try_subtract(p_size, 1) => p_size - 1
        try_multiply(p_size, 2) => p_size * 2
        try_divide(p_size, 0) => NULL::DOUBLE
        isnan(p_retailprice) => FALSE
        bit_count(p_size) => bit_count(p_size)::INTEGER
        bit_get(p_size, 1)::INT => (p_size // 2) % 2
        shiftleft(p_size, 1) => p_size * 2
        shiftright(p_size, 1) => p_size // 2
        round(degrees(radians(p_size)), 6) => p_size::DOUBLE
        round(sin(p_size) + cos(p_size) + tan(p_size), 6)
        round(asin(0.5) + acos(0.5) + atan(p_size) + atan2(p_size, 2), 6)
        rand() < 1 => TRUE
        random() < 1 => TRUE
        hex(p_size) => hex(p_size)
        pi() > 3 => TRUE
        factorial(5) => 120::BIGINT
        trunc(DATE '2024-05-06', 'MONTH') => DATE '2024-05-01'
        width_bucket(p_size, 0, 50, 5) IS NOT NULL => TRUE
    """),
    "math_duckdb": ("duckdb", "part", """
        p_partkey
        even(p_size - 0.5) => even(p_size - 0.5)::DOUBLE
        fdiv(p_size, 7)::DOUBLE
        xor(p_size, 6)
        isinf(p_retailprice)
        isfinite(p_retailprice)
        isnan(p_retailprice)
        pow(p_size, 2)
        trunc(p_retailprice)::BIGINT
        p_size // 7
        p_size % 7
        p_size ** 2
        round(log(p_size + 1), 6)
        round(log2(p_size + 1), 6)
        bit_count(p_size)::INTEGER
        random() < 1
        length(gen_random_uuid()::VARCHAR)
    """),
    "date_spark": ("spark", "orders", """
        o_orderkey
        add_months(o_orderdate, 1) => (o_orderdate + INTERVAL 1 MONTH)::DATE
        to_date('2024-05-06') => DATE '2024-05-06'
        date_add(o_orderdate, 3) => (o_orderdate + INTERVAL 3 DAY)::DATE
        date_sub(o_orderdate, 3) => (o_orderdate - INTERVAL 3 DAY)::DATE
        datediff(o_orderdate, DATE '1995-01-01') => date_diff('day', DATE '1995-01-01', o_orderdate)::INTEGER
        date_format(o_orderdate, 'yyyy-MM') => strftime(o_orderdate, '%Y-%m')
        date_from_unix_date(1) => DATE '1970-01-02'
        day(o_orderdate) => day(o_orderdate)::INTEGER
        dayname(o_orderdate) => dayname(o_orderdate)[1:3]
        monthname(o_orderdate) => monthname(o_orderdate)[1:3]
        dayofweek(o_orderdate) => (dayofweek(o_orderdate) + 1)::INTEGER
        dayofyear(o_orderdate) => dayofyear(o_orderdate)::INTEGER
        weekofyear(o_orderdate) => weekofyear(o_orderdate)::INTEGER
        year(o_orderdate) => year(o_orderdate)::INTEGER
        quarter(o_orderdate) => quarter(o_orderdate)::INTEGER
        month(o_orderdate) => month(o_orderdate)::INTEGER
        hour(o_orderdate) => hour(o_orderdate)::INTEGER
        minute(o_orderdate) => minute(o_orderdate)::INTEGER
        second(o_orderdate) => second(o_orderdate)::INTEGER
        last_day(o_orderdate) => last_day(o_orderdate)
        make_date(2024, 5, 6) => DATE '2024-05-06'
        make_timestamp_ntz(2024, 5, 6, 7, 8, 9) => TIMESTAMP '2024-05-06 07:08:09'
        date_format(make_timestamp(2024, 5, 6, 7, 8, 9), 'yyyy-MM-dd HH:mm:ss') => '2024-05-06 07:08:09'
        o_orderdate + make_interval(0, 1) => o_orderdate + INTERVAL 1 MONTH
        months_between(DATE '2024-03-01', DATE '2024-01-01') => 2.0::DOUBLE
        next_day(DATE '2024-05-06', 'TU') => DATE '2024-05-07'
        unix_date(DATE '1970-01-03') => 2
        unix_timestamp('1970-01-02 00:00:00') => 86400::BIGINT
        unix_seconds(TIMESTAMP '1970-01-02 00:00:00') => 86400::BIGINT
        unix_millis(TIMESTAMP '1970-01-02 00:00:00') => 86400000::BIGINT
        unix_micros(TIMESTAMP '1970-01-02 00:00:00') => 86400000000::BIGINT
        unix_millis(timestamp_seconds(86400)) => 86400000::BIGINT
        unix_millis(timestamp_millis(86400000)) => 86400000::BIGINT
        unix_millis(timestamp_micros(86400000000)) => 86400000::BIGINT
        from_unixtime(86400) => '1970-01-02 00:00:00'
        to_unix_timestamp('1970-01-02 00:00:00') => 86400::BIGINT
        date_trunc('MONTH', o_orderdate)::DATE => date_trunc('month', o_orderdate)::DATE
        trunc(o_orderdate, 'YEAR') => date_trunc('year', o_orderdate)::DATE
        to_timestamp_ntz('2024-05-06 07:08:09') => TIMESTAMP '2024-05-06 07:08:09'
        unix_seconds(to_timestamp('1970-01-02', 'yyyy-MM-dd')) => 86400::BIGINT
        unix_seconds(convert_timezone('UTC', 'Asia/Tokyo', TIMESTAMP_NTZ '1970-01-02 00:00:00')::TIMESTAMP) => 118800::BIGINT
        timestampdiff(DAY, DATE '2024-01-01', DATE '2024-01-31') => 30::BIGINT
        timestampadd(DAY, 2, TIMESTAMP_NTZ '2024-01-01 00:00:00') => TIMESTAMP '2024-01-03'
        extract(DOY FROM o_orderdate) => dayofyear(o_orderdate)::BIGINT
        current_date() IS NOT NULL => TRUE
        current_timestamp() IS NOT NULL => TRUE
        localtimestamp() IS NOT NULL => TRUE
        now() IS NOT NULL => TRUE
        curdate() = current_date() => TRUE
        current_time() IS NOT NULL => TRUE
        hour(to_time('07:08:09')) => 7
        minute(make_time(1, 2, 3)) => 2
        date(o_orderdate) => o_orderdate::DATE
        extract(YEAROFWEEK FROM o_orderdate) => isoyear(o_orderdate)::BIGINT
    """),
    "date_bigquery": ("bigquery", "orders", """
        o_orderkey
        DATE_ADD(DATE '2024-05-06', INTERVAL 2 DAY) => DATE '2024-05-08'
        DATE_SUB(DATE '2024-05-06', INTERVAL 2 DAY) => DATE '2024-05-04'
        DATETIME_ADD(o_orderdate, INTERVAL 2 HOUR) => o_orderdate + INTERVAL 2 HOUR
        DATETIME_SUB(o_orderdate, INTERVAL 2 HOUR) => o_orderdate - INTERVAL 2 HOUR
        DATETIME_DIFF(o_orderdate, DATETIME '1995-01-01 00:00:00', DAY) => date_diff('day', TIMESTAMP '1995-01-01', o_orderdate)
        DATETIME_TRUNC(o_orderdate, MONTH)::DATE => date_trunc('month', o_orderdate)::DATE
        DATE_TRUNC(DATE '2024-05-06', MONTH) => DATE '2024-05-01'
        DATE_DIFF(DATE '2024-05-06', DATE '2024-01-01', MONTH) => 4::BIGINT
        TIMESTAMP_DIFF(TIMESTAMP '2024-01-02 00:00:00', TIMESTAMP '2024-01-01 00:00:00', HOUR) => 24::BIGINT
        UNIX_SECONDS(TIMESTAMP_ADD(TIMESTAMP '1970-01-01 00:00:00+00', INTERVAL 1 HOUR)) => 3600::BIGINT
        UNIX_SECONDS(TIMESTAMP_SUB(TIMESTAMP '1970-01-02 00:00:00+00', INTERVAL 1 HOUR)) => 82800::BIGINT
        UNIX_SECONDS(TIMESTAMP_TRUNC(TIMESTAMP '1970-01-02 05:00:00+00', DAY)) => 86400::BIGINT
        UNIX_SECONDS(TIMESTAMP_SECONDS(5)) => 5::BIGINT
        UNIX_MILLIS(TIMESTAMP_MILLIS(5)) => 5::BIGINT
        UNIX_MICROS(TIMESTAMP_MICROS(5)) => 5::BIGINT
        UNIX_DATE(DATE '1970-01-03') => 2
        DATE_FROM_UNIX_DATE(2) => DATE '1970-01-03'
        FORMAT_DATE('%Y/%m', DATE '2024-05-06') => '2024/05'
        FORMAT_DATETIME('%Y/%m', o_orderdate) => strftime(o_orderdate, '%Y/%m')
        FORMAT_TIMESTAMP('%Y/%m', TIMESTAMP '2024-05-06 00:00:00') => '2024/05'
        PARSE_DATE('%Y/%m/%d', '2024/05/06') => DATE '2024-05-06'
        PARSE_DATETIME('%Y/%m/%d %H:%M:%S', '2024/05/06 07:08:09') => TIMESTAMP '2024-05-06 07:08:09'
        UNIX_SECONDS(PARSE_TIMESTAMP('%Y/%m/%d', '1970/01/02')) => 86400::BIGINT
        HOUR(PARSE_TIME('%H:%M:%S', '07:08:09')) => 7
        EXTRACT(YEAR FROM o_orderdate) => year(o_orderdate)::BIGINT
        LAST_DAY(DATE '2024-02-03') => DATE '2024-02-29'
        DATE(o_orderdate) => o_orderdate::DATE
        CURRENT_DATETIME() IS NOT NULL => TRUE
        CURRENT_TIMESTAMP() IS NOT NULL => TRUE
        CURRENT_DATE() IS NOT NULL => TRUE
    """),
    "date_snowflake": ("snowflake", "orders", """
        o_orderkey
        DATEADD(DAY, 2, '2024-05-06'::DATE) => DATE '2024-05-08'
        DATEDIFF(MONTH, '2024-01-31'::DATE, '2024-02-01'::DATE) => 1::BIGINT
        TIMEADD(HOUR, 2, o_orderdate) => o_orderdate + INTERVAL 2 HOUR
        TIMESTAMPADD(HOUR, 2, o_orderdate) => o_orderdate + INTERVAL 2 HOUR
        DATE_FROM_PARTS(2024, 5, 6) => DATE '2024-05-06'
        DATEFROMPARTS(2024, 5, 6) => DATE '2024-05-06'
        TIMESTAMP_FROM_PARTS(2024, 5, 6, 7, 8, 9) => TIMESTAMP '2024-05-06 07:08:09'
        TIMESTAMPFROMPARTS(2024, 5, 6, 7, 8, 9) => TIMESTAMP '2024-05-06 07:08:09'
        TIMESTAMP_NTZ_FROM_PARTS(2024, 5, 6, 7, 8, 9) => TIMESTAMP '2024-05-06 07:08:09'
        TIMESTAMPNTZFROMPARTS(2024, 5, 6, 7, 8, 9) => TIMESTAMP '2024-05-06 07:08:09'
        TO_CHAR(TIMESTAMP_LTZ_FROM_PARTS(2024, 5, 6, 7, 8, 9)) => '2024-05-06 07:08:09'
        TO_CHAR(TIMESTAMP_TZ_FROM_PARTS(2024, 5, 6, 7, 8, 9)) => '2024-05-06 07:08:09'
        HOUR(TIME_FROM_PARTS(7, 8, 9)) => 7
        LAST_DAY('2024-02-03'::DATE) => DATE '2024-02-29'
        DAYNAME('2024-05-06'::DATE) => 'Mon'
        MONTHNAME('2024-05-06'::DATE) => 'May'
        DAYOFWEEKISO('2024-05-05'::DATE) => 7
        WEEKISO('2024-05-06'::DATE) => 19
        YEAROFWEEK('2024-12-30'::DATE) => 2025
        YEAROFWEEKISO('2024-12-30'::DATE) => 2025
        TO_DATE('2024-05-06') => DATE '2024-05-06'
        TRY_TO_DATE('x') => NULL::DATE
        TRY_TO_TIMESTAMP('x') IS NULL => TRUE
        MINUTE(TO_TIME('07:08:09')) => 8
        TRY_TO_TIME('x') IS NULL => TRUE
        DATE_TRUNC('MONTH', o_orderdate)::DATE => date_trunc('month', o_orderdate)::DATE
        ADD_MONTHS('2024-01-31'::DATE, 1) => DATE '2024-02-29'
        YEAR(o_orderdate) => year(o_orderdate)::INTEGER
        GETDATE() IS NOT NULL => TRUE
        SYSDATE() IS NOT NULL => TRUE
        CURRENT_TIMESTAMP() IS NOT NULL => TRUE
        CURRENT_VERSION() IS NOT NULL => TRUE
        CURRENT_SCHEMA() IS NOT NULL => TRUE
        ARRAY_SIZE(CURRENT_SCHEMAS()) => 1
    """),
    "date_mixed": ("clickhouse", "orders", """
        o_orderkey
        toYear(o_orderdate) => year(o_orderdate)::INTEGER
        toMonth(o_orderdate) => month(o_orderdate)::INTEGER
        toDayOfMonth(o_orderdate) => day(o_orderdate)::INTEGER
        toYYYYMM(o_orderdate) => (year(o_orderdate) * 100 + month(o_orderdate))::INTEGER
        toMonday(o_orderdate) => date_trunc('week', o_orderdate)::DATE
        toStartOfMonth(o_orderdate) => date_trunc('month', o_orderdate)::DATE
        toStartOfYear(o_orderdate) => date_trunc('year', o_orderdate)::DATE
        CAST(toStartOfDay(o_orderdate) AS Date) => o_orderdate::DATE
        toDate(o_orderdate) => o_orderdate::DATE
        toInt64(o_orderkey) => o_orderkey
        today() = today() => TRUE
        now() IS NOT NULL => TRUE
    """),
    "date_duckdb": ("duckdb", "orders", """
        o_orderkey
        epoch(o_orderdate)::BIGINT
        make_date(2024, 5, 6)
        strftime(o_orderdate, '%d.%m.%Y')
        strptime('06/05/2024', '%d/%m/%Y')
        date_trunc('month', o_orderdate)::DATE
        date_diff('week', DATE '2024-01-01', DATE '2024-02-01')
        date_sub('month', DATE '2024-01-15', DATE '2024-03-14')
        date_part('quarter', o_orderdate)
        last_day(o_orderdate)
        dayname(DATE '2024-05-06')
        monthname(DATE '2024-05-06')
        isodow(o_orderdate)::INTEGER
        dayofyear(o_orderdate)::INTEGER
        weekofyear(o_orderdate)::INTEGER
        century(o_orderdate)::INTEGER
        decade(o_orderdate)::INTEGER
        quarter(o_orderdate)
        epoch_ms(86400000)
        make_timestamp(2024, 5, 6, 7, 8, 9)
        datediff('day', DATE '2024-01-01', o_orderdate::DATE)
        datetrunc('year', o_orderdate)::DATE
        today() = current_date
        to_timestamp(86400)::DATE
    """),
    "date_generic": ("generic", "orders", """
        o_orderkey
        TS_OR_DS_TO_DATE('2024-05-06') => DATE '2024-05-06'
        TS_OR_DS_TO_DATE_STR('2024-05-06 01:00:00') => '2024-05-06'
        TS_OR_DS_ADD('2024-05-06', 2) => DATE '2024-05-08'
        TS_OR_DI_TO_DI('2024-05-06') => 20240506
        DATE_TO_DI(DATE '2024-05-06') => 20240506
        DI_TO_DATE(20240506) => DATE '2024-05-06'
        DATE_STR_TO_DATE('2024-05-06') => DATE '2024-05-06'
        DATE_TO_DATE_STR(DATE '2024-05-06') => '2024-05-06'
        TIME_STR_TO_DATE('2024-05-06') => DATE '2024-05-06'
        TIME_STR_TO_UNIX('1970-01-02 00:00:00') => 86400::BIGINT
        UNIX_SECONDS(TIME_STR_TO_TIME('1970-01-02 00:00:00')) => 86400::BIGINT
        TIME_TO_UNIX(TIMESTAMP '1970-01-02 00:00:00') => 86400::BIGINT
        TIME_TO_TIME_STR(TIMESTAMP '1970-01-02 00:00:00') => '1970-01-02 00:00:00'
        UNIX_SECONDS(UNIX_TO_TIME(5)) => 5::BIGINT
        UNIX_TO_TIME_STR(5) => '1970-01-01 00:00:05'
        UNIX_TO_STR(5, 'yyyy') => '1970'
        STR_TO_UNIX('1970-01-02', 'yyyy-MM-dd') => 86400::BIGINT
        TOMONDAY(DATE '2024-05-09') => DATE '2024-05-06'
        TO_MONDAY(DATE '2024-05-09') => DATE '2024-05-06'
        CAST(TO_START_OF_DAY(TIMESTAMP '2024-05-09 05:00:00') AS DATE) => DATE '2024-05-09'
        DATETYPE(2024, 5, 6) => DATE '2024-05-06'
        EPOCH(TIMESTAMP '1970-01-02 00:00:00') => 86400::BIGINT
        CURRENT_DATE_UTC() IS NOT NULL => TRUE
        CURRENT_LOCALTIMESTAMP() IS NOT NULL => TRUE
        GET_CURRENT_TIME() IS NOT NULL => TRUE
        TODAY() IS NOT NULL => TRUE
        IS_ASCII('abc') => TRUE
        STR_POSITION('abc', 'c') => 3
        FIND('abc', 'c') => 3
        SEARCH('Hello', 'ell') => TRUE
        TEXTLEN('abc') => 3
        REPEATSTR('ab', 2) => 'abab'
        LENGTH(SHA512('a')) => 128
        LENGTH(SHA2_512('a')) => 128
        SHA2_256('a') => sha256('a')
        RANDCANONICAL() < 1 => TRUE
    """),
    "json_spark": ("spark", "events", """
        event_id
        get_json_object(props, '$.k') => props->>'$.k'
        json_array_length('[1,2,3]') => 3
        json_object_keys('{"a": 1, "b": 2}')[1] => 'b'
        to_json(named_struct('a', event_id)) => '{"a":' || event_id || '}'
        from_json(props, 'k INT').k => (props->>'$.k')::INTEGER
        variant_get(parse_json(props), '$.k', 'int') => (props->>'$.k')::INTEGER
        try_parse_json('{') IS NULL => TRUE
        schema_of_json('{"a":1}') => 'STRUCT<a: BIGINT>'
    """),
    "json_duckdb": ("duckdb", "events", """
        event_id
        props->>'$.k'
        json_extract_string(props, '$.k')
        json_extract(props, '$.k')::VARCHAR
        json_array_length('[1,2]')::INTEGER
        json_valid(props)
        json_keys('{"a":1}')[1]
    """),
    "json_snowflake": ("snowflake", "events", """
        event_id
        PARSE_JSON(props):k::INT => (props->>'$.k')::INTEGER
        GET_PATH(PARSE_JSON(props), 'k')::INT => (props->>'$.k')::INTEGER
        CHECK_JSON('{') IS NOT NULL => TRUE
        TRY_PARSE_JSON('{') IS NULL => TRUE
        IS_ARRAY(PARSE_JSON('[1]')) => TRUE
        IS_NULL_VALUE(PARSE_JSON('null')) => TRUE
        STRIP_NULL_VALUE(PARSE_JSON('null')) IS NULL => TRUE
        ARRAY_SIZE(OBJECT_KEYS(PARSE_JSON('{"a":1}'))) => 1
        JSON_EXTRACT_PATH_TEXT(props, 'k') => props->>'$.k'
        TO_VARIANT(event_id)::INT => event_id::INTEGER
    """),
    "json_bigquery": ("bigquery", "events", """
        event_id
        JSON_EXTRACT_SCALAR(props, '$.k') => props->>'$.k'
        JSON_VALUE(props, '$.k') => props->>'$.k'
        JSON_QUERY(props, '$.k') => props->>'$.k'
        JSON_EXTRACT(props, '$.k') => props->>'$.k'
        ARRAY_LENGTH(JSON_EXTRACT_STRING_ARRAY('["a","b"]')) => 2
        ARRAY_LENGTH(JSON_VALUE_ARRAY('["a","b"]')) => 2
        TO_JSON_STRING(STRUCT(1 AS a)) => '{"a":1}'
    """),
    "json_mixed": ("mysql", "events", """
        event_id
        JSON_EXTRACT(props, '$.k') => props->>'$.k'
        JSON_ARRAY(1, 2) => '[1,2]'
        JSON_OBJECT('a', 1) => '{"a":1}'
        JSON_SET('{"a":1}', '$.a', 2) => '{"a":2}'
        JSON_REMOVE('{"a":1,"b":2}', '$.a') => '{"b":2}'
        JSON_ARRAY_APPEND('[1]', '$', 2) => '[1,2]'
        JSON_ARRAY_INSERT('[1]', '$[0]', 2) => '[2,1]'
        JSON_VALID(props) => TRUE
    """),
    "rest_generic": ("generic", "part", """
        p_partkey
        ARRAYJOIN(ARRAY('a', 'b'), ',') => 'a,b'
        ARRAY_SUM(ARRAY(1, p_size)) => (1 + p_size)::DOUBLE
        ARRAY_ANY(ARRAY(1, p_size), x -> x > 40) => p_size > 40
        BIT_NOT(p_size) => ~p_size
        DATETIME_FROM_PARTS(2024, 5, 6, 7, 8, 9) => TIMESTAMP '2024-05-06 07:08:09'
        JSON_EXTRACT_PATH('{"a":{"b":1}}', 'a', 'b') => '1'
        JSON_PARSE('{"a":1}') => '{"a":1}'
        SPLIT_REGEX('a1b', '[0-9]')[1] => 'a'
        STR_TO_TIME('1970-01-02', 'yyyy-MM-dd') IS NOT NULL => TRUE
        TIME_TO_STR(DATE '2024-05-06', 'yyyy') => '2024'
        FORMATDATETIME(DATE '2024-05-06', 'yyyy') => '2024'
        UNIX_SECONDS(FROM_ISO8601_TIMESTAMP('1970-01-02T00:00:00Z')) => 86400::BIGINT
        UNIX_SECONDS(FROM_ISO8601_TIMESTAMP_NANOS('1970-01-02T00:00:00.5Z')) => 86400::BIGINT
        SIZE(JSON_ARRAY_ELEMENTS('["a","b"]')) => 2
        LENGTH(NEWID()) => 36
        SCHEMA_NAME() IS NOT NULL => TRUE
        SUSER_NAME() IS NOT NULL => TRUE
        SUSER_SNAME() IS NOT NULL => TRUE
        SYSTEM_USER() IS NOT NULL => TRUE
    """),
    "rest_aggregates": ("generic", "orders GROUP BY o_orderstatus", """
        o_orderstatus
        SUM_IF(o_orderkey, o_custkey > 10) => (sum(o_orderkey) FILTER (WHERE o_custkey > 10))::BIGINT
        ROUND(SKEW(o_totalprice), 1) => round(skewness(o_totalprice), 1)
    """),
}


def split(line: str) -> tuple[str, str]:
    call, _, duck = line.strip().partition(" => ")
    return call, duck or call


def texts() -> dict[str, tuple[str, str, str]]:
    out = {}
    for name, (dialect, source, lines) in GROUPS.items():
        pairs = [split(line) for line in lines.strip().splitlines()]
        select = lambda side: "SELECT " + ", ".join(f"{p[side]} AS c{i}" for i, p in enumerate(pairs)) + f" FROM {source}"
        out[f"fn_{name}"] = (dialect, select(0), select(1))
    return out
