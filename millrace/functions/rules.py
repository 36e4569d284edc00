"""Function rules: what a foreign function is in Spark SQL.

A rule is a template over the lowered arguments ({0}, {1}, {*} for all, {1:} for the second and further ones) or one
for each number of arguments.  Rules for one dialect come before those for all.  A name without a rule must be a
Spark function of the same name and meaning.
"""

from __future__ import annotations

import re

AGGREGATE = {
    "APPROXIMATE_JACCARD_INDEX": "(size(array_intersect(collect_set({0}), collect_set({1}))) / size(array_union(collect_set({0}), collect_set({1}))))",
    "APPROX_DISTINCT": "approx_count_distinct({0})",
    "APPROX_QUANTILE": "approx_percentile({0}, {1})",
    "ARBITRARY": "any_value({0})",
    "ARG_MAX": "max_by({0}, {1})", "ARGMAX": "max_by({0}, {1})", "ARG_MIN": "min_by({0}, {1})", "ARGMIN": "min_by({0}, {1})",
    "ARRAY_CONCAT_AGG": "flatten(collect_list({0}))", "ARRAY_UNIQUE_AGG": "collect_set({0})", "GROUPARRAY": "collect_list({0})", "GROUPUNIQARRAY": "collect_set({0})",
    "BITAND_AGG": "bit_and({0})", "BITOR_AGG": "bit_or({0})", "BITXOR_AGG": "bit_xor({0})", "BIT_AND_AGG": "bit_and({0})", "BIT_OR_AGG": "bit_or({0})", "BIT_XOR_AGG": "bit_xor({0})",
    "BOOLAND_AGG": "bool_and({0})", "BOOLOR_AGG": "bool_or({0})", "BOOLXOR_AGG": "(count_if({0}) = 1)", "LOGICAL_AND": "bool_and({0})", "LOGICAL_OR": "bool_or({0})",
    "COUNTIF": "count_if({0})", "COUNT_BIG": "count({0})", "SUM_IF": "sum(CASE WHEN {1} THEN {0} END)", "SUMIF": "sum(CASE WHEN {1} THEN {0} END)", "AVGIF": "avg(CASE WHEN {1} THEN {0} END)",
    "LIST": "collect_list({0})", "MEDIAN": "median({0})",
    "QUANTILE": "percentile({0}, {1})", "QUANTILES": "percentile({0}, array({1:}))",
    "QUANTILE_CONT": "percentile_cont({1}) WITHIN GROUP (ORDER BY {0})", "QUANTILE_DISC": "percentile_disc({1}) WITHIN GROUP (ORDER BY {0})",
    "REGR_VALX": "CASE WHEN {0} IS NULL THEN NULL ELSE {1} END", "REGR_VALY": "CASE WHEN {1} IS NULL THEN NULL ELSE {0} END",
    "SKEW": "skewness({0})", "UNIQ": {1: "approx_count_distinct({0})", None: "approx_count_distinct(struct({*}))"}, "UNIQEXACT": "count(DISTINCT {*})", "VAR": "var_samp({0})", "VARP": "var_pop({0})", "STDEV": "stddev_samp({0})", "STDEVP": "stddev_pop({0})",
    "JSON_ARRAYAGG": "to_json(collect_list({0}))", "JSON_OBJECTAGG": "to_json(map_from_entries(collect_list(struct({0}, {1}))))", "JSON_GROUP_ARRAY": "to_json(collect_list({0}))", "JSON_AGG": "to_json(collect_list({0}))",
    "HISTOGRAM_EXACT": "map_from_entries(collect_list(struct({0}, 1)))", "PRODUCT": "aggregate(collect_list({0}), double(1), (a, x) -> a * x)", "GEOMEAN": "exp(avg(ln({0})))", "GEOMETRIC_MEAN": "exp(avg(ln({0})))",
}

ARRAYS = {
    "ARRAYJOIN": "array_join({*})", "ARRAYMAX": "array_max({0})", "ARRAYMIN": "array_min({0})", "ARRAYREVERSE": "reverse({0})", "ARRAYSLICE": "slice({*})", "ARRAY_ANY": "exists({*})",
    "ARRAY_CAT": "concat({*})", "ARRAY_CONCAT": "concat({*})", "LIST_CONCAT": "concat({*})", "LIST_CAT": "concat({*})", "ARRAY_CONSTRUCT": "array({*})", "LIST_VALUE": "array({*})", "LIST_PACK": "array({*})",
    "ARRAY_CONSTRUCT_COMPACT": "array_compact(array({*}))", "ARRAY_FILTER": "filter({*})", "LIST_FILTER": "filter({*})", "ARRAY_FLATTEN": "flatten({0})",
    "ARRAY_GENERATE_RANGE": {2: "if({1} <= {0}, array(), sequence({0}, {1} - 1))", 3: "sequence({0}, {1} - 1, {2})"},
    "ARRAY_INTERSECTION": "array_intersect({*})", "LIST_INTERSECT": "array_intersect({*})", "ARRAY_LENGTH": "size({0})", "CARDINALITY": "size({0})", "ARRAY_SIZE": "size({0})", "LIST_LENGTH": "size({0})",
    "ARRAY_REMOVE_AT": "filter({0}, (v, i) -> i <> {1})", "ARRAY_REVERSE": "reverse({0})", "LIST_REVERSE": "reverse({0})", "ARRAY_REVERSE_SORT": "sort_array({0}, false)", "LIST_REVERSE_SORT": "sort_array({0}, false)",
    "ARRAY_SUM": "aggregate({0}, cast(0 as double), (s, v) -> s + v)", "LIST_SUM": "aggregate({0}, cast(0 as double), (s, v) -> s + v)", "LIST_AVG": "(aggregate({0}, cast(0 as double), (s, v) -> s + v) / size({0}))",
    "ARRAY_TO_STRING": "array_join({*})", "LIST_APPEND": "array_append({*})", "ARRAY_PUSH_BACK": "array_append({*})", "LIST_PREPEND": "array_prepend({1}, {0})", "LIST_CONTAINS": "array_contains({*})", "LIST_HAS": "array_contains({*})", "ARRAY_HAS": "array_contains({*})", "HAS": "array_contains({*})",
    "LIST_DISTINCT": "array_distinct({0})", "LIST_UNIQUE": "size(array_distinct({0}))", "LIST_HAS_ANY": "arrays_overlap({*})", "ARRAY_HAS_ANY": "arrays_overlap({*})", "HASANY": "arrays_overlap({*})", "ARRAYS_OVERLAP": "arrays_overlap({*})",
    "LIST_HAS_ALL": "(size(array_except({1}, {0})) = 0)", "ARRAY_HAS_ALL": "(size(array_except({1}, {0})) = 0)", "HASALL": "(size(array_except({1}, {0})) = 0)",
    "LIST_MAX": "array_max({0})", "LIST_MIN": "array_min({0})", "LIST_POSITION": "nullif(array_position({0}, {1}), 0)", "LIST_INDEXOF": "nullif(array_position({0}, {1}), 0)", "LIST_SORT": "array_sort({0})", "LIST_TRANSFORM": "transform({*})", "LIST_APPLY": "transform({*})", "ARRAY_TRANSFORM": "transform({*})", "ARRAYMAP": "transform({1}, {0})", "ARRAYFILTER": "filter({1}, {0})",
    "LIST_REDUCE": {2: "reduce(slice({0}, 2, size({0})), {0}[0], {1})", 3: "reduce({0}, {2}, {1})"}, "LIST_SLICE": "slice({0}, {1}, {2} - {1} + 1)", "LIST_ZIP": "arrays_zip({*})", "LIST_EXTRACT": "try_element_at({0}, {1})", "LIST_ELEMENT": "try_element_at({0}, {1})", "ELEMENT_AT": "try_element_at({0}, {1})", "LIST_RESIZE": "slice(concat({0}, array_repeat(null, {1})), 1, {1})",
    "GENERATE_ARRAY": "sequence({*})", "GENERATE_DATE_ARRAY": {2: "sequence(CAST({0} AS DATE), CAST({1} AS DATE), INTERVAL 1 DAY)", 3: "sequence(CAST({0} AS DATE), CAST({1} AS DATE), {2})"}, "GENERATE_TIMESTAMP_ARRAY": "sequence(CAST({0} AS TIMESTAMP), CAST({1} AS TIMESTAMP), {2})", "GENERATE_SERIES": "sequence({*})",
    "MAP_DELETE": "map_filter({0}, (k, v) -> NOT k IN ({1:}))", "MAP_INSERT": "map_concat({0}, map({1}, {2}))", "MAP_SIZE": "size({0})", "MAP_EXTRACT": "array({0}[{1}])", "MAP_KEYS": "map_keys({0})",
    "STRING_TO_ARRAY": "split({0}, concat('\\\\Q', {1}, '\\\\E'))", "STRTOK_TO_ARRAY": "split({0}, concat('[', {1}, ']'))", "STRUCT_EXTRACT": "{0}[{1}]", "TO_ARRAY": "array({0})",
    "RANGE": {1: "if({0} <= 0, array(), sequence(0, {0} - 1))", 2: "if({1} <= {0}, array(), sequence({0}, {1} - 1))", 3: "sequence({0}, {1} - sign({2}), {2})"}, "LEN_ARRAY": "size({0})",
    "OBJECT_KEYS": "json_object_keys(CAST({0} AS STRING))", "ARRAY_POSITION_ZERO": "array_position({0}, {1}) - 1",
}

CONDITION = {
    "IFF": "if({*})", "IIF": "if({*})", "TO_BOOLEAN": "CAST({0} AS BOOLEAN)", "TO_DOUBLE": "CAST({0} AS DOUBLE)", "TO_DECIMAL": {1: "CAST({0} AS DECIMAL(38,0))", 2: "to_number({*})", 3: "CAST({0} AS DECIMAL({1},{2}))"},
    "TO_NUMERIC": {1: "CAST({0} AS DECIMAL(38,0))", 2: "to_number({*})", 3: "CAST({0} AS DECIMAL({1},{2}))"}, "TRY_TO_BOOLEAN": "try_cast({0} AS BOOLEAN)", "TRY_TO_DOUBLE": "try_cast({0} AS DOUBLE)",
    "TO_NUMBER": {1: "CAST({0} AS DECIMAL(38,0))", 2: "to_number({*})", 3: "CAST({0} AS DECIMAL({1},{2}))"}, "TRY_TO_DECIMAL": {1: "try_cast({0} AS DECIMAL(38,0))", 3: "try_cast({0} AS DECIMAL({1},{2}))"}, "TRY_TO_NUMERIC": {1: "try_cast({0} AS DECIMAL(38,0))", 3: "try_cast({0} AS DECIMAL({1},{2}))"},
    "TRY_TO_NUMBER": {1: "try_cast({0} AS DECIMAL(38,0))", 2: "try_to_number({*})", 3: "try_cast({0} AS DECIMAL({1},{2}))"}, "EQUAL_NULL": "({0} <=> {1})", "CHOOSE": "elt({*})", "NULLIFZERO": "nullif({0}, 0)", "ZEROIFNULL": "coalesce({0}, 0)",
    "TOSTRING": "CAST({0} AS STRING)", "TOINT32": "CAST({0} AS INT)", "TOINT64": "CAST({0} AS BIGINT)", "TOFLOAT64": "CAST({0} AS DOUBLE)", "TODATE": "CAST({0} AS DATE)",
}

DATES = {
    "ADDDATE": "date_add({0}, {1})", "SUBDATE": "date_sub({0}, {1})", "CURRENT_DATETIME": "localtimestamp()", "CURRENT_LOCALTIMESTAMP": "localtimestamp()", "CURRENT_DATE_UTC": "to_date(to_utc_timestamp(current_timestamp(), current_timezone()))",
    "CURTIME": "current_time()", "GET_CURRENT_TIME": "current_time()", "GETDATE": "current_timestamp()", "SYSDATE": "current_timestamp()", "SYSDATETIME": "current_timestamp()", "SYSTIMESTAMP": "current_timestamp()", "GETUTCDATE": "current_timestamp()", "TODAY": "current_date()",
    "DATEFROMPARTS": "make_date({*})", "DATE_FROM_PARTS": "make_date({*})", "DATETYPE": "make_date({*})", "DATETIMEFROMPARTS": {6: "make_timestamp_ntz({*})", 7: "make_timestamp_ntz({0}, {1}, {2}, {3}, {4}, {5} + CAST({6} AS DECIMAL(10,3)) / 1000)"}, "DATETIME_FROM_PARTS": "make_timestamp_ntz({*})",
    "TIMESTAMPFROMPARTS": "make_timestamp_ntz({*})", "TIMESTAMPNTZFROMPARTS": "make_timestamp_ntz({*})", "TIMESTAMP_FROM_PARTS": "make_timestamp_ntz({*})", "TIMESTAMP_NTZ_FROM_PARTS": "make_timestamp_ntz({*})", "TIMESTAMP_LTZ_FROM_PARTS": "make_timestamp_ltz({*})", "TIMESTAMP_TZ_FROM_PARTS": "make_timestamp({*})",
    "MAKETIME": "make_time({*})", "TIME_FROM_PARTS": "make_time({*})", "DATE_STR_TO_DATE": "CAST({0} AS DATE)", "DATE_TO_DATE_STR": "CAST({0} AS STRING)", "DATE_TO_DI": "CAST(date_format({0}, 'yyyyMMdd') AS INT)", "DI_TO_DATE": "to_date(CAST({0} AS STRING), 'yyyyMMdd')",
    "DAYOFWEEKISO": "extract(DAYOFWEEK_ISO FROM {0})", "ISODOW": "extract(DAYOFWEEK_ISO FROM {0})", "DOW": "(dayofweek({0}) - 1)", "EOMONTH": {1: "last_day({0})", 2: "last_day(add_months({0}, {1}))"}, "EPOCH": "unix_timestamp(CAST({0} AS TIMESTAMP))", "EPOCH_MS": "unix_millis(CAST({0} AS TIMESTAMP))", "EPOCH_US": "unix_micros(CAST({0} AS TIMESTAMP))",
    "FROM_ISO8601_DATE": "CAST({0} AS DATE)", "FROM_ISO8601_TIMESTAMP": "CAST({0} AS TIMESTAMP)", "FROM_ISO8601_TIMESTAMP_NANOS": "CAST({0} AS TIMESTAMP)", "TIMESTAMPADD": "timestampadd({*})",
    "TIME_STR_TO_DATE": "to_date({0})", "TIME_STR_TO_TIME": "CAST({0} AS TIMESTAMP)", "TIME_STR_TO_UNIX": "unix_timestamp({0})", "TIME_TO_TIME_STR": "CAST({0} AS STRING)", "TIME_TO_UNIX": "unix_timestamp({0})", "TO_UNIXTIME": "unix_timestamp(CAST({0} AS TIMESTAMP))", "UNIX_TO_TIME": "timestamp_seconds({0})", "UNIX_TO_TIME_STR": "from_unixtime({0})", "TO_TIMESTAMP_SECONDS": "timestamp_seconds({0})",
    "TOMONDAY": "to_date(date_trunc('WEEK', {0}))", "TO_MONDAY": "to_date(date_trunc('WEEK', {0}))", "TOSTARTOFDAY": "date_trunc('DAY', {0})", "TO_START_OF_DAY": "date_trunc('DAY', {0})", "TOSTARTOFMONTH": "to_date(date_trunc('MONTH', {0}))", "TOSTARTOFYEAR": "to_date(date_trunc('YEAR', {0}))", "TOSTARTOFHOUR": "date_trunc('HOUR', {0})", "TOYEAR": "year({0})", "TOMONTH": "month({0})", "TODAYOFMONTH": "day({0})", "TOYYYYMM": "(year({0}) * 100 + month({0}))",
    "TS_OR_DI_TO_DI": "CAST(substr(replace(CAST({0} AS STRING), '-', ''), 1, 8) AS INT)", "TS_OR_DS_ADD": "date_add(to_date({0}), {1})", "TS_OR_DS_TO_DATE": "to_date({0})", "TS_OR_DS_TO_DATE_STR": "CAST(to_date({0}) AS STRING)", "WEEKISO": "weekofyear({0})", "YEAROFWEEK": "extract(YEAROFWEEK FROM {0})", "YEAROFWEEKISO": "extract(YEAROFWEEK FROM {0})", "DECADE": "floor(year({0}) / 10)", "CENTURY": "ceil(year({0}) / 100)",
    "TIME_SLICE": "timestamp_seconds(floor(unix_timestamp({0}) / ({1} * 60)) * {1} * 60)", "TIMEDIFF": "concat(if({0} < {1}, '-', ''), lpad(abs(timestampdiff(SECOND, {1}, {0})) DIV 3600, 2, '0'), ':', lpad(abs(timestampdiff(SECOND, {1}, {0})) DIV 60 % 60, 2, '0'), ':', lpad(abs(timestampdiff(SECOND, {1}, {0})) % 60, 2, '0'))", "STR_TO_UNIX": "unix_timestamp({*})", "UNIX_TO_STR": "from_unixtime({*})", "NANVL": "nanvl({*})",
}

HASHES = {
    "BASE64_DECODE_BINARY": "unbase64({0})", "BASE64_DECODE_STRING": "CAST(unbase64({0}) AS STRING)", "BASE64_ENCODE": "base64({0})", "FROM_BASE64": "unbase64({0})", "TO_BASE64": "base64({0})", "FROM_HEX": "unhex({0})", "FROM_UTF8": "decode({0}, 'UTF-8')", "TO_UTF8": "encode({0}, 'UTF-8')",
    "GENERATE_UUID": "uuid()", "GEN_RANDOM_UUID": "uuid()", "NEWID": "uuid()", "HEX_DECODE_BINARY": "unhex({0})", "HEX_DECODE_STRING": "CAST(unhex({0}) AS STRING)", "HEX_ENCODE": "hex({0})", "MD5_HEX": "md5({0})", "SHA256": "sha2({0}, 256)", "SHA2_256": "sha2({0}, 256)", "SHA2_512": "sha2({0}, 512)", "SHA512": "sha2({0}, 512)", "SHA1_HEX": "sha1({0})", "SHA2_HEX": "sha2({*})", "TO_HEX": "lower(hex({0}))",
}

JSON = {
    "CHECK_JSON": "(try_parse_json({0}) IS NULL)", "IS_ARRAY": "(schema_of_variant({0}) LIKE 'ARRAY%')", "IS_NULL_VALUE": "is_variant_null({0})", "JSON": "{0}", "JSONB": "{0}", "JSON_ARRAY": "to_json(array({*}))", "JSON_ARRAY_ELEMENTS": "from_json({0}, 'array<string>')", "JSON_ARRAY_LENGTH": "json_array_length({0})",
    "JSON_EXTRACT_STRING_ARRAY": "from_json({0}, 'array<string>')", "JSON_VALUE_ARRAY": "from_json({0}, 'array<string>')", "JSON_KEYS": "json_object_keys({0})", "JSON_OBJECT": "to_json(named_struct({*}))", "JSON_PARSE": "{0}", "JSON_STRIP_NULLS": "to_json(from_json({0}, 'map<string,string>'), map('ignoreNullFields', 'true'))", "OBJECT_CONSTRUCT": "map_filter(map({*}), (k, v) -> v IS NOT NULL)", "OBJECT_CONSTRUCT_KEEP_NULL": "map({*})", "OBJECT_INSERT": "map_concat({0}, map({1}, {2}))", "STRIP_NULL_VALUE": "(CASE WHEN is_variant_null({0}) THEN NULL ELSE {0} END)", "TO_JSON_STRING": "to_json({0})", "TO_JSONB": "to_json({0})", "ROW_TO_JSON": "to_json({0})", "TO_VARIANT": "CAST({0} AS VARIANT)", "JSON_VALID": "(try_parse_json({0}) IS NOT NULL)", "JSON_TYPE": "schema_of_json({0})",
}

MATHS = {
    "BITAND": "({0} & {1})", "BITOR": "({0} | {1})", "BITXOR": "({0} ^ {1})", "BITWISE_XOR": "({0} ^ {1})", "BITWISE_AND": "({0} & {1})", "BITWISE_OR": "({0} | {1})", "BITNOT": "(~{0})", "BIT_NOT": "(~{0})", "BITSHIFTLEFT": "shiftleft({*})", "BITSHIFTRIGHT": "shiftright({*})", "BOOLAND": "({0} AND {1})", "BOOLNOT": "(NOT {0})", "BOOLOR": "({0} OR {1})", "BOOLXOR": "({0} <> {1})", "XOR": "({0} <> {1})",
    "DIV0": "CASE WHEN {1} = 0 THEN 0 ELSE {0} / {1} END", "DIV0NULL": "CASE WHEN coalesce({1}, 0) = 0 THEN 0 ELSE {0} / {1} END", "DIV": "({0} DIV {1})", "FDIV": "floor({0} / {1})", "GREATEST_IGNORE_NULLS": "greatest({*})", "LEAST_IGNORE_NULLS": "least({*})", "ISINF": "({0} IN (double('Infinity'), double('-Infinity')))", "IS_INF": "({0} IN (double('Infinity'), double('-Infinity')))", "IS_NAN": "isnan({0})", "ISFINITE": "(NOT isnan({0}) AND NOT {0} IN (double('Infinity'), double('-Infinity')))",
    "LOG2": "log2({0})", "LOG10": "log10({0})", "POW": "power({*})", "RANDCANONICAL": "rand()", "SAFE_ADD": "try_add({*})", "SAFE_DIVIDE": "try_divide({*})", "SAFE_MULTIPLY": "try_multiply({*})", "SAFE_SUBTRACT": "try_subtract({*})", "SQUARE": "power({0}, 2)", "XOR_BITS": "({0} ^ {1})", "TRUNCATE": {1: "CAST({0} AS BIGINT)", 2: "(sign({0}) * floor(abs({0}) * power(10, {1})) / power(10, {1}))"}, "EVEN": "(sign({0}) * ceil(abs({0}) / 2) * 2)", "GCD_SAFE": "{0}", "CBRT": "cbrt({0})", "PI": "pi()",
}

STRINGS = {
    "CHARINDEX": "locate({*})", "CONTAINS_SUBSTR": "contains(lower({0}), lower({1}))", "EDITDIST3": "levenshtein({*})", "EDITDISTANCE": "levenshtein({*})", "EDIT_DISTANCE": "levenshtein({*})", "LEVENSHTEIN_DISTANCE": "levenshtein({*})", "ENDS_WITH": "endswith({*})", "SUFFIX": "endswith({*})", "STARTS_WITH": "startswith({*})", "PREFIX": "startswith({*})", "FIND": "locate({1}, {0})", "FORMAT": "format_string({*})", "PRINTF": "format_string({*})", "IS_ASCII": "regexp_like({0}, '^[\\\\x00-\\\\x7F]*$')",
    "REPEATSTR": "repeat({*})", "REPLICATE": "repeat({*})", "SEARCH": "contains(lower({0}), lower({1}))", "SPLITBYREGEXP": "split({1}, {0})", "SPLITBYSTRING": "split({1}, concat('\\\\Q', {0}, '\\\\E'))", "SPLITBYCHAR": "split({1}, concat('\\\\Q', {0}, '\\\\E'))", "SPLIT_REGEX": "split({*})", "STRING_SPLIT_REGEX": "split({*})", "STR_SPLIT_REGEX": "split({*})", "REGEXP_SPLIT_TO_ARRAY": "split({*})", "STRING_SPLIT": "split({0}, concat('\\\\Q', {1}, '\\\\E'))", "STR_SPLIT": "split({0}, concat('\\\\Q', {1}, '\\\\E'))", "STRPOS": "instr({0}, {1})", "STR_POSITION": "locate({1}, {0})", "STRTOK": {1: "split_part({0}, ' ', 1)", 2: "split_part({0}, {1}, 1)", 3: "split_part({*})"}, "SUBSTRINGINDEX": "substring_index({*})", "TEXTLEN": "length({0})", "STRLEN": "octet_length({0})", "UNICODE": "ascii({0})", "ORD": "ascii({0})", "LCASE": "lower({0})", "UCASE": "upper({0})", "MID": "substr({*})", "STUFF": "overlay({0} PLACING {3} FROM {1} FOR {2})", "REGEXP_CONTAINS": "regexp_like({*})", "REGEXP_MATCHES": "regexp_like({0}, {1})", "REGEXP_FULL_MATCH": "regexp_like({0}, concat('^(?:', {1}, ')$'))", "REGEXP_SUBSTR_ALL": "regexp_extract_all({0}, {1}, 0)", "POSITION": "locate({0}, {1})", "POSITIONUTF8": "locate({1}, {0})", "REGEXP_INSTR": "regexp_instr({*})", "TRANSLATE_ALL": "translate({*})", "BAR": "repeat('#', {0})", "LOWERUTF8": "lower({0})", "UPPERUTF8": "upper({0})", "LENGTHUTF8": "length({0})", "CHAR_LENGTH": "char_length({0})", "STRIP_ACCENTS_ASCII": "{0}", "REVERSE": "reverse({0})", "NSTRING": "{0}",
}

SESSION = {"CURRENT_SCHEMAS": "array(current_schema())", "CURRENT_VERSION": "version()", "SCHEMA": "current_schema()", "SCHEMA_NAME": "current_schema()", "SUSER_NAME": "current_user()", "SUSER_SNAME": "current_user()", "SYSTEM_USER": "current_user()", "USER_NAME": "current_user()", "DB_NAME": "current_database()"}

RULES = AGGREGATE | ARRAYS | CONDITION | DATES | HASHES | JSON | MATHS | STRINGS | SESSION

BY_DIALECT = {
    "snowflake": {"JAROWINKLER_SIMILARITY": "CAST(jarowinkler_similarity({0}, {1}) * 100 AS INT)", "ARRAY_CONTAINS": "array_contains({1}, {0})", "MAP_CONTAINS_KEY": "map_contains_key({1}, {0})", "ARRAY_POSITION": "nullif(array_position({1}, {0}), 0) - 1", "ARRAY_INSERT": "array_insert({0}, {1} + 1, {2})", "ARRAY_SLICE": "slice({0}, {1} + 1, {2} - {1})", "GET": "{0}[{1}]", "DECODE": "decode({*})", "STARTSWITH": "startswith({*})", "ARRAY_SIZE": "size({0})", "CHARINDEX": "locate({*})", "BOOLXOR": "({0} <> {1})", "TO_CHAR": "CAST({0} AS STRING)", "SPLIT": "split({0}, concat('\\\\Q', {1}, '\\\\E'))"},
    "duckdb": {"ENCODE": "encode({0}, 'UTF-8')", "DECODE": "decode({0}, 'UTF-8')", "DAYNAME": "date_format({0}, 'EEEE')", "MONTHNAME": "date_format({0}, 'MMMM')", "MAKE_TIMESTAMP": "make_timestamp_ntz({*})", "ARRAY_PREPEND": "array_prepend({1}, {0})", "XOR": "({0} ^ {1})", "ARRAY_SLICE": "slice({0}, {1}, {2} - {1} + 1)", "CONTAINS": "contains({*})", "SPLIT": "split({0}, concat('\\\\Q', {1}, '\\\\E'))", "EPOCH_MS": "timestampadd(MILLISECOND, {0}, TIMESTAMP_NTZ '1970-01-01')", "TO_TIMESTAMP": "timestamp_seconds({0})", "FIRST": "first({0})", "ARRAY_POSITION": "nullif(array_position({0}, {1}), 0)", "SORT": "array_sort({0})", "MD5": "md5({0})", "TRUNC": "CAST({0} AS BIGINT)", "HASH": "xxhash64({*})"},
    "tsql": {"LEN": "length(rtrim({0}))", "ISNULL": "coalesce({*})", "CHARINDEX": "locate({*})", "STRING_SPLIT": "split({0}, concat('\\\\Q', {1}, '\\\\E'))", "SQUARE": "power({0}, 2)", "CEILING": "ceil({0})"},
    "mysql": {"DAYNAME": "date_format({0}, 'EEEE')", "MONTHNAME": "date_format({0}, 'MMMM')", "IF": "if({*})", "IFNULL": "coalesce({*})", "LOCATE": "locate({*})", "INSTR": "instr({*})", "LENGTH": "octet_length({0})", "DATE": "to_date({0})", "TRUNCATE": RULES["TRUNCATE"], "ISNULL": "isnull({0})", "FIND_IN_SET": "find_in_set({*})", "DATEDIFF": "datediff({*})", "UNIX_TIMESTAMP": {0: "unix_timestamp()", 1: "unix_timestamp(CAST({0} AS TIMESTAMP))"}},
    "bigquery": {"SPLIT": {1: "split({0}, ',')", 2: "split({0}, concat('\\\\Q', {1}, '\\\\E'))"}, "TO_HEX": "lower(hex({0}))", "STRPOS": "instr({*})", "SAFE_OFFSET": "{0}", "OFFSET": "{0}", "SHA256": "unhex(sha2({0}, 256))", "DATE": "to_date({*})", "LOGICAL_AND": "bool_and({0})", "STRING": "CAST({0} AS STRING)", "TRUNC": RULES["TRUNCATE"]},
    "oracle": {"NVL": "coalesce({*})", "LENGTH": "nullif(length({0}), 0)", "TRUNC": {1: "to_date({0})", 2: "trunc({*})"}, "SUBSTR": "substr({*})", "INSTR": {2: "locate({1}, {0})", 3: "locate({1}, {0}, {2})", 4: "CASE WHEN (length(substr({0}, {2})) - length(replace(substr({0}, {2}), {1}, ''))) / length({1}) >= {3} THEN length(substring_index(substr({0}, {2}), {1}, {3})) + {2} ELSE 0 END"}},
    "clickhouse": {"LENGTH": "octet_length({0})", "IF": "if({*})", "REPLACEALL": "replace({*})", "TOSTRING": "CAST({0} AS STRING)", "EMPTY": "(length({0}) = 0)", "NOTEMPTY": "(length({0}) > 0)", "ANY": "first({0}, true)", "ANYLAST": "last({0}, true)", "NOW": "current_timestamp()", "RANGE": RULES["RANGE"], "QUANTILE": "percentile({0}, {1})", "LOCATE": "locate({1}, {0})"},
    "trino": {"STRPOS": "instr({*})", "SPLIT": "split({0}, concat('\\\\Q', {1}, '\\\\E'))", "CONTAINS": "array_contains({*})", "JSON_EXTRACT_SCALAR": "get_json_object({*})", "TO_HEX": "hex({0})", "CARDINALITY": "size({0})", "ARRAY_AGG": "collect_list({0})", "APPROX_PERCENTILE": "approx_percentile({*})", "TRUNCATE": RULES["TRUNCATE"], "REDUCE": "reduce({0}, {1}, {2}, {3})"},
    "sqlite": {"IFNULL": "coalesce({*})", "INSTR": "instr({*})", "TOTAL": "coalesce(sum({0}), 0D)", "GROUP_CONCAT": "listagg({*})", "DATE": "to_date({0})"},
    "postgresql": {"STRPOS": "instr({*})", "TRUNC": RULES["TRUNCATE"], "TO_HEX": "lower(hex({0}))", "ARRAY_POSITION": "nullif(array_position({0}, {1}), 0)", "AGE": "({0} - {1})", "BTRIM": "trim({0})", "LENGTH": "length({0})"},
}
for _copy, _of in (("presto", "trino"), ("athena", "trino"), ("dune", "trino"), ("redshift", "postgresql"), ("materialize", "postgresql"), ("risingwave", "postgresql"), ("cockroachdb", "postgresql"), ("fabric", "tsql"), ("doris", "mysql"), ("starrocks", "mysql"), ("singlestore", "mysql"), ("tidb", "mysql")):
    BY_DIALECT[_copy] = BY_DIALECT[_of]


_FIELD = re.compile(r"\{(\*|\d+:|\d+)\}")


def apply(template, args: list[str]) -> str | None:
    """The text of a rule, or None if it has no form that uses exactly so many arguments.

    A rule for each number of arguments may have one under None for all other numbers.
    """
    if isinstance(template, dict):
        template = template.get(len(args), template.get(None))
        if template is None:
            return None
    used: set[int] = set()

    def filled(field: re.Match) -> str:
        key = field[1]
        at = range(len(args)) if key == "*" else range(int(key[:-1]), len(args)) if key.endswith(":") else [int(key)]
        used.update(at)
        return ", ".join(args[i] for i in at if i < len(args))

    out = _FIELD.sub(filled, template)
    return out if used == set(range(len(args))) else None


def rule_for(name: str, dialect_name: str):
    return BY_DIALECT.get(dialect_name, {}).get(name) or (None if dialect_name in ("spark", "databricks", "hive") else RULES.get(name))
