"""The few functions that have no Spark expression: Arrow-batched UDFs and table functions, registered on demand."""

from __future__ import annotations

import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf

_STEP = re.compile(r"\.([A-Za-z_]\w*)|\[(\d+)\]|\.\"([^\"]+)\"")


def steps(path: str) -> list[str | int]:
    """$.a[0].b as its steps."""
    return [int(i) if i else name or quoted for name, i, quoted in _STEP.findall(path)]


def _edit(text: str | None, path: str | None, how: str, value: Any = None) -> str | None:
    if text is None or path is None:
        return None
    try:
        root = json.loads(text)
    except ValueError:
        return None
    *way, last = steps(path) or [None]
    at = root
    for s in way:
        try:
            at = at[s]
        except (KeyError, IndexError, TypeError):
            return json.dumps(root, separators=(",", ":"))
    if how == "append":
        target = at if last is None else at.get(last) if isinstance(at, dict) else at[last] if isinstance(at, list) and isinstance(last, int) and last < len(at) else None
        if isinstance(target, list):
            target.append(value)
    elif how == "insert" and isinstance(at, list) and isinstance(last, int):
        at.insert(last, value)
    elif how == "set" and (isinstance(at, dict) and isinstance(last, str) or isinstance(at, list) and isinstance(last, int) and last < len(at)):
        at[last] = value
    elif how == "remove":
        if isinstance(at, dict):
            at.pop(last, None)
        elif isinstance(at, list) and isinstance(last, int) and last < len(at):
            at.pop(last)
    return json.dumps(root, separators=(",", ":"))


def jaro_winkler(a: str, b: str) -> float:
    """Similarity from 0 to 1."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free, hits = [True] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == c:
                free[j] = False
                hits.append((i, j))
                break
    if not hits:
        return 0.0
    other = sorted(j for _, j in hits)
    swaps = sum(a[i] != b[j] for (i, _), j in zip(hits, other, strict=True)) / 2
    m = len(hits)
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro)


def json_set(text: pd.Series, path: pd.Series, value: pd.Series) -> pd.Series:
    return pd.Series([_edit(t, p, "set", v) for t, p, v in zip(text, path, value.astype(object), strict=True)])


def json_remove(text: pd.Series, path: pd.Series) -> pd.Series:
    return pd.Series([_edit(t, p, "remove") for t, p in zip(text, path, strict=True)])


def json_array_append(text: pd.Series, path: pd.Series, value: pd.Series) -> pd.Series:
    return pd.Series([_edit(t, p, "append", v) for t, p, v in zip(text, path, value.astype(object), strict=True)])


def json_array_insert(text: pd.Series, path: pd.Series, value: pd.Series) -> pd.Series:
    return pd.Series([_edit(t, p, "insert", v) for t, p, v in zip(text, path, value.astype(object), strict=True)])


def jarowinkler_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


class SqlTokens:
    """SELECT * FROM sql_tokens(text, dialect)"""

    def eval(self, sql: str, dialect: str):
        from millrace.front.lexer import tokenize

        for t in tokenize(sql or "", dialect, strict=False)[:-1]:
            yield t.kind, t.text, t.start, t.end


class SqlLineage:
    """SELECT * FROM sql_lineage(text, dialect)"""

    def eval(self, sql: str, dialect: str):
        from millrace.plans.analysis import lineage, output_columns

        for _, name, form in output_columns(sql, dialect):
            if form != "wildcard":
                for x in lineage(sql, name, dialect).leaves():
                    if x.source_kind == "table":
                        yield name, x.source, x.name


FUNCTIONS = {json_set: "string", json_remove: "string", json_array_append: "string", json_array_insert: "string", jarowinkler_similarity: "double"}
TABLE_FUNCTIONS = {
    "sql_tokens": (SqlTokens, "kind: string, token: string, start: int, end: int"),
    "sql_lineage": (SqlLineage, "out_col: string, src_table: string, src_col: string"),
}


def register_top_k(spark: SparkSession) -> None:
    """Spark's own aggregate of the first rows, which it doesn't name in SQL."""
    catalyst = spark._jvm.org.apache.spark.sql.catalyst
    name = catalyst.FunctionIdentifier("collect_top_k")
    own = getattr(getattr(catalyst.analysis, "FunctionRegistry$"), "MODULE$").internal()
    spark._jsparkSession.sessionState().functionRegistry().createOrReplaceTempFunction("collect_top_k", own.lookupFunctionBuilder(name).get(), "built-in")


def register(spark: SparkSession) -> None:
    register_top_k(spark)
    for f, kind in FUNCTIONS.items():
        spark.udf.register(f.__name__, pandas_udf(f, kind))
    for name, (cls, kind) in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, udtf(cls, returnType=kind))
