"""The front end over whole tables of SQL text: maps over Arrow batches, so a corpus of any size is one narrow stage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def _safe(f: Callable) -> Callable:
    def run(sql: str | None):
        try:
            return (None if sql is None else f(sql)), None
        except Exception as e:  # a row's own error is its result
            return None, f"{type(e).__name__}: {e}"[:500]

    return run


def _map(df: DataFrame, column: str, name: str, kind: pa.DataType, spark_type: str, f: Callable) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        safe = _safe(f)
        for b in batches:
            got = [safe(x) for x in b.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([g[0] for g in got], kind), pa.array([g[1] for g in got], pa.string())], names=[*b.schema.names, name, f"{name}_error"])

    kept = df.drop(name, f"{name}_error")
    return kept.mapInArrow(run, ", ".join([*(f"`{c.name}` {c.dataType.simpleString()}" for c in kept.schema), f"`{name}` {spark_type}", f"`{name}_error` string"]))


def transpile_column(df: DataFrame, column: str, source: str, target: str = "spark", name: str = "transpiled") -> DataFrame:
    from ..front.writer import transpile

    return _map(df, column, name, pa.string(), "string", lambda x: ";\n".join(transpile(x, source, target)))


def format_column(df: DataFrame, column: str, source: str, name: str = "formatted") -> DataFrame:
    from ..front.writer import format_sql

    return _map(df, column, name, pa.string(), "string", lambda x: format_sql(x, source))


def token_rows(df: DataFrame, column: str, source: str) -> DataFrame:
    """One row a token: kind, token, start, end."""
    from ..front.lexer import tokenize

    kind = pa.list_(pa.struct([("kind", pa.string()), ("token", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    made = _map(df, column, "_tokens", kind, "array<struct<kind: string, token: string, start: int, end: int>>", lambda x: [{"kind": t.kind, "token": t.text, "start": t.start, "end": t.end} for t in tokenize(x, source, strict=False)[:-1]])
    return made.select(*df.columns, F.explode("_tokens").alias("_t")).select(*df.columns, "_t.*")


def lineage_edges(df: DataFrame, column: str, source: str) -> DataFrame:
    """One row an edge: output column, source table, source column, depth."""
    from .analysis import lineage, output_columns

    kind = pa.list_(pa.struct([("out_col", pa.string()), ("src_table", pa.string()), ("src_col", pa.string())]))

    def edges(sql: str) -> list[dict]:
        return [{"out_col": name, "src_table": x.source, "src_col": x.name} for _, name, form in output_columns(sql, source) if form != "wildcard" for x in lineage(sql, name, source).leaves() if x.source_kind == "table"]

    made = _map(df, column, "_edges", kind, "array<struct<out_col: string, src_table: string, src_col: string>>", edges)
    return made.select(*df.columns, F.explode("_edges").alias("_e")).select(*df.columns, "_e.*")


def validate_column(df: DataFrame, column: str, source: str, name: str = "issues") -> DataFrame:
    from .analysis import validate

    return _map(df, column, name, pa.list_(pa.string()), "array<string>", lambda x: [i.code for i in validate(x, source)])
