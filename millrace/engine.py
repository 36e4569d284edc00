"""The engine: SQL text in any dialect in, DataFrame out."""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from .front import nodes as n
from .front.dialects import UnsupportedSQL
from .front.parser import parse
from .functions.udfs import register as register_functions
from .operators.match_recognize import match_recognize
from .plans.lower import Lower
from .sources.tables import register_directory
from .sources.writes import copy_files, execute_write


class Engine:
    """Runs statements of any dialect on a Spark session."""

    def __init__(self, spark: SparkSession, dialect: str = "generic") -> None:
        self.spark, self.dialect = spark, dialect
        spark.conf.set("spark.sql.timeType.enabled", "true")  # off by default in Spark 4.1
        self._columns: dict[str, list[tuple[str, str]]] = {}

    @cached_property
    def functions(self) -> set[str]:
        """Names of Spark's functions and of ours, which are registered on first use."""
        register_functions(self.spark)
        return {r[0].rsplit(".", 1)[-1].lower() for r in self.spark.sql("SHOW FUNCTIONS").collect()}

    def columns(self, parts: list[str]) -> list[tuple[str, str]] | None:
        name = ".".join(f"`{p}`" for p in parts)
        if name not in self._columns:
            if not self.spark.catalog.tableExists(name):
                return None
            self._columns[name] = [(f.name, f.dataType.simpleString().split("(")[0]) for f in self.spark.table(name).schema]
        return self._columns[name]

    def register(self, path: str, names: list[str] | None = None) -> Engine:
        """Every Parquet table of a directory as a view."""
        register_directory(self.spark, path, names)
        self._columns.clear()
        return self

    def known(self, name: str) -> bool:
        return name in self.functions

    def lower(self, node: n.Node, dialect: str | None = None) -> str:
        return Lower(dialect or self.dialect, self.columns, self.known, self.distinct, self.match_view).statement(node)

    def distinct(self, text: str) -> list:
        """The values of a one-column text; Spark's own limit on pivot values holds."""
        most = int(self.spark.conf.get("spark.sql.pivotMaxValues"))
        rows = self.spark.sql(text).limit(most + 1).collect()
        if len(rows) > most:
            raise UnsupportedSQL(f"PIVOT over more than {most} values")
        return [r[0] for r in rows]

    def match_view(self, base: str, partition: list[str], order: list[str], define: dict[str, str], pattern: str, skip_past: bool, columns: set[str] | None = None) -> str:
        name = f"__matches_{uuid.uuid4().hex[:8]}"
        match_recognize(self.spark.sql(base), partition, order, define, pattern, skip_past, columns).createOrReplaceTempView(name)
        return f"`{name}`"

    def insert_all(self, s: n.InsertAll, source: str) -> DataFrame:
        """Every target gets the rows of the query that meet its condition; FIRST: that meet none before."""
        name = f"__rows_{uuid.uuid4().hex[:8]}"
        self.spark.sql(self.lower(s.query, source)).createOrReplaceTempView(name)
        conditions: list[n.Node] = []
        out = None
        for cond, table, columns, values in s.targets:
            tests = ([cond] if cond is not None else []) + ([n.Un("NOT", n.Fn("COALESCE", [c, n.Lit("bool", False)])) for c in conditions if c is not cond] if s.first or isinstance(cond, n.Lit) else [])
            where = None
            for t in tests:
                where = t if where is None else n.Bin("AND", where, t)
            if cond is not None and cond not in conditions:
                conditions.append(cond)
            rows = n.Query(n.Select([*values] or [n.Star()], n.Table([name]), where=where))
            out = self.spark.sql(self.lower(n.Insert(table, columns, rows, False), source))
        return out

    def to_spark(self, sql: str, dialect: str | None = None) -> list[str]:
        """The Spark SQL of each statement of a text."""
        return [self.lower(s, dialect) for s in parse(sql, dialect or self.dialect)]

    def sql(self, sql: str, dialect: str | None = None, args=None) -> DataFrame:
        """Run a text; the last statement's result is returned."""
        source, out = dialect or self.dialect, None
        for s in parse(sql, source):
            if isinstance(s, (n.Update, n.Delete, n.Merge)):
                out = execute_write(self, s, source)
            elif isinstance(s, n.InsertAll):
                out = self.insert_all(s, source)
            elif isinstance(s, n.Copy):
                out = copy_files(self, s, source)
            elif isinstance(s, n.Query) and isinstance(s.body, n.Select) and s.body.into is not None:
                name, s.body.into = s.body.into.parts[-1], None
                self.spark.sql(self.lower(s, source)).createOrReplaceTempView(name)
                out = self.spark.table(name)
            elif isinstance(s, n.Command) and s.word == "SUMMARIZE":
                out = self.spark.table(s.text.strip()).summary()
            else:
                text = self.lower(s, source)
                if isinstance(s, n.CreateFunction):
                    self.functions.add(s.name[-1].lower())
                out = self.spark.sql(text, args=args) if args else self.spark.sql(text)
            self._columns.clear() if not isinstance(s, n.Query) else None
        if out is None:
            raise ValueError("no statement")
        return out
