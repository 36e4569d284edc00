"""Dialect names, aliases and the traits in which source dialects differ."""

from __future__ import annotations

from dataclasses import dataclass, field


class UnknownDialect(ValueError):
    pass


class UnsupportedSQL(ValueError):
    """A construct that has no rule; it is never passed on unread."""

    def __init__(self, construct: str, span: tuple[int, int] | None = None) -> None:
        super().__init__(f"unsupported: {construct}" + (f" at {span[0]}" if span else ""))
        self.construct, self.span = construct, span


@dataclass(frozen=True)
class Dialect:
    name: str
    aliases: tuple[str, ...] = ()
    ident_quotes: str = '"'  # opening characters of quoted identifiers
    string_quotes: str = "'"
    backslash: bool = False  # backslash escapes in plain strings
    nulls: str = "high"  # where null sorts: high, low, last (both directions)
    array_base: int = 1
    int_division: bool = False  # int / int truncates
    caret: str = "power"  # what ^ means: power or xor
    log_one: str = "ln"  # log(x): ln or log10
    log_two_base_first: bool = True
    concat_skips_null: bool = False  # the function CONCAT
    pipes_skip_null: bool = False  # the operator ||
    greatest_null: bool = False  # GREATEST/LEAST give null on a null
    tilde_full_match: bool = False
    cast_rounds: bool = False  # float to integer casts round
    float_is_double: bool = False
    regexp_replace_all: bool = True
    date_diff_boundaries: bool = True
    format_style: str = "java"  # of date patterns: java, strftime, mysql, oracle
    hash_comment: bool = False
    write: dict = field(default_factory=dict, compare=False, hash=False)


_LIST = [
    Dialect("generic", ("ansi", "")),
    Dialect("postgresql", ("postgres", "pgsql"), int_division=True, cast_rounds=True, concat_skips_null=True, log_one="log10", regexp_replace_all=False, format_style="oracle"),
    Dialect("mysql", ("mariadb",), "`", "'\"", True, "low", caret="xor", hash_comment=True, greatest_null=True, cast_rounds=True, format_style="mysql"),
    Dialect("bigquery", (), "`", "'\"", True, "low", array_base=0, caret="xor", hash_comment=True, greatest_null=True, cast_rounds=True, float_is_double=True, log_two_base_first=False, date_diff_boundaries=True, format_style="strftime"),
    Dialect("snowflake", (), '"', "'", True, "high", array_base=0, greatest_null=True, cast_rounds=True, float_is_double=True, format_style="oracle"),
    Dialect("duckdb", (), '"', "'", False, "last", log_one="log10", concat_skips_null=True, tilde_full_match=True, cast_rounds=True, regexp_replace_all=False, format_style="strftime"),
    Dialect("sqlite", (), "\"`[", "'", False, "low", int_division=True, format_style="strftime"),
    Dialect("hive", (), "`", "'\"", True, "low", array_base=0, caret="xor"),
    Dialect("spark", ("spark2", "spark3"), "`", "'\"", True, "low", array_base=0, caret="xor"),
    Dialect("trino", (), nulls="last", format_style="mysql", greatest_null=True, cast_rounds=True, int_division=True),
    Dialect("presto", (), nulls="last", format_style="mysql", greatest_null=True, cast_rounds=True, int_division=True),
    Dialect("redshift", (), int_division=True, cast_rounds=True, format_style="oracle"),
    Dialect("tsql", ("mssql", "sqlserver"), '["', "'", False, "low", int_division=True, caret="xor", concat_skips_null=True, log_two_base_first=False, float_is_double=True),
    Dialect("oracle", (), pipes_skip_null=True, concat_skips_null=True, greatest_null=True, cast_rounds=True, format_style="oracle"),
    Dialect("clickhouse", (), '"`', "'", True, "last", greatest_null=True, format_style="mysql"),
    Dialect("databricks", (), "`", "'\"", True, "low", array_base=0, caret="xor"),
    Dialect("athena", (), '"`', nulls="last", format_style="mysql", greatest_null=True, cast_rounds=True, int_division=True),
    Dialect("teradata", (), nulls="low", int_division=True, format_style="oracle"),
    Dialect("doris", (), "`", "'\"", True, "low", format_style="mysql"),
    Dialect("starrocks", (), "`", "'\"", True, "low", format_style="mysql"),
    Dialect("materialize", (), int_division=True, cast_rounds=True, concat_skips_null=True, log_one="log10", format_style="oracle"),
    Dialect("risingwave", (), int_division=True, cast_rounds=True, concat_skips_null=True, log_one="log10", format_style="oracle"),
    Dialect("singlestore", ("memsql",), "`", "'\"", True, "low", format_style="mysql"),
    Dialect("cockroachdb", ("cockroach",), cast_rounds=True, concat_skips_null=True, format_style="oracle"),
    Dialect("tidb", (), "`", "'\"", True, "low", caret="xor", format_style="mysql"),
    Dialect("druid", (), nulls="low"),
    Dialect("solr"),
    Dialect("tableau", (), '["', "'\""),
    Dialect("dune", (), nulls="last", format_style="mysql"),
    Dialect("fabric", (), '["', "'", False, "low", int_division=True, caret="xor", concat_skips_null=True, float_is_double=True),
    Dialect("drill", (), "`", nulls="last"),
    Dialect("dremio", (), nulls="last"),
    Dialect("exasol", (), '"[', format_style="oracle"),
    Dialect("datafusion", (), nulls="high", int_division=True),
]
DIALECTS = {d.name: d for d in _LIST}
_BY_NAME = {n: d for d in _LIST for n in (d.name, *d.aliases)}


def dialect(name: str | Dialect | None) -> Dialect:
    """The dialect of a name or alias; text after a comma is ignored."""
    if isinstance(name, Dialect):
        return name
    found = _BY_NAME.get((name or "generic").split(",")[0].strip().lower())
    if not found:
        raise UnknownDialect(name)
    return found
