"""SQL type spellings: text to a normal form, and from there to Spark."""

from __future__ import annotations

from dataclasses import dataclass, field

from .dialects import Dialect, dialect

#: Spellings of each kind.
SPELLINGS = {
    "boolean": "BOOL BOOLEAN LOGICAL",
    "tinyint": "TINYINT BYTEINT BYTE",
    "smallint": "SMALLINT INT2 INT16 SHORT SMALLSERIAL",
    "integer": "INT INT4 INT32 INTEGER MEDIUMINT SIGNED SERIAL",
    "bigint": "BIGINT INT8 INT64 LONG BIGSERIAL UINTEGER UINT32",
    "hugeint": "HUGEINT INT128 UHUGEINT UBIGINT UINT64",
    "float": "REAL FLOAT FLOAT4 FLOAT32",
    "double": "DOUBLE FLOAT8 FLOAT64",
    "decimal": "DEC DECIMAL NUMERIC NUMBER BIGNUMERIC BIGDECIMAL MONEY FIXED",
    "string": "CHAR CHARACTER VARCHAR VARCHAR2 NVARCHAR NVARCHAR2 NCHAR CLOB NCLOB TEXT STRING TINYTEXT MEDIUMTEXT LONGTEXT BPCHAR NAME NTEXT FIXEDSTRING",
    "binary": "BINARY BLOB BYTEA BYTES IMAGE VARBINARY RAW",
    "bit": "BIT VARBIT",
    "date": "DATE DATE32",
    "time": "TIME TIMETZ",
    "timestamp": "TIMESTAMP DATETIME DATETIME2 SMALLDATETIME TIMESTAMP_NTZ TIMESTAMPNTZ DATETIME64 TIMESTAMP_S TIMESTAMP_MS TIMESTAMP_NS",
    "timestamptz": "TIMESTAMPTZ DATETIMEOFFSET TIMESTAMP_LTZ TIMESTAMPLTZ TIMESTAMP_TZ",
    "interval": "INTERVAL",
    "json": "JSON JSONB OBJECT VARIANT",
    "uuid": "UUID UNIQUEIDENTIFIER",
    "array": "ARRAY LIST",
    "struct": "STRUCT ROW TUPLE RECORD",
    "map": "MAP",
    "geometry": "GEOMETRY",
    "geography": "GEOGRAPHY",
}
KIND = {word: kind for kind, words in SPELLINGS.items() for word in words.split()}
PLAIN = {
    "boolean": "BOOLEAN", "tinyint": "TINYINT", "smallint": "SMALLINT", "integer": "INT", "bigint": "BIGINT", "hugeint": "DECIMAL(38,0)", "float": "FLOAT",
    "double": "DOUBLE", "string": "STRING", "binary": "BINARY", "bit": "BOOLEAN", "date": "DATE", "time": "TIME", "timestamp": "TIMESTAMP_NTZ", "timestamptz": "TIMESTAMP",
    "json": "STRING", "uuid": "STRING", "geometry": "BINARY", "geography": "BINARY", "interval": "INTERVAL",
}


@dataclass
class SQLType:
    kind: str
    params: list[int] = field(default_factory=list)
    inner: list[SQLType] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    text: str = ""

    def spark(self, d: Dialect | str | None = None) -> str:
        """The Spark spelling, for a type written in dialect d."""
        d = dialect(d)
        if self.kind == "array":
            return f"ARRAY<{self.inner[0].spark(d) if self.inner else 'STRING'}>"
        if self.kind == "map":
            return f"MAP<{', '.join(x.spark(d) for x in self.inner)}>"
        if self.kind == "struct":
            return f"STRUCT<{', '.join(f'`{n}`: {x.spark(d)}' for n, x in zip(self.names, self.inner, strict=True))}>"
        if self.kind == "decimal":
            if self.params:
                return f"DECIMAL({self.params[0]},{self.params[1] if len(self.params) > 1 else 0})"
            return {"duckdb": "DECIMAL(18,3)", "snowflake": "DECIMAL(38,0)", "bigquery": "DECIMAL(38,9)"}.get(d.name, "DECIMAL(38,10)" if d.name in ("postgresql", "oracle") else "DECIMAL(10,0)")
        if self.kind == "float" and (d.float_is_double or self.params and self.params[0] > 24):
            return "DOUBLE"
        if self.kind == "timestamp" and d.name in ("spark", "databricks", "hive") and self.text.upper() == "TIMESTAMP":
            return "TIMESTAMP"
        if self.kind == "timestamp" and d.name == "bigquery" and self.text.upper() == "TIMESTAMP":
            return "TIMESTAMP"
        if self.kind == "tinyint" or self.text.upper() == "INT8" and d.name == "clickhouse":
            return "TINYINT"
        if self.kind == "custom":
            from .dialects import UnsupportedSQL

            raise UnsupportedSQL(f"type {self.text}")
        return PLAIN[self.kind]

    def __str__(self) -> str:
        if self.kind == "array":
            return f"array<{self.inner[0] if self.inner else 'unknown'}>"
        if self.kind == "map":
            return f"map<{', '.join(map(str, self.inner))}>"
        if self.kind == "struct":
            return f"struct<{', '.join(f'{n}: {x}' for n, x in zip(self.names, self.inner, strict=True))}>"
        return (self.text.lower() if self.kind == "custom" else self.kind) + (f"({','.join(map(str, self.params))})" if self.params else "")


def parse_type(text: str, source: str | Dialect = "generic") -> SQLType:
    """A whole text as a type; anything left over is an error."""
    from .parser import Parser

    p = Parser(text, source)
    found = p.type_()
    p.finish()
    return found
