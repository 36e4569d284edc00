"""Writes: UPDATE, DELETE and MERGE as DataFrame rewrites of a view, and COPY to and from files.

Temporary views and plain Parquet tables have no row-level writes in Spark.  A rewrite keeps the rest of the engine
declarative: the changed table is a new plan over the old one, registered under the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..front import nodes as n
from ..plans.lower import Lower, ident


def _lowered(engine, source, table: n.Table, other: n.Node | None):
    low = Lower(source, engine.columns, engine.known)
    low.scopes.append({})
    low.structs.append({})
    target = low.rel(table)
    rest = low.rel(other) if other is not None else ""
    return low, target, rest


def execute_write(engine, s: n.Node, source: str) -> DataFrame:
    name = s.table.parts[-1]
    alias = s.table.alias or name
    columns = [c for c, _ in engine.columns(s.table.parts) or []]
    if isinstance(s, n.Merge):
        out = merge(engine, s, source, alias, columns)
    elif isinstance(s, n.Delete):
        low, target, rest = _lowered(engine, source, s.table, s.using)
        cond = low.e(s.where) if s.where is not None else "true"
        if rest:
            text = f"SELECT * FROM {target} WHERE NOT EXISTS (SELECT 1 FROM {rest} WHERE {cond})"
        else:
            text = f"SELECT * FROM {target} WHERE NOT coalesce({cond}, false)"
        out = engine.spark.sql(text)
    else:
        low, target, rest = _lowered(engine, source, s.table, s.source)
        cond = low.e(s.where) if s.where is not None else "true"
        sets = {c.lower(): low.e(x) for c, x in s.sets}
        if rest:
            key = "__row"
            base = f"(SELECT *, monotonically_increasing_id() AS {key} FROM {target}) AS {ident(alias)}"
            new = ", ".join(f"first(CASE WHEN __hit THEN {ident('__n_' + c)} ELSE {ident(c)} END) AS {ident(c)}" for c in columns)
            values = ", ".join(f"{ident(alias)}.{ident(c)}, {sets.get(c.lower(), f'{ident(alias)}.{ident(c)}')} AS {ident('__n_' + c)}" for c in columns)
            inner = f"SELECT {ident(alias)}.{key}, coalesce({cond}, false) AS __hit, {values} FROM {base} LEFT JOIN {rest} ON {cond}"
            out = engine.spark.sql(f"SELECT {new} FROM ({inner}) GROUP BY {key}")
        else:
            items = ", ".join(f"CASE WHEN {cond} THEN {sets[c.lower()]} ELSE {ident(c)} END AS {ident(c)}" if c.lower() in sets else ident(c) for c in columns)
            out = engine.spark.sql(f"SELECT {items} FROM {target}")
    out.createOrReplaceTempView(name)
    engine._columns.clear()
    return out


def merge(engine, s: n.Merge, source: str, alias: str, columns: list[str]) -> DataFrame:
    """One full outer join; the first clause that applies decides about a row."""
    low, target, rest = _lowered(engine, source, s.table, s.source)
    other = s.source.alias or s.source.parts[-1]
    on = low.e(s.on)
    text = f"FROM (SELECT *, true AS __t FROM {target}) AS {ident(alias)} FULL JOIN (SELECT *, true AS __s FROM {rest}) AS {ident(other)} ON {on}"
    both, mine, theirs = f"({ident(alias)}.__t AND {ident(other)}.__s)", f"({ident(alias)}.__t AND {ident(other)}.__s IS NULL)", f"({ident(alias)}.__t IS NULL AND {ident(other)}.__s)"
    tests = []
    for i, (matched, by_source, cond, action, payload) in enumerate(s.clauses):
        where = both if matched else mine if by_source else theirs
        tests.append((i, where + (f" AND coalesce({low.e(cond)}, false)" if cond is not None else ""), action, payload))
    pick = "CASE " + " ".join(f"WHEN {w} THEN {i}" for i, w, _, _ in tests) + " ELSE -1 END"
    out = []
    source_columns = {c.lower() for c, _ in engine.columns(s.source.parts) or []} if isinstance(s.source, n.Table) else set()
    for k, c in enumerate(columns):
        parts = ""
        for i, _, action, payload in tests:
            if action == "UPDATE":
                sets = {a.lower(): low.e(x) for a, x in payload} if payload else {x: f"{ident(other)}.{ident(x)}" for x in source_columns}
                parts += f" WHEN __c = {i} THEN {sets.get(c.lower(), f'{ident(alias)}.{ident(c)}')}"
            elif action == "INSERT":
                values = f"{ident(other)}.{ident(c)}"
                if payload:
                    names = [x.lower() for x in payload[0]] or [x.lower() for x in columns]
                    values = low.e(payload[1][names.index(c.lower())]) if c.lower() in names else "NULL"
                parts += f" WHEN __c = {i} THEN {values}"
        out.append(f"CASE{parts} ELSE {ident(alias)}.{ident(c)} END AS {ident(c)}" if parts else f"{ident(alias)}.{ident(c)} AS {ident(c)}")

    deleted = [str(i) for i, _, action, _ in tests if action == "DELETE"]
    keep = f"(__c >= 0 OR {ident(alias)}.__t)" + (f" AND NOT __c IN ({', '.join(deleted)})" if deleted else "")
    # the choice is inlined: Spark computes it once for the row
    items = ", ".join(x.replace("__c", f"({pick})") for x in out)
    return engine.spark.sql(f"SELECT {items} {text} WHERE {keep.replace('__c', f'({pick})')}")


def copy_files(engine, s: n.Copy, source: str) -> DataFrame:
    from .tables import OPTIONS, read

    options = {OPTIONS.get(k.lower(), k.lower()): v for k, v in s.options.items()}
    if s.into:
        df = read(engine.spark, s.path, s.kind, engine.spark.table(".".join(s.source.parts)).schema, **options)
        merged = engine.spark.table(".".join(s.source.parts)).unionByName(df)
        merged.createOrReplaceTempView(s.source.parts[-1])
        return merged
    df = engine.spark.sql(engine.lower(s.source if isinstance(s.source, n.Query) else n.Query(n.Select([n.Star()], s.source)), source))
    by = [c.strip() for c in options.pop("partition_by", "").strip("()").split(",") if c.strip()]
    writer = df.write.format({"ndjson": "json"}.get(s.kind, s.kind)).options(**options).mode("overwrite")
    (writer.partitionBy(*by) if by else writer).save(s.path)
    return df.sparkSession.createDataFrame([(s.path,)], "path string").withColumn("format", F.lit(s.kind))
