"""Syntax tree to SQL text in a dialect's spelling, on one line or laid out.

This is the writer of the formatter, the builder and text-to-text use; `plans.lower` is the one whose output runs.
"""

from __future__ import annotations

from . import nodes as n
from .dialects import Dialect, dialect
from .lexer import tokenize
from .parser import parse
from .respell import respelled

CLAUSES = ("FROM", "WHERE", "GROUP BY", "HAVING", "QUALIFY", "WINDOW", "ORDER BY", "LIMIT", "OFFSET")


class Writer:
    def __init__(self, target: str | Dialect = "generic", pretty: bool = False, identify: bool = False) -> None:
        self.d, self.pretty, self.identify = dialect(target), pretty, identify

    # layout

    def lines(self, head: str, items: list[str], level: int) -> str:
        if not self.pretty:
            return f"{head} {', '.join(items)}"
        pad = "\n" + "  " * (level + 1)
        return head + pad + f",{pad}".join(items)

    def clause(self, word: str, body: str, level: int) -> str:
        return f"\n{'  ' * level}{word} {body}" if self.pretty else f" {word} {body}"

    def nested(self, q: n.Node, level: int) -> str:
        if not self.pretty:
            return f"({self.query(q, level)})"
        return f"(\n{'  ' * (level + 1)}{self.query(q, level + 1)}\n{'  ' * level})"

    # identifiers and literals

    def ident(self, name: str, quoted: bool = False) -> str:
        if not quoted and not self.identify and name.replace("_", "a").isalnum() and not name[0].isdigit():
            return name
        q = self.d.ident_quotes[0]
        close = {"[": "]"}.get(q, q)
        return q + name.replace(close, close * 2) + close

    def text(self, value: str) -> str:
        return "'" + (value.replace("\\", "\\\\") if self.d.backslash else value).replace("'", "\\'" if self.d.name in ("bigquery", "spark", "databricks", "hive") else "''") + "'"

    # statements and queries

    def statement(self, s: n.Node) -> str:
        if isinstance(s, n.Insert):
            cols = f" ({', '.join(map(self.ident, s.columns))})" if s.columns else ""
            return f"INSERT {'OVERWRITE' if s.overwrite else 'INTO'} {self.path(s.table)}{cols}{self.clause('', self.query(s.query, 0), 0).rstrip() if self.pretty else ' ' + self.query(s.query, 0)}"
        if isinstance(s, n.InsertAll):
            parts = []
            for cond, table, columns, values in s.targets:
                when = "" if cond is None else "ELSE " if isinstance(cond, n.Lit) else f"WHEN {self.e(cond)} THEN "
                parts.append(f"{when}INTO {self.path(table)}" + (f" ({', '.join(map(self.ident, columns))})" if columns else "") + (f" VALUES ({', '.join(map(self.e, values))})" if values else ""))
            return f"INSERT {'FIRST' if s.first else 'ALL'} {' '.join(parts)} {self.query(s.query, 0)}"
        if isinstance(s, n.CreateFunction):
            args = ", ".join(self.ident(a) + (f" {self.type(t)}" if t else "") for a, t in s.args)
            return f"CREATE FUNCTION {self.path(s.name)}({args}){f' RETURNS {self.type(s.returns)}' if s.returns else ''} AS {self.e(s.body)}"
        if isinstance(s, n.Update):
            sets = ", ".join(f"{self.ident(c)} = {self.e(x)}" for c, x in s.sets)
            return f"UPDATE {self.rel(s.table, 0)} SET {sets}" + (f" FROM {self.rel(s.source, 0)}" if s.source is not None else "") + (f" WHERE {self.e(s.where)}" if s.where is not None else "")
        if isinstance(s, n.Delete):
            return f"DELETE FROM {self.rel(s.table, 0)}" + (f" USING {self.rel(s.using, 0)}" if s.using is not None else "") + (f" WHERE {self.e(s.where)}" if s.where is not None else "")
        if isinstance(s, n.Create):
            head = f"CREATE {'OR REPLACE ' if s.replace else ''}{'TEMPORARY ' if s.temporary else ''}{s.kind} {'IF NOT EXISTS ' if s.if_not_exists else ''}{self.path(s.name)}"
            if s.query is not None:
                return f"{head} AS {self.query(s.query, 0)}"
            return f"{head} ({', '.join(f'{self.ident(c)} {t.text.upper() if t else str()}' + self.params(t) + ('' if null else ' NOT NULL') for c, t, null in s.columns)})"
        if isinstance(s, n.Command):
            return s.text
        if isinstance(s, n.Merge):
            out = f"MERGE INTO {self.rel(s.table, 0)} USING {self.rel(s.source, 0)} ON {self.e(s.on)}"
            for matched, by_source, cond, action, payload in s.clauses:
                out += f" WHEN {'' if matched else 'NOT '}MATCHED{' BY SOURCE' if by_source else ''}{f' AND {self.e(cond)}' if cond is not None else ''} THEN {action}"
                if action == "UPDATE":
                    out += " SET " + ("*" if payload is None else ", ".join(f"{self.ident(c)} = {self.e(x)}" for c, x in payload))
                elif action == "INSERT":
                    out += " *" if payload is None else f" ({', '.join(map(self.ident, payload[0]))}) VALUES ({', '.join(map(self.e, payload[1]))})"
            return out
        if isinstance(s, n.Copy):
            source = f"({self.query(s.source, 0)})" if isinstance(s.source, n.Query) else self.rel(s.source, 0)
            return f"COPY {source} {'FROM' if s.into else 'TO'} {self.text(s.path)} (FORMAT {s.kind})"
        return self.query(s, 0)

    def params(self, t) -> str:
        return f"({', '.join(map(str, t.params))})" if t is not None and t.params else ""

    def path(self, parts: list[str]) -> str:
        return ".".join(map(self.ident, parts))

    def query(self, q: n.Node, level: int) -> str:
        if not isinstance(q, n.Query):
            return self.body(q, level)
        out = ""
        if q.ctes:
            parts = [f"{self.ident(c.name)}{' (' + ', '.join(map(self.ident, c.columns)) + ')' if c.columns else ''} AS {({'YES': 'MATERIALIZED ', 'NOT': 'NOT MATERIALIZED '}.get(c.materialized, ''))}{self.nested(c.query, level)}" for c in q.ctes]
            out = f"WITH {'RECURSIVE ' if q.recursive and self.d.name not in ('tsql', 'oracle') else ''}{', '.join(parts)}" + ("\n" + "  " * level if self.pretty else " ")
        top = ""
        if q.limit is not None and not q.offset and self.d.name in ("tsql", "fabric") and isinstance(q.body, n.Select):
            top = f"TOP {self.e(q.limit)}{' PERCENT' if q.percent else ''}{' WITH TIES' if q.ties else ''} "
        out += self.body(q.body, level, top)
        if q.order:
            out += self.clause("ORDER BY", ", ".join(map(self.order, q.order)), level)
        if q.fill is not None:
            out += " WITH FILL" + "".join(f" {word} {self.e(x)}" for word, x in (("FROM", q.fill.low), ("TO", q.fill.high), ("STEP", q.fill.step)) if x is not None)
            if q.fill.interpolate:
                out += f" INTERPOLATE ({', '.join(self.ident(c) + (f' AS {self.e(x)}' if x is not None else '') for c, x in q.fill.interpolate)})"
        for word, items in q.sort.items():
            out += self.clause(f"{word} BY", ", ".join(map(self.order, items)), level)
        if q.limit is not None and not top:
            if q.ties or self.d.name in ("oracle",) or q.percent and self.d.name != "duckdb":
                out += (self.clause("OFFSET", self.e(q.offset) + " ROWS", level) if q.offset is not None else "") + self.clause("FETCH", f"FIRST {self.e(q.limit)}{' PERCENT' if q.percent else ''} ROWS {'WITH TIES' if q.ties else 'ONLY'}", level)
                return out
            out += self.clause("LIMIT", self.e(q.limit) + ("%" if q.percent else ""), level)
        if q.limit_by:
            out += self.clause("LIMIT", f"{self.e(q.limit_by[0])} BY {', '.join(map(self.e, q.limit_by[1:]))}", level)
        if q.offset is not None:
            out += self.clause("OFFSET", self.e(q.offset), level)
        if q.json:
            out += self.clause("FOR JSON", q.json, level)
        return out + (" " + q.pipes if q.pipes else "")

    def body(self, b: n.Node, level: int, top: str = "") -> str:
        if isinstance(b, n.Query):
            return self.nested(b, level)
        if isinstance(b, n.Values):
            return "VALUES " + ", ".join("(" + ", ".join(map(self.e, r)) + ")" for r in b.rows)
        if isinstance(b, n.SetOp):
            sep = "\n" + "  " * level if self.pretty else " "
            right = self.body(b.right, level)
            if isinstance(b.right, n.SetOp):
                right = f"({right})"
            return f"{self.body(b.left, level)}{sep}{b.op}{' ALL' if b.all else ''}{' BY NAME' if b.by_name else ''}{sep}{right}"
        head = "SELECT"
        if b.top:
            top = f"TOP {self.e(b.top[0])}{' PERCENT' if b.top[1] else ''}{' WITH TIES' if b.top[2] else ''} "
        if top:
            head += " " + top.strip()
        if b.distinct:
            head += " DISTINCT"
        if b.distinct_on:
            head += f" DISTINCT ON ({', '.join(map(self.e, b.distinct_on))})"
        if b.as_struct:
            head += f" AS {b.as_struct}"
        out = self.lines(head, [self.e(x) for x in b.items], level)
        if b.into is not None:
            out += self.clause("INTO", self.rel(b.into, level), level)
        if b.source is not None:
            out += self.clause("FROM", self.rel(b.source, level), level)
        if b.where is not None:
            out += self.clause("WHERE", self.e(b.where), level)
        if b.connect:
            first, cond, nocycle = b.connect
            out += (self.clause("START WITH", self.e(first), level) if first is not None else "") + self.clause("CONNECT BY", ("NOCYCLE " if nocycle else "") + self.e(cond), level)
        if b.group_all:
            out += self.clause("GROUP BY", "ALL", level)
        elif b.group:
            out += self.clause("GROUP BY", ("DISTINCT " if b.group_distinct else "") + ", ".join(map(self.e, b.group)) + (f" WITH {b.with_total}" if b.with_total else ""), level)
        if b.having is not None:
            out += self.clause("HAVING", self.e(b.having), level)
        if b.windows:
            out += self.clause("WINDOW", ", ".join(f"{self.ident(a)} AS {self.window(w)}" for a, w in b.windows), level)
        if b.qualify is not None:
            out += self.clause("QUALIFY", self.e(b.qualify), level)
        return out

    def order(self, o: n.OrderItem) -> str:
        return self.e(o.x) + (" DESC" if o.desc else "") + (f" NULLS {o.nulls}" if o.nulls else "")

    # relations

    def rel(self, r: n.Node, level: int) -> str:
        alias = getattr(r, "alias", "")
        cols = getattr(r, "columns", [])
        named = (f" AS {self.ident(alias)}" if self.d.name != "oracle" else f" {self.ident(alias)}") + (f"({', '.join(map(self.ident, cols))})" if cols and isinstance(cols[0], str) else "") if alias else ""
        if isinstance(r, n.Table):
            return self.path(r.parts) + named
        if isinstance(r, n.FileTable):
            return self.text(r.path) + named
        if isinstance(r, n.Derived):
            return ("LATERAL " if r.lateral else "") + self.nested(r.query, level) + named
        if isinstance(r, n.Group):
            return f"({self.rel(r.rel, level)})" + named
        if isinstance(r, n.TableFn) and r.shape is not None:
            columns = ", ".join(f"{self.ident(c)} FOR ORDINALITY" if t is None else f"{self.ident(c)} {self.type(t)} {'PATH ' if r.fn.name == 'JSON_TABLE' else ''}{self.text(path)}{' AS JSON' if kind == 'json' else ''}" for c, t, path, kind in r.shape)
            args = ", ".join(map(self.e, r.fn.args))
            return (f"JSON_TABLE({args} COLUMNS({columns}))" if r.fn.name == "JSON_TABLE" else f"OPENJSON({args}) WITH ({columns})") + named
        if isinstance(r, n.TableFn):
            return ("LATERAL " if r.lateral else "") + self.e(r.fn) + (" WITH ORDINALITY" if r.ordinality == "ORDINALITY" else "") + named + (f" WITH OFFSET AS {self.ident(r.offset_alias)}" if r.ordinality == "OFFSET" else "")
        if isinstance(r, n.Join):
            kind = {"INNER": "JOIN", "SEMI": "LEFT SEMI JOIN", "ANTI": "LEFT ANTI JOIN"}.get(r.kind, f"{r.kind} JOIN")
            sep = "\n" + "  " * level if self.pretty else " "
            out = f"{self.rel(r.left, level)}{sep}{'NATURAL ' if r.natural else ''}{kind} {self.rel(r.right, level)}"
            if r.using:
                return out + f" USING ({', '.join(map(self.ident, r.using))})"
            return out + (f" ON {self.e(r.on)}" if r.on is not None else "")
        if isinstance(r, n.LateralView) and isinstance(r.fn, n.Fn) and r.fn.name == "ARRAY_JOIN":
            return f"{self.rel(r.rel, level)} {'LEFT ' if r.outer else ''}ARRAY JOIN {', '.join(map(self.e, r.fn.args))}"
        if isinstance(r, n.LateralView):
            return f"{self.rel(r.rel, level)} LATERAL VIEW {'OUTER ' if r.outer else ''}{self.e(r.fn)} {r.alias}" + (f" AS {', '.join(r.columns)}" if r.columns else "")
        if isinstance(r, n.Pivot):
            return f"{self.rel(r.rel, level)} PIVOT({', '.join(map(self.e, r.aggs))} FOR {', '.join(map(self.e, r.on))} IN ({', '.join(map(self.e, r.values)) or 'ANY'}){' GROUP BY ' + ', '.join(map(self.e, r.group)) if r.group else ''})" + named
        if isinstance(r, n.Unpivot):
            return f"{self.rel(r.rel, level)} UNPIVOT({self.ident(r.value)} FOR {self.ident(r.name)} IN ({', '.join(self.e(c) for c, _ in r.columns)}))" + (f" AS {self.ident(alias)}" if alias else "")
        if isinstance(r, n.MatchRecognize):
            parts = ["PARTITION BY " + ", ".join(map(self.e, r.partition))] if r.partition else []
            parts += ["ORDER BY " + ", ".join(map(self.order, r.order))] if r.order else []
            parts += ["MEASURES " + ", ".join(f"{self.e(x)} AS {self.ident(name)}" for x, name in r.measures)] if r.measures else []
            parts += [f"{r.rows} ROW{'S' if r.rows == 'ALL' else ''} PER MATCH"]
            parts += [f"AFTER MATCH SKIP {r.after}"] if r.after else []
            pattern = r.pattern.strip()
            parts += [f"PATTERN {pattern if pattern.startswith('(') else f'({pattern})'}"]
            parts += ["DEFINE " + ", ".join(f"{self.ident(v)} AS {self.e(x)}" for v, x in r.define)] if r.define else []
            return f"{self.rel(r.rel, level)} MATCH_RECOGNIZE ({' '.join(parts)})" + named
        raise TypeError(type(r).__name__)

    # expressions

    def window(self, w: n.Window) -> str:
        if w.name_only:
            return self.ident(w.base)
        parts = [self.ident(w.base)] if w.base else []
        if w.partition:
            parts.append("PARTITION BY " + ", ".join(map(self.e, w.partition)))
        if w.order:
            parts.append("ORDER BY " + ", ".join(map(self.order, w.order)))
        if w.frame:
            b = [x[0] if x[1] is None else f"{self.e(x[1])} {x[0]}" for x in (w.frame.start, w.frame.end)]
            parts.append(f"{w.frame.unit} BETWEEN {b[0]} AND {b[1]}" + (f" EXCLUDE {w.frame.exclude}" if w.frame.exclude else ""))
        return f"({' '.join(parts)})"

    def e(self, x: n.Node) -> str:  # noqa: C901
        e, many = self.e, lambda xs: ", ".join(map(self.e, xs))
        match x:
            case n.Name():
                quoted = [*x.quoted, *[False] * len(x.parts)]
                return ".".join(self.ident(p, q) for p, q in zip(x.parts, quoted, strict=False))
            case n.Lit():
                return {"string": lambda: self.text(x.value), "bool": lambda: "TRUE" if x.value else "FALSE", "null": lambda: "NULL", "hex": lambda: str(x.value) if str(x.value)[:2].lower() == "0x" else f"x'{x.value}'", "number": lambda: x.value}[x.kind]()
            case n.Param():
                return x.text
            case n.Raw():
                return x.text
            case n.Star():
                out = ".".join(map(self.ident, x.qualifier)) + ("." if x.qualifier else "") + "*"
                word = "EXCLUDE" if self.d.name in ("duckdb", "snowflake") else "EXCEPT"
                return out + (f" {word} ({', '.join(map(self.ident, x.drop))})" if x.drop else "") + (f" REPLACE ({', '.join(f'{e(v)} AS {self.ident(c)}' for v, c in x.swap)})" if x.swap else "") + (f" RENAME ({', '.join(f'{self.ident(a)} AS {self.ident(b)}' for a, b in x.rename)})" if x.rename else "")
            case n.Un():
                return f"{x.op} {e(x.x)}" if x.op.isalpha() or "_" in x.op else f"{x.op}{self.wrap(x.x)}"
            case n.Bin():
                if isinstance(x.right, n.Tuple) and x.op.endswith((" ANY", " ALL")):
                    return f"{self.wrap(x.left)} {x.op} ({many(x.right.items)})"
                return f"{self.wrap(x.left, x.op)} {x.op} {self.wrap(x.right, x.op, True)}" + (f" ESCAPE {e(x.escape)}" if x.escape is not None else "")
            case n.In():
                return f"{self.wrap(x.x)} {'NOT ' if x.negated else ''}IN ({self.query(x.query, 0) if x.query is not None else many(x.items)})"
            case n.Between():
                return f"{self.wrap(x.x)} {'NOT ' if x.negated else ''}BETWEEN {'SYMMETRIC ' if x.symmetric else ''}{self.wrap(x.low)} AND {self.wrap(x.high)}"
            case n.Is():
                return f"{self.wrap(x.x)} IS {'NOT ' if x.negated else ''}{x.what}"
            case n.Fn(name="(+)"):
                return f"{e(x.args[0])} (+)"
            case n.Fn(name="MATCH_AGAINST"):
                return f"MATCH({many(x.args[:-1])}) AGAINST ({e(x.args[-1])})"
            case n.Fn():
                return self.call(x)
            case n.Cast():
                return f"{('SAFE_CAST' if self.d.name == 'bigquery' else 'TRY_CAST') if x.safe else 'CAST'}({e(x.x)} AS {self.type(x.type)})"
            case n.Case():
                return "CASE" + (f" {e(x.operand)}" if x.operand is not None else "") + "".join(f" WHEN {e(a)} THEN {e(b)}" for a, b in x.whens) + (f" ELSE {e(x.other)}" if x.other is not None else "") + " END"
            case n.Interval():
                return f"INTERVAL {e(x.value)}{' ' + x.unit if x.unit else ''}{' TO ' + x.to if x.to else ''}"
            case n.Sub():
                return f"({self.query(x.query, 0)})"
            case n.Exists():
                return f"EXISTS({self.query(x.query, 0)})"
            case n.Quant():
                return f"{x.word} ({self.query(x.x, 0) if isinstance(x.x, n.Query) else e(x.x)})"
            case n.ArrayLit():
                return f"[{many(x.items)}]" if self.d.name in ("duckdb", "bigquery", "clickhouse", "snowflake") else f"array({many(x.items)})" if self.d.name in ("spark", "databricks", "hive") else f"ARRAY[{many(x.items)}]"
            case n.StructLit():
                return "{" + ", ".join(f"{self.text(k or '')}: {e(v)}" for k, v in zip(x.names, x.items, strict=False)) + "}"
            case n.MapLit():
                return "MAP {" + ", ".join(f"{e(k)}: {e(v)}" for k, v in zip(x.keys, x.values, strict=True)) + "}"
            case n.Tuple():
                return f"({many(x.items)})"
            case n.Index():
                if x.is_slice:
                    return f"{e(x.x)}[{e(x.i) if x.i is not None else ''}:{e(x.hi) if x.hi is not None else ''}{':' + e(x.step) if x.step is not None else ''}]"
                return f"{e(x.x)}[{e(x.i)}]"
            case n.Field():
                return f"{self.wrap(x.x)}.{self.ident(x.name)}"
            case n.JsonPath():
                return f"{e(x.x)}:{x.path}"
            case n.Lambda():
                return f"{x.params[0] if len(x.params) == 1 else '(' + ', '.join(x.params) + ')'} -> {e(x.body)}"
            case n.Named():
                return f"{x.name} => {e(x.x)}"
            case n.Alias():
                return f"{e(x.x)} AS {self.ident(x.name) if x.name else '(' + ', '.join(x.columns) + ')'}"
            case n.Typed():
                return f"{x.type} {self.text(x.text)}"
            case n.Extract():
                return f"EXTRACT({x.part} FROM {e(x.x)})"
            case n.AtZone():
                return f"{self.wrap(x.x)} AT TIME ZONE {e(x.zone)}"
            case n.Collate():
                return f"{self.wrap(x.x)} COLLATE {x.name}"
            case n.Grouping():
                return f"{'GROUPING SETS' if x.kind == 'SETS' else x.kind} ({many(x.items)})"
            case n.Query():
                return f"({self.query(x, 0)})"
        raise TypeError(type(x).__name__)

    def type(self, t) -> str:
        if self.d.name in ("spark", "databricks", "hive"):
            return t.spark(self.d)
        if t.kind == "array":
            return f"{self.type(t.inner[0])}[]" if t.inner and self.d.name in ("duckdb", "postgresql", "generic") else f"ARRAY<{self.type(t.inner[0])}>" if t.inner else "ARRAY"
        if t.kind == "struct":
            return f"STRUCT({', '.join(f'{a} {self.type(b)}' for a, b in zip(t.names, t.inner, strict=True))})"
        if t.kind == "map":
            return f"MAP({', '.join(map(self.type, t.inner))})"
        return (t.text or t.kind).upper() + self.params(t)

    def wrap(self, x: n.Node, op: str = "", right: bool = False) -> str:
        from .parser import BINARY, COMPARE

        text = self.e(x)
        if isinstance(x, n.Bin):
            own, outer = BINARY.get(x.op, 5), BINARY.get(op, 5 if op in COMPARE or op else 12)
            return f"({text})" if own < outer or own == outer and (right or op not in BINARY) else text
        if isinstance(x, (n.In, n.Between, n.Is, n.Lambda)) and op not in ("AND", "OR", "XOR") or isinstance(x, n.Un) and x.op == "NOT" and op not in ("AND", "OR", "XOR"):
            return f"({text})"
        return text

    def call(self, f: n.Fn) -> str:
        if f.bare:
            return f.name
        args = ", ".join(map(self.e, f.args))
        out = f"{f.name}" + (f"({', '.join(map(self.e, f.params))})" if f.params else "") + f"({'DISTINCT ' if f.distinct else ''}{args}"
        if f.extreme:
            out += f" HAVING {f.extreme[0]} {self.e(f.extreme[1])}"
        if f.order:
            out += f" ORDER BY {', '.join(map(self.order, f.order))}"
        if f.separator is not None:
            out += f" SEPARATOR {self.e(f.separator)}"
        if f.limit is not None:
            out += f" LIMIT {self.e(f.limit)}"
        out += ")"
        if f.within:
            out += f" WITHIN GROUP (ORDER BY {', '.join(map(self.order, f.within))})"
        if f.where is not None:
            out += f" FILTER(WHERE {self.e(f.where)})"
        if f.nulls:
            out += f" {f.nulls} NULLS"
        if f.keep and f.keep[0] != "FROM LAST":
            out += f" KEEP (DENSE_RANK {f.keep[0]} ORDER BY {', '.join(map(self.order, f.keep[1]))})"
        if f.over is not None:
            out += f" OVER {self.window(f.over)}"
        return out


def generate(node: n.Node, target: str | Dialect = "generic", pretty: bool = False, identify: bool = False) -> str:
    return Writer(target, pretty, identify).statement(node)


def format_sql(sql: str, source: str | Dialect = "generic") -> str:
    """A text laid out; comments come before the statement that they stand in, a closing semicolon is kept."""
    out = []
    notes = [t for t in tokenize(sql, source, comments=True, strict=False) if t.kind == "comment"]
    for s in parse(sql, source):
        end = s.span[1] if s.span else len(sql)
        own, notes = [t.text for t in notes if t.start < end], [t for t in notes if t.start >= end]
        out.append("".join(c + "\n" for c in own) + generate(s, source, True))
    text = ";\n\n".join(out) + (";" if sql.rstrip().endswith(";") else "")
    return text + "".join("\n" + t.text for t in notes)


def transpile(sql: str, source: str | Dialect, target: str | Dialect, pretty: bool = False, identify: bool = False) -> list[str]:
    """Text to text.  To Spark and Databricks the executable lowering is used; to others names, row limits and spelling change."""
    if dialect(target).name in ("spark", "databricks", "hive"):
        from ..plans.lower import lower

        return [lower(s, source) for s in parse(sql, source)]
    return [generate(respelled(s, source, target), target, pretty, identify) for s in parse(sql, source)]
