"""Statements, queries and expressions: a Pratt parser over the tokens of any dialect.

Grammar words decide, not dialect names; a dialect's profile only settles what one spelling means in one place and
another elsewhere.
"""

from __future__ import annotations

import re

import sys

from . import nodes as n
from .dialects import Dialect, UnsupportedSQL, dialect
from .lexer import SQLSyntaxError, Token, tokenize
from .types import KIND, SQLType

sys.setrecursionlimit(max(sys.getrecursionlimit(), 12_000))
MAX_BYTES, MAX_TOKENS, MAX_DEPTH = 16 << 20, 1_000_000, 512

#: Words that end an expression or a relation where an alias could stand.
RESERVED = set(
    "SELECT FROM WHERE GROUP HAVING QUALIFY WINDOW ORDER LIMIT OFFSET FETCH UNION INTERSECT EXCEPT MINUS ON USING JOIN INNER LEFT RIGHT FULL CROSS NATURAL OUTER SEMI ANTI ASOF POSITIONAL LATERAL "
    "AS AND OR NOT XOR IN IS LIKE ILIKE BETWEEN CASE WHEN THEN ELSE END WITH PIVOT UNPIVOT TABLESAMPLE SET VALUES INTO CONNECT START SORT DISTRIBUTE CLUSTER PREWHERE GLOBAL ANY ALL SETTINGS FORMAT FOR "
    "STRAIGHT_JOIN RETURNING COLLATE DIV RLIKE REGEXP GLOB SIMILAR ISNULL NOTNULL MATCH_RECOGNIZE BY TOP DISTINCT ESCAPE WITHIN FILTER OVER APPLY ARRAY_JOIN OPTION KEEP USE".split()
)
JOIN_WORDS = set("JOIN INNER LEFT RIGHT FULL CROSS NATURAL SEMI ANTI ASOF POSITIONAL GLOBAL ANY ALL STRAIGHT_JOIN OUTER ARRAY PASTE".split())
COMPARE = {"=", "==", "<>", "!=", "^=", "<", "<=", ">", ">=", "<=>"}
BINARY = {"OR": 1, "XOR": 2, "AND": 3, "||": 8, "|": 6, "#": 6, "&": 7, "<<": 8, ">>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10, "//": 10, "DIV": 10, "MOD": 10, "^": 11, "**": 11}
OTHER = {"->", "->>", "#>", "#>>", "@>", "<@", "&&", "?", "?|", "?&", "<->", "@@", "#-"}
WORD_COMPARE = {"EQ": "=", "NE": "<>", "LT": "<", "LE": "<=", "GT": ">", "GE": ">="}


class Parser:
    def __init__(self, sql: str, source: str | Dialect = "generic") -> None:
        if len(sql) > MAX_BYTES:
            raise SQLSyntaxError("text is too long", sql[:100], 0)
        self.sql, self.d = sql, dialect(source)
        self.toks = tokenize(sql, self.d)
        if len(self.toks) > MAX_TOKENS:
            raise SQLSyntaxError("too many tokens", sql[:100], 0)
        self.i = self.depth = 0
        self.last = len(self.toks) - 1

    # tokens

    @property
    def t(self) -> Token:
        return self.toks[self.i]

    def peek(self, k: int = 1) -> Token:
        i = self.i + k
        return self.toks[i] if i < self.last else self.toks[self.last]

    def next(self) -> Token:
        t = self.toks[self.i]
        if self.i < self.last:
            self.i += 1
        return t

    def fail(self, expected: str) -> SQLSyntaxError:
        return SQLSyntaxError(f"expected {expected}, found {self.t.text or 'end of input'!r}", self.sql, self.t.start)

    def is_(self, *words: str) -> bool:
        """Whether the next tokens are these words or operators."""
        i, toks = self.i, self.toks
        if toks[i].sym != words[0]:
            return False
        return len(words) == 1 or all(i + k <= self.last and toks[i + k].sym == w for k, w in enumerate(words))

    def any_(self, *words: str) -> bool:
        return self.toks[self.i].sym in words

    def take(self, *words: str) -> bool:
        if self.is_(*words):
            self.i += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            raise self.fail(" ".join(words))

    def finish(self) -> None:
        while self.take(";"):
            pass
        if self.t.kind != "end":
            raise self.fail("end of input")

    def ident(self, what: str = "a name") -> str:
        t = self.t
        if t.kind == "quoted":
            return self.next().value
        if t.kind == "word":
            return self.next().text
        if t.kind == "string" and self.d.name in ("spark", "mysql", "tsql", "snowflake", "duckdb", "sqlite", "generic", "bigquery"):
            return self.next().value
        raise self.fail(what)

    def idents(self) -> list[str]:
        """( a, b, … )"""
        self.need("(")
        out = [self.ident()]
        while self.take(","):
            out.append(self.ident())
        self.need(")")
        return out

    def path(self) -> list[str]:
        if self.is_("#") and self.d.name in ("tsql", "fabric"):  # a temporary table
            self.next()
        out = [self.ident("a table name")]
        while self.is_("."):
            self.next()
            out.append(self.ident())
        return out

    def alias(self, reserved: set[str] = RESERVED) -> str:
        if self.take("AS"):
            return self.ident("an alias")
        if self.t.kind == "quoted" or self.t.kind == "word" and self.t.word not in reserved:
            return self.ident()
        return ""

    def list_of(self, one, stop: str = "") -> list:
        out = [one()]
        while self.take(","):
            if stop and self.is_(stop) or self.t.kind == "end":  # a trailing comma
                break
            out.append(one())
        return out

    # statements

    def statements(self) -> list[n.Node]:
        out = []
        while True:
            while self.take(";"):
                pass
            if self.t.kind == "end":
                return out
            out.append(self.statement())
            if not self.is_(";") and self.t.kind != "end":
                raise self.fail("end of statement")

    def statement(self) -> n.Node:
        start, w = self.t.start, self.t.word
        if w in ("SELECT", "SEL", "WITH", "VALUES", "FROM", "TABLE") or self.is_("("):
            if w == "WITH":
                return self.with_statement(start)
            out = self.query()
        elif w in ("PIVOT", "UNPIVOT", "PIVOT_WIDER"):
            out = n.Query(n.Select([n.Star()], self.pivot_statement()))
        elif w in ("INSERT", "REPLACE") and self.peek().word in ("INTO", "OVERWRITE", "ALL", "FIRST"):
            out = self.insert()
        elif w == "UPDATE":
            out = self.update()
        elif w == "DELETE":
            out = self.delete()
        elif w == "MERGE":
            out = self.merge()
        elif w == "CREATE":
            out = self.create()
        elif w == "COPY":
            out = self.copy()
        elif w == "SUMMARIZE":
            self.next()
            out = n.Command("SUMMARIZE", self.rest())
        elif w:
            out = n.Command(w, self.rest())
        else:
            raise self.fail("a statement")
        out.span = (start, self.toks[max(self.i - 1, 0)].end)
        return out

    def with_statement(self, start: int) -> n.Node:
        ctes, recursive = self.ctes()
        if self.t.word in ("INSERT", "UPDATE", "DELETE", "MERGE"):
            out = self.statement()
            if isinstance(out, n.Insert):
                out.query = n.Query(out.query, ctes, recursive) if not isinstance(out.query, n.Query) else out.query
                out.query.ctes = ctes + [c for c in out.query.ctes if c not in ctes]
                return out
            raise UnsupportedSQL("WITH before this statement", (start, start))
        q = self.query()
        q = q if isinstance(q, n.Query) and not q.ctes else n.Query(q)
        q.ctes, q.recursive = ctes, recursive
        return q

    def rest(self) -> str:
        start = self.t.start
        while self.t.kind != "end" and not self.is_(";"):
            self.next()
        return self.sql[start : self.toks[self.i - 1].end]

    def insert(self) -> n.Node:
        self.next()
        if self.any_("ALL", "FIRST"):
            return self.insert_all()
        over = self.next().word == "OVERWRITE"
        self.take("TABLE")
        table = self.path()
        columns = self.idents() if self.is_("(") and not self.peek().word in ("SELECT", "WITH", "VALUES") else []
        self.take("DEFAULT")
        return n.Insert(table, columns, self.query(), over)

    def insert_all(self) -> n.InsertAll:
        first, targets, cond = self.next().word == "FIRST", [], None
        while not (self.any_("SELECT", "WITH") or self.is_("(")):
            if self.take("WHEN"):
                cond = self.expr()
                self.need("THEN")
            elif self.take("ELSE"):
                cond = n.Lit("bool", True)
            else:
                self.need("INTO")
                table, columns, values = self.path(), [], []
                if self.is_("("):
                    columns = self.idents()
                if self.take("VALUES", "("):
                    values = self.list_of(self.expr)
                    self.need(")")
                targets.append((cond, table, columns, values))
        return n.InsertAll(targets, self.query(), first)

    def create_function(self) -> n.CreateFunction:
        self.next()
        self.take("IF", "NOT", "EXISTS")
        name, args, returns = self.path(), [], None
        self.need("(")
        while not self.take(")"):
            arg = self.ident()
            args.append((arg, None if self.any_(",", ")") else self.type_()))
            self.take(",")
        while True:
            if self.take("RETURNS"):
                returns = self.type_()
            elif self.any_("DETERMINISTIC", "IMMUTABLE", "STABLE", "VOLATILE", "STRICT"):
                self.next()
            elif self.take("LANGUAGE"):
                if self.next().word != "SQL":
                    raise self.fail("LANGUAGE SQL")
            else:
                break
        self.take("AS")
        self.take("RETURN")
        if self.t.kind == "string":  # a quoted body
            body = parse_one(re.sub(r"^\s*SELECT\s+", "", self.next().value, flags=re.I).join(("SELECT ", "")), self.d.name).body.items[0]
            self.take("LANGUAGE", "SQL")
        else:
            body = self.expr()
        return n.CreateFunction(name, args, returns, body)

    def assignments(self) -> list[tuple[str, n.Node]]:
        def one() -> tuple[str, n.Node]:
            name = self.path()[-1]
            self.need("=")
            return name, self.expr()

        return self.list_of(one)

    def target(self) -> n.Table:
        t = n.Table(self.path())
        t.alias = self.alias(RESERVED | {"SET", "USING", "WHERE"})
        return t

    def update(self) -> n.Update:
        self.next()
        table = self.target()
        self.need("SET")
        sets = self.assignments()
        source = self.from_list() if self.take("FROM") else None
        return n.Update(table, sets, source, self.expr() if self.take("WHERE") else None)

    def delete(self) -> n.Delete:
        self.next()
        self.take("FROM")
        table = self.target()
        using = self.from_list() if self.take("USING") else None
        return n.Delete(table, using, self.expr() if self.take("WHERE") else None)

    def merge(self) -> n.Merge:
        self.next()
        self.take("INTO")
        table = self.target()
        self.need("USING")
        source = self.relation()
        self.need("ON")
        on, clauses = self.expr(), []
        while self.take("WHEN"):
            matched = not self.take("NOT")
            self.need("MATCHED")
            by_source = False
            if self.take("BY"):
                by_source = self.next().word == "SOURCE"
            cond = self.expr() if self.take("AND") else None
            self.need("THEN")
            if self.take("DELETE"):
                clauses.append((matched, by_source, cond, "DELETE", None))
            elif self.take("UPDATE"):
                self.need("SET")
                clauses.append((matched, by_source, cond, "UPDATE", None if self.take("*") else self.assignments()))
            else:
                self.need("INSERT")
                columns = self.idents() if self.is_("(") else []
                if self.take("*"):
                    clauses.append((matched, by_source, cond, "INSERT", None))
                    continue
                self.need("VALUES", "(")
                values = self.list_of(self.expr)
                self.need(")")
                clauses.append((matched, by_source, cond, "INSERT", (columns, values)))
        return n.Merge(table, source, on, clauses)

    def create(self) -> n.Node:
        start = self.i
        self.next()
        replace = self.take("OR", "REPLACE")
        temporary = self.any_("TEMP", "TEMPORARY", "GLOBAL", "LOCAL", "VOLATILE")
        while self.any_("TEMP", "TEMPORARY", "GLOBAL", "LOCAL", "VOLATILE"):
            self.next()
        self.take("MATERIALIZED")
        kind = self.t.word
        if kind in ("FUNCTION", "MACRO"):
            return self.create_function()
        if kind not in ("TABLE", "VIEW"):
            self.i = start
            return n.Command("CREATE", self.rest())
        self.next()
        exists = self.take("IF", "NOT", "EXISTS")
        name, columns = self.path(), []
        if self.is_("("):
            self.next()
            while not self.is_(")"):
                if self.t.word in ("PRIMARY", "FOREIGN", "UNIQUE", "CONSTRAINT", "CHECK", "KEY", "INDEX"):
                    self.skip_item()
                elif kind == "VIEW":
                    columns.append((self.ident(), None, True))
                else:
                    own, type_, null = self.ident(), self.type_(), True
                    mark = self.i
                    self.skip_item()
                    words = [t.word for t in self.toks[mark : self.i]]
                    null = not any(a == "NOT" and b == "NULL" for a, b in zip(words, words[1:], strict=False)) and "PRIMARY" not in words
                    columns.append((own, type_, null))
                if not self.take(","):
                    break
            self.need(")")
        query = None
        while self.t.kind != "end" and not self.is_(";"):  # options are the writer's business
            if self.take("AS") or self.t.word in ("SELECT", "WITH"):
                query = self.query()
                break
            self.next()
        while self.t.kind != "end" and not self.is_(";"):
            self.next()
        return n.Create(kind, name, query, columns, temporary, exists, replace)

    def skip_item(self) -> None:
        depth = 0
        while self.t.kind != "end" and not (depth == 0 and self.any_(",", ")")):
            depth += self.is_("(") - self.is_(")")
            self.next()

    def copy(self) -> n.Node:
        self.next()
        if self.take("("):
            source: n.Node = self.query()
            self.need(")")
        else:
            source = n.Table(self.path())
            if self.is_("("):
                self.idents()
        into = self.t.word == "FROM"
        if not self.take("TO") and not self.take("FROM"):
            raise self.fail("TO or FROM")
        path, options = self.next().value, {}
        self.take("WITH")
        if self.take("("):
            while not self.take(")"):
                key = self.ident().upper()
                self.take("=")
                options[key] = (self.next().value or self.toks[self.i - 1].text) if not self.any_(",", ")") else "true"
                self.take(",")
        kind = options.pop("FORMAT", path.rsplit(".", 1)[-1]).lower()
        return n.Copy(source, path, kind, options, into)

    # queries

    def ctes(self) -> tuple[list[n.CTE], bool]:
        self.need("WITH")
        recursive = self.take("RECURSIVE")

        def one() -> n.CTE:
            name = self.ident()
            columns = self.idents() if self.is_("(") else []
            if self.take("USING", "KEY"):
                raise UnsupportedSQL("USING KEY", (self.t.start, self.t.end))
            self.need("AS")
            how = "NOT" if self.take("NOT", "MATERIALIZED") else "YES" if self.take("MATERIALIZED") else ""
            self.need("(")
            query = self.query()
            self.need(")")
            return n.CTE(name, columns, query, how)

        return self.list_of(one), recursive

    def query(self) -> n.Query:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise SQLSyntaxError("nested too deeply", self.sql, self.t.start)
        start = self.t.start
        ctes, recursive = self.ctes() if self.is_("WITH") else ([], False)
        q = n.Query(self.set_query(), ctes, recursive)
        if isinstance(q.body, n.Query) and not q.body.parenthesised and not ctes:
            q = q.body
        self.tail(q)
        if self.is_("|>"):
            at = self.t.start
            depth = 0
            while self.t.kind != "end" and not (depth == 0 and self.any_(")", ";")):
                depth += self.is_("(") - self.is_(")")
                self.next()
            q.pipes = self.sql[at : self.toks[self.i - 1].end]
        self.depth -= 1
        q.span = (start, self.toks[self.i - 1].end)
        return q

    def set_query(self) -> n.Node:
        left = self.set_term()
        while self.any_("UNION", "EXCEPT", "MINUS") or self.any_("LEFT", "INNER", "FULL") and self.peek().word in ("UNION", "EXCEPT") or self.any_("OUTER") and self.peek().word == "UNION":
            left = self.set_op(left, self.set_term)
        return left

    def set_term(self) -> n.Node:
        left = self.query_primary()
        while self.any_("INTERSECT"):
            left = self.set_op(left, self.query_primary)
        return left

    def set_op(self, left: n.Node, side) -> n.Node:
        prefix = self.next().word if self.any_("LEFT", "INNER", "FULL", "OUTER") else ""
        op = {"MINUS": "EXCEPT"}.get(w := self.next().word, w)
        every = self.take("ALL")
        if not every:
            self.take("DISTINCT")
        by_name = "FULL" if self.take("BY", "NAME") or self.take("CORRESPONDING") else ""
        if by_name and prefix in ("INNER", "LEFT"):
            by_name = prefix
        if by_name and self.take("BY"):
            self.idents()
        return n.SetOp(op, left, side(), every, by_name)

    def query_primary(self) -> n.Node:
        if self.is_("("):
            self.next()
            q = self.query()
            self.need(")")
            q.parenthesised = True
            return q
        if self.is_("VALUES") or self.is_("VALUE"):
            return self.values()
        if self.take("TABLE"):
            return n.Select([n.Star()], n.Table(self.path()))
        if self.is_("FROM"):
            self.next()
            source = self.from_list()
            if not self.is_("SELECT"):
                return self.select_tail(n.Select([n.Star()], source))
            s = self.select_head()
            s.source = source
            return self.select_tail(s)
        if self.is_("WITH"):
            return self.query()
        if self.any_("PIVOT", "UNPIVOT"):
            return n.Select([n.Star()], self.pivot_statement())
        if not self.is_("SELECT") and not self.is_("SEL"):
            raise self.fail("a query")
        s = self.select_head()
        if self.take("FROM"):
            s.source = self.from_list()
        return self.select_tail(s)

    def values(self) -> n.Values:
        self.next()

        def row() -> list[n.Node]:
            if self.take("ROW") or self.is_("("):
                self.need("(")
                out = self.list_of(self.expr)
                self.need(")")
                return out
            return [self.expr()]

        return n.Values(self.list_of(row))

    def select_head(self) -> n.Select:
        self.next()
        s = n.Select([])
        if self.take("DISTINCT") or self.take("UNIQUE"):
            s.distinct = True
            if self.take("ON"):
                self.need("(")
                s.distinct, s.distinct_on = False, self.list_of(self.expr)
                self.need(")")
        else:
            self.take("ALL")
        if self.take("AS", "STRUCT"):
            s.as_struct = "STRUCT"
        elif self.take("AS", "VALUE"):
            s.as_struct = "VALUE"
        if self.is_("TOP") and (self.peek().kind in ("number", "param") or self.peek().text == "("):
            self.next()
            count = self.primary()
            percent = self.take("PERCENT")
            s.top = (count, percent, self.take("WITH", "TIES"))
        s.items = self.list_of(self.select_item, "FROM")
        if self.take("INTO"):
            self.any_("TEMP", "TEMPORARY") and self.next()
            self.take("TABLE")
            name = self.path() if not self.is_("#") else [self.next().text and self.ident()]
            s.into = n.Table(name)
        return s

    def select_item(self) -> n.Node:
        start = self.t.start
        if self.t.kind in ("word", "quoted") and self.peek().text == ":" and self.d.name == "duckdb":  # name: value
            name = self.ident()
            self.next()
            return n.Alias(self.expr(), name)
        x = self.expr()
        if self.d.name == "tsql" and isinstance(x, n.Bin) and x.op == "=" and isinstance(x.left, n.Name) and len(x.left.parts) == 1 and not self.is_("AS"):
            return n.Alias(x.right, x.left.parts[0])
        if self.take("AS"):
            if self.is_("("):
                return n.Alias(x, "", self.idents())
            return n.Alias(x, self.ident("an alias"), span=(start, self.t.start))
        if self.t.kind in ("quoted", "string") or self.t.kind == "word" and self.t.word not in RESERVED:
            return n.Alias(x, self.ident(), span=(start, self.t.start))
        return x

    def select_tail(self, s: n.Select) -> n.Select:
        while True:
            if self.take("PREWHERE") or self.take("WHERE"):
                c = self.expr()
                s.where = c if s.where is None else n.Bin("AND", s.where, c)
            elif self.is_("START", "WITH") or self.is_("CONNECT", "BY"):
                self.connect(s)
            elif self.take("GROUP", "BY"):
                self.group_by(s)
            elif self.take("HAVING"):
                s.having = self.expr()
            elif self.take("QUALIFY"):
                s.qualify = self.expr()
            elif self.is_("WINDOW") and self.peek(2).word == "AS":
                self.next()

                def one() -> tuple[str, n.Window]:
                    name = self.ident()
                    self.need("AS")
                    return name, self.window()

                s.windows = self.list_of(one)
            else:
                return s

    def connect(self, s: n.Select) -> None:
        first = None
        if self.take("START", "WITH"):
            first = self.expr()
        self.need("CONNECT", "BY")
        nocycle = self.take("NOCYCLE")
        cond = self.expr()
        if self.take("START", "WITH"):
            first = self.expr()
        s.connect = (first, cond, nocycle)

    def group_by(self, s: n.Select) -> None:
        if self.take("ALL"):
            s.group_all = True
        else:
            s.group_distinct = self.take("DISTINCT")
            s.group = self.list_of(self.group_item)
        if self.is_("WITH") and self.peek().word in ("ROLLUP", "CUBE", "TOTALS"):
            self.next()
            s.with_total = self.next().word

    def group_item(self) -> n.Node:
        if self.any_("ROLLUP", "CUBE") and self.peek().text == "(":
            kind = self.next().word
        elif self.take("GROUPING", "SETS"):
            kind = "SETS"
        else:
            return self.expr()
        self.need("(")
        items = self.list_of(self.group_item)
        self.need(")")
        return n.Grouping(kind, items)

    def tail(self, q: n.Query) -> None:
        while True:
            if self.take("ORDER", "BY") or self.take("ORDER", "SIBLINGS", "BY"):
                if self.take("ALL"):
                    q.order_all = True
                    q.order = [self.order_mark(n.Raw("ALL"))]
                else:
                    q.order = self.list_of(self.order_item)
                    if self.take("WITH", "FILL"):
                        q.fill = n.Fill()
                        for word, slot in (("FROM", "low"), ("TO", "high"), ("STEP", "step")):
                            if self.take(word):
                                setattr(q.fill, slot, self.expr())
            elif self.any_("SORT", "DISTRIBUTE", "CLUSTER") and self.peek().word == "BY":
                word = self.next().word
                self.next()
                q.sort[word] = self.list_of(self.order_item)
            elif self.take("LIMIT"):
                if self.take("ALL"):
                    continue
                first = self.expr()
                if self.take(","):
                    q.offset, q.limit = first, self.expr()
                elif self.take("BY"):
                    q.limit_by = [first, *self.list_of(self.expr)]
                else:
                    q.limit = first
                    q.percent = self.take("%") or self.take("PERCENT")
                    if isinstance(q.limit, n.Bin) and q.limit.op == "%" and q.limit.right is None:
                        q.percent = True
                    q.ties = self.take("WITH", "TIES")
                    if self.take("BY"):
                        q.limit_by, q.limit = [first, *self.list_of(self.expr)], None
            elif self.take("OFFSET"):
                q.offset = self.expr()
                self.any_("ROW", "ROWS") and self.next()
            elif self.take("FETCH"):
                self.any_("FIRST", "NEXT") and self.next()
                q.limit = n.Lit("number", "1") if self.any_("ROW", "ROWS") else self.primary()
                q.percent = self.take("PERCENT")
                self.any_("ROW", "ROWS") and self.next()
                if not self.take("ONLY"):
                    self.need("WITH", "TIES")
                    q.ties = True
            elif self.is_("FOR") and self.peek().word == "JSON":
                self.i += 2
                q.json = self.next().word
                if self.is_(","):
                    raise UnsupportedSQL("options of FOR JSON", (self.t.start, self.t.end))
            elif self.take("INTERPOLATE"):
                if q.fill is None:
                    raise self.fail("WITH FILL before INTERPOLATE")
                self.need("(")
                while not self.take(")"):
                    column = self.ident()
                    q.fill.interpolate.append((column, self.expr() if self.take("AS") else None))
                    self.take(",")
            elif self.is_("FOR") and self.peek().word in ("UPDATE", "SHARE", "NO", "KEY"):
                self.next()
                while self.t.kind == "word":
                    self.next()
            elif self.any_("SETTINGS", "OPTION", "FORMAT") and self.t.kind == "word" and not isinstance(q.body, n.Values):
                while self.t.kind != "end" and not self.any_(")", ";"):
                    self.next()
            else:
                return

    def order_item(self) -> n.OrderItem:
        return self.order_mark(self.expr())

    def order_mark(self, x: n.Node) -> n.OrderItem:
        desc = self.take("DESC")
        explicit = desc or self.take("ASC")
        nulls = ""
        if self.take("NULLS"):
            nulls = self.next().word
        return n.OrderItem(x, desc, nulls, explicit)

    # relations

    def from_list(self) -> n.Node:
        rel = self.joined()
        while self.is_(","):
            self.next()
            rel = n.Join(rel, self.joined(), "CROSS")
        return rel

    def joined(self) -> n.Node:
        rel = self.relation()
        pending: list[n.Join] = []
        while True:
            if self.is_("LATERAL", "VIEW"):
                self.i += 2
                outer = self.take("OUTER")
                fn = self.primary()
                alias = "" if self.is_("AS") else self.ident()
                columns = self.list_of(self.ident) if self.take("AS") else []
                rel = n.LateralView(rel, fn, outer, alias, columns)
                continue
            apply = self.any_("CROSS", "OUTER") and self.peek().word == "APPLY"
            if apply:
                kind = "CROSS" if self.next().word == "CROSS" else "LEFT"
                self.next()
                side = self.relation()
                side.lateral = True
                rel = n.Join(rel, side, kind, None if kind == "CROSS" else n.Lit("bool", True))
                continue
            if self.t.word not in JOIN_WORDS or not self.join_ahead():
                if self.is_("ON") and pending:  # a delayed condition belongs to an earlier join
                    self.next()
                    j = pending.pop()
                    j.on = self.expr()
                    continue
                return rel
            kind, natural, strictness = self.join_kind()
            if kind == "ARRAY":
                items = self.list_of(self.select_item)
                rel = n.LateralView(rel, n.Fn("ARRAY_JOIN", items), strictness == "LEFT")
                continue
            right = self.relation()
            j = n.Join(rel, right, kind, natural=natural, strictness=strictness)
            if self.take("ON"):
                j.on = self.expr()
            elif self.is_("USING"):
                self.next()
                j.using = self.idents() if self.is_("(") else self.list_of(self.ident)
            elif self.take("MATCH_CONDITION"):
                self.need("(")
                j.on = self.expr()
                self.need(")")
                if self.take("ON"):
                    j.on = n.Bin("AND", self.expr(), j.on)
                elif self.take("USING"):
                    j.using = self.idents()
            elif kind in ("INNER", "LEFT", "RIGHT", "FULL") and not natural and self.join_ahead(True):
                right2, _ = self.delayed(right)
                j.right = right2
                self.need("ON")
                j.on = self.expr()
            rel = j

    def delayed(self, left: n.Node) -> tuple[n.Node, bool]:
        """a JOIN b JOIN c ON … ON …: joins to the right whose condition comes first."""
        kind, natural, strictness = self.join_kind()
        right = self.relation()
        if self.t.word in JOIN_WORDS and self.join_ahead():
            right, _ = self.delayed(right)
        self.need("ON")
        return n.Group(n.Join(left, right, kind, self.expr(), natural=natural, strictness=strictness)), True

    def join_ahead(self, only: bool = False) -> bool:
        for k in range(5):
            w = self.peek(k).word
            if w in ("JOIN", "STRAIGHT_JOIN"):
                return True
            if w not in JOIN_WORDS | {"HASH", "LOOP", "MERGE", "REMOTE"}:
                return False
        return False

    def join_kind(self) -> tuple[str, bool, str]:
        words = []
        while not self.any_("JOIN", "STRAIGHT_JOIN"):
            words.append(self.next().word)
        if self.next().word == "STRAIGHT_JOIN":
            return "INNER", False, ""
        if "ARRAY" in words:
            return "ARRAY", False, "LEFT" if "LEFT" in words else ""
        strict = next((w for w in words if w in ("ANY", "ALL")), "")
        natural = "NATURAL" in words
        side = next((w for w in words if w in ("LEFT", "RIGHT", "FULL", "CROSS")), "")
        for special in ("ASOF", "POSITIONAL", "PASTE"):
            if special in words:
                return ("POSITIONAL" if special == "PASTE" else special) + (f" {side}" if side else ""), natural, strict
        for special in ("SEMI", "ANTI"):
            if special in words:
                return ("RIGHT " if side == "RIGHT" else "") + special, natural, strict
        return side or "INNER", natural, strict

    def relation(self) -> n.Node:
        start = self.t.start
        rel = self.relation_primary()
        while True:
            if self.is_("PIVOT") or self.is_("UNPIVOT"):
                rel = self.pivot(rel)
            elif self.is_("MATCH_RECOGNIZE"):
                rel = self.match_recognize(rel)
            elif self.any_("TABLESAMPLE", "SAMPLE") or self.is_("USING", "SAMPLE"):
                rel.sample = self.sample()
            else:
                break
        rel.span = (start, self.toks[self.i - 1].end)
        return rel

    def sample(self) -> n.Sample:
        if self.take("USING"):
            pass
        self.next()
        self.any_("BERNOULLI", "SYSTEM", "RESERVOIR") and self.next()
        paren = self.take("(")
        size = self.primary()
        unit = "PERCENT"
        if self.any_("PERCENT", "ROWS", "ROW", "%"):
            unit = "ROWS" if self.next().word in ("ROWS", "ROW") else "PERCENT"
        if paren:
            self.need(")")
        seed = None
        if self.any_("REPEATABLE", "SEED"):
            self.next()
            self.need("(")
            seed = self.expr()
            self.need(")")
        return n.Sample(size, unit, seed)

    def relation_alias(self, rel: n.Node) -> n.Node:
        rel.alias = self.alias(RESERVED | {"TABLESAMPLE", "SAMPLE", "PIVOT", "UNPIVOT", "MATCH_CONDITION", "WHEN", "SET", "USING"} | JOIN_WORDS)
        if rel.alias and self.is_("(") and hasattr(rel, "columns"):
            self.next()
            rel.columns = []
            while not self.take(")"):
                rel.columns.append(self.ident())
                if not self.any_(",", ")"):  # a column definition: its type
                    self.type_()
                self.take(",")
        return rel

    def relation_primary(self) -> n.Node:
        lateral = self.take("LATERAL")
        if self.is_("("):
            if self.subquery_ahead():
                self.next()
                q = self.query()
                self.need(")")
                return self.relation_alias(n.Derived(q, lateral=lateral))
            self.next()
            rel = self.from_list()
            self.need(")")
            return self.relation_alias(n.Group(rel))
        if self.t.kind == "string":
            t = self.next()
            return self.relation_alias(n.FileTable(t.value, t.value.rsplit(".", 1)[-1].lower()))
        if self.is_("VALUES"):
            return self.relation_alias(n.Derived(n.Query(self.values()), lateral=lateral))
        if self.is_("TABLE") and self.peek().text == "(":
            self.i += 2
            fn = self.expr()
            self.need(")")
            return self.relation_alias(n.TableFn(fn, lateral=True))
        mark = self.i
        if self.t.kind in ("word", "quoted"):
            name = self.ident()
            if self.is_("("):
                self.i = mark
                return self.table_function(lateral)
            self.i = mark
        if self.t.kind == "param":
            raise UnsupportedSQL(f"table parameter {self.t.text}", (self.t.start, self.t.end))
        parts = self.path()
        table = n.Table(parts)
        if self.any_("TIMESTAMP", "VERSION") and self.peek().word == "AS" or self.is_("FOR") and self.peek().word in ("SYSTEM_TIME", "VERSION", "TIMESTAMP") or self.any_("AT", "BEFORE") and self.peek().text == "(":
            raise UnsupportedSQL("time travel without a versioned catalog", (self.t.start, self.t.end))
        self.take("FINAL")
        if self.take("WITH", "("):  # table hints
            while not self.take(")"):
                self.next()
        self.relation_alias(table)
        if self.take("WITH", "("):
            while not self.take(")"):
                self.next()
        if self.any_("USE", "FORCE", "IGNORE") and self.peek().word in ("INDEX", "KEY"):
            self.i += 2
            self.idents()
        return table

    def json_shape(self) -> list[tuple]:
        """Column definitions of JSON_TABLE and OPENJSON, to the closing parenthesis."""
        shape = []
        while not self.take(")"):
            name = self.ident()
            if self.take("FOR", "ORDINALITY"):
                shape.append((name, None, "", "ordinality"))
            else:
                kind, path, what = self.type_(), f"$.{name}", "value"
                self.take("PATH")
                if self.t.kind == "string":
                    path = self.next().value
                if self.take("AS", "JSON"):
                    what = "json"
                if not self.any_(",", ")"):
                    raise UnsupportedSQL("this column of a JSON table", (self.t.start, self.t.end))
                shape.append((name, kind, path, what))
            self.take(",")
        return shape

    def json_table(self, lateral: bool) -> n.Node:
        name = self.next().word
        self.need("(")
        fn, shape = n.Fn(name, [self.expr()]), None
        if self.take(","):
            fn.args.append(self.expr())
        if name == "JSON_TABLE":
            self.need("COLUMNS", "(")
            shape = self.json_shape()
        self.need(")")
        if name == "OPENJSON" and self.take("WITH", "("):
            shape = self.json_shape()
        return self.relation_alias(n.TableFn(fn, lateral=True, shape=shape))

    def table_function(self, lateral: bool) -> n.Node:
        if self.any_("JSON_TABLE", "OPENJSON") and self.peek().text == "(":
            return self.json_table(lateral)
        name = self.t.word
        fn = self.primary()
        if isinstance(fn, n.Fn) and fn.name in ("READ_PARQUET", "PARQUET_SCAN", "READ_CSV", "READ_CSV_AUTO", "READ_JSON", "READ_JSON_AUTO", "READ_NDJSON", "READ_ORC", "READ_TEXT"):
            kind = fn.name.replace("PARQUET_SCAN", "READ_PARQUET").split("_")[1].lower()
            options = {a.name.lower(): a.x.value for a in fn.args if isinstance(a, n.Named) and isinstance(a.x, n.Lit)}
            return self.relation_alias(n.FileTable(fn.args[0].value, {"ndjson": "json"}.get(kind, kind), options))
        rel = n.TableFn(fn, lateral=lateral)
        if self.take("WITH", "ORDINALITY"):
            rel.ordinality = "ORDINALITY"
        self.relation_alias(rel)
        if self.take("WITH", "ORDINALITY"):
            rel.ordinality = "ORDINALITY"
        if self.take("WITH", "OFFSET"):
            rel.ordinality = "OFFSET"
            rel.offset_alias = self.alias() or "offset"
        del name
        return rel

    def subquery_ahead(self) -> bool:
        k = 0
        while self.peek(k).text == "(" and self.peek(k).kind == "op":
            k += 1
        return self.peek(k).word in ("SELECT", "WITH", "VALUES", "FROM", "TABLE", "PIVOT", "UNPIVOT") and self.closes_query(k)

    def closes_query(self, k: int) -> bool:
        """((select …) x join …) is a group, ((select …) union …) a query."""
        if k == 1:
            return True
        depth, j = 0, 0
        while self.peek(j).kind != "end":
            t = self.peek(j)
            depth += (t.kind == "op") * ((t.text == "(") - (t.text == ")"))
            if depth == 1 and t.text == ")" and t.kind == "op":
                after = self.peek(j + 1)
                return after.text == ")" or after.word in ("UNION", "INTERSECT", "EXCEPT", "MINUS", "ORDER", "LIMIT")
            j += 1
        return True

    def pivot(self, rel: n.Node) -> n.Node:
        if self.next().word == "UNPIVOT":
            return self.unpivot(rel)
        self.need("(")
        aggs = self.list_of(self.select_item)
        self.need("FOR")
        on = [n.Tuple([n.Name([x]) for x in self.idents()])] if self.is_("(") else [n.Name(self.path())]
        self.need("IN", "(")
        values = [] if self.take("ANY") else self.list_of(self.select_item)
        self.need(")")
        group = self.list_of(self.expr) if self.take("GROUP", "BY") else []
        self.need(")")
        return self.relation_alias(n.Pivot(rel, aggs, on, values, group))

    def pivot_statement(self) -> n.Node:
        if self.next().word == "UNPIVOT":
            rel = self.relation()
            self.need("ON")
            columns = [(x.x, x.name) if isinstance(x, n.Alias) else (x, None) for x in self.list_of(self.select_item)]
            name, value = "name", "value"
            if self.take("INTO"):
                self.need("NAME")
                name = self.ident()
                self.need("VALUE")
                value = self.ident()
            return n.Unpivot(rel, value, name, columns)
        rel = self.relation()
        on: list[n.Node] = []
        values: list[n.Node] = []
        if self.take("ON"):
            x = self.expr()
            if isinstance(x, n.In):
                on, values = [x.x], x.items
            else:
                on = [x]
        aggs = self.list_of(self.select_item) if self.take("USING") else [n.Fn("COUNT", [n.Star()])]
        group = self.list_of(self.expr) if self.take("GROUP", "BY") else []
        return n.Pivot(rel, aggs, on, values, group, alias="")

    def unpivot(self, rel: n.Node) -> n.Node:
        nulls = self.take("INCLUDE", "NULLS")
        if not nulls:
            self.take("EXCLUDE", "NULLS")
        self.need("(")
        value = self.ident()
        self.need("FOR")
        name = self.ident()
        self.need("IN", "(")

        def one() -> tuple[n.Node, str | None]:
            x = self.expr()
            if self.take("AS"):
                return x, self.next().value or self.toks[self.i - 1].text
            return x, None

        columns = self.list_of(one)
        self.need(")")
        self.need(")")
        return self.relation_alias(n.Unpivot(rel, value, name, columns, nulls))

    def match_recognize(self, rel: n.Node) -> n.Node:
        self.next()
        self.need("(")
        m = n.MatchRecognize(rel, [], [], [], "", [])
        while not self.take(")"):
            if self.take("PARTITION", "BY"):
                m.partition = self.list_of(self.expr)
            elif self.take("ORDER", "BY"):
                m.order = self.list_of(self.order_item)
            elif self.take("MEASURES"):

                def measure() -> tuple[n.Node, str]:
                    x = self.expr()
                    self.need("AS")
                    return x, self.ident()

                m.measures = self.list_of(measure)
            elif self.any_("ONE", "ALL") and self.peek().word in ("ROW", "ROWS"):
                m.rows = self.next().word
                while not self.take("MATCH"):
                    self.next()
            elif self.take("AFTER", "MATCH", "SKIP"):
                words = []
                while not self.any_("PATTERN", "DEFINE", "SUBSET"):
                    words.append(self.next().word)
                m.after = " ".join(words)
            elif self.take("PATTERN"):
                at = self.t.end
                depth = 0
                while True:
                    depth += self.is_("(") - self.is_(")")
                    t = self.next()
                    if not depth:
                        break
                m.pattern = self.sql[at : t.start]
            elif self.take("DEFINE"):

                def define() -> tuple[str, n.Node]:
                    name = self.ident()
                    self.need("AS")
                    return name, self.expr()

                m.define = self.list_of(define)
            else:
                raise self.fail("a clause of MATCH_RECOGNIZE")
        return self.relation_alias(m)

    # expressions

    def expr(self, least: int = 0) -> n.Node:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise SQLSyntaxError("nested too deeply", self.sql, self.t.start)
        start = self.t.start
        left = self.prefix(least)
        while (right := self.infix(left, least)) is not None:
            left = right
            left.span = (start, self.toks[self.i - 1].end)
        self.depth -= 1
        return left

    def prefix(self, least: int) -> n.Node:
        if self.is_("NOT") and not self.is_("NOT", "("):
            self.next()
            return n.Un("NOT", self.expr(4))
        if self.take("NOT"):
            return n.Un("NOT", self.expr(4))
        if self.any_("-", "+", "~") and self.t.kind == "op":
            op = self.next().text
            return n.Un(op, self.expr(12))
        if self.any_("PRIOR", "CONNECT_BY_ROOT") and self.peek().kind in ("word", "quoted"):
            word = self.next().word
            return n.Un(word, self.expr(12))
        return self.postfix(self.primary())

    def infix(self, left: n.Node, least: int) -> n.Node | None:
        t = self.t
        op = t.word if t.kind == "word" else t.text if t.kind in ("op", "param") else ""
        if not op:
            return None
        if op in ("OR", "AND", "XOR") and BINARY[op] > least:
            self.next()
            return n.Bin(op, left, self.expr(BINARY[op]))
        if least < 5:
            found = self.comparison(left, op)
            if found is not None:
                return found
        if op == "?" and self.d.name == "clickhouse" and least < 1:
            self.next()
            then = self.expr(1)
            self.need(":")
            return n.Case(None, [(left, then)], self.expr())
        if op in ("->", "->>", "#>", "#>>", "@>", "<@", "&&", "?|", "?&", "<->", "@@", "#-") and least < 8:
            if op == "->" and isinstance(left, (n.Name, n.Tuple)) and self.peek().kind not in ("string", "number"):
                self.next()
                names = [left.parts[0]] if isinstance(left, n.Name) else [x.parts[0] for x in left.items]
                return n.Lambda(names, self.expr())
            self.next()
            return n.Bin(op, left, self.expr(8))
        if op == "=>" or op == ":=":
            if isinstance(left, n.Name) and len(left.parts) == 1:
                self.next()
                return n.Named(left.parts[0], self.expr())
            return None
        if op == "OPERATOR" and self.peek().text == "(" and least < 8:  # OPERATOR(schema.op)
            self.i += 2
            while self.t.kind != "op" or self.is_("."):
                self.next()
            own = self.next().text
            self.need(")")
            return n.Bin(own, left, self.expr(8))
        if op in BINARY and BINARY[op] > least and not (op == "MOD" and self.peek().text == "("):
            if op == "%" and self.peek().kind == "end" or op == "#" and self.d.name not in ("postgresql", "duckdb", "materialize", "generic"):
                return None
            if op == "DIV" and self.d.name in ("tsql",):
                return None
            self.next()
            return n.Bin({"MOD": "%"}.get(op, op), left, self.expr(BINARY[op]))
        return None

    def comparison(self, left: n.Node, op: str) -> n.Node | None:
        negated = False
        if op == "NOT" and self.peek().word in ("IN", "LIKE", "ILIKE", "BETWEEN", "RLIKE", "REGEXP", "SIMILAR", "GLOB", "NULL"):
            self.next()
            negated, op = True, self.t.word
            if op == "NULL":
                self.next()
                return n.Is(left, "NULL", True)
        wrap = (lambda x: n.Un("NOT", x)) if negated else (lambda x: x)
        if op in COMPARE or op in WORD_COMPARE and self.d.name == "teradata":
            self.next()
            op = WORD_COMPARE.get(op, {"==": "=", "!=": "<>", "^=": "<>"}.get(op, op))
            if self.any_("ANY", "ALL", "SOME") and self.peek().text == "(":
                return n.Bin(op, left, self.quantified())
            return n.Bin(op, left, self.expr(5))
        if op in ("~", "~*", "!~", "!~*"):
            self.next()
            return n.Bin(op, left, self.expr(5))
        if op in ("LIKE", "ILIKE", "GLOB", "RLIKE", "REGEXP", "SIMILAR"):
            self.next()
            if op == "SIMILAR":
                self.need("TO")
                op = "SIMILAR TO"
            op = "RLIKE" if op == "REGEXP" else op
            if self.any_("ANY", "ALL", "SOME") and self.peek().text == "(":
                op += " " + {"SOME": "ANY"}.get(w := self.next().word, w)
                self.next()
                items = self.list_of(self.expr)
                self.need(")")
                return wrap(n.Bin(op, left, n.Tuple(items)))
            right = self.expr(5)
            return wrap(n.Bin(op, left, right, self.expr(5) if self.take("ESCAPE") else None))
        if op == "IN":
            self.next()
            if self.is_("UNNEST"):
                self.next()
                self.need("(")
                array = self.expr()
                self.need(")")
                return wrap(n.Fn("ARRAY_CONTAINS", [array, left]))
            if not self.is_("("):
                return wrap(n.Fn("ARRAY_CONTAINS", [self.expr(5), left]))
            if self.subquery_ahead():
                self.next()
                q = self.query()
                self.need(")")
                return n.In(left, [], negated, q)
            self.next()
            items = [] if self.is_(")") else self.list_of(self.expr, ")")
            self.need(")")
            return n.In(left, items, negated)
        if op == "BETWEEN":
            self.next()
            symmetric = self.take("SYMMETRIC")
            self.take("ASYMMETRIC")
            low = self.expr(5)
            self.need("AND")
            return n.Between(left, low, self.expr(5), negated, symmetric)
        if op == "IS":
            self.next()
            negated = self.take("NOT")
            if self.take("DISTINCT", "FROM"):
                same = n.Bin("<=>", left, self.expr(5))
                return same if negated else n.Un("NOT", same)
            if self.take("JSON"):
                self.any_("VALUE", "OBJECT", "ARRAY", "SCALAR") and self.next()
                valid = n.Is(n.Fn("TRY_PARSE_JSON", [left]), "NULL", not negated)
                return valid
            what = self.next().word
            if what not in ("NULL", "TRUE", "FALSE", "UNKNOWN"):
                raise self.fail("NULL, TRUE, FALSE or DISTINCT FROM")
            return n.Is(left, what, negated)
        if op in ("ISNULL", "NOTNULL"):
            self.next()
            return n.Is(left, "NULL", op == "NOTNULL")
        if op == "OVERLAPS":
            self.next()
            return n.Bin(op, left, self.expr(5))
        if op == "?" and self.d.name in ("postgresql", "materialize", "cockroachdb"):
            self.next()
            return n.Bin(op, left, self.expr(8))
        return None

    def quantified(self) -> n.Quant:
        word = {"SOME": "ANY"}.get(w := self.next().word, w)
        self.need("(")
        x = self.query() if self.any_("SELECT", "WITH", "VALUES", "FROM") else self.expr()
        self.need(")")
        return n.Quant(word, x)

    def postfix(self, x: n.Node) -> n.Node:
        while True:
            if self.is_("::") or self.is_("?::") or self.is_(":>"):
                safe = self.next().text == "?::"
                x = n.Cast(x, self.type_(), safe)
            elif self.is_("[") and not isinstance(x, n.Lit):
                self.next()
                low = None if self.is_(":") else self.expr()
                if self.take(":"):
                    hi = None if self.any_("]", ":") else self.expr()
                    x = n.Index(x, low, hi, True, None if not self.take(":") else self.expr())
                else:
                    x = n.Index(x, low)
                self.need("]")
            elif self.is_("AGAINST") and isinstance(x, n.Fn) and x.name == "MATCH":
                self.next()
                self.need("(")
                x = n.Fn("MATCH_AGAINST", [*x.args, self.primary()])
                if self.any_("IN", "WITH"):  # IN NATURAL LANGUAGE MODE
                    words = []
                    while not self.is_(")"):
                        words.append(self.next().word)
                    if words != ["IN", "NATURAL", "LANGUAGE", "MODE"]:
                        raise UnsupportedSQL(" ".join(words), (self.t.start, self.t.end))
                self.need(")")
            elif self.is_(".") and not isinstance(x, n.Lit):
                self.next()
                if self.take("*"):
                    x = self.star(x.parts if isinstance(x, n.Name) else [])
                    continue
                name = self.ident()
                if self.is_("("):  # a method: the value is the first argument
                    call = self.call(name)
                    call.args.insert(0, x)
                    x = call
                else:
                    x = n.Field(x, name)
            elif self.is_(":") and self.d.name in ("snowflake", "databricks", "spark") and isinstance(x, (n.Name, n.JsonPath, n.Fn)) and self.peek().kind in ("word", "quoted"):
                at = self.i
                self.next()
                path = self.ident()
                while self.is_(".") or self.is_("["):
                    if self.take("."):
                        path += "." + self.ident()
                    else:
                        self.next()
                        t = self.next()
                        path += f"[{t.text}]"
                        self.need("]")
                del at
                x = n.JsonPath(x, path)
            elif self.take("AT", "TIME", "ZONE"):
                x = n.AtZone(x, self.postfix(self.primary()))
            elif self.take("COLLATE"):
                x = n.Collate(x, ".".join(self.path()))
            elif self.is_("(") and self.peek().text == "+" and self.peek(2).text == ")":
                self.i += 3
                x = n.Fn("(+)", [x])
            else:
                return x

    def star(self, qualifier: list[str]) -> n.Star:
        s = n.Star(qualifier)
        while True:
            if self.any_("EXCEPT", "EXCLUDE") and (self.peek().text == "(" or self.is_("EXCLUDE") and self.peek().kind in ("word", "quoted")) and not self.peek(2).word == "SELECT":
                self.next()
                s.drop = [x.split(".")[-1] for x in self.idents()] if self.is_("(") else [self.ident()]
            elif self.is_("REPLACE") and self.peek().text == "(":
                self.i += 2

                def one() -> tuple[n.Node, str]:
                    x = self.expr()
                    self.need("AS")
                    return x, self.ident()

                s.swap = self.list_of(one)
                self.need(")")
            elif self.is_("RENAME"):
                self.next()
                paren = self.take("(")

                def pair() -> tuple[str, str]:
                    a = self.ident()
                    self.need("AS")
                    return a, self.ident()

                s.rename = self.list_of(pair) if paren else [pair()]
                if paren:
                    self.need(")")
            else:
                return s

    def primary(self) -> n.Node:
        t, start = self.t, self.t.start
        x = self.primary_()
        if x.span is None:
            x.span = (start, self.toks[max(self.i - 1, 0)].end)
        del t
        return x

    def primary_(self) -> n.Node:
        t = self.t
        if t.kind == "number":
            self.next()
            return n.Lit("hex" if t.text[:2].lower() == "0x" else "number", t.text.replace("_", ""))
        if t.kind == "string":
            self.next()
            if t.text[0] in "xX" and t.text[1] in "'\"":
                return n.Lit("hex", t.value)
            value = t.value
            while self.t.kind == "string" and self.d.name in ("postgresql", "mysql", "generic"):
                value += self.next().value
            return n.Lit("string", value)
        if t.kind == "param":
            self.next()
            return n.Param(t.text)
        if t.kind == "quoted":
            return self.named()
        if t.kind == "op":
            if t.text == "*":
                self.next()
                return self.star([])
            if t.text == "(":
                return self.parenthesised()
            if t.text == "[":
                self.next()
                items = [] if self.is_("]") else self.list_of(self.expr, "]")
                self.need("]")
                return n.ArrayLit(items)
            if t.text == "{":
                self.next()
                names, items = [], []
                while not self.take("}"):
                    names.append(self.next().value or self.toks[self.i - 1].text)
                    self.need(":")
                    items.append(self.expr())
                    self.take(",")
                return n.StructLit(names, items)
            raise self.fail("an expression")
        if t.kind != "word":
            raise self.fail("an expression")
        w = t.word
        follow = self.peek()
        if w == "LAMBDA" and follow.kind in ("word", "quoted") and self.d.name == "duckdb":
            self.next()
            names = self.list_of(self.ident)
            self.need(":")
            return n.Lambda(names, self.expr())
        if follow.kind == "op" and follow.text == "(" or w in ("CASE", "INTERVAL", "ARRAY", "MAP", "DATE", "TIME", "TIMESTAMP", "TIMESTAMPTZ", "DATETIME", "EXISTS", "STRUCT"):
            special = getattr(self, f"x_{w.lower()}", None)
            if special:
                found = special()
                if found is not None:
                    return found
        if w in ("NULL", "TRUE", "FALSE") and follow.text != "(":
            self.next()
            return n.Lit("null") if w == "NULL" else n.Lit("bool", w == "TRUE")
        if w in ("CURRENT_DATE", "CURRENT_TIMESTAMP", "CURRENT_TIME", "LOCALTIMESTAMP", "SYSDATE", "SYSTIMESTAMP", "CURRENT_USER", "SESSION_USER") and follow.text != "(":
            self.next()
            return n.Fn(w, [], bare=True)
        if w in RESERVED and follow.text != "(" and follow.text != "." and w not in ("FORMAT", "SETTINGS", "USE", "TOP", "FILTER", "KEEP", "OPTION", "START", "SORT", "CLUSTER", "ANY", "ALL", "SET", "VALUES", "LEFT", "RIGHT"):
            raise self.fail("an expression")
        if w in KIND and follow.kind == "string":
            self.next()
            return n.Typed(w, self.next().value)
        return self.named()

    def named(self) -> n.Node:
        parts, quoted = [], []
        while True:
            quoted.append(self.t.kind == "quoted")
            parts.append(self.ident())
            if self.is_("(") and not (self.peek().text == "+" and self.peek(2).text == ")"):
                if len(parts) > 1 and self.d.name != "bigquery" and parts[0].upper() not in ("SAFE", "NET", "DBO", "SYS"):
                    call = self.call(parts[-1])
                    call.args.insert(0, n.Name(parts[:-1], quoted[:-1]))
                    return call
                return self.call("_".join(parts) if parts[0].upper() in ("SAFE", "NET") else parts[-1])
            if self.is_(".") and self.peek().text == "*":
                self.i += 2
                return self.star(parts)
            if not self.is_(".") or self.peek().kind not in ("word", "quoted"):
                return n.Name(parts, quoted)
            self.next()

    def parenthesised(self) -> n.Node:
        if self.subquery_ahead():
            self.next()
            q = self.query()
            self.need(")")
            return n.Sub(q)
        self.need("(")
        if self.take(")"):
            return n.Tuple([])
        first = self.expr()
        if self.take("AS"):
            first = n.Alias(first, self.ident())
        if self.take(")"):
            return first
        self.need(",")
        items = [first, *([] if self.is_(")") else self.list_of(self.expr, ")"))]
        self.need(")")
        return n.Tuple(items)

    def call(self, name: str) -> n.Fn:
        self.need("(")
        f = n.Fn(name.upper())
        if self.take("DISTINCT"):
            f.distinct = True
        else:
            self.take("ALL")
        while not self.is_(")"):
            if self.any_("SELECT", "WITH") and self.subquery_word():
                f.args.append(n.Sub(self.query()))
            elif self.is_("ORDER", "BY"):
                self.i += 2
                f.order = self.list_of(self.order_item)
            elif self.take("SEPARATOR"):
                f.separator = self.expr()
            elif self.take("LIMIT"):
                f.limit = self.expr()
            elif self.any_("IGNORE", "RESPECT") and self.peek().word == "NULLS":
                f.nulls = self.next().word
                self.next()
            elif self.take("HAVING"):
                f.extreme = (self.next().word, self.expr())
            elif self.take("USING"):
                f.args.append(n.Named("USING", n.Lit("string", self.ident())))
            elif self.take("AS"):  # struct(x AS name)
                f.args[-1] = n.Alias(f.args[-1], self.ident())
            elif self.t.kind in ("word", "quoted") and f.args and not self.toks[self.i - 1].text == "," and f.name in ("STRUCT", "ROW"):
                f.args[-1] = n.Alias(f.args[-1], self.ident())
            else:
                f.args.append(self.expr())
            if not self.take(",") and self.t.kind == "end":
                raise self.fail(")")
            if not self.is_(")") and self.toks[self.i - 1].text != "," and not self.any_("ORDER", "SEPARATOR", "LIMIT", "IGNORE", "RESPECT", "HAVING", "USING", "AS") and f.name not in ("STRUCT", "ROW"):
                raise self.fail(") or ,")
        self.need(")")
        return self.call_tail(f)

    def subquery_word(self) -> bool:
        return self.any_("SELECT", "WITH")

    def call_tail(self, f: n.Fn) -> n.Fn:
        if self.is_("(") and f.args and f.name.startswith(("QUANTILE", "QUANTILES", "TOPK", "GROUPARRAY", "SUMMAP")):  # parameters first
            again = self.call(f.name)
            again.params = f.args
            return again
        while True:
            if self.take("WITHIN", "GROUP"):
                self.need("(")
                self.need("ORDER", "BY")
                f.within = self.list_of(self.order_item)
                self.need(")")
            elif self.is_("FILTER") and self.peek().text == "(":
                self.i += 2
                self.take("WHERE")
                f.where = self.expr()
                self.need(")")
            elif self.any_("IGNORE", "RESPECT") and self.peek().word == "NULLS":
                f.nulls = self.next().word
                self.next()
            elif self.is_("FROM") and self.peek().word in ("FIRST", "LAST") and f.name == "NTH_VALUE":
                self.next()
                if self.next().word == "LAST":
                    f.keep = ("FROM LAST", [])
            elif self.is_("KEEP") and self.peek().text == "(":
                self.i += 2
                self.need("DENSE_RANK")
                word = self.next().word
                self.need("ORDER", "BY")
                f.keep = (word, self.list_of(self.order_item))
                self.need(")")
            elif self.take("OVER"):
                f.over = self.window() if self.is_("(") else n.Window(base=self.ident(), name_only=True)
            else:
                return f

    def window(self) -> n.Window:
        self.need("(")
        w = n.Window()
        if self.t.kind in ("word", "quoted") and self.t.word not in ("PARTITION", "ORDER", "ROWS", "RANGE", "GROUPS", "DISTRIBUTE", "SORT"):
            w.base = self.ident()
        if self.take("PARTITION", "BY") or self.take("DISTRIBUTE", "BY"):
            w.partition = self.list_of(self.expr)
        if self.take("ORDER", "BY") or self.take("SORT", "BY"):
            w.order = self.list_of(self.order_item)
        if self.any_("ROWS", "RANGE", "GROUPS"):
            unit = self.next().word
            if self.take("BETWEEN"):
                start = self.bound()
                self.need("AND")
                end = self.bound()
            else:
                start, end = self.bound(), ("CURRENT ROW", None)
            exclude = ""
            if self.take("EXCLUDE"):
                exclude = self.next().word
                if exclude in ("CURRENT", "NO"):
                    exclude = "" if exclude == "NO" else "CURRENT ROW"
                    self.next()
            w.frame = n.Frame(unit, start, end, exclude)
        self.need(")")
        return w

    def bound(self) -> tuple[str, n.Node | None]:
        if self.take("UNBOUNDED"):
            return f"UNBOUNDED {self.next().word}", None
        if self.take("CURRENT", "ROW"):
            return "CURRENT ROW", None
        x = self.expr(5)
        return self.next().word, x

    # words with a grammar of their own

    def x_case(self) -> n.Case:
        self.next()
        operand = None if self.is_("WHEN") else self.expr()
        whens = []
        while self.take("WHEN"):
            cond = self.expr()
            self.need("THEN")
            whens.append((cond, self.expr()))
        other = self.expr() if self.take("ELSE") else None
        self.need("END")
        return n.Case(operand, whens, other)

    def x_cast(self) -> n.Cast:
        name = self.next().word
        self.need("(")
        x = self.expr()
        if self.take(","):
            type_ = self.type_from_string(self.next().value)
        else:
            self.need("AS")
            type_ = self.type_()
        if self.take("FORMAT"):
            fmt = self.next().value
            self.need(")")
            return n.Fn("TO_TIMESTAMP" if type_.kind.startswith("timestamp") else "TO_DATE", [x, n.Lit("string", fmt)])
        self.need(")")
        return n.Cast(x, type_, name != "CAST")

    x_try_cast = x_safe_cast = x_cast

    def type_from_string(self, text: str) -> SQLType:
        return Parser(text, self.d).type_()

    def x_convert(self) -> n.Node | None:
        if self.d.name in ("tsql", "fabric"):
            self.next()
            self.need("(")
            type_ = self.type_()
            self.need(",")
            x = self.expr()
            if self.take(","):
                self.expr()
            self.need(")")
            return n.Cast(x, type_)
        mark = self.i
        self.next()
        self.need("(")
        x = self.expr()
        if self.take("USING"):
            self.ident()
            self.need(")")
            return n.Cast(x, SQLType("string"))
        if self.take(","):
            type_ = self.type_()
            self.need(")")
            return n.Cast(x, type_)
        self.i = mark
        return None

    def x_try_convert(self) -> n.Cast:
        self.next()
        self.need("(")
        type_ = self.type_()
        self.need(",")
        x = self.expr()
        self.need(")")
        return n.Cast(x, type_, True)

    def x_extract(self) -> n.Node | None:
        mark = self.i
        self.next()
        self.need("(")
        t = self.next()
        if not self.take("FROM"):
            self.i = mark
            return None
        x = self.expr()
        self.need(")")
        return n.Extract((t.value or t.text).upper(), x)

    def x_position(self) -> n.Node | None:
        mark = self.i
        self.next()
        self.need("(")
        a = self.expr(5)
        if not self.take("IN"):
            self.i = mark
            return None
        b = self.expr()
        self.need(")")
        return n.Fn("LOCATE", [a, b])

    def x_trim(self) -> n.Node | None:
        mark = self.i
        self.next()
        self.need("(")
        side = self.next().word if self.any_("BOTH", "LEADING", "TRAILING") else "BOTH"
        chars = None if self.is_("FROM") else self.expr()
        if not self.take("FROM"):
            self.i = mark
            return None
        x = self.expr()
        self.need(")")
        return n.Fn({"BOTH": "TRIM", "LEADING": "LTRIM", "TRAILING": "RTRIM"}[side], [x, *([chars] if chars else [])])

    def x_substring(self) -> n.Node | None:
        mark = self.i
        self.next()
        self.need("(")
        x = self.expr()
        if not self.is_("FROM"):
            self.i = mark
            return None
        self.next()
        args = [x, self.expr()]
        if self.take("FOR"):
            args.append(self.expr())
        self.need(")")
        return n.Fn("SUBSTRING", args)

    def x_exists(self) -> n.Node | None:
        if self.peek().text == "(" and self.peek(2).word in ("SELECT", "WITH", "FROM", "VALUES"):
            self.i += 2
            q = self.query()
            self.need(")")
            return n.Exists(q)
        return None

    def x_interval(self) -> n.Node | None:
        if self.peek().text in (",", ")", ".") or self.peek().kind == "end" or self.peek().word in RESERVED - {"CASE"}:
            return None
        self.next()
        value = self.expr(9)
        unit = to = ""
        if self.t.kind == "word" and (u := self.t.word.rstrip("S")) in UNITS:
            unit = u
            self.next()
            if self.take("("):
                self.next()
                self.need(")")
            if self.take("TO"):
                to = self.next().word
        return n.Interval(value, unit, to)

    def x_array(self) -> n.Node | None:
        follow = self.peek()
        if follow.text == "[":
            self.i += 1
            return self.primary_()
        if follow.text == "(" and self.peek(2).word in ("SELECT", "WITH"):
            self.i += 2
            q = self.query()
            self.need(")")
            return n.Fn("ARRAY_SUBQUERY", [n.Sub(q)])
        if follow.text == "<":
            self.type_()
            if self.take("["):
                items = [] if self.is_("]") else self.list_of(self.expr)
                self.need("]")
                return n.ArrayLit(items)
        return None

    def x_map(self) -> n.Node | None:
        if self.peek().text == "{":
            self.i += 2
            keys, values = [], []
            while not self.take("}"):
                keys.append(self.expr())
                self.need(":")
                values.append(self.expr())
                self.take(",")
            return n.MapLit(keys, values)
        return None

    def x_struct(self) -> n.Node | None:
        if self.peek().text == "<":
            type_ = self.type_()
            self.need("(")
            items = self.list_of(self.expr)
            self.need(")")
            return n.StructLit([*type_.names], items)
        return None

    def _typed(self) -> n.Node | None:
        word = self.t.word
        k = 1
        zone = ""
        if self.peek().word in ("WITH", "WITHOUT") and self.peek(2).word == "TIME":
            zone, k = self.peek().word, 4
        if self.peek(k).kind == "string":
            self.i += k
            word = "TIMESTAMPTZ" if zone == "WITH" else word
            return n.Typed(word, self.next().value)
        return None

    x_date = x_time = x_timestamp = x_timestamptz = x_datetime = _typed

    # types

    def type_(self) -> SQLType:
        t = self.next()
        if t.kind not in ("word", "quoted"):
            raise SQLSyntaxError(f"expected a type, found {t.text!r}", self.sql, t.start)
        w = t.word or t.value.upper()
        out = SQLType(KIND.get(w, "custom"), text=t.text)
        if w == "DOUBLE":
            self.take("PRECISION")
        if w in ("NULLABLE", "LOWCARDINALITY") and self.is_("("):
            self.next()
            out = self.type_()
            self.need(")")
            return out
        if w in ("CHARACTER", "CHAR", "NATIONAL"):
            self.take("VARYING")
            out.kind = "string"
        if w == "UNSIGNED":
            out.kind = "bigint"
        close = ""
        if out.kind in ("array", "struct", "map") and self.any_("<", "("):
            close = {"<": ">", "(": ")"}[self.next().text]
            while True:
                if out.kind == "struct":
                    mark = self.i
                    name = self.ident()
                    self.take(":")
                    if self.any_(",", close, "(", "<", ">>"):
                        self.i, name = mark, f"col{len(out.inner) + 1}"
                    out.names.append(name)
                out.inner.append(self.type_())
                self.take("NOT", "NULL")
                if not self.take(","):
                    break
            if close == ">" and self.is_(">>"):
                self.toks[self.i] = Token("op", ">", self.t.start + 1, self.t.end)
            else:
                self.need(close)
        elif self.is_("(") and self.peek().kind in ("number", "word", "string"):
            self.next()
            while not self.take(")"):
                p = self.next()
                if p.kind == "number":
                    out.params.append(int(p.text))
        if out.kind in ("time", "timestamp"):
            if self.take("WITH", "TIME", "ZONE") or self.take("WITH", "LOCAL", "TIME", "ZONE"):
                out.kind = "timestamptz" if out.kind == "timestamp" else out.kind
            else:
                self.take("WITHOUT", "TIME", "ZONE")
        self.take("UNSIGNED")
        while self.is_("[") and (self.peek().text == "]" or self.peek(2).text == "]"):
            self.next()
            if not self.take("]"):
                self.next()
                self.need("]")
            out = SQLType("array", inner=[out], text="ARRAY")
        if self.any_("ARRAY", "LIST") and self.peek().text != "(":
            self.next()
            out = SQLType("array", inner=[out], text="ARRAY")
        return out


UNITS = {"YEAR", "QUARTER", "MONTH", "WEEK", "DAY", "HOUR", "MINUTE", "SECOND", "MILLISECOND", "MICROSECOND", "DECADE", "CENTURY"}


def parse(sql: str, source: str | Dialect = "generic") -> list[n.Node]:
    """The statements of a text."""
    return Parser(sql, source).statements()


def parse_one(sql: str, source: str | Dialect = "generic") -> n.Node:
    found = parse(sql, source)
    if len(found) != 1:
        raise SQLSyntaxError(f"expected one statement, found {len(found)}", sql, 0)
    return found[0]


def parse_expr(sql: str, source: str | Dialect = "generic") -> n.Node:
    p = Parser(sql, source)
    x = p.expr()
    p.finish()
    return x
