"""A fluent, immutable query builder over the syntax tree."""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from . import nodes as n
from .parser import Parser, parse_expr
from .writer import generate


class Expr:
    """An expression; Python operators and methods build larger ones."""

    def __init__(self, node: n.Node) -> None:
        self.node = node

    def sql(self, dialect: str = "generic") -> str:
        from .writer import Writer

        return Writer(dialect).e(self.node)

    __str__ = sql

    def _bin(self, op: str, other: Any) -> Expr:
        return Expr(n.Bin(op, self.node, node(other)))

    def as_(self, alias: str) -> Expr:
        return Expr(n.Alias(self.node, alias))

    def cast(self, type_: str) -> Expr:
        return Expr(n.Cast(self.node, Parser(type_).type_()))

    def between(self, low: Any, high: Any) -> Expr:
        return Expr(n.Between(self.node, node(low), node(high)))

    def in_(self, *values: Any) -> Expr:
        return self._in(values, False)

    def not_in(self, *values: Any) -> Expr:
        return self._in(values, True)

    def _in(self, values: tuple, negated: bool) -> Expr:
        if len(values) == 1 and isinstance(values[0], Select):
            return Expr(n.In(self.node, [], negated, values[0].ast()))
        return Expr(n.In(self.node, [node(v) for v in values], negated))

    def is_null(self) -> Expr:
        return Expr(n.Is(self.node, "NULL"))

    def is_not_null(self) -> Expr:
        return Expr(n.Is(self.node, "NULL", True))

    def not_(self) -> Expr:
        return Expr(n.Un("NOT", self.node))

    def neg(self) -> Expr:
        return Expr(n.Un("-", self.node))

    def asc(self) -> n.OrderItem:
        return n.OrderItem(self.node, explicit=True)

    def desc(self) -> n.OrderItem:
        return n.OrderItem(self.node, True, explicit=True)

    def over(self, partition_by: list[Any] = (), order_by: list[Any] = (), frame: n.Frame | None = None) -> Expr:
        return Expr(replace(self.node, over=n.Window([part(x) for x in partition_by], [order(x) for x in order_by], frame)))


for _name, _op in {"eq": "=", "neq": "<>", "lt": "<", "lte": "<=", "gt": ">", "gte": ">=", "add": "+", "sub": "-", "mul": "*", "div": "/", "mod": "%", "like": "LIKE", "ilike": "ILIKE", "rlike": "RLIKE", "and_": "AND", "or_": "OR", "xor": "XOR", "is_": "<=>"}.items():
    setattr(Expr, _name, lambda self, other, _op=_op: self._bin(_op, other))
for _name, _op in {"__eq__": "=", "__ne__": "<>", "__lt__": "<", "__le__": "<=", "__gt__": ">", "__ge__": ">=", "__add__": "+", "__sub__": "-", "__mul__": "*", "__truediv__": "/", "__mod__": "%", "__and__": "AND", "__or__": "OR"}.items():
    setattr(Expr, _name, lambda self, other, _op=_op: self._bin(_op, other))
Expr.__invert__ = Expr.not_
Expr.__hash__ = object.__hash__


def node(x: Any) -> n.Node:
    """The node of a value: expressions stay, builders become subqueries, the rest literals."""
    if isinstance(x, Expr):
        return x.node
    if isinstance(x, n.Node):
        return x
    if isinstance(x, (Select, SetBuilder)):
        return n.Sub(x.ast())
    if x is None:
        return n.Lit("null")
    if isinstance(x, bool):
        return n.Lit("bool", x)
    if isinstance(x, (int, float)):
        return n.Lit("number", repr(x)) if x >= 0 else n.Un("-", n.Lit("number", repr(-x)))
    return n.Lit("string", str(x))


def part(x: Any) -> n.Node:
    """As `node`, but text is SQL."""
    return parse_expr(x) if isinstance(x, str) and x != "*" else n.Star() if isinstance(x, str) else node(x)


def order(x: Any) -> n.OrderItem:
    if isinstance(x, n.OrderItem):
        return x
    if isinstance(x, str):
        p = Parser(x)
        return p.order_item()
    return n.OrderItem(node(x))


def col(name: str) -> Expr:
    return Expr(n.Name(name.split(".")))


def lit(x: Any) -> Expr:
    return Expr(node(x))


def sql_expr(text: str) -> Expr:
    return Expr(parse_expr(text))


condition = sql_expr


def star() -> Expr:
    return Expr(n.Star())


def table(name: str, alias: str = "") -> n.Table:
    return n.Table(name.split("."), alias)


def func(name: str, *args: Any) -> Expr:
    return Expr(n.Fn(name.upper(), [node(a) for a in args]))


def count_distinct(x: Any) -> Expr:
    return Expr(n.Fn("COUNT", [node(x)], distinct=True))


def count_star() -> Expr:
    return Expr(n.Fn("COUNT", [n.Star()]))


def extract(field: str, x: Any) -> Expr:
    return Expr(n.Extract(field.upper(), node(x)))


def alias(x: Any, name: str) -> Expr:
    return Expr(n.Alias(node(x), name))


#: Helpers that are a function of the same meaning: Python name -> SQL name.
HELPERS = {
    "count": "COUNT", "sum_": "SUM", "avg": "AVG", "min_": "MIN", "max_": "MAX", "approx_distinct": "APPROX_DISTINCT", "upper": "UPPER", "lower": "LOWER", "length": "LENGTH", "trim": "TRIM", "ltrim": "LTRIM", "rtrim": "RTRIM", "reverse": "REVERSE",
    "initcap": "INITCAP", "substring": "SUBSTRING", "replace_": "REPLACE", "concat_ws": "CONCAT_WS", "coalesce": "COALESCE", "null_if": "NULLIF", "if_null": "IFNULL", "abs_": "ABS", "round_": "ROUND", "floor": "FLOOR", "ceil": "CEIL", "power": "POWER",
    "sqrt": "SQRT", "ln": "LN", "exp": "EXP", "sign": "SIGN", "greatest": "GREATEST", "least": "LEAST", "current_date": "CURRENT_DATE", "current_time": "CURRENT_TIME", "current_timestamp": "CURRENT_TIMESTAMP", "row_number": "ROW_NUMBER", "rank": "RANK", "dense_rank": "DENSE_RANK",
}
for _name, _sql in HELPERS.items():
    globals()[_name] = lambda *args, _sql=_sql: func(_sql, *args)


class Case:
    def __init__(self, operand: Any = None, whens: tuple = (), other: Any = None) -> None:
        self.operand, self.whens, self.other = operand, whens, other

    def when(self, cond: Any, value: Any) -> Case:
        return Case(self.operand, (*self.whens, (part(cond) if isinstance(cond, str) and self.operand is None else node(cond), node(value))), self.other)

    def else_(self, value: Any) -> Expr:
        return Expr(n.Case(None if self.operand is None else node(self.operand), list(self.whens), node(value)))

    def end(self) -> Expr:
        return Expr(n.Case(None if self.operand is None else node(self.operand), list(self.whens)))


def case(operand: Any = None) -> Case:
    return Case(operand)


class _Built:
    q: n.Node

    def ast(self) -> n.Node:
        return self.q

    def sql(self, dialect: str = "generic", pretty: bool = False) -> str:
        return generate(self.q, dialect, pretty)

    __str__ = sql

    def run(self, engine, dialect: str = "generic"):
        """The DataFrame of what was built."""
        return engine.spark.sql(engine.lower(self.q, dialect))


class SetBuilder(_Built):
    def __init__(self, q: n.Query) -> None:
        self.q = q

    def _set(self, op: str, other: Select | SetBuilder, every: bool = False) -> SetBuilder:
        return SetBuilder(n.Query(n.SetOp(op, self.q, other.ast(), every)))

    def union(self, other):
        return self._set("UNION", other)

    def union_all(self, other):
        return self._set("UNION", other, True)

    def intersect(self, other):
        return self._set("INTERSECT", other)

    def except_(self, other):
        return self._set("EXCEPT", other)

    def order_by(self, *items):
        return type(self)(replace(self.q, order=[*self.q.order, *map(order, items)]))

    def limit(self, x):
        return type(self)(replace(self.q, limit=node(x)))

    def offset(self, x):
        return type(self)(replace(self.q, offset=node(x)))


class Select(SetBuilder):
    def __init__(self, q: n.Query | None = None) -> None:
        super().__init__(q or n.Query(n.Select([])))

    def _with(self, **changes) -> Select:
        return Select(replace(self.q, body=replace(self.q.body, **changes)))

    def select(self, *items):
        return self._with(items=[*self.q.body.items, *map(part, items)])

    def from_(self, source):
        return self._with(source=self._source(source))

    def _source(self, x):
        if isinstance(x, (Select, SetBuilder)):
            return n.Derived(x.ast(), "q")
        return table(x) if isinstance(x, str) else x

    def join(self, source, on=None, kind: str = "INNER"):
        return self._with(source=n.Join(self.q.body.source, self._source(source), kind.upper(), None if on is None else part(on)))

    def left_join(self, source, on):
        return self.join(source, on, "LEFT")

    def right_join(self, source, on):
        return self.join(source, on, "RIGHT")

    def full_join(self, source, on):
        return self.join(source, on, "FULL")

    def cross_join(self, source):
        return self.join(source, None, "CROSS")

    def _and(self, name: str, conds) -> Select:
        c = getattr(self.q.body, name)
        for x in map(part, conds):
            c = x if c is None else n.Bin("AND", c, x)
        return self._with(**{name: c})

    def where(self, *conds):
        return self._and("where", conds)

    def having(self, *conds):
        return self._and("having", conds)

    def qualify(self, cond):
        return self._and("qualify", [cond])

    def group_by(self, *items):
        return self._with(group=[*self.q.body.group, *map(part, items)])

    def sort_by(self, *items):
        return Select(replace(self.q, sort={**self.q.sort, "SORT": list(map(order, items))}))

    def distinct(self):
        return self._with(distinct=True)

    def distinct_on(self, *items):
        return self._with(distinct_on=list(map(part, items)))

    def with_(self, name: str, query, *columns):
        return Select(replace(self.q, ctes=[*self.q.ctes, n.CTE(name, list(columns), query.ast())]))


class Statement(_Built):
    def __init__(self, q: n.Node) -> None:
        self.q = q

    def where(self, *conds):
        c = self.q.where
        for x in map(part, conds):
            c = x if c is None else n.Bin("AND", c, x)
        return Statement(replace(self.q, where=c))

    def set(self, column: str, value: Any):
        return Statement(replace(self.q, sets=[*self.q.sets, (column, node(value))]))

    def values(self, *rows):
        own = self.q.query.body.rows if isinstance(self.q.query, n.Query) and isinstance(self.q.query.body, n.Values) else []
        return Statement(replace(self.q, query=n.Query(n.Values([*own, *([node(x) for x in r] for r in rows)]))))

    def query(self, q):
        return Statement(replace(self.q, query=q.ast()))


def select(*items) -> Select:
    return Select().select(*items)


def from_(source) -> Select:
    return Select().from_(source)


def update(name: str, **sets) -> Statement:
    return Statement(n.Update(table(name), [(c, node(v)) for c, v in sets.items()], None, None))


def delete(name: str) -> Statement:
    return Statement(n.Delete(table(name), None, None))


def insert_into(name: str, *columns: str) -> Statement:
    return Statement(n.Insert(name.split("."), list(columns), n.Query(n.Values([]))))


def insert(source, into: str, *columns: str) -> Statement:
    return insert_into(into, *columns).query(source)


def merge_into(name: str, source, on: str, *clauses: tuple) -> Statement:
    return Statement(n.Merge(table(name), table(source) if isinstance(source, str) else source, part(on), list(clauses)))
