"""The syntax tree.  Nodes are plain dataclasses; `children` and `transform` walk any of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, fields, replace
from typing import Any


@dataclass
class Node:
    span: tuple[int, int] | None = field(default=None, kw_only=True, compare=False, repr=False)


# expressions


@dataclass
class Name(Node):
    parts: list[str]
    quoted: list[bool] = field(default_factory=list)


@dataclass
class Lit(Node):
    kind: str  # number, string, bool, null, hex
    value: Any = None


@dataclass
class Param(Node):
    text: str


@dataclass
class Star(Node):
    qualifier: list[str] = field(default_factory=list)
    drop: list[str] = field(default_factory=list)
    swap: list[tuple[Node, str]] = field(default_factory=list)
    rename: list[tuple[str, str]] = field(default_factory=list)


@dataclass
class Un(Node):
    op: str
    x: Node


@dataclass
class Bin(Node):
    op: str
    left: Node
    right: Node
    escape: Node | None = None


@dataclass
class In(Node):
    x: Node
    items: list[Node]
    negated: bool = False
    query: Node | None = None


@dataclass
class Between(Node):
    x: Node
    low: Node
    high: Node
    negated: bool = False
    symmetric: bool = False


@dataclass
class Is(Node):
    x: Node
    what: str  # NULL, TRUE, FALSE, UNKNOWN
    negated: bool = False


@dataclass
class OrderItem(Node):
    x: Node
    desc: bool = False
    nulls: str = ""  # FIRST, LAST or not given
    explicit: bool = False


@dataclass
class Window(Node):
    partition: list[Node] = field(default_factory=list)
    order: list[OrderItem] = field(default_factory=list)
    frame: Frame | None = None
    base: str = ""
    name_only: bool = False


@dataclass
class Frame(Node):
    unit: str
    start: tuple[str, Node | None]
    end: tuple[str, Node | None]
    exclude: str = ""


@dataclass
class Fn(Node):
    name: str
    args: list[Node] = field(default_factory=list)
    distinct: bool = False
    order: list[OrderItem] = field(default_factory=list)
    limit: Node | None = None
    separator: Node | None = None
    within: list[OrderItem] = field(default_factory=list)
    where: Node | None = None
    over: Window | None = None
    nulls: str = ""  # IGNORE, RESPECT
    extreme: tuple[str, Node] | None = None  # HAVING MAX/MIN
    keep: tuple[str, list[OrderItem]] | None = None  # KEEP (DENSE_RANK FIRST/LAST ORDER BY)
    params: list[Node] = field(default_factory=list)  # quantile(p)(x)
    bare: bool = False


@dataclass
class Cast(Node):
    x: Node
    type: Any
    safe: bool = False


@dataclass
class Case(Node):
    operand: Node | None
    whens: list[tuple[Node, Node]]
    other: Node | None = None


@dataclass
class Interval(Node):
    value: Node
    unit: str = ""
    to: str = ""


@dataclass
class Sub(Node):
    query: Node


@dataclass
class Exists(Node):
    query: Node


@dataclass
class Quant(Node):
    word: str
    x: Node


@dataclass
class ArrayLit(Node):
    items: list[Node]


@dataclass
class StructLit(Node):
    names: list[str | None]
    items: list[Node]


@dataclass
class MapLit(Node):
    keys: list[Node]
    values: list[Node]


@dataclass
class Tuple(Node):
    items: list[Node]


@dataclass
class Index(Node):
    x: Node
    i: Node | None
    hi: Node | None = None
    is_slice: bool = False
    step: Node | None = None


@dataclass
class Field(Node):
    x: Node
    name: str


@dataclass
class JsonPath(Node):
    x: Node
    path: str


@dataclass
class Lambda(Node):
    params: list[str]
    body: Node


@dataclass
class Named(Node):
    name: str
    x: Node


@dataclass
class Alias(Node):
    x: Node
    name: str
    columns: list[str] = field(default_factory=list)


@dataclass
class Typed(Node):
    type: str
    text: str


@dataclass
class Extract(Node):
    part: str
    x: Node


@dataclass
class AtZone(Node):
    x: Node
    zone: Node


@dataclass
class Collate(Node):
    x: Node
    name: str


@dataclass
class Raw(Node):
    text: str


# relations


@dataclass
class Table(Node):
    parts: list[str]
    alias: str = ""
    columns: list[str] = field(default_factory=list)
    sample: Sample | None = None


@dataclass
class Sample(Node):
    size: Node
    unit: str  # PERCENT, ROWS
    seed: Node | None = None


@dataclass
class FileTable(Node):
    path: str
    kind: str = ""
    options: dict = field(default_factory=dict)
    alias: str = ""
    columns: list[str] = field(default_factory=list)


@dataclass
class Derived(Node):
    query: Node
    alias: str = ""
    columns: list[str] = field(default_factory=list)
    lateral: bool = False
    sample: Sample | None = None


@dataclass
class TableFn(Node):
    fn: Fn
    alias: str = ""
    columns: list[str] = field(default_factory=list)
    ordinality: str = ""  # ORDINALITY (from 1) or OFFSET (from 0)
    offset_alias: str = ""
    lateral: bool = False
    shape: list[tuple] | None = None  # of JSON tables: (name, type, path, kind); kind is value, json or ordinality


@dataclass
class Group(Node):
    rel: Node
    alias: str = ""


@dataclass
class Join(Node):
    left: Node
    right: Node
    kind: str  # INNER LEFT RIGHT FULL CROSS SEMI ANTI RIGHT SEMI ASOF POSITIONAL ...
    on: Node | None = None
    using: list[str] = field(default_factory=list)
    natural: bool = False
    strictness: str = ""


@dataclass
class LateralView(Node):
    rel: Node
    fn: Fn
    outer: bool = False
    alias: str = ""
    columns: list[str] = field(default_factory=list)


@dataclass
class Pivot(Node):
    rel: Node
    aggs: list[Node]
    on: list[Node]
    values: list[Node]
    group: list[Node] = field(default_factory=list)
    alias: str = ""


@dataclass
class Unpivot(Node):
    rel: Node
    value: str
    name: str
    columns: list[tuple[Node, Any]]
    include_nulls: bool = False
    alias: str = ""


@dataclass
class MatchRecognize(Node):
    rel: Node
    partition: list[Node]
    order: list[OrderItem]
    measures: list[tuple[Node, str]]
    pattern: str
    define: list[tuple[str, Node]]
    rows: str = "ONE"
    after: str = ""
    alias: str = ""


# queries


@dataclass
class CTE(Node):
    name: str
    columns: list[str]
    query: Node
    materialized: str = ""


@dataclass
class Grouping(Node):
    kind: str  # CUBE, ROLLUP, SETS
    items: list[Node]


@dataclass
class Select(Node):
    items: list[Node]
    source: Node | None = None
    where: Node | None = None
    group: list[Node] = field(default_factory=list)
    group_all: bool = False
    group_distinct: bool = False
    with_total: str = ""  # ROLLUP, CUBE, TOTALS after the list
    having: Node | None = None
    qualify: Node | None = None
    windows: list[tuple[str, Window]] = field(default_factory=list)
    distinct: bool = False
    distinct_on: list[Node] = field(default_factory=list)
    top: tuple[Node, bool, bool] | None = None  # n, percent, ties
    into: Node | None = None
    as_struct: str = ""  # STRUCT, VALUE
    connect: tuple[Node | None, Node, bool] | None = None  # start, condition, nocycle
    hints: str = ""


@dataclass
class Values(Node):
    rows: list[list[Node]]


@dataclass
class SetOp(Node):
    op: str  # UNION, INTERSECT, EXCEPT
    left: Node
    right: Node
    all: bool = False
    by_name: str = ""


@dataclass
class Query(Node):
    body: Node
    ctes: list[CTE] = field(default_factory=list)
    recursive: bool = False
    order: list[OrderItem] = field(default_factory=list)
    order_all: bool = False
    sort: dict = field(default_factory=dict)  # SORT / DISTRIBUTE / CLUSTER BY
    limit: Node | None = None
    offset: Node | None = None
    percent: bool = False
    ties: bool = False
    limit_by: list[Node] = field(default_factory=list)
    pipes: str = ""
    parenthesised: bool = False
    json: str = ""  # FOR JSON: PATH or AUTO
    fill: Fill | None = None


@dataclass
class Fill(Node):
    """WITH FILL of the last order item, and the columns to INTERPOLATE (expression or null)."""

    low: Node | None = None
    high: Node | None = None
    step: Node | None = None
    interpolate: list[tuple[str, Node | None]] = field(default_factory=list)


# statements


@dataclass
class InsertAll(Node):
    """Multi-insert: (condition or null, table, columns, values) in order; first: only the first that fits."""

    targets: list[tuple]
    query: Query
    first: bool = False


@dataclass
class CreateFunction(Node):
    name: list[str]
    args: list[tuple]  # name and type or null
    returns: Any
    body: Node


@dataclass
class Insert(Node):
    table: list[str]
    columns: list[str]
    query: Node
    overwrite: bool = False


@dataclass
class Update(Node):
    table: Table
    sets: list[tuple[str, Node]]
    source: Node | None
    where: Node | None


@dataclass
class Delete(Node):
    table: Table
    using: Node | None
    where: Node | None


@dataclass
class Merge(Node):
    table: Table
    source: Node
    on: Node
    clauses: list[tuple]  # (matched, by source, condition, action, payload)


@dataclass
class Create(Node):
    kind: str  # TABLE, VIEW
    name: list[str]
    query: Node | None
    columns: list[tuple[str, Any, bool]] = field(default_factory=list)
    temporary: bool = False
    if_not_exists: bool = False
    replace: bool = False


@dataclass
class Copy(Node):
    source: Node  # query or table
    path: str
    kind: str
    options: dict
    into: bool = False  # COPY table FROM path


@dataclass
class Command(Node):
    word: str
    text: str


def children(node: Any) -> Iterator[Node]:
    """The nodes directly below."""
    if isinstance(node, Node):
        for f in fields(node):
            if f.name != "span":
                yield from _nodes(getattr(node, f.name))


def _nodes(value: Any) -> Iterator[Node]:
    if isinstance(value, Node):
        yield value
    elif isinstance(value, (list, tuple)):
        for x in value:
            yield from _nodes(x)
    elif isinstance(value, dict):
        for x in value.values():
            yield from _nodes(x)


SKIP, STOP = "skip", "stop"


def walk(node: Node, visit: Callable[[Node], Any]) -> bool:
    """Depth first; a visitor returns SKIP to leave a node's children out, STOP to end.  False if it was stopped."""
    says = visit(node)
    if says == STOP:
        return False
    return says == SKIP or all(walk(x, visit) for x in children(node))


def find_all(node: Node, *kinds: type) -> list[Node]:
    out: list[Node] = []
    walk(node, lambda n: out.append(n) if isinstance(n, kinds) else None)
    return out


def transform(node: Any, change: Callable[[Node], Node]) -> Any:
    """A copy of a tree, changed from the leaves up."""
    if isinstance(node, Node):
        own = {f.name: transform(getattr(node, f.name), change) for f in fields(node) if f.name != "span"}
        return change(replace(node, **own))
    if isinstance(node, list):
        return [transform(x, change) for x in node]
    if isinstance(node, tuple):
        return tuple(transform(x, change) for x in node)
    if isinstance(node, dict):
        return {k: transform(v, change) for k, v in node.items()}
    return node
