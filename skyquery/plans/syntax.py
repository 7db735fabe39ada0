"""Syntax trees of expressions and statements."""

from __future__ import annotations

from dataclasses import dataclass, field


class Node:
    pass


@dataclass(frozen=True)
class Literal(Node):
    value: object
    kind: str  # int, double, bool, string, complex, null


@dataclass(frozen=True)
class Name(Node):
    name: str
    table: str | None = None


@dataclass(frozen=True)
class Star(Node):
    pass


@dataclass(frozen=True)
class Unary(Node):
    op: str
    x: Node


@dataclass(frozen=True)
class Binary(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class In(Node):
    x: Node
    items: tuple[Node, ...] | Query
    negated: bool = False


@dataclass(frozen=True)
class Between(Node):
    x: Node
    low: Node
    high: Node
    negated: bool = False


@dataclass(frozen=True)
class Like(Node):
    x: Node
    pattern: Node
    ignore_case: bool = False
    negated: bool = False


@dataclass(frozen=True)
class Matches(Node):
    x: Node
    pattern: Node
    negated: bool = False


@dataclass(frozen=True)
class Pattern(Node):
    """A regex literal: form p (glob), m (search) or f (whole), and whether case is ignored."""

    form: str
    text: str
    ignore_case: bool


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple[Node, ...]
    distinct: bool = False


@dataclass(frozen=True)
class Range(Node):
    start: Node | None
    stop: Node | None
    step: Node | None


@dataclass(frozen=True)
class Subscript(Node):
    x: Node
    index: tuple[Node, ...]


@dataclass(frozen=True)
class ArrayOf(Node):
    items: tuple[Node, ...]


@dataclass(frozen=True)
class RecordOf(Node):
    fields: tuple[tuple[str, Node], ...]


@dataclass(frozen=True)
class WithUnit(Node):
    x: Node
    unit: str


@dataclass(frozen=True)
class Keyword(Node):
    name: str
    column: str | None = None


@dataclass(frozen=True)
class Exists(Node):
    query: Query


@dataclass(frozen=True)
class Around(Node):
    x: Node
    centre: Node
    width: Node


@dataclass(frozen=True)
class Item:
    x: Node
    alias: str | None = None
    type: str | None = None


@dataclass(frozen=True)
class TableRef:
    name: str
    alias: str
    query: Query | None = None
    on: Node | None = None
    how: str = "cross"


@dataclass(frozen=True)
class Key:
    x: Node
    ascending: bool = True


@dataclass
class Query(Node):
    items: list[Item] = field(default_factory=list)
    distinct: bool = False
    tables: list[TableRef] = field(default_factory=list)
    withs: list[TableRef] = field(default_factory=list)
    where: Node | None = None
    group: list[Node] = field(default_factory=list)
    rollup: bool = False
    having: Node | None = None
    order: list[Key] = field(default_factory=list)
    order_distinct: bool = False
    limit: Node | None = None
    offset: Node | None = None
    giving: str | None = None

    def __hash__(self):
        return id(self)


@dataclass
class Statement:
    """Any other command: its name and what was given with it."""

    command: str
    given: dict


AGGREGATES = frozenset(
    "GCOUNT GMIN GMINS GMAX GMAXS GSUM GSUMS GMEAN GMEANS GVARIANCE GVARIANCES GSTDDEV GSTDDEVS GRMS GRMSS GANY GANYS GALL GALLS GNTRUE GNTRUES GNFALSE GNFALSES "
    "GSUMSQR GSUMSQRS GPRODUCT GPRODUCTS GFIRST GLAST GMEDIAN GROWID GHIST GAGGR GFRACTILE".split()
)


def walk(node):
    """The node and all nodes below it, but not those of nested queries."""
    if isinstance(node, (list, tuple)):
        for x in node:
            yield from walk(x)
    elif isinstance(node, Query):
        return
    elif isinstance(node, Node):
        yield node
        for value in vars(node).values():
            yield from walk(value)


def is_aggregate(node) -> bool:
    return any(isinstance(n, Call) and n.name in AGGREGATES for n in walk(node))
