"""What SHOW tells."""

from __future__ import annotations

from ..functions import scalar
from ..functions.units import LITERAL_UNITS
from .lexer import QueryError
from .syntax import AGGREGATES

# The lines of each topic.
TOPICS = {
    "commands": ["SELECT", "UPDATE", "INSERT", "DELETE", "COUNT", "CALC", "CREATE TABLE", "ALTER TABLE", "DROP TABLE", "SHOW"],
    "expressions": ["literals, columns, functions, operators, IIF, arrays [a,b], records [k=v], subscripts x[i] and slices x[a:b:c], units 5deg"],
    "operators": ["** (right)", "unary + - ~", "* / // %", "+ -", "&", "^", "|", "= != < <= > >= ~= !~= IN BETWEEN LIKE ILIKE ~ !~", "NOT", "AND", "OR"],
    "constants": ["TRUE FALSE T F", "12 0x1F", "1.5 1e3", "2i", "'text'", "p/glob/ m/part/ f/whole/"],
    "datatypes": ["BOOL", "SHORT", "INT", "INT64", "FLOAT", "DOUBLE", "COMPLEX", "DCOMPLEX", "STRING"],
    "sets": ["[a, b, c]", "(a, b, c)", "{a, b, c}", "(SELECT ...)"],
    "tableoptions": ["NDIM=", "SHAPE=[]", "UNIT=", "COMMENT="],
}


def topic(words: list[str]) -> list[str]:
    if not words:
        return ["topics:", *sorted([*TOPICS, "functions", "units"])]
    if words[0] in ("functions", "function"):
        return sorted({*scalar.REGISTRY, *AGGREGATES, "IIF"})
    if words[0] == "units":
        return [f"{name} {factor!r}" for name, factor in LITERAL_UNITS.items()]
    if words[0] in TOPICS:
        return TOPICS[words[0]]
    raise QueryError(f"unknown SHOW topic {words[0]}")
