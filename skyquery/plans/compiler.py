"""Expressions to Columns. The static kind of each operand picks the operator's variant."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import aggregates, scalar
from ..functions.units import LITERAL_UNITS
from ..functions.values import NAN, Value, array, boolean, common, complex_, complex_of, double, integer, of_type, text
from .lexer import QueryError
from .syntax import AGGREGATES, Around, ArrayOf, Between, Binary, Call, Exists, In, Keyword, Like, Literal, Matches, Name, Node, Pattern, Query, Range, RecordOf, Star, Subscript, Unary, WithUnit

ROWNR = aggregates.ROWNR


def wildcard_regex(pattern: str) -> str:
    """A pattern with ``% _`` and ``* ?`` as the text of a regular expression, without anchors."""
    return "".join(".*" if c in "%*" else "." if c in "_?" else re.sub(r"([^\w\s])", r"\\\1", c) if ord(c) < 128 else c for c in pattern)


def whole(regex: str) -> str:
    return rf"^(?:{regex})\z"


def checked_regex(regex: str) -> str:
    try:
        re.compile(regex.replace(r"\z", r"\Z"))
    except re.error as e:
        raise QueryError(f"bad regular expression {regex!r}: {e}") from None
    return regex


@dataclass
class Scope:
    """The columns an expression can name. ``columns``: (table, column) to the name in the frame; ``keywords``: of the table, for ``::name``."""

    frame: DataFrame | None
    columns: dict[tuple[str, str], str] = field(default_factory=dict)
    order: list[str] = field(default_factory=list)
    keywords: dict = field(default_factory=dict)
    aggregated: bool = False
    subquery: Callable | None = None

    @staticmethod
    def of(frame: DataFrame, table: str = "", keywords: dict | None = None) -> Scope:
        return Scope(frame, {(table, c): c for c in frame.columns if c != ROWNR}, [table], keywords or {})

    def find(self, name: Name) -> str | None:
        tables = [name.table] if name.table is not None else self.order
        for t in tables:
            for (table, column), inner in self.columns.items():
                if table == t and column == name.name:
                    return inner
        matched = {inner for (t, c), inner in self.columns.items() if t in tables and c.lower() == name.name.lower()}
        if len(matched) == 1:
            return matched.pop()
        if name.table is not None:  # a dotted column, or the field of a record
            for (_, column), inner in self.columns.items():
                if column == f"{name.table}.{name.name}":
                    return inner
        return None


class Compiler:
    def __init__(self, scope: Scope):
        self.scope = scope

    def __call__(self, node: Node) -> Value:
        method = getattr(self, "_" + type(node).__name__.lower(), None)
        if method is None:
            raise QueryError(f"{type(node).__name__} cannot stand here")
        return method(node)

    def condition(self, node: Node) -> Column:
        return boolean(self(node))

    # --- leaves ---
    def _literal(self, n: Literal) -> Value:
        if n.kind == "int":
            return Value(F.lit(n.value).cast("long"), "int", n.value)
        if n.kind == "complex":
            return Value(complex_of(F.lit(0.0), F.lit(float(n.value))), "complex")
        return Value(F.lit(n.value), n.kind, n.value)

    def _name(self, n: Name) -> Value:
        inner = self.scope.find(n)
        if inner is None and n.table is not None and (whole_ := self.scope.find(Name(n.table))) is not None and self.scope.frame is not None:
            kind = self.scope.frame.schema[whole_].dataType
            if hasattr(kind, "fieldNames") and n.name in kind.fieldNames():
                return of_type(F.col(f"`{whole_}`")[n.name], kind[n.name].dataType)
        if inner is None or self.scope.frame is None:
            raise QueryError(f"unknown column {n.table + '.' if n.table else ''}{n.name}")
        return of_type(F.col(f"`{inner}`"), self.scope.frame.schema[inner].dataType)

    def _keyword(self, n: Keyword) -> Value:
        value = self.scope.keywords
        if n.column is not None and (n.column in (self.scope.keywords.get("_columns") or {})):
            value = self.scope.keywords["_columns"][n.column]
        parts = n.name.split(".") if n.name not in value else [n.name]
        for part in parts:
            if not isinstance(value, dict) or part not in value:
                return Value(F.lit(None), "null")
            value = value[part]
        if isinstance(value, bool):
            return Value(F.lit(value), "bool", value)
        if isinstance(value, int):
            return Value(F.lit(value).cast("long"), "int", value)
        if isinstance(value, float):
            return Value(F.lit(value), "double", value)
        if isinstance(value, str):
            return Value(F.lit(value), "string", value)
        if isinstance(value, list) and all(isinstance(x, (int, float)) for x in value):
            return Value(F.array(*[F.lit(float(x)) for x in value]).cast("array<double>"), "array")
        raise QueryError(f"keyword {n.name} is no value")

    # --- arithmetic ---
    def _unary(self, n: Unary) -> Value:
        x = self(n.x)
        if n.op == "not":
            return Value(~boolean(x), "bool")
        if n.op == "~":
            return Value(F.bitwise_not(integer(x)), "int")
        if n.op == "+":
            return x if x.kind in ("int", "double", "complex", "array") else Value(double(x), "double")
        if x.kind == "int":
            return Value(-x.col, "int", -x.constant if isinstance(x.constant, int) else None)
        if x.kind == "complex":
            return Value(complex_of(-x.col["re"], -x.col["im"]), "complex")
        if x.kind == "array":
            return Value(F.transform(x.col, lambda v: -v), "array")
        return Value(-double(x), "double", -x.constant if isinstance(x.constant, float) else None)

    def _binary(self, n: Binary) -> Value:
        if n.op in ("and", "or"):
            a, b = self.condition(n.left), self.condition(n.right)
            return Value(a & b if n.op == "and" else a | b, "bool")
        a, b = self(n.left), self(n.right)
        if n.op in ("=", "!=", "<", "<=", ">", ">=", "~=", "!~="):
            return Value(self.compare(n.op, a, b), "bool")
        return self.arithmetic(n.op, a, b)

    def arithmetic(self, op: str, a: Value, b: Value) -> Value:
        kinds = {a.kind, b.kind}
        if op in ("&", "|", "^"):
            if kinds == {"bool"}:
                x, y = a.col.cast("long"), b.col.cast("long")
            else:
                x, y = integer(a), integer(b)
            return Value({"&": x.bitwiseAND, "|": x.bitwiseOR, "^": x.bitwiseXOR}[op](y), "int")
        if "string" in kinds:
            if op != "+":
                raise QueryError(f"{op} is not possible with texts")
            return Value(F.concat(text(a), text(b)), "string")
        if "array" in kinds:
            return self._elementwise(op, a, b)
        if "complex" in kinds:
            return self._complex(op, complex_(a), complex_(b))
        if kinds <= {"int", "bool"}:
            x, y = integer(a), integer(b)
            if op in ("/", "//"):
                return Value(F.call_function("div", x, y), "int")
            if op == "**":
                return Value(F.pow(x.cast("double"), y.cast("double")).cast("long"), "int")
            return Value({"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "%": lambda: x % y}[op](), "int")
        return Value(self._doubles(op, double(a), double(b)), "int" if op == "//" else "double")

    @staticmethod
    def _doubles(op: str, x: Column, y: Column) -> Column:
        if op == "//":
            return (x / y).cast("long")
        if op == "%":
            return F.when(y == 0, F.lit(NAN)).otherwise(x % F.when(y == 0, F.lit(1.0)).otherwise(y))
        return {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: x / y, "**": lambda: F.pow(x, y)}[op]()

    def _elementwise(self, op: str, a: Value, b: Value) -> Value:
        f = lambda x, y: self._doubles(op, x, y).cast("double")
        if a.kind == "array" and b.kind == "array":
            return Value(F.zip_with(a.col, b.col, f), "array")
        if a.kind == "array":
            y = double(b)
            return Value(F.transform(a.col, lambda x: f(x, y)), "array")
        x0 = double(a)
        return Value(F.transform(b.col, lambda y: f(x0, y)), "array")

    @staticmethod
    def _complex(op: str, x: Column, y: Column) -> Value:
        a, b, c, d = x["re"], x["im"], y["re"], y["im"]
        if op in ("+", "-"):
            return Value(complex_of(a + c if op == "+" else a - c, b + d if op == "+" else b - d), "complex")
        if op == "*":
            return Value(complex_of(a * c - b * d, a * d + b * c), "complex")
        if op == "/":
            n = c * c + d * d
            return Value(complex_of((a * c + b * d) / n, (b * c - a * d) / n), "complex")
        raise QueryError(f"{op} is not possible with complex numbers")

    @staticmethod
    def compare(op: str, a: Value, b: Value) -> Column:
        if op in ("~=", "!~="):
            near = F.abs(double(a) - double(b)) < 1e-5
            return near if op == "~=" else ~near
        x, y, _ = common(a, b)
        return {"=": lambda: x == y, "!=": lambda: x != y, "<": lambda: x < y, "<=": lambda: x <= y, ">": lambda: x > y, ">=": lambda: x >= y}[op]()

    # --- predicates ---
    def _in(self, n: In) -> Value:
        x = self(n.x)
        if isinstance(n.items, Query):
            raise QueryError("IN (SELECT ...) can stand in WHERE only, joined by AND")
        if not n.items:
            return Value(F.lit(n.negated), "bool")
        items = [self(item) for item in n.items]
        if x.kind in ("int", "string") and all(y.kind == x.kind and y.constant is not None for y in items):
            # one list for Catalyst, which long ones become a set and a filter of the scan
            found = x.col.isin(*[y.constant for y in items])
            return Value(~found if n.negated else found, "bool")
        found = None
        for y in items:
            one = F.exists(y.col, lambda v: double(x) == v) if y.kind == "array" and x.kind != "array" else self.compare("=", x, y)
            found = one if found is None else found | one
        return Value(~found if n.negated else found, "bool")

    def _between(self, n: Between) -> Value:
        x, low, high = (self(v) for v in (n.x, n.low, n.high))
        if "string" in {x.kind, low.kind, high.kind}:
            raise QueryError("BETWEEN takes numbers")
        inside = self.compare(">=", x, low) & self.compare("<=", x, high)
        return Value(~inside if n.negated else inside, "bool")

    def _constant_text(self, n: Node, what: str) -> str:
        v = self(n)
        if v.kind != "string" or not isinstance(v.constant, str):
            raise QueryError(f"{what} must be a constant text")
        return v.constant

    def _like(self, n: Like) -> Value:
        regex = whole(wildcard_regex(self._constant_text(n.pattern, "the pattern of LIKE")))
        found = text(self(n.x)).rlike(("(?i)" if n.ignore_case else "") + regex)
        return Value(~found if n.negated else found, "bool")

    def _matches(self, n: Matches) -> Value:
        if isinstance(n.pattern, Pattern):
            p = n.pattern
            regex = whole(wildcard_regex(p.text)) if p.form == "p" else whole(p.text) if p.form == "f" else p.text
            regex = checked_regex(("(?i)" if p.ignore_case else "") + regex)
        elif isinstance(n.pattern, Call) and n.pattern.name in ("PATTERN", "SQLPATTERN", "REGEX") and len(n.pattern.args) == 1:
            inner = self._constant_text(n.pattern.args[0], "the pattern")
            regex = checked_regex(inner if n.pattern.name == "REGEX" else wildcard_regex(inner))
        else:
            regex = checked_regex(self._constant_text(n.pattern, "the pattern"))
        found = text(self(n.x)).rlike(regex)
        return Value(~found if n.negated else found, "bool")

    def _around(self, n: Around) -> Value:
        x, centre, width = (double(self(v)) for v in (n.x, n.centre, n.width))
        return Value(F.abs(x - centre) <= width, "bool")

    def _exists(self, n: Exists) -> Value:
        raise QueryError("EXISTS can stand in WHERE only, joined by AND")

    # --- the rest ---
    def _call(self, n: Call) -> Value:
        if n.name in AGGREGATES:
            if not self.scope.aggregated:
                raise QueryError(f"{n.name} can stand in the selection and HAVING only")
            inner = Compiler(Scope(self.scope.frame, self.scope.columns, self.scope.order, self.scope.keywords, False))
            return aggregates.aggregate(n.name, [inner(a) for a in n.args if not isinstance(a, Star)], n.distinct)
        if n.name == "IIF":
            if len(n.args) != 3:
                raise QueryError("IIF takes three arguments")
            a, b, kind = common(self(n.args[1]), self(n.args[2]))
            return Value(F.when(self.condition(n.args[0]), a).otherwise(b), kind)
        if n.name in ("ROWNR", "ROWID", "ROWNUMBER"):
            if self.scope.frame is None or ROWNR not in self.scope.frame.columns:
                return Value(F.lit(0).cast("long"), "int")
            return Value(F.col(ROWNR).cast("long"), "int")
        if n.name in ("ISCOLUMN", "ISKEYWORD") and len(n.args) == 1:
            name = self._constant_text(n.args[0], f"the argument of {n.name}")
            known = any(c == name for _, c in self.scope.columns) if n.name == "ISCOLUMN" else name in self.scope.keywords
            return Value(F.lit(known), "bool", known)
        if n.name in ("PATTERN", "SQLPATTERN") and len(n.args) == 1:
            regex = wildcard_regex(self._constant_text(n.args[0], "the pattern"))
            return Value(F.lit(regex), "string", regex)
        if n.name == "REGEX" and len(n.args) == 1:
            return self(n.args[0])
        if n.name in ("INCONE", "ANYCONE") and len(n.args) == 2:
            return scalar.call("CONES3", [self(n.args[0]), Value(F.slice(array(self(n.args[1])), 1, 2), "array"), Value(F.element_at(array(self(n.args[1])), 3), "double")])
        return scalar.call(n.name, [self(a) for a in n.args])

    def _subscript(self, n: Subscript) -> Value:
        x = self(n.x)
        if len(n.index) != 1:
            raise QueryError("arrays have one axis")
        i = n.index[0]
        if isinstance(i, Range):
            if x.kind != "array":
                raise QueryError("only arrays can be sliced")
            start = integer(self(i.start)).cast("int") if i.start else F.lit(0)
            stop = F.least(integer(self(i.stop)).cast("int"), F.size(x.col)) if i.stop else F.size(x.col)
            part = F.slice(x.col, start + 1, F.greatest(stop - start, F.lit(0)))
            if i.step:
                step = integer(self(i.step)).cast("int")
                return Value(F.filter(part, lambda _, k: k % step == 0), "array")
            return Value(part, "array")
        at = integer(self(i)).cast("int")
        if x.kind == "array":
            return Value(x.col[at], "double")
        if x.kind == "string":
            return Value(F.substring(x.col, at + 1, 1), "string")
        raise QueryError("only arrays and texts have elements")

    def _arrayof(self, n: ArrayOf) -> Value:
        if not n.items:
            return Value(F.lit(None), "null")
        items = [self(i) for i in n.items]
        if len(items) == 1:
            return items[0]
        return Value(F.array(*[double(v) for v in items]), "array")

    def _recordof(self, n: RecordOf) -> Value:
        return Value(F.struct(*[self(x).col.alias(name) for name, x in n.fields]), "other")

    def _withunit(self, n: WithUnit) -> Value:
        x, factor = self(n.x), LITERAL_UNITS[n.unit.upper()]
        if x.kind == "array":
            return Value(F.transform(x.col, lambda v: v * factor), "array")
        constant = x.constant * factor if isinstance(x.constant, (int, float)) and not isinstance(x.constant, bool) else None
        return Value(F.lit(constant) if constant is not None else double(x) * factor, "double", constant)
