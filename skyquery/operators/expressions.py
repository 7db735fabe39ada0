"""Array expressions: one language over packed arrays and over lattices in long form.

A parsed expression becomes a single projection. Over ``Packed`` operands (an array column,
and perhaps a mask array) it is a fused ``transform``; over ``Long`` operands, columns of one
joined frame, it is plain Column arithmetic. Every result is a value and a mask that is true
where the value is good. Names of functions are case-sensitive.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import INF, NAN
from ..plans.lexer import QueryError
from .lattice import Lattice


@dataclass(frozen=True)
class Element:
    """One element's value as a Column, with the kind float, double or bool, and its mask (None: always good). ``scalar``: the same for all elements."""

    col: Column
    kind: str
    mask: Column | None = None
    scalar: bool = False


def _both(a: Column | None, b: Column | None) -> Column | None:
    return b if a is None else a if b is None else a & b


def _divide(x: Column, y: Column) -> Column:
    """Division as hardware does it: x/0 is an infinity, 0/0 no number."""
    zero = F.when(F.isnan(x) | (x == 0), F.lit(NAN)).when(x > 0, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(y == 0, zero).otherwise(x / F.when(y == 0, F.lit(1.0)).otherwise(y))


def _log(f):
    return lambda x: F.when(x == 0, F.lit(-INF)).when((x < 0) | F.isnan(x), F.lit(NAN)).otherwise(f(x))


def _fmod(x: Column, y: Column) -> Column:
    return F.when(y == 0, F.lit(NAN)).otherwise(x % F.when(y == 0, F.lit(1.0)).otherwise(y))


# The functions of one and of two arguments.
ONE = {
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "exp": F.exp, "log": _log(F.log), "log10": _log(F.log10), "sqrt": F.sqrt, "abs": F.abs,
    "sign": F.signum, "round": lambda x: F.round(x, 0), "ceil": lambda x: F.ceil(x).cast("double"), "floor": lambda x: F.floor(x).cast("double"),
}
TWO = {"atan2": F.atan2, "pow": F.pow, "fmod": _fmod, "min": F.least, "max": F.greatest}
REDUCTIONS = ("sum", "min", "max", "mean", "median", "variance", "stddev", "ntrue", "nfalse", "any", "all")

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|([A-Za-z_]\w*)|(==|!=|<=|>=|&&|\|\||[-+*/()<>!,]))")


def parse(text: str):
    """A tree of tuples: ("num", x), ("name", n), ("call", f, args), ("op", o, a, b), ("not", a), ("neg", a)."""
    parts, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise QueryError(f"unexpected {text[at:].strip()[:1]!r} at {at}")
        parts.append((("num", float(m[1])) if m[1] else ("name", m[2]) if m[2] else ("op", m[3]), m.start(m.lastindex)))
        at = m.end()
    pos = 0

    def here():
        return parts[pos][0] if pos < len(parts) else ("end", "")

    def fail(what: str):
        raise QueryError(f"{what} expected at {parts[pos][1] if pos < len(parts) else len(text)}")

    def op(*ops):
        nonlocal pos
        if here()[0] == "op" and here()[1] in ops:
            pos += 1
            return parts[pos - 1][0][1]
        return None

    def level(below, *ops, chain=True):
        x = below()
        while o := op(*ops):
            x = ("op", o, x, below())
            if not chain:
                break
        return x

    either = lambda: level(every, "||")
    every = lambda: level(compared, "&&")
    compared = lambda: level(added, "==", "!=", "<=", ">=", "<", ">", chain=False)
    added = lambda: level(multiplied, "+", "-")
    multiplied = lambda: level(signed, "*", "/")

    def signed():
        if op("-"):
            return ("neg", signed())
        if op("!"):
            return ("not", signed())
        return primary()

    def primary():
        nonlocal pos
        kind, value = here()
        if kind in ("num", "name"):
            pos += 1
            if kind == "name" and op("("):
                args = []
                if not op(")"):
                    args.append(either())
                    while op(","):
                        args.append(either())
                    if not op(")"):
                        fail("')'")
                return ("call", value, tuple(args))
            return (kind, value)
        if op("("):
            x = either()
            if not op(")"):
                fail("')'")
            return x
        return fail("an expression")

    out = either()
    if pos != len(parts):
        fail("the end")
    return out


def _width(kind: str, col: Column) -> Column:
    """Results of float operands stay floats."""
    return col.cast("float") if kind == "float" else col


class Evaluator:
    """Trees over elements. ``names``: the operands; ``reduce(name, tree)``: value and kind of a reduction of a whole operand."""

    def __init__(self, names: dict[str, Element], reduce):
        self.names, self.reduce = names, reduce

    def __call__(self, tree) -> Element:
        what = tree[0]
        if what == "num":
            return Element(F.lit(tree[1]).cast("float"), "float", None, True)
        if what == "name":
            if tree[1] in ("T", "F", "true", "false"):
                return Element(F.lit(tree[1] in ("T", "true")), "bool", None, True)
            if tree[1] not in self.names:
                raise QueryError(f"unknown array {tree[1]}")
            return self.names[tree[1]]
        if what in ("neg", "not"):
            x = self(tree[1])
            if (x.kind == "bool") != (what == "not"):
                raise QueryError(f"{'!' if what == 'not' else '-'} of a {x.kind}")
            return Element(~x.col if what == "not" else -x.col, x.kind, x.mask, x.scalar)
        if what == "op":
            return self._op(tree[1], self(tree[2]), self(tree[3]))
        return self._call(tree[1], tree[2])

    def _numbers(self, *xs: Element) -> tuple[list[Column], str]:
        if any(x.kind == "bool" for x in xs):
            raise QueryError("a number is needed, not a bool")
        kind = "double" if any(x.kind == "double" for x in xs) else "float"
        return [x.col.cast("double") for x in xs], kind

    def _op(self, op: str, a: Element, b: Element) -> Element:
        mask, scalar = _both(a.mask, b.mask), a.scalar and b.scalar
        if op in ("&&", "||"):
            if a.kind != "bool" or b.kind != "bool":
                raise QueryError(f"{op} takes bools")
            return Element(a.col & b.col if op == "&&" else a.col | b.col, "bool", mask, scalar)
        (x, y), kind = self._numbers(a, b)
        if op in ("+", "-", "*", "/"):
            col = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: _divide(x, y)}[op]()
            return Element(_width(kind, col), kind, mask, scalar)
        return Element({"==": lambda: x == y, "!=": lambda: x != y, "<": lambda: x < y, "<=": lambda: x <= y, ">": lambda: x > y, ">=": lambda: x >= y}[op](), "bool", mask, scalar)

    def _call(self, name: str, args: tuple) -> Element:
        if name in REDUCTIONS and len(args) == 1:
            return self.reduce(name, args[0])
        if name in ONE and len(args) == 1:
            x = self(args[0])
            (v,), kind = self._numbers(x)
            return Element(_width(kind, ONE[name](v)), kind, x.mask, x.scalar)
        if name in TWO and len(args) == 2:
            a, b = self(args[0]), self(args[1])
            (x, y), kind = self._numbers(a, b)
            return Element(_width(kind, TWO[name](x, y)), kind, _both(a.mask, b.mask), a.scalar and b.scalar)
        if name == "iif" and len(args) == 3:
            c, a, b = map(self, args)
            if c.kind != "bool" or (a.kind == "bool") != (b.kind == "bool"):
                raise QueryError("iif takes a bool, and two values of one type")
            kind = "bool" if a.kind == "bool" else "double" if "double" in (a.kind, b.kind) else "float"
            return Element(_width(kind, F.when(c.col, a.col).otherwise(b.col)), kind, _both(c.mask, _both(a.mask, b.mask)), False)
        if name == "value" and len(args) == 1:
            x = self(args[0])
            return Element(x.col, x.kind, None, x.scalar)
        if name == "mask" and len(args) == 1:
            x = self(args[0])
            return Element(x.mask if x.mask is not None else F.lit(True), "bool", None, x.scalar)
        raise QueryError(f"unknown function {name} of {len(args)} arguments")


def _used(tree) -> list[str]:
    if not isinstance(tree, tuple):
        return []
    if tree and tree[0] == "name":
        return [tree[1]]
    return [n for part in tree for n in _used(part)] if tree and isinstance(tree[0], (str, tuple)) else []


# --- packed arrays ---
def _fold(name: str, a: Column) -> Column:
    """Reduction of an array of good doubles (or of booleans as 1 and 0)."""
    n = F.size(a).cast("double")
    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    mean = F.when(F.size(a) == 0, F.lit(0.0)).otherwise(total / F.greatest(n, F.lit(1.0)))
    if name == "sum":
        return total
    if name == "mean":
        return mean
    if name == "min":
        return F.coalesce(F.array_min(a), F.lit(INF))
    if name == "max":
        return F.coalesce(F.array_max(a), F.lit(-INF))
    if name == "median":
        from ..functions.scalar import _median

        return _median(a)
    if name in ("variance", "stddev"):
        let = lambda v, f: F.element_at(F.transform(F.array(v), f), 1)
        var = F.when(F.size(a) < 2, F.lit(0.0)).otherwise(let(mean, lambda m: F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.greatest(n - 1, F.lit(1.0))))
        return var if name == "variance" else F.sqrt(var)
    if name == "ntrue":
        return F.size(F.filter(a, lambda x: x != 0)).cast("double")
    if name == "nfalse":
        return F.size(F.filter(a, lambda x: x == 0)).cast("double")
    return (F.exists(a, lambda x: x != 0) if name == "any" else F.forall(a, lambda x: x != 0)).cast("double")


def packed(expression: str, arrays: dict[str, Column | tuple[Column, Column]], kinds: dict[str, str] | None = None) -> tuple[Column, Column | None]:
    """The expression over array columns, as columns of the values and the mask (None: all good).

    ``arrays``: name to the array, or to the array and its mask; ``kinds``: float, double
    (the default) or bool. An expression without an array is an array of one. Arrays of one
    row must have equal lengths: values without partners are null.
    """
    tree, kinds = parse(expression), kinds or {}
    names = [n for n in dict.fromkeys(_used(tree)) if n in arrays]
    whole = {n: arrays[n] if isinstance(arrays[n], tuple) else (arrays[n], None) for n in arrays}

    def evaluate(t) -> tuple[Column, Column | None, str, bool]:
        """Arrays of values and masks of a tree, its kind, and whether it is scalar."""
        used = [n for n in dict.fromkeys(_used(t)) if n in arrays]
        fields = [whole[n][0].alias(f"v{i}") for i, n in enumerate(used)] + [whole[n][1].alias(f"m{i}") for i, n in enumerate(used) if whole[n][1] is not None]

        def element(row: Column | None) -> Element:
            elements = {n: Element(row[f"v{i}"], kinds.get(n, "double"), row[f"m{i}"] if whole[n][1] is not None else None) for i, n in enumerate(used)} if row is not None else {}
            return Evaluator(elements, lambda name, inner: Element(reduced(name, inner), "float", None, True))(t)

        outside = [n for n in used if not _only_reduced(t, n)]
        if not outside:
            sample = Evaluator({}, lambda name, inner: Element(reduced(name, inner), "float", None, True))(t)
            return F.array(sample.col), None, sample.kind, True
        shape = {}

        def value(row):
            e = element(row)
            shape["kind"], shape["masked"] = e.kind, e.mask is not None
            return e.col

        zipped = F.arrays_zip(*fields)
        values = F.transform(zipped, value)
        masks = F.transform(zipped, lambda row: element(row).mask) if shape["masked"] else None
        return values, masks, shape["kind"], False

    def reduced(name: str, inner) -> Column:
        values, masks, kind, _ = evaluate(inner)
        if (name in ("ntrue", "nfalse", "any", "all")) != (kind == "bool"):
            raise QueryError(f"{name} of a {kind} array")
        plain = F.transform(values, lambda x: x.cast("int").cast("double") if kind == "bool" else x.cast("double"))
        if masks is not None:
            plain = F.transform(F.filter(F.arrays_zip(plain.alias("v"), masks.alias("m")), lambda x: x["m"]), lambda x: x["v"])
        return _fold(name, plain).cast("float" if kind == "float" or kind == "bool" else "double")

    if unknown := [n for n in _used(tree) if n not in arrays and n not in ("T", "F", "true", "false")]:
        raise QueryError(f"unknown array {unknown[0]}")
    del names
    values, masks, _, _ = evaluate(tree)
    return values, masks


def _only_reduced(tree, name: str) -> bool:
    """Whether a name stands inside reductions only."""
    if not isinstance(tree, tuple) or not tree:
        return True
    if tree[0] == "name":
        return tree[1] != name
    if tree[0] == "call" and tree[1] in REDUCTIONS and len(tree[2]) == 1:
        return True
    return all(_only_reduced(part, name) for part in tree if isinstance(part, tuple))


# --- lattices ---
def _grouped(name: str, v: Column) -> Column:
    v = v.cast("double")
    return {
        "sum": lambda: F.coalesce(F.sum(v), F.lit(0.0)), "mean": lambda: F.coalesce(F.avg(v), F.lit(0.0)), "min": lambda: F.coalesce(F.min(v), F.lit(INF)), "max": lambda: F.coalesce(F.max(v), F.lit(-INF)),
        "median": lambda: F.coalesce(F.median(v), F.lit(0.0)), "variance": lambda: F.coalesce(F.var_samp(v), F.lit(0.0)), "stddev": lambda: F.coalesce(F.stddev_samp(v), F.lit(0.0)),
    }[name]()


def _joined(trees: list, lattices: dict[str, Lattice]) -> tuple[Lattice, DataFrame, dict[str, Element]]:
    """The lattices that the trees name, joined once on their indices: the first of them, the rows, and the lattices as elements."""
    used = list(dict.fromkeys(n for tree in trees for n in _used(tree)))
    names = [n for n in used if n in lattices]
    if unknown := [n for n in used if n not in lattices and n not in ("T", "F", "true", "false")]:
        raise QueryError(f"unknown lattice {unknown[0]}")
    if not names:
        raise QueryError("the expression has no lattice")
    first = lattices[names[0]]
    frame: DataFrame | None = None
    elements = {}
    for i, n in enumerate(names):
        lat = lattices[n]
        if lat.shape != first.shape:
            raise QueryError(f"shapes {first.shape} and {lat.shape} differ")
        part = lat.frame.select(*first.axes, F.col("value").alias(f"_v{i}"), F.col("mask").alias(f"_m{i}"))
        frame = part if frame is None else frame.join(part, first.axes)
        kind = {"float": "float", "boolean": "bool"}.get(lat.frame.schema["value"].dataType.typeName(), "double")
        elements[n] = Element(F.col(f"_v{i}"), kind, F.col(f"_m{i}"))
    return first, frame, elements


def _reduced(name: str, x: Element) -> tuple[Column, str]:
    """The aggregate over the elements that the mask leaves, and its kind."""
    col = F.when(x.mask, x.col) if x.mask is not None else x.col
    if name in ("ntrue", "nfalse", "any", "all"):
        if x.kind != "bool":
            raise QueryError(f"{name} of a {x.kind} lattice")
        made = {"ntrue": lambda: F.count_if(col), "nfalse": lambda: F.count_if(~col), "any": lambda: F.coalesce(F.bool_or(col), F.lit(False)).cast("int"), "all": lambda: F.coalesce(F.bool_and(col), F.lit(True)).cast("int")}[name]()
        return made.cast("double"), "float"
    if x.kind == "bool":
        raise QueryError(f"{name} of a bool lattice")
    return _grouped(name, col), x.kind


def _reducer(frame: DataFrame, elements: dict[str, Element]):
    """Reductions inside an expression: each is one aggregation whose number goes into the expression."""

    def reduce_(name: str, inner) -> Element:
        col, kind = _reduced(name, Evaluator(elements, reduce_)(inner))
        return Element(F.lit(frame.agg(col).first()[0]).cast(kind), kind, None, True)

    return reduce_


def evaluate(expression: str, lattices: dict[str, Lattice]) -> Lattice | float:
    """The expression over lattices. One without a lattice outside reductions gives a number.

    The lattices are joined once on their indices; each reduction is one aggregation over
    the joined rows. For several numbers of the same lattices ``reductions`` takes one pass.
    """
    tree = parse(expression)
    first, frame, elements = _joined([tree], lattices)
    x = Evaluator(elements, _reducer(frame, elements))(tree)
    if x.scalar:
        return frame.sparkSession.range(1).select(x.col).first()[0]
    return Lattice(frame.select(*first.axes, x.col.alias("value"), (x.mask if x.mask is not None else F.lit(True)).alias("mask")), first.shape)


def reductions(expressions: dict[str, str], lattices: dict[str, Lattice]) -> DataFrame:
    """One row with a column for each of the named reductions, such as ``{"top": "max(e)", "n": "ntrue(e > 0)"}``: one aggregation for all.

    Reductions of an expression that holds others still take an aggregation for each inner one.
    """
    trees = {n: parse(text) for n, text in expressions.items()}
    for n, tree in trees.items():
        if tree[0] != "call" or tree[1] not in REDUCTIONS or len(tree[2]) != 1:
            raise QueryError(f"{expressions[n]!r} is no reduction")
    _, frame, elements = _joined(list(trees.values()), lattices)
    inner = Evaluator(elements, _reducer(frame, elements))
    made = {n: _reduced(tree[1], inner(tree[2][0])) for n, tree in trees.items()}
    return frame.agg(*[col.cast(kind).alias(n) for n, (col, kind) in made.items()])


# --- complex lattices: values are structs of re and im ---
def form_complex(re: Lattice, im: Lattice) -> Lattice:
    return re.combine(im, lambda a, b: F.struct(a.cast("double").alias("re"), b.cast("double").alias("im")))


def real(x: Lattice) -> Lattice:
    return x.apply(lambda v: v["re"])


def imag(x: Lattice) -> Lattice:
    return x.apply(lambda v: v["im"])


def conj(x: Lattice) -> Lattice:
    return x.apply(lambda v: F.struct(v["re"].alias("re"), (-v["im"]).alias("im")))


def arg(x: Lattice) -> Lattice:
    return x.apply(lambda v: F.atan2(v["im"], v["re"]))


def absolute(x: Lattice) -> Lattice:
    return x.apply(lambda v: F.hypot(v["re"], v["im"]))
