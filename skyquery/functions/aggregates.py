"""Aggregates of the query language over groups or whole tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.lexer import QueryError
from .values import Value, boolean, double

#: The hidden column with each row's number.
ROWNR = "_rownr"
#: Aggregates that need the row number.
BY_ROW = frozenset({"GFIRST", "GLAST", "GROWID", "GAGGR"})


def _d(col: Column) -> Value:
    return Value(col, "double")


def aggregate(name: str, args: list[Value], distinct: bool = False) -> Value:
    """The aggregate as a Value. DISTINCT counts or sums each value once."""
    base = name if name in ("GRMS",) else name[:-1] if name.endswith("S") and name[:-1] in _BUILDERS else name
    if base == "GCOUNT":
        if distinct and args:
            return Value(F.count_distinct(args[0].col), "int")
        return Value(F.count(F.lit(1)), "int")
    if base not in _BUILDERS:
        raise QueryError(f"unknown aggregate {name}")
    if base not in ("GHIST", "GFRACTILE") and len(args) != 1 or not args:
        raise QueryError(f"{name} does not take {len(args)} arguments")
    if distinct:
        if base in ("GSUM", "GMEAN"):
            x = double(args[0])
            return _d(F.coalesce(F.sum_distinct(x), F.lit(0.0)) if base == "GSUM" else F.sum_distinct(x) / F.count_distinct(x))
        if base not in ("GMIN", "GMAX", "GANY", "GALL"):
            raise QueryError(f"DISTINCT is not possible in {name}")
    return _BUILDERS[base](*args)


def _zero(col: Column) -> Value:
    return _d(F.coalesce(col, F.lit(0.0)))


def _count(condition: Column) -> Value:
    return Value(F.count_if(condition), "int")


def _hist(x: Value, bins: Value, low: Value, high: Value) -> Value:
    """Counts below, in each of the equal bins, and above, as an array."""
    n = bins.constant
    if not isinstance(n, int) or n < 1:
        raise QueryError("GHIST needs a constant number of bins")
    v, a, b = double(x), double(low), double(high)
    place = F.when(v < a, 0).when(v >= b, n + 1).otherwise(F.floor((v - a) / ((b - a) / n)).cast("int") + 1)
    return Value(F.array(*[F.count_if(place == i).cast("double") for i in range(n + 2)]), "array")


def _fractile(x: Value, f: Value) -> Value:
    if not isinstance(f.constant, (int, float)):
        raise QueryError("GFRACTILE needs a constant fraction")
    return _d(F.percentile(double(x), F.lit(float(f.constant))))


_BUILDERS = {
    "GMIN": lambda x: Value(F.min(x.col), x.kind),
    "GMAX": lambda x: Value(F.max(x.col), x.kind),
    "GSUM": lambda x: _zero(F.sum(double(x))),
    "GMEAN": lambda x: _d(F.avg(double(x))),
    "GVARIANCE": lambda x: _zero(F.var_samp(double(x))),
    "GSTDDEV": lambda x: _zero(F.stddev_samp(double(x))),
    "GRMS": lambda x: _zero(F.sqrt(F.avg(double(x) * double(x)))),
    "GANY": lambda x: Value(F.coalesce(F.bool_or(boolean(x)), F.lit(False)), "bool"),
    "GALL": lambda x: Value(F.coalesce(F.bool_and(boolean(x)), F.lit(True)), "bool"),
    "GNTRUE": lambda x: _count(boolean(x)),
    "GNFALSE": lambda x: _count(~boolean(x)),
    "GSUMSQR": lambda x: _zero(F.sum(double(x) * double(x))),
    "GPRODUCT": lambda x: _d(F.coalesce(F.product(double(x)), F.lit(1.0))),
    "GFIRST": lambda x: Value(F.min_by(x.col, F.col(ROWNR)), x.kind),
    "GLAST": lambda x: Value(F.max_by(x.col, F.col(ROWNR)), x.kind),
    "GMEDIAN": lambda x: _d(F.median(double(x))),
    "GROWID": lambda x: Value(F.min(F.col(ROWNR)), "int"),
    "GFRACTILE": _fractile,
    "GHIST": _hist,
    "GAGGR": lambda x: Value(F.transform(F.array_sort(F.collect_list(F.struct(F.col(ROWNR).alias("r"), double(x).alias("v")))), lambda s: s["v"]), "array"),
}
