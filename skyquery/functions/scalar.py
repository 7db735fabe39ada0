"""Scalar functions by name: math, text, dates, angles, arrays, complex numbers, measures."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.lexer import QueryError
from . import sky
from .values import INF, NAN, Value, array, boolean, complex_of, double, integer, text

#: name -> [(least, most number of arguments or None, builder of the Values)]
REGISTRY: dict[str, list[tuple[int, int | None, Callable[..., Value]]]] = {}


def register(names: str, least: int, most: int | None = -1):
    """Makes a builder known under names; ``most`` None: any number, left out: as many as ``least``."""

    def put(build):
        for name in names.split():
            REGISTRY.setdefault(name.upper(), []).append((least, least if most == -1 else most, build))
        return build

    return put


def register_function(name: str, build: Callable[..., Value], arguments: int) -> None:
    """Adds a function of one's own: Values to a Value."""
    register(name, arguments)(build)


def call(name: str, args: list[Value]) -> Value:
    for least, most, build in REGISTRY.get(name, []):
        if least <= len(args) and (most is None or len(args) <= most):
            return build(*args)
    if name in REGISTRY:
        raise QueryError(f"{name} does not take {len(args)} arguments")
    raise QueryError(f"unknown function {name}")


def _d(col: Column) -> Value:
    return Value(col, "double")


def _plain(names: str, f) -> None:
    register(names, 1)(lambda x: _d(f(double(x))))


def _log(f):
    return lambda x: F.when(x == 0, F.lit(-INF)).when((x < 0) | F.isnan(x), F.lit(NAN)).otherwise(f(x))


def _whole(f):
    """floor and the like as doubles, which whole numbers beyond 64 bits, and values that are no numbers, already are."""
    return lambda x: F.when(F.isnan(x) | (F.abs(x) >= 2.0**52), x).otherwise(f(F.when(F.isnan(x) | (F.abs(x) >= 2.0**52), F.lit(0.0)).otherwise(x)).cast("double"))


def _fmod(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(NAN)).otherwise(a % F.when(b == 0, F.lit(1.0)).otherwise(b))


for _name, _f in (
    ("SIN", F.sin), ("COS", F.cos), ("TAN", F.tan), ("ASIN", F.asin), ("ACOS", F.acos), ("ATAN", F.atan), ("SINH", F.sinh), ("COSH", F.cosh), ("TANH", F.tanh), ("EXP", F.exp), ("LOG LN", _log(F.log)), ("LOG10", _log(F.log10)),
    ("SQRT", F.sqrt), ("SQUARE", lambda x: x * x), ("CUBE", lambda x: x * x * x), ("FLOOR", _whole(F.floor)), ("CEIL", _whole(F.ceil)),
    ("ROUND", _whole(lambda x: F.round(x, 0))), ("SIGN", lambda x: F.when(F.isnan(x), F.lit(0.0)).otherwise(F.signum(x))),
):
    _plain(_name, _f)


@register("ABS", 1)
def _abs(x):
    if x.kind == "complex":
        return _d(F.hypot(x.col["re"], x.col["im"]))
    return _d(F.abs(double(x)))


register("ATAN2", 2)(lambda y, x: _d(F.atan2(double(y), double(x))))
register("POW", 2)(lambda a, b: _d(F.pow(double(a), double(b))))
register("FMOD", 2)(lambda a, b: _d(_fmod(double(a), double(b))))
register("MIN", 2)(lambda a, b: _d(F.least(double(a), double(b))))
register("MAX", 2)(lambda a, b: _d(F.greatest(double(a), double(b))))
register("NEAR NEARABS", 2, 3)(lambda a, b, tol=None: Value(F.abs(double(a) - double(b)) < (double(tol) if tol else F.lit(1e-13)), "bool"))
register("INT INTEGER", 1)(lambda x: Value(double(x).cast("long") if x.kind == "double" else integer(x), "int"))
register("BOOL BOOLEAN", 1)(lambda x: Value(boolean(x), "bool"))
register("STRING STR", 1)(lambda x: Value(text(x), "string"))
register("PI", 0)(lambda: _d(F.lit(math.pi)))
register("E", 0)(lambda: _d(F.lit(math.e)))
register("C", 0)(lambda: _d(F.lit(299792458.0)))
register("RAND", 0, None)(lambda *_: _d(F.rand()))
register("ISNAN", 1)(lambda x: Value(F.isnan(double(x)), "bool"))
register("ISINF", 1)(lambda x: Value(F.abs(double(x)) == INF, "bool"))
register("ISFINITE", 1)(lambda x: Value(~F.isnan(double(x)) & (F.abs(double(x)) != INF), "bool"))
register("ISDEF ISDEFINED", 1)(lambda x: Value(F.lit(True), "bool"))
register("ISNULL", 1)(lambda x: Value(x.col.isNull(), "bool"))

# --- complex numbers ---
register("COMPLEX", 2)(lambda a, b: Value(complex_of(double(a), double(b)), "complex"))
register("REAL", 1)(lambda x: _d(x.col["re"] if x.kind == "complex" else double(x)))
register("IMAG", 1)(lambda x: _d(x.col["im"] if x.kind == "complex" else double(x) * 0.0))
register("NORM", 1)(lambda x: _d(x.col["re"] * x.col["re"] + x.col["im"] * x.col["im"] if x.kind == "complex" else double(x) * double(x)))
register("ARG", 1)(lambda x: _d(F.atan2(x.col["im"], x.col["re"]) if x.kind == "complex" else double(x) * 0.0))
register("CONJ", 1)(lambda x: Value(complex_of(x.col["re"], -x.col["im"]), "complex") if x.kind == "complex" else _d(double(x)))

# --- text ---
_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_s = lambda col: Value(col, "string")
register("STRLEN LEN", 1)(lambda x: Value(F.octet_length(text(x)).cast("long"), "int"))
register("UPCASE UPPER", 1)(lambda x: _s(F.translate(text(x), _LOWER, _UPPER)))
register("DOWNCASE LOWER", 1)(lambda x: _s(F.translate(text(x), _UPPER, _LOWER)))
register("TRIM", 1)(lambda x: _s(F.regexp_replace(text(x), r"^[ \t\n\r]+|[ \t\n\r]+\z", "")))
register("LTRIM", 1)(lambda x: _s(F.regexp_replace(text(x), r"^[ \t\n\r]+", "")))
register("RTRIM", 1)(lambda x: _s(F.regexp_replace(text(x), r"[ \t\n\r]+\z", "")))
register("SREVERSE", 1)(lambda x: _s(F.reverse(text(x))))


@register("CAPITALIZE", 1)
def _capitalize(x):
    """First letters of words in upper case, the others in lower; words begin behind a space or tab."""
    by_space = F.transform(F.split(F.translate(text(x), _UPPER, _LOWER), "(?<=[ \t])"), lambda w: F.concat(F.translate(F.substring(w, 1, 1), _LOWER, _UPPER), F.substring(w, 2, 2147483647)))
    return _s(F.array_join(by_space, ""))


@register("SUBSTR", 2, 3)
def _substr(s, start, size=None):
    at, t = integer(start).cast("int"), text(s)
    length = F.greatest(integer(size).cast("int"), F.lit(0)) if size is not None else F.lit(2147483647)
    return _s(F.when((at < 0) | (at >= F.length(t)), F.lit("")).otherwise(F.substring(t, F.greatest(at, F.lit(0)) + 1, length)))


register("REPLACE", 3)(lambda s, old, new: _s(F.when(text(old) == "", text(s)).otherwise(F.replace(text(s), text(old), text(new)))))

# --- dates: MJD days ---
_DAY0 = "1858-11-17"
_date = lambda mjd: F.date_add(F.lit(_DAY0).cast("date"), F.floor(mjd).cast("int"))
_seconds = lambda mjd: F.floor((mjd - F.floor(mjd)) * 86400.0).cast("long")
_i = lambda col: Value(col.cast("long"), "int")


@register("DATETIME", 1)
def _datetime(x):
    t = F.trim(text(x))
    part = lambda k: F.regexp_extract(t, r"^(\d+)[/-](\d+)[/-](\d+)(?:/(\d+)(?::(\d+)(?::(\d+))?)?)?", k)
    number = lambda k: F.coalesce(F.nullif(part(k), F.lit("")), F.lit("0")).cast("int")
    days = F.datediff(F.make_date(number(1), number(2), number(3)), F.lit(_DAY0).cast("date")).cast("double")
    return _d(days + (number(4) * 3600 + number(5) * 60 + number(6)).cast("double") / 86400.0)


register("MJD", 1)(lambda x: _d(double(x)))
register("DATE", 1)(lambda x: _d(_whole(F.floor)(double(x))))
register("TIME", 1)(lambda x: _d(_seconds(double(x)).cast("double")))
register("YEAR", 1)(lambda x: _i(F.year(_date(double(x)))))
register("MONTH", 1)(lambda x: _i(F.month(_date(double(x)))))
register("DAY", 1)(lambda x: _i(F.day(_date(double(x)))))
register("CMONTH", 1)(lambda x: _s(F.date_format(_date(double(x)), "MMM")))
register("WEEKDAY DOW", 1)(lambda x: _i(F.dayofweek(_date(double(x))) - 1))
register("CDOW CWEEKDAY", 1)(lambda x: _s(F.date_format(_date(double(x)), "EEE")))
register("WEEK", 1)(lambda x: _i(F.floor((F.dayofyear(_date(double(x))) - 1) / 7) + 1))
_clock = lambda s: F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)
register("CTIME", 1)(lambda x: _s(_clock(_seconds(double(x)))))
register("MJDTODATE CTOD CDATE", 1)(lambda x: _s(F.concat(F.date_format(_date(double(x)), "yyyy/MM/dd"), F.lit("/"), _clock(_seconds(double(x))))))

# --- angles: radians ---
register("HMS", 1)(lambda x: _s(sky.hms(double(x))))
register("DMS", 1)(lambda x: _s(sky.dms(double(x))))
register("HDMS", 1)(lambda x: _s(F.concat(sky.hms(double(x)), F.lit(" "), sky.dms(double(x)))))
register("NORMANGLE", 1)(lambda x: _d(F.pmod(double(x), F.lit(2 * math.pi))))
register("ANGDIST", 4)(lambda *a: _d(sky.distance(*map(double, a))))
register("ANGDISTX", 4)(lambda *a: Value(F.array(sky.distance(*map(double, a)), F.lit(0.0)), "array"))


@register("INCONE ANYCONE CONES", 5)
def _incone(l1, b1, l2, b2, r):
    l1, b1, l2, b2, r = map(double, (l1, b1, l2, b2, r))
    # the band of latitudes is a cheap first test, and one that a join or a scan can use
    return Value((F.abs(b1 - b2) <= r) & (sky.distance(l1, b1, l2, b2) <= r), "bool")


register("FINDCONE", 5)(lambda l1, b1, l2, b2, r: _i(F.when(sky.distance(*map(double, (l1, b1, l2, b2))) <= double(r), 0).otherwise(-1)))


@register("CONES3 ANYCONE3 FINDCONE3", 3)
def _cones3(position, cones, radius):
    """Position [l, b] in any of the cones [l, b, l, b, ...] of one radius."""
    p, c, r = array(position), array(cones), double(radius)
    at = lambda i: sky.distance(F.element_at(p, 1), F.element_at(p, 2), F.element_at(c, 2 * i + 1), F.element_at(c, 2 * i + 2)) <= r
    return Value(F.exists(F.sequence(F.lit(0), F.greatest(F.floor(F.size(c) / 2).cast("int") - 1, F.lit(0))), lambda i: (F.size(c) >= 2) & at(i)), "bool")


# --- arrays of doubles ---
_sum = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
_n = lambda a: F.size(a).cast("double")
_mean = lambda a: F.when(F.size(a) == 0, F.lit(0.0)).otherwise(_sum(a) / F.greatest(_n(a), F.lit(1.0)))
_count = lambda a, f: F.size(F.filter(a, f)).cast("long")


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _median(a: Column) -> Column:
    s = F.array_sort(a)
    half = F.floor(F.size(a) / 2).cast("int")
    middle = lambda x: F.when(F.size(x) % 2 == 1, F.get(x, half)).otherwise((F.get(x, half - 1) + F.get(x, half)) / 2)
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(_let(s, middle))


def _variance(a: Column) -> Column:
    spread = lambda m: F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.greatest(_n(a), F.lit(1.0))
    return F.when(F.size(a) < 2, F.lit(0.0)).otherwise(_let(_mean(a), spread))


def _array_function(names: str, f, kind: str = "double") -> None:
    register(names, 1)(lambda a: Value(f(array(a)), kind))


register("NDIM", 1)(lambda x: Value(F.lit(1 if x.kind == "array" else 0).cast("long"), "int"))
register("NELEM NELEMENTS", 1)(lambda x: Value(F.size(x.col).cast("long") if x.kind == "array" else F.lit(1).cast("long"), "int"))
register("SHAPE", 1)(lambda x: Value(F.array(_n(x.col)) if x.kind == "array" else F.array().cast("array<double>"), "array"))
_array_function("ARRSUM SUM", _sum)
_array_function("ARRMIN", lambda a: F.coalesce(F.array_min(a), F.lit(0.0)))
_array_function("ARRMAX", lambda a: F.coalesce(F.array_max(a), F.lit(0.0)))
_array_function("MIN", lambda a: F.coalesce(F.array_min(a), F.lit(0.0)))
_array_function("MAX", lambda a: F.coalesce(F.array_max(a), F.lit(0.0)))
_array_function("ARRMEAN MEAN", _mean)
_array_function("ARRMEDIAN MEDIAN", _median)
_array_function("ARRVARIANCE VARIANCE", _variance)
_array_function("ARRSTDDEV STDDEV", lambda a: F.sqrt(_variance(a)))
_array_function("ARRRMS RMS", lambda a: F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x) / F.greatest(_n(a), F.lit(1.0)))))
_array_function("ARRAVDEV AVDEV", lambda a: _let(_mean(a), lambda m: F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.abs(x - m)) / F.greatest(_n(a), F.lit(1.0)))))
_array_function("ARRPRODUCT PRODUCT", lambda a: F.aggregate(a, F.lit(1.0), lambda s, x: s * x))
_array_function("ARRSUMSQR SUMSQR", lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))
_array_function("ARRANY ANY", lambda a: F.exists(a, lambda x: x != 0), "bool")
_array_function("ARRALL ALL", lambda a: F.forall(a, lambda x: x != 0), "bool")
_array_function("ARRNTRUE NTRUE", lambda a: _count(a, lambda x: x != 0), "int")
_array_function("ARRNFALSE NFALSE", lambda a: _count(a, lambda x: x == 0), "int")
_array_function("ARRFLAT FLATTEN", lambda a: a, "array")
_array_function("AREVERSE REVERSE", F.reverse, "array")
register("TRANSPOSE", 1, None)(lambda a, *_: Value(array(a), "array"))
register("DIAGONAL", 1, None)(lambda a, *_: _d(F.coalesce(F.get(array(a), F.lit(0)), F.lit(0.0))))
register("ARRFRACTILE FRACTILE", 2)(lambda a, f: _d(F.coalesce(F.get(F.array_sort(array(a)), F.floor(double(f) * (F.size(array(a)) - 1)).cast("int")), F.lit(0.0))))


@register("ARRAY", 2, None)
def _array(v, *shape):
    n = integer(shape[0])
    for s in shape[1:]:
        n = n * integer(s)
    return Value(F.array_repeat(double(v), n.cast("int")), "array")


@register("RESIZE", 2)
def _resize(a, n):
    n = integer(n).cast("int")
    return Value(F.slice(F.concat(array(a), F.array_repeat(F.lit(0.0), n)), F.lit(1), n), "array")


# --- measures: J2000, UTC and ITRF in ---
for _names, _frame in (("J2000 ICRS", "J2000"), ("GALACTIC GAL", "GALACTIC"), ("ECLIPTIC ECL", "ECLIPTIC"), ("B1950", "B1950")):
    for _n1 in _names.split():
        register(f"MEAS_DIR_{_n1}", 2)(lambda lon, lat, frame=_frame: Value(F.array(*sky.convert_direction(double(lon), double(lat), "J2000", frame)), "array"))
for _names, _scale in (("UTC", "UTC"), ("TAI", "TAI"), ("TDT TT", "TT"), ("TDB", "TDB")):
    for _n1 in _names.split():
        register(f"MEAS_EPOCH_{_n1}", 1)(lambda mjd, scale=_scale: _d(sky.convert_epoch(double(mjd), "UTC", scale)))
register("MEAS_POS_ITRF", 3)(lambda x, y, z: Value(F.array(*map(double, (x, y, z))), "array"))
register("MEAS_POS_WGS84", 3)(lambda x, y, z: Value(F.array(*sky.itrf_to_wgs84(*map(double, (x, y, z)))), "array"))
