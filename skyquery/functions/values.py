"""Columns with their kind: the static side of a language whose values have dynamic types."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.lexer import QueryError

INF = float("inf")
NAN = float("nan")


@dataclass(frozen=True)
class Value:
    """kind: int, double, bool, string, complex, array (of double), null or other."""

    col: Column
    kind: str
    constant: object = None


def of_type(col: Column, kind: T.DataType) -> Value:
    """A column as the language sees it: integers wide, fractions double, timestamps as MJD days."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return Value(col if isinstance(kind, T.LongType) else col.cast("long"), "int")
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return Value(col if isinstance(kind, T.DoubleType) else col.cast("double"), "double")
    if isinstance(kind, T.BooleanType):
        return Value(col, "bool")
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return Value(col, "string")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return Value(F.unix_micros(col.cast("timestamp")).cast("double") / 86400e6 + 40587.0, "double")
    if isinstance(kind, T.DateType):
        return Value(F.datediff(col, F.lit("1858-11-17").cast("date")).cast("double"), "double")
    if isinstance(kind, T.StructType) and {f.name for f in kind} == {"re", "im"}:
        return Value(complex_of(col["re"].cast("double"), col["im"].cast("double")), "complex")
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.BooleanType):
            return Value(F.transform(col, lambda x: x.cast("int").cast("double")), "array")
        if isinstance(kind.elementType, T.NumericType):
            return Value(col if isinstance(kind.elementType, T.DoubleType) else col.cast("array<double>"), "array")
    if isinstance(kind, T.NullType):
        return Value(col, "null")
    return Value(col, "other")


def complex_of(re: Column, im: Column) -> Column:
    return F.struct(re.alias("re"), im.alias("im"))


def integer(v: Value, what: str = "an integer") -> Column:
    if v.kind == "int":
        return v.col
    if v.kind == "bool":
        return v.col.cast("long")
    raise QueryError(f"{what} is needed, not {v.kind}")


def double(v: Value) -> Column:
    if v.kind == "double":
        return v.col
    if v.kind in ("int", "null"):
        return v.col.cast("double")
    if v.kind == "bool":
        return v.col.cast("int").cast("double")
    raise QueryError(f"a number is needed, not {v.kind}")


def boolean(v: Value) -> Column:
    if v.kind == "bool":
        return v.col
    if v.kind in ("int", "double"):
        return v.col != 0
    raise QueryError(f"a condition is needed, not {v.kind}")


def text(v: Value) -> Column:
    """As text; doubles with six decimals."""
    if v.kind == "string":
        return v.col
    if v.kind == "double":
        return F.format_string("%f", v.col)
    if v.kind in ("int", "bool", "null"):
        return v.col.cast("string")
    raise QueryError(f"a text is needed, not {v.kind}")


def array(v: Value) -> Column:
    """As an array of doubles; a number is an array of one."""
    if v.kind == "array":
        return v.col
    if v.kind in ("int", "double", "bool"):
        return F.array(double(v))
    raise QueryError(f"an array is needed, not {v.kind}")


def complex_(v: Value) -> Column:
    return v.col if v.kind == "complex" else complex_of(double(v), F.lit(0.0))


def common(a: Value, b: Value) -> tuple[Column, Column, str]:
    """Two values in a kind that holds both."""
    if a.kind == b.kind:
        return a.col, b.col, a.kind
    kinds = {a.kind, b.kind}
    if "null" in kinds:
        return a.col, b.col, (kinds - {"null"}).pop()
    if "array" in kinds:
        return array(a), array(b), "array"
    if "string" in kinds:
        return text(a), text(b), "string"
    if "complex" in kinds:
        return complex_(a), complex_(b), "complex"
    if "other" in kinds:
        raise QueryError("values of these types cannot be mixed")
    return (double(a), double(b), "double") if "double" in kinds else (integer(a), integer(b), "int")
