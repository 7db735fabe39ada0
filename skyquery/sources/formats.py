"""Reading and writing files, and keyword records."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Formats that Spark reads and writes itself.
FORMATS = ("parquet", "orc", "csv", "json", "text")


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: T.StructType | str | None = None, **options) -> DataFrame:
    """A table of files. CSV has a header line; give a schema to spare the pass that infers one."""
    if kind not in FORMATS and kind != "jdbc":
        raise ValueError(f"unknown format {kind}")
    reader = spark.read.format(kind)
    if kind == "csv":
        options = {"header": True, "inferSchema": schema is None} | options
    if schema is not None:
        reader = reader.schema(schema)
    return reader.options(**options).load(path) if kind != "jdbc" else reader.options(**options).load()


def write(frame: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", partition_by: list[str] | None = None, **options) -> None:
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}")
    writer = frame.write.format(kind).mode(mode).options(**({"header": True} if kind == "csv" else {}), **options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def record_to_json(record: dict) -> str:
    """A keyword record: an ordered map of values, lists and records; complex numbers as [re, im] under ``complex``."""

    def plain(x):
        if isinstance(x, complex):
            return {"complex": [x.real, x.imag]}
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        if isinstance(x, (list, tuple)):
            return [plain(v) for v in x]
        if x is None or isinstance(x, (bool, int, float, str)):
            return x
        raise TypeError(f"a record cannot hold {type(x).__name__}")

    return json.dumps(plain(record))


def record_from_json(text: str) -> dict:
    def back(x):
        if isinstance(x, dict):
            return complex(*x["complex"]) if set(x) == {"complex"} else {k: back(v) for k, v in x.items()}
        return [back(v) for v in x] if isinstance(x, list) else x

    return back(json.loads(text))


def schema_from_text(text: str) -> T.StructType:
    """Columns from lines such as ``NAME double 2-D unit=s # comment``; other lines are left out."""
    from .tables import TYPES

    fields = []
    for line in text.splitlines():
        m = re.match(r"\s*([A-Za-z_]\w*)\s+([A-Za-z]\w*)\s*(array|(\d)-?D)?\s*(?:unit=(\S+))?\s*(?:#\s*(.*))?$", line, re.IGNORECASE)
        if m and m[2].upper() in TYPES:
            known = {k: v for k, v in (("ndim", int(m[4]) if m[4] else None), ("unit", m[5]), ("comment", m[6])) if v}
            kind = TYPES[m[2].upper()]
            fields.append(T.StructField(m[1], T.ArrayType(kind) if m[3] else kind, True, known))
    return T.StructType(fields)
