"""Tables with row numbers and keywords: a folder of Parquet versions and one metadata file.

Every change writes a new version beside the old one and then replaces the metadata, which
names the current version, in one rename. Readers see the old or the new table, never a part
of either; the version before the current one is kept for readers that have begun, and older ones go. Metadata are read
anew for each change, and of several writers whose changes start from one version one succeeds, so that no change is lost.
"""

from __future__ import annotations

import json
import re
import tempfile
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.aggregates import ROWNR
from ..plans.lexer import QueryError

# Column types by the names they have in queries.
TYPES = {
    **dict.fromkeys(("BOOL", "B", "BOOLEAN"), T.BooleanType()), **dict.fromkeys(("SHORT", "I2", "INT16"), T.ShortType()), **dict.fromkeys(("INT", "I4", "INT32", "I", "INTEGER"), T.IntegerType()),
    **dict.fromkeys(("INT64", "I8", "BIGINT"), T.LongType()), **dict.fromkeys(("FLOAT", "R4"), T.FloatType()), **dict.fromkeys(("DOUBLE", "R8", "D"), T.DoubleType()),
    **dict.fromkeys(("STRING", "S"), T.StringType()), **dict.fromkeys(("COMPLEX", "C4"), T.StructType([T.StructField("re", T.FloatType()), T.StructField("im", T.FloatType())])),
    **dict.fromkeys(("DCOMPLEX", "C8"), T.StructType([T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())])),
}


def column_type(name: str) -> T.DataType:
    if name.upper() not in TYPES:
        raise QueryError(f"unknown type {name}")
    return TYPES[name.upper()]


def field(spec: dict) -> T.StructField:
    """A column from its definition: name, type and options; with a shape or dimensions it is an array."""
    kind = column_type(spec["type"])
    known = {k: spec[k] for k in ("ndim", "shape", "unit", "comment") if k in spec}
    return T.StructField(spec["name"], T.ArrayType(kind) if {"ndim", "shape"} & set(known) else kind, True, known)


def ordered(frame: DataFrame) -> DataFrame:
    """With a number that grows with the rows' order, if there is none yet."""
    return frame if ROWNR in frame.columns else frame.withColumn(ROWNR, F.monotonically_increasing_id())


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is not set a temporary folder will do on a single machine, and only there."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: executors could not share what is written")
    return (named or tempfile.gettempdir()).rstrip("/")


def _settled(frame: DataFrame) -> DataFrame:
    """The frame itself if its partitions are those of files or local data, else what a checkpoint keeps of it."""
    if "Exchange" not in frame._jdf.queryExecution().executedPlan().toString():
        return frame
    spark = frame.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return frame.checkpoint()


def numbered(frame: DataFrame) -> DataFrame:
    """With the numbers 0, 1, ... of the rows in the order in which they are read, if there are none yet.

    Counts the rows of each partition first; no window is needed. Files and local data read
    their rows in the same order each time. The rows of a plan that shuffles may come in other partitions
    the second time, so they are written to the checkpoint folder first.
    """
    if ROWNR in frame.columns:
        return frame
    frame = _settled(frame)
    counts = frame.groupBy(F.spark_partition_id().alias("p")).count().collect()
    starts, total = {}, 0
    for p, n in sorted((r[0], r[1]) for r in counts):
        starts[p], total = total, total + n
    width = max(starts, default=0) + 1
    offsets = F.split(F.lit(",".join(str(starts.get(p, 0)) for p in range(width))), ",").cast("array<bigint>")
    number = F.monotonically_increasing_id()
    return frame.withColumn(ROWNR, number).withColumn(ROWNR, F.element_at(offsets, F.shiftright(ROWNR, 33).cast("int") + 1) + F.col(ROWNR).bitwiseAND(F.lit((1 << 33) - 1)))


def by_key(frame: DataFrame, key: Column) -> DataFrame:
    """With row numbers that a column of whole numbers gives."""
    return frame.withColumn(ROWNR, key.cast("long"))


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _folder(warehouse: str, name: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_][A-Za-z0-9_.-]*", name) or ".." in name:
        raise QueryError(f"{name!r} is no name for a table")
    return f"{warehouse.rstrip('/')}/{name}"


def exists(spark: SparkSession, warehouse: str, name: str) -> bool:
    if not re.fullmatch(r"[A-Za-z0-9_][A-Za-z0-9_.-]*", name):
        return False
    fs, path = _fs(spark, f"{_folder(warehouse, name)}/table.json")
    return bool(fs.exists(path))


class Table:
    """A table in a warehouse folder. Rows keep their numbers; all changes are made at once."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._meta = self._read()
        self._based = self._meta["version"]

    # --- opening and creating ---
    @classmethod
    def open(cls, spark: SparkSession, warehouse: str, name: str) -> Table:
        if not exists(spark, warehouse, name):
            raise QueryError(f"there is no table {name}")
        return cls(spark, _folder(warehouse, name))

    @classmethod
    def create(cls, spark: SparkSession, warehouse: str, name: str, schema: T.StructType, rows: int = 0, keywords: dict | None = None) -> Table:
        """A new table of so many empty rows."""
        if exists(spark, warehouse, name):
            raise QueryError(f"table {name} exists")
        empty = spark.range(rows).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema], F.col("id").alias(ROWNR))
        return cls._begin(spark, _folder(warehouse, name), empty, keywords or {}, {f.name: f.metadata for f in schema})

    @classmethod
    def save(cls, frame: DataFrame, warehouse: str, name: str, keywords: dict | None = None) -> Table:
        """A new table of the frame's rows."""
        if exists(frame.sparkSession, warehouse, name):
            raise QueryError(f"table {name} exists")
        return cls._begin(frame.sparkSession, _folder(warehouse, name), frame, keywords or {}, {f.name: f.metadata for f in frame.schema})

    @classmethod
    def _begin(cls, spark: SparkSession, folder: str, frame: DataFrame, keywords: dict, columns: dict) -> Table:
        out = object.__new__(cls)
        out.spark, out.folder, out._based = spark, folder, None
        out._meta = {"version": None, "before": None, "keywords": keywords, "columns": columns, "info": {"type": "", "subtype": ""}, "rows": 0}
        out.replace(frame, renumber=ROWNR not in frame.columns)
        return out

    # --- metadata ---
    def _read(self) -> dict:
        fs, path = _fs(self.spark, f"{self.folder}/table.json")
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _write(self) -> None:
        fs, temporary = _fs(self.spark, f"{self.folder}/.table-{uuid.uuid4().hex}.json")
        stream = fs.create(temporary, True)
        stream.write(bytearray(json.dumps(self._meta).encode()))
        stream.close()
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/table.json")
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(temporary.toUri() if temporary.isAbsoluteAndSchemeAuthorityNull() is False else fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(temporary, target, options)

    def _change(self, change: Callable[[dict], None], seconds: float = 30.0) -> None:
        """Applies a change to the metadata as they are now, while no other handle does."""
        fs, path = _fs(self.spark, f"{self.folder}/.commit")
        until = time.monotonic() + seconds
        while True:
            try:
                if fs.createNewFile(path):
                    break
            except Py4JJavaError as e:
                raise QueryError(f"the table cannot be written: {e.java_exception.getMessage()}") from None
            if time.monotonic() > until:
                raise QueryError(f"another writer holds {self.folder}/.commit")
            time.sleep(0.05)
        try:
            if self._meta["version"] is not None or self._there():
                self._meta = self._read()
            change(self._meta)
            self._write()
        finally:
            fs.delete(path, False)

    def _there(self) -> bool:
        fs, path = _fs(self.spark, f"{self.folder}/table.json")
        return bool(fs.exists(path))

    def _now(self) -> dict:
        self._meta = self._read()
        return self._meta

    def keywords(self) -> dict:
        meta = self._now()
        return {**meta["keywords"], "_columns": meta["columns"]}

    def keyword(self, name: str):
        return _known(self._now(), name)

    def set_keyword(self, name: str, value) -> None:
        self._change(lambda meta: meta["keywords"].__setitem__(name, value))

    def drop_keyword(self, name: str) -> None:
        def change(meta: dict) -> None:
            _known(meta, name)
            del meta["keywords"][name]

        self._change(change)

    def column_keywords(self, column: str) -> dict:
        return self._now()["columns"].get(column, {})

    def set_column_keyword(self, column: str, name: str, value) -> None:
        self._change(lambda meta: meta["columns"].setdefault(column, {}).__setitem__(name, value))

    def info(self) -> dict:
        return dict(self._now()["info"])

    def set_info(self, kind: str = "", subtype: str = "") -> None:
        self._change(lambda meta: meta.__setitem__("info", {"type": kind, "subtype": subtype}))

    # --- rows ---
    def frame(self) -> DataFrame:
        """The rows as they are now, with their numbers in a hidden column. What is written next is taken to start from them."""
        self._based = self._now()["version"]
        return self.spark.read.parquet(f"{self.folder}/{self._based}")

    def count(self) -> int:
        return self._now()["rows"]

    def row(self, number: int) -> dict:
        found = self.frame().filter(F.col(ROWNR) == number).first()
        if found is None:
            raise IndexError(f"no row {number}")
        return {k: v for k, v in found.asDict(recursive=True).items() if k != ROWNR}

    def cell(self, column: str, number: int):
        return self.row(number)[column]

    def replace(self, frame: DataFrame, renumber: bool = False, columns: dict | None = None) -> None:
        """Makes the frame's rows the table's. Renumbered rows keep their order and are numbered without gaps.

        ``columns``: keywords of new columns. If the table has another version than the one that ``frame`` last gave, nothing is changed and QueryError raised.
        """
        version, based = f"v-{uuid.uuid4().hex}", self._based
        if renumber:
            keyed = ordered(frame)
            held = f"{self.folder}/.sorted-{uuid.uuid4().hex}"
            # sorted and written first, so that the numbers are given to rows whose order is fixed
            keyed.orderBy(ROWNR).drop(ROWNR).withColumn("_part", F.spark_partition_id()).withColumn("_nth", F.monotonically_increasing_id()).write.parquet(held)
            rows = self.spark.read.parquet(held)
            starts, total = {}, 0
            for p, low, n in sorted((r[0], r[1], r[2]) for r in rows.groupBy("_part").agg(F.min("_nth"), F.count(F.lit(1))).collect()):
                starts[p], total = total - low, total + n
            offsets = F.split(F.lit(",".join(str(starts.get(p, 0)) for p in range(max(starts, default=0) + 1))), ",").cast("array<bigint>")
            frame = rows.withColumn(ROWNR, F.col("_nth") + F.element_at(offsets, F.col("_part") + 1)).drop("_part", "_nth")
            frame.write.parquet(f"{self.folder}/{version}")
            self._delete(held)
        else:
            frame.write.parquet(f"{self.folder}/{version}")
        rows, gone = self.spark.read.parquet(f"{self.folder}/{version}").count(), []

        def change(meta: dict) -> None:
            if meta["version"] != based:
                raise QueryError("the table was changed by another writer meanwhile")
            gone.append(meta.get("before"))
            meta["before"], meta["version"], meta["rows"] = meta["version"], version, rows
            meta["columns"].update(columns or {})

        try:
            self._change(change)
        except QueryError:
            self._delete(f"{self.folder}/{version}")
            raise
        self._based = version
        if gone[0]:
            self._delete(f"{self.folder}/{gone[0]}")

    def _delete(self, path: str) -> None:
        fs, p = _fs(self.spark, path)
        fs.delete(p, True)

    def append(self, rows: DataFrame) -> int:
        """Adds rows; columns they lack are null. Returns how many."""
        now = self.frame()
        missing = [c for c in rows.columns if c not in now.columns]
        if missing:
            raise QueryError(f"unknown column {missing[0]}")
        first = self.count()
        fresh = numbered(rows.drop(ROWNR)).withColumn(ROWNR, F.col(ROWNR) + first)
        kinds = {f.name: f.dataType for f in now.schema}
        fresh = fresh.select(*[F.col(c).cast(kinds[c]) if c in fresh.columns else F.lit(None).cast(kinds[c]).alias(c) for c in now.columns])
        self.replace(now.unionByName(fresh))
        return self.count() - first

    def add_rows(self, n: int) -> None:
        if n:
            now = self.frame()
            fresh = self.spark.range(n).select(*[(F.col("id") + self.count()).alias(c) if c == ROWNR else F.lit(None).cast(now.schema[c].dataType).alias(c) for c in now.columns])
            self.replace(now.unionByName(fresh))

    def remove_rows(self, numbers: list[int]) -> None:
        """Removes rows, all at once; those behind them move up."""
        gone = self.spark.createDataFrame([(n,) for n in set(numbers)], "n long")
        self.replace(self.frame().join(gone, F.col(ROWNR) == F.col("n"), "left_anti"), renumber=True)

    def put_cells(self, column: str, values: dict[int, object]) -> None:
        """Sets cells of a column, by row number."""
        kind = self.frame().schema[column].dataType
        given = self.spark.createDataFrame(list(values.items()), T.StructType([T.StructField("_n", T.LongType()), T.StructField("_v", kind)]))
        joined = self.frame().join(given, F.col(ROWNR) == F.col("_n"), "left")
        self.replace(joined.withColumn(column, F.when(F.col("_n").isNotNull(), F.col("_v")).otherwise(F.col(column))).drop("_n", "_v"))

    def add_column(self, spec: T.StructField) -> None:
        if spec.name in self.frame().columns:
            raise QueryError(f"column {spec.name} exists")
        self.replace(self.frame().withColumn(spec.name, F.lit(None).cast(spec.dataType)), columns={spec.name: spec.metadata})

    # --- locks: advisory ---
    def lock(self, owner: str = "") -> bool:
        """True if the lock is now held; another's lock stays."""
        fs, path = _fs(self.spark, f"{self.folder}/table.lock")
        if fs.exists(path):
            return False
        stream = fs.create(path, False)
        stream.write(bytearray(owner.encode()))
        stream.close()
        return True

    def unlock(self) -> None:
        self._delete(f"{self.folder}/table.lock")

    def is_locked(self) -> bool:
        fs, path = _fs(self.spark, f"{self.folder}/table.lock")
        return bool(fs.exists(path))

    def drop(self, force: bool = False) -> None:
        """Deletes the table's own folder; a locked one only if forced."""
        if self.is_locked() and not force:
            raise QueryError("the table is locked")
        self._delete(self.folder)


def _known(meta: dict, name: str):
    if name not in meta["keywords"]:
        raise QueryError(f"there is no keyword {name}")
    return meta["keywords"][name]


def difference(a: Table, b: Table) -> list[str]:
    """How two tables differ in columns, types, numbers of rows, and keywords."""
    x, y = ({f.name: f.dataType.simpleString() for f in t.frame().schema if f.name != ROWNR} for t in (a, b))
    out = [f"column {c}: {x.get(c)} and {y.get(c)}" for c in sorted({*x, *y}) if x.get(c) != y.get(c)]
    if a.count() != b.count():
        out.append(f"rows: {a.count()} and {b.count()}")
    k, m = a.keywords(), b.keywords()
    return out + [f"keyword {n}: {k.get(n)!r} and {m.get(n)!r}" for n in sorted({*k, *m}) if n != "_columns" and k.get(n) != m.get(n)]
