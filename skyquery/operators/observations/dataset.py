"""A dataset of main and dimension tables: opening, saving, checking, summing up, flagging, chunking, merging."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...functions.aggregates import ROWNR
from ...sources import tables as managed
from ...sources.tables import numbered
from ..views import group_rows, group_sizes, groups
from .schema import FOREIGN_KEYS, MAIN, REQUIRED, SUBTABLES


@dataclass
class Observation:
    main: DataFrame
    sub: dict[str, DataFrame] = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        """A dimension table with its rows' numbers."""
        if name not in self.sub:
            raise KeyError(f"there is no table {name}")
        return numbered(self.sub[name])

    @property
    def rows(self) -> DataFrame:
        return numbered(self.main)

    # --- storage ---
    @staticmethod
    def create(spark: SparkSession) -> Observation:
        """Without rows, and with the required dimension tables."""
        empty = lambda schema: spark.createDataFrame([], schema)
        return Observation(empty(MAIN), {n: empty(SUBTABLES[n]) for n in REQUIRED})

    @staticmethod
    def open(spark: SparkSession, warehouse: str, name: str) -> Observation:
        main = managed.Table.open(spark, warehouse, name)
        parts = main.keywords().get("subtables", [])
        return Observation(main.frame(), {p: managed.Table.open(spark, warehouse, f"{name}.{p}").frame() for p in parts})

    def save(self, warehouse: str, name: str) -> None:
        """Dimension tables first, so that a dataset that can be opened is whole."""
        for part, frame in self.sub.items():
            managed.Table.save(frame, warehouse, f"{name}.{part}")
        managed.Table.save(self.main, warehouse, name, {"subtables": list(self.sub)})

    # --- checking ---
    def violations(self) -> list[str]:
        """References to rows that are not there: one line for each column, from one pass over the main table."""
        limits = {t: self.sub[t].count() for t in set(FOREIGN_KEYS.values()) if t in self.sub}
        checked = [c for c, t in FOREIGN_KEYS.items() if c in self.main.columns and t in limits]
        if not checked:
            return []
        bad = lambda c: (F.col(c) < 0) | (F.col(c) >= limits[FOREIGN_KEYS[c]])
        got = self.main.agg(*[F.count_if(bad(c)).alias(f"n_{c}") for c in checked], *[F.min(F.when(bad(c), F.col(c))).alias(f"x_{c}") for c in checked]).first()
        return [f"{c}: {got[f'n_{c}']} rows refer to no row of {FOREIGN_KEYS[c]} (such as {got[f'x_{c}']})" for c in checked if got[f"n_{c}"]]

    def validate(self) -> None:
        if found := self.violations():
            raise ValueError("; ".join(found))

    def with_dimensions(self) -> DataFrame:
        """Main rows with field, window and antenna names: broadcasts, as far as the dimension tables are small enough for Spark."""
        dim = lambda t, **cols: self.table(t).select(F.col(ROWNR).cast("int").alias(f"_{t}"), *[F.col(c).alias(a) for a, c in cols.items()])
        rows = self.rows
        for column, frame, key in (
            ("FIELD_ID", dim("FIELD", FIELD_NAME="NAME"), "_FIELD"),
            ("DATA_DESC_ID", dim("DATA_DESCRIPTION", SPECTRAL_WINDOW_ID="SPECTRAL_WINDOW_ID"), "_DATA_DESCRIPTION"),
            ("ANTENNA1", dim("ANTENNA", ANTENNA1_NAME="NAME"), "_ANTENNA"),
            ("ANTENNA2", dim("ANTENNA", ANTENNA2_NAME="NAME"), "_ANTENNA"),
        ):
            rows = rows.join(frame, F.col(column) == F.col(key), "left").drop(key)
        return rows

    # --- metadata ---
    def metadata(self) -> dict:
        """Names and sizes of the dimensions, and the distinct scans, arrays and observations."""
        distinct = self.main.agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in ("SCAN_NUMBER", "ARRAY_ID", "OBSERVATION_ID", "FIELD_ID", "DATA_DESC_ID", "STATE_ID") if c in self.main.columns], F.count(F.lit(1)).alias("rows"), F.min("TIME").alias("begin"), F.max("TIME").alias("end")).first().asDict()
        listed = lambda t, *cols: [r.asDict() for r in self.table(t).orderBy(ROWNR).select(*[c for c in cols if c in self.sub[t].columns]).collect()] if t in self.sub else []
        return distinct | {
            "antennas": listed("ANTENNA", "NAME", "STATION", "DISH_DIAMETER"), "fields": listed("FIELD", "NAME"), "windows": listed("SPECTRAL_WINDOW", "NAME", "NUM_CHAN", "REF_FREQUENCY"),
            "descriptions": listed("DATA_DESCRIPTION", "SPECTRAL_WINDOW_ID", "POLARIZATION_ID"), "observations": listed("OBSERVATION", "TELESCOPE_NAME", "OBSERVER"), "states": listed("STATE", "OBS_MODE"), "polarizations": listed("POLARIZATION", "CORR_TYPE"),
        }

    def summary(self) -> str:
        m = self.metadata()
        lines = [f"rows: {m['rows']}", f"time: {m['begin']} to {m['end']}", f"scans: {m.get('SCAN_NUMBER')}", f"arrays: {m.get('ARRAY_ID')}"]
        for what, key in (("observations", "TELESCOPE_NAME"), ("fields", "NAME"), ("antennas", "NAME"), ("windows", "NAME"), ("states", "OBS_MODE")):
            lines.append(f"{what} ({len(m[what])}): " + ", ".join(str(x.get(key)) for x in m[what]))
        return "\n".join(lines)

    # --- flags ---
    def flag_stats(self) -> DataFrame:
        return self.main.agg(F.count(F.lit(1)).alias("rows"), F.count_if("FLAG_ROW").alias("flagged"))

    def flagged(self, rows: list[int] | DataFrame, flag: bool = True) -> Observation:
        """FLAG_ROW set on rows by number; numbers that are not there are left out."""
        chosen = rows if isinstance(rows, DataFrame) else self.main.sparkSession.createDataFrame([(r,) for r in rows], "_r long")
        chosen = chosen.select(F.col(chosen.columns[0]).alias("_r")).distinct()
        main = self.rows.join(chosen, F.col(ROWNR) == F.col("_r"), "left")
        return Observation(main.withColumn("FLAG_ROW", F.when(F.col("_r").isNotNull(), F.lit(flag)).otherwise(F.col("FLAG_ROW"))).drop("_r"), self.sub)

    def flagged_where(self, condition, flag: bool = True) -> Observation:
        return Observation(self.rows.withColumn("FLAG_ROW", F.when(condition, F.lit(flag)).otherwise(F.col("FLAG_ROW"))), self.sub)

    # --- chunks ---
    CHUNK = ("ARRAY_ID", "FIELD_ID", "DATA_DESC_ID")

    def chunks(self) -> DataFrame:
        """Rows by (ARRAY_ID, FIELD_ID, DATA_DESC_ID), in key order. A chunk's numbers are one cell; ``chunk_sizes`` and ``chunk_rows`` take chunks of any size."""
        return groups(self.main, list(self.CHUNK))

    def chunk_sizes(self) -> DataFrame:
        """For each chunk how many rows it has (``n``), the ``first`` and the ``last``."""
        return group_sizes(self.main, list(self.CHUNK))

    def chunk_rows(self) -> DataFrame:
        """Each row's chunk and number, in chunk order."""
        return group_rows(self.main, list(self.CHUNK))

    def _timed(self, interval: float) -> tuple[DataFrame, Column]:
        """Rows with their bin, counted from the first time on, and the bin's centre."""
        if interval <= 0:
            raise ValueError("the interval must be above 0")
        first = self.main.agg(F.min("TIME")).first()[0]
        if first is None:
            first = 0.0
        bin_ = F.floor((F.col("TIME") - first) / interval).cast("long")
        return self.rows.withColumn("bin", bin_), (F.lit(first) + (F.col("bin") + 0.5) * interval).alias("centre")

    def time_chunks(self, interval: float) -> DataFrame:
        """Rows by time: bins of the interval from the first time on; bins without rows are left out. A bin's numbers are one cell; ``time_chunk_sizes`` takes bins of any size."""
        rows, centre = self._timed(interval)
        return groups(rows, ["bin"]).select("bin", centre, "rows").orderBy("bin")

    def time_chunk_sizes(self, interval: float) -> DataFrame:
        """For each bin its centre, how many rows it has (``n``), the ``first`` and the ``last``."""
        rows, centre = self._timed(interval)
        return group_sizes(rows, ["bin"]).select("bin", centre, "n", "first", "last").orderBy("bin")


def concatenate(a: Observation, b: Observation) -> Observation:
    """Two datasets as one. Dimension rows of the second that the first has by name are shared, others are added, and references follow.

    Antennas, fields and windows are the same by NAME, descriptions by window and
    polarization, observations and states are added.
    """
    sub = dict(a.sub)

    def merged(table: str, same: list[str], extra: DataFrame | None = None) -> DataFrame:
        """Adds the second's rows; returns (old, new) row numbers of the second."""
        first, second = a.table(table), extra if extra is not None else b.table(table)
        n = first.count()
        if same:
            known = first.groupBy(*same).agg(F.min(ROWNR).alias("_known"))
            joined = second.join(known, same, "left")
            # of rows that are new, and alike, the first is added
            fresh = joined.filter("_known is null").withColumn("_nth", F.row_number().over(Window.partitionBy(*same).orderBy(ROWNR))).filter("_nth = 1").drop("_nth")
        else:
            joined = second.withColumn("_known", F.lit(None).cast("long"))
            fresh = joined
        placed = numbered(fresh.withColumnRenamed(ROWNR, "_second").orderBy("_second"))
        placed = placed.withColumn("_new", F.col(ROWNR) + n).drop(ROWNR).withColumnRenamed("_second", ROWNR)
        columns = [c for c in a.sub[table].columns if c != ROWNR]
        sub[table] = first.select(*columns, ROWNR).unionByName(placed.select(*columns, F.col("_new").cast("long").alias(ROWNR)))
        if same:
            moved = joined.join(placed.select(*same, F.col("_new")), same, "left")
            return moved.select(F.col(ROWNR).alias("_old"), F.coalesce("_known", "_new").alias("_to"))
        return placed.select(F.col(ROWNR).alias("_old"), F.col("_new").alias("_to"))

    maps = {"ANTENNA1": merged("ANTENNA", ["NAME"]), "FIELD_ID": merged("FIELD", ["NAME"])}
    maps["ANTENNA2"] = maps["ANTENNA1"]
    windows = merged("SPECTRAL_WINDOW", ["NAME"])
    described = b.table("DATA_DESCRIPTION").join(windows, F.col("SPECTRAL_WINDOW_ID") == F.col("_old"), "left")
    described = described.withColumn("SPECTRAL_WINDOW_ID", F.coalesce(F.col("_to").cast("int"), F.col("SPECTRAL_WINDOW_ID"))).drop("_old", "_to")
    maps["DATA_DESC_ID"] = merged("DATA_DESCRIPTION", ["SPECTRAL_WINDOW_ID", "POLARIZATION_ID"], described)
    for column, table in (("OBSERVATION_ID", "OBSERVATION"), ("STATE_ID", "STATE")):
        if table in a.sub and table in b.sub:
            maps[column] = merged(table, [])
    second = b.rows
    for column, found in maps.items():
        if column in second.columns:
            f = found.select(F.col("_old"), F.col("_to"))
            second = second.join(f, F.col(column) == F.col("_old"), "left").withColumn(column, F.coalesce(F.col("_to").cast("int"), F.col(column))).drop("_old", "_to")
    columns = [c for c in a.main.columns if c != ROWNR]
    start = a.main.count()
    main = a.rows.select(*columns, ROWNR).unionByName(second.select(*columns, (F.col(ROWNR) + start).alias(ROWNR)))
    return Observation(main, sub)


class Writer:
    """Collects rows of the main and the dimension tables, and checks them before they become a dataset."""

    def __init__(self, spark: SparkSession):
        self.spark, self.staged = spark, {"MAIN": [], **{n: [] for n in SUBTABLES}}

    def add(self, table: str, **values) -> int:
        """Stages a row and returns its number."""
        schema = MAIN if table == "MAIN" else SUBTABLES[table]
        if unknown := [c for c in values if c not in schema.fieldNames()]:
            raise ValueError(f"{table} has no column {unknown[0]}")
        self.staged[table].append(values)
        return len(self.staged[table]) - 1

    def write(self) -> Observation:
        """The dataset. All references that lead nowhere are reported in one ValueError."""
        wrong = []
        for column, table in FOREIGN_KEYS.items():
            n = len(self.staged[table])
            wrong += [f"row {i}: {column} = {row[column]}, but {table} has {n} rows" for i, row in enumerate(self.staged["MAIN"]) if column in row and not 0 <= row[column] < n and not (column in ("STATE_ID", "OBSERVATION_ID") and row[column] == -1)]
        if wrong:
            raise ValueError("; ".join(wrong))
        made = {}
        for table, rows in self.staged.items():
            schema = MAIN if table == "MAIN" else SUBTABLES[table]
            if rows or table == "MAIN" or table in REQUIRED:
                full = [tuple(row.get(c) for c in schema.fieldNames()) for row in rows]
                made[table] = self.spark.createDataFrame(full, schema)
        return Observation(made.pop("MAIN"), made)


# Correlation codes.
STOKES = {"I": 1, "Q": 2, "U": 3, "V": 4, "RR": 5, "RL": 6, "LR": 7, "LL": 8, "XX": 9, "XY": 10, "YX": 11, "YY": 12}


def to_stokes(data, given: list[str], wanted: list[str]):
    """An array of complex correlations as other ones: copied if they are there, I, Q, U and V from circular or linear ones, else 0."""
    at = {name: F.element_at(data, i + 1) for i, name in enumerate(given)}
    zero = {"re": F.lit(0.0), "im": F.lit(0.0)}

    def part(name: str, which: str):
        return at[name][which].cast("double") if name in at else zero[which]

    def combine(terms):
        re, im = F.lit(0.0), F.lit(0.0)
        for name, factor in terms:
            f = complex(factor)
            re = re + part(name, "re") * f.real - part(name, "im") * f.imag
            im = im + part(name, "re") * f.imag + part(name, "im") * f.real
        return F.struct(re.alias("re"), im.alias("im"))

    circular = {"I": [("RR", 0.5), ("LL", 0.5)], "Q": [("RL", 0.5), ("LR", 0.5)], "U": [("RL", -0.5j), ("LR", 0.5j)], "V": [("RR", 0.5), ("LL", -0.5)]}
    linear = {"I": [("XX", 0.5), ("YY", 0.5)], "Q": [("XX", 0.5), ("YY", -0.5)], "U": [("XY", 0.5), ("YX", 0.5)], "V": [("XY", -0.5j), ("YX", 0.5j)]}
    out = []
    for name in wanted:
        if name in at:
            out.append(combine([(name, 1)]))
        elif name in circular and {n for n, _ in circular[name]} <= set(at):
            out.append(combine(circular[name]))
        elif name in linear and {n for n, _ in linear[name]} <= set(at):
            out.append(combine(linear[name]))
        else:
            out.append(combine([]))
    return F.array(*out)


def add_history(o: Observation, message: str, origin: str = "", priority: str = "INFO", time: float = 0.0, application: str = "") -> Observation:
    """A line added to the history; what is there stays."""
    schema = SUBTABLES["HISTORY"]
    row = {"TIME": time, "OBSERVATION_ID": -1, "MESSAGE": message, "PRIORITY": priority, "ORIGIN": origin, "OBJECT_ID": -1, "APPLICATION": application}
    new = o.main.sparkSession.createDataFrame([tuple(row.get(c) for c in schema.fieldNames())], T.StructType(schema.fields))
    old = o.sub.get("HISTORY")
    return Observation(o.main, o.sub | {"HISTORY": new if old is None else old.drop(ROWNR).unionByName(new, allowMissingColumns=True)})
