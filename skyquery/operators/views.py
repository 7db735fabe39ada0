"""Views of tables: chosen rows, concatenation, iteration by keys, and indexes."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggregates import ROWNR
from ..sources.tables import numbered


def rows_view(frame: DataFrame, rows: list[int] | DataFrame) -> DataFrame:
    """The rows of the given numbers, in that order and as often as they are given; ``_base`` is the number in the base.

    ``rows`` is a list, or for many rows a DataFrame of (position, row).
    """
    base = numbered(frame)
    if isinstance(rows, list):
        rows = frame.sparkSession.createDataFrame(list(enumerate(rows)), "position long, row long")
    joined = rows.join(base, F.col("row") == F.col(ROWNR))
    return joined.select(*[c for c in base.columns if c != ROWNR], F.col("row").alias("_base"), F.col("position").alias(ROWNR))


def mask_view(frame: DataFrame, mask: Column) -> DataFrame:
    """The rows for which the mask is true; ``_base`` is the number in the base. Their own numbers keep the order, with gaps."""
    return numbered(frame).filter(mask).withColumn("_base", F.col(ROWNR))


def concatenate(frames: list[DataFrame]) -> DataFrame:
    """Tables one after another, with the first one's columns; ``_source`` and ``_source_row`` tell where a row is from."""
    if not frames:
        raise ValueError("no tables to concatenate")
    first = [c for c in frames[0].columns if c != ROWNR]
    parts, start = [], 0
    for i, frame in enumerate(frames):
        if missing := [c for c in first if c not in frame.columns]:
            raise ValueError(f"table {i} has no column {missing[0]}")
        rows = numbered(frame)
        parts.append(rows.select(*first, F.lit(i).alias("_source"), F.col(ROWNR).alias("_source_row"), (F.col(ROWNR) + start).alias(ROWNR)))
        start += rows.count() if i < len(frames) - 1 else 0
    return reduce(DataFrame.unionByName, parts)


def groups(frame: DataFrame, keys: list[str], rows: str = "rows") -> DataFrame:
    """One row for each combination of keys, with the sorted numbers of its rows, in key order.

    A key's numbers are one cell: for keys of very many rows take ``group_sizes`` and ``group_rows``.
    """
    if not keys:
        raise ValueError("no keys to iterate by")
    found = numbered(frame).groupBy(*keys).agg(F.sort_array(F.collect_list(ROWNR)).alias(rows))
    return found.orderBy(*keys)


def group_sizes(frame: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each combination of keys, in key order: how many rows it has (``n``), its ``first`` and its ``last``."""
    if not keys:
        raise ValueError("no keys to iterate by")
    return numbered(frame).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(ROWNR).alias("first"), F.max(ROWNR).alias("last")).orderBy(*keys)


def group_rows(frame: DataFrame, keys: list[str]) -> DataFrame:
    """The keys and the number of each row, in key order and then by number: a key of any size is as many rows."""
    if not keys:
        raise ValueError("no keys to iterate by")
    return numbered(frame).select(*keys, F.col(ROWNR).alias("row")).orderBy(*keys, "row")


def iterate(frame: DataFrame, keys: list[str]) -> Iterator[tuple[dict, DataFrame]]:
    """The key combinations in order, each with the DataFrame of its rows. For work on all groups use groupBy instead."""
    if not keys:
        raise ValueError("no keys to iterate by")
    base = numbered(frame)
    for key in base.select(*keys).distinct().orderBy(*keys).toLocalIterator():
        values = key.asDict()
        yield values, base.filter(reduce(Column.__and__, [F.col(k).eqNullSafe(F.lit(v)) for k, v in values.items()]))


class ColumnsIndex:
    """Rows by the values of columns. Lookups are filters, which Parquet statistics prune."""

    def __init__(self, frame: DataFrame, columns: list[str]):
        if not columns:
            raise ValueError("no columns to index")
        self.frame, self.columns = numbered(frame), columns

    def _match(self, key: dict) -> DataFrame:
        if set(key) != set(self.columns):
            raise ValueError(f"a key has the columns {self.columns}")
        return self.frame.filter(reduce(Column.__and__, [F.col(c).eqNullSafe(F.lit(v)) for c, v in key.items()]))

    def rows(self, **key) -> DataFrame:
        """Numbers of the rows with the key, ascending."""
        return self._match(key).select(F.col(ROWNR).alias("row")).orderBy("row")

    def row(self, **key) -> int:
        """Number of the one row with the key; KeyError if there is none, or more than one."""
        found = [r[0] for r in self.rows(**key).limit(2).collect()]
        if len(found) != 1:
            raise KeyError("no such row" if not found else "more than one row")
        return found[0]

    def contains(self, **key) -> bool:
        return not self._match(key).limit(1).isEmpty()

    def unique_keys(self) -> int:
        return self.frame.select(*self.columns).distinct().count()

    def lookup(self, keys: DataFrame) -> DataFrame:
        """Each of many keys with the numbers of its rows: one join in place of many lookups."""
        return keys.join(self.frame.select(*self.columns, F.col(ROWNR).alias("row")), self.columns)


def _segments(frame: DataFrame, within: list[str], bucket: Column | None) -> DataFrame:
    """The frame with ``_segment``: the keys, and the bucket if there is one. A struct, so that null keys are equal to one another."""
    return frame.withColumn("_segment", F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(within)], *([bucket.alias("bucket")] if bucket is not None else []), F.lit(0).alias("any")))


def _last_known(frame: DataFrame, values: dict[str, Column], order: list[str], within: list[str], bucket: Column | None) -> DataFrame:
    """``values`` gives new columns: the last value that is not null, up to the row, in the order within the keys.

    Without buckets a key is one task's work. With them a segment is: the last values of
    each segment are summed up first, carried over the segments before in a table of one
    row a segment, and joined back on the partitioning that the window has made.
    """
    cut = _segments(frame, within, bucket).withColumns({f"_of_{n}": v for n, v in values.items()})
    w = Window.partitionBy("_segment").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = cut.withColumns({n: F.last(f"_of_{n}", ignorenulls=True).over(w) for n in values})
    helpers = [f"_of_{n}" for n in values]
    if bucket is None:
        return inside.drop("_segment", *helpers)
    at = lambda n: F.when(F.col(f"_of_{n}").isNotNull(), F.struct(*order))
    ends = cut.groupBy("_segment").agg(*[F.max_by(f"_of_{n}", at(n)).alias(f"_end_{n}") for n in values])
    keys = [F.col(f"_segment.k{i}") for i in range(len(within))]
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_segment.bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_segment", *[F.last(f"_end_{n}", ignorenulls=True).over(before).alias(f"_before_{n}") for n in values])
    joined = inside.join(carried, "_segment", "left").withColumns({n: F.coalesce(F.col(n), F.col(f"_before_{n}")) for n in values})
    return joined.drop("_segment", *helpers, *[f"_before_{n}" for n in values])


def carried_forward(frame: DataFrame, columns: list[str], order: list[str], within: list[str], bucket: Column | None = None) -> DataFrame:
    """Nulls replaced by the last value before them in the order, within groups; rows of a null key are one group.

    ``bucket``, such as the day of a time, must never fall along the order: it splits a hot group
    into segments that different tasks work on. The result is the same.
    """
    made = _last_known(frame, {f"_known_{i}": F.col(c) for i, c in enumerate(columns)}, order, within, bucket)
    given = {c: F.col(f"_known_{i}") for i, c in enumerate(columns)}
    return made.select(*[given.get(c, F.col(c)).alias(c) for c in frame.columns])


def as_of_join(left: DataFrame, right: DataFrame, on: list[str], at: str, right_at: str, columns: list[str], bucket: Callable[[Column], Column] | None = None) -> DataFrame:
    """Each left row with the columns of the last right row of equal keys that is not later; null if none is.

    Both sides are put in one sequence for each key and the last right row is carried
    forward: one shuffle on the keys and a sort, no pairs. ``bucket`` makes of a time a
    value that never falls with it, such as its day: a hot key is then dealt by it. Null keys and times equal nothing.
    """
    packed = F.struct(F.col(right_at).alias("_at"), *columns)
    sides = left.select(*on, F.col(at).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(right.select(packed.alias("p")).schema["p"].dataType).alias("_right"))
    known = right.filter(reduce(Column.__and__, [F.col(c).isNotNull() for c in (*on, right_at)]))
    other = known.select(*on, F.col(right_at).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(sides.schema["_left"].dataType).alias("_left"), packed.alias("_right"))
    joined = _last_known(sides.unionByName(other), {"_last": F.col("_right")}, ["_t", "_side"], on, bucket(F.col("_t")) if bucket else None).filter("_side = 1")
    return joined.select("_left.*", *[F.col(f"_last.{c}").alias(c) for c in columns])


#: Above any exponent of a double: intervals without an end are in one bin of this level.
_ENDLESS = 1100


def range_join(left: DataFrame, right: DataFrame, at: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs with low <= at <= high, joined on equal bins.

    Intervals up to ``width`` long use bins of that width, longer ones bins that are a power of 2 as wide:
    each interval lies in at most two bins, however long. A point is looked up once for each
    power that occurs, which one small aggregation finds out. Intervals that end before they begin, and nulls, match nothing.
    """
    long = F.col(high) - F.col(low)
    level = F.when(long <= width, 0).otherwise(F.least(F.ceil(F.log2(long / width)), F.lit(_ENDLESS))).cast("int")
    size = lambda c: F.lit(float(width)) * F.pow(F.lit(2.0), c)
    bin_ = lambda x, c: F.floor(F.col(x) / size(c)).cast("long")
    levelled = right.filter(F.col(low) <= F.col(high)).withColumn("_level", level)
    levels = sorted(r[0] for r in levelled.select("_level").distinct().collect() if r[0] is not None)
    dealt = levelled.withColumn("_bin", F.explode(F.when(F.col("_level") == _ENDLESS, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(bin_(low, F.col("_level")), bin_(high, F.col("_level"))))))
    places = F.array(*[F.struct(F.lit(n).alias("_level"), (F.lit(0).cast("long") if n == _ENDLESS else bin_(at, F.lit(n))).alias("_bin")) for n in levels]) if levels else F.expr("CAST(array() AS array<struct<_level:int,_bin:bigint>>)")
    points = left.withColumn("_place", F.explode(places)).select(*left.columns, "_place._level", "_place._bin")
    return points.join(dealt, ["_level", "_bin"]).filter((F.col(at) >= F.col(low)) & (F.col(at) <= F.col(high))).drop("_level", "_bin")


def cone_join(left: DataFrame, right: DataFrame, lon: str, lat: str, centre_lon: str, centre_lat: str, radius: str, most_radius: float) -> DataFrame:
    """Pairs of positions and cones that hold them (radians): equal cells of the sky, then the distance.

    A cell is a band of declination as high as the largest radius, cut in longitude to pieces
    about as wide; a cone lies in a few cells wherever it is, and near a pole, where it may take in all
    longitudes, there are few. Latitudes lie within a quarter turn, longitudes may have any number of turns; nulls match nothing.
    """
    from ..functions.sky import distance

    band, rim, turn = max(float(most_radius), 1e-9), 1e-9, 2 * math.pi
    # pieces of a band: as many as fit on its narrower edge
    edge = F.least(F.greatest(F.abs(F.col("_band") * band), F.abs((F.col("_band") + 1) * band)), F.lit(math.pi / 2))
    pieces = F.greatest(F.lit(1).cast("long"), F.floor(F.cos(edge) * turn / band).cast("long"))
    around = lambda x: x - F.floor(x / turn) * turn
    points = left.withColumn("_band", F.floor(F.col(lat) / band)).withColumn("_cell", F.least(F.floor(around(F.col(lon)) / turn * pieces).cast("long"), pieces - 1))
    c, d, r = F.col(centre_lon), F.col(centre_lat), F.col(radius) + rim
    dealt = right.withColumn("_band", F.explode(F.sequence(F.floor((d - r) / band), F.floor((d + r) / band))))
    # the longitudes that a cone reaches on either side of its centre
    reach = F.when(F.abs(d) + r >= math.pi / 2, math.pi).otherwise(F.asin(F.least(F.lit(1.0), F.sin(r) / F.cos(d)))) + rim
    first, last = (F.floor(x / turn * pieces).cast("long") for x in (c - reach, c + reach))
    cells = F.when(last - first + 1 >= pieces, F.sequence(F.lit(0).cast("long"), pieces - 1)).otherwise(F.transform(F.sequence(first, last), lambda x: F.pmod(x, pieces)))
    dealt = dealt.withColumn("_cell", F.explode(cells))
    near = distance(F.col(lon), F.col(lat), c, d) <= F.col(radius)
    return points.join(dealt, ["_band", "_cell"]).filter(near).drop("_band", "_cell")
