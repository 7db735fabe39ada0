"""Masked n-dimensional arrays in long form: a row for each element, with its indices, value and mask.

Indices are in columns ``i0, i1, ...`` (axis 0 the fastest), the value in ``value``, and
``mask`` is true where it is good. Every operator is a filter, projection, union, group-by or
equi-join over these rows, so arrays of any size are dealt over the cluster.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Lattice:
    frame: DataFrame
    shape: tuple[int, ...]

    @property
    def axes(self) -> list[str]:
        return [f"i{k}" for k in range(len(self.shape))]

    # --- making ---
    @staticmethod
    def generate(spark: SparkSession, shape: tuple[int, ...], value: Callable[..., Column], mask: Callable[..., Column] | None = None) -> Lattice:
        """From functions of the indices."""
        total = reduce(lambda a, b: a * b, shape, 1)
        rows, step = spark.range(total), 1
        columns = []
        for k, n in enumerate(shape):
            columns.append((F.floor(F.col("id") / F.lit(step)) % n).cast("long").alias(f"i{k}"))
            step *= n
        rows = rows.select(*columns)
        at = [F.col(f"i{k}") for k in range(len(shape))]
        return Lattice(rows.withColumn("value", value(*at)).withColumn("mask", mask(*at) if mask else F.lit(True)), shape)

    @staticmethod
    def from_arrays(frame: DataFrame, row: str, values: str, shape: tuple[int, int]) -> Lattice:
        """A table of arrays as a 2-dimensional lattice: element, then row."""
        rows = frame.select(F.col(row).cast("long").alias("i1"), F.posexplode(values).alias("i0", "value"))
        return Lattice(rows.select(F.col("i0").cast("long").alias("i0"), "i1", "value", F.lit(True).alias("mask")), shape)

    def with_frame(self, frame: DataFrame) -> Lattice:
        return Lattice(frame, self.shape)

    # --- elements ---
    def at(self, *index: int):
        found = self.frame.filter(reduce(Column.__and__, [F.col(a) == i for a, i in zip(self.axes, index, strict=True)])).select("value").first()
        if found is None:
            raise IndexError(index)
        return found[0]

    def put_at(self, value, *index: int) -> Lattice:
        here = reduce(Column.__and__, [F.col(a) == i for a, i in zip(self.axes, index, strict=True)])
        return self.with_frame(self.frame.withColumn("value", F.when(here, F.lit(value)).otherwise(F.col("value"))))

    def set(self, value) -> Lattice:
        return self.with_frame(self.frame.withColumn("value", F.lit(value).cast(self.frame.schema["value"].dataType)))

    def apply(self, f: Callable[[Column], Column]) -> Lattice:
        return self.with_frame(self.frame.withColumn("value", f(F.col("value"))))

    def sub(self, start: tuple[int, ...], length: tuple[int, ...], stride: tuple[int, ...] | None = None) -> Lattice:
        """A strided box, with indices of its own from 0."""
        stride = stride or (1,) * len(self.shape)
        for s, n, t, size in zip(start, length, stride, self.shape, strict=True):
            if s < 0 or n < 1 or t < 1 or s + (n - 1) * t >= size:
                raise IndexError(f"box {start} {length} {stride} leaves {self.shape}")
        inside = [F.col(a).between(s, s + (n - 1) * t) & ((F.col(a) - s) % t == 0) for a, s, n, t in zip(self.axes, start, length, stride, strict=True)]
        moved = {a: F.floor((F.col(a) - s) / F.lit(t)).cast("long") for a, s, t in zip(self.axes, start, stride, strict=True)}
        return Lattice(self.frame.filter(reduce(Column.__and__, inside)).withColumns(moved), tuple(length))

    def put_sub(self, other: Lattice, start: tuple[int, ...], stride: tuple[int, ...] | None = None) -> Lattice:
        """Values of the other lattice put into a strided box."""
        stride = stride or (1,) * len(self.shape)
        moved = other.frame.select(*[(F.col(a) * t + s).alias(a) for a, s, t in zip(self.axes, start, stride, strict=True)], F.col("value").alias("_new"))
        return self.with_frame(self.frame.join(moved, self.axes, "left").withColumn("value", F.coalesce("_new", "value")).select(*self.axes, "value", "mask"))

    def concat(self, others: list[Lattice], axis: int) -> Lattice:
        """One after another along an axis. Masks are kept."""
        parts, offset, shape = [self.frame], self.shape[axis], list(self.shape)
        for other in others:
            if any(a != b for k, (a, b) in enumerate(zip(self.shape, other.shape, strict=True)) if k != axis):
                raise ValueError("the other axes differ")
            parts.append(other.frame.withColumn(f"i{axis}", F.col(f"i{axis}") + offset))
            offset += other.shape[axis]
        shape[axis] = offset
        return Lattice(reduce(DataFrame.unionByName, parts), tuple(shape))

    def rebin(self, factors: tuple[int, ...]) -> Lattice:
        """Means of blocks; blocks at the far edges may be smaller. The mask is not looked at."""
        keys = [F.floor(F.col(a) / F.lit(f)).cast("long").alias(a) for a, f in zip(self.axes, factors, strict=True)]
        shape = tuple(-(-n // f) for n, f in zip(self.shape, factors, strict=True))
        return Lattice(self.frame.groupBy(*keys).agg(F.avg("value").alias("value")).withColumn("mask", F.lit(True)), shape)

    def tiles(self, cursor: tuple[int, ...]) -> DataFrame:
        """One row for each tile of the cursor's shape: its indices ``t0, ...`` and its elements, first axis fastest; tiles are clipped at the edges."""
        keys = [F.floor(F.col(a) / F.lit(c)).cast("long").alias(f"t{k}") for k, (a, c) in enumerate(zip(self.axes, cursor, strict=True))]
        element = F.struct(*reversed(self.axes), "value", "mask")
        return self.frame.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(element)), lambda x: x["value"]).alias("values"))

    # --- elementwise ---
    def combine(self, other: Lattice, f: Callable[[Column, Column], Column]) -> Lattice:
        """Both lattices' values by a function; the result is good where both are."""
        if self.shape != other.shape:
            raise ValueError(f"shapes {self.shape} and {other.shape} differ")
        right = other.frame.select(*self.axes, F.col("value").alias("_v"), F.col("mask").alias("_m"))
        joined = self.frame.join(right, self.axes)
        return self.with_frame(joined.select(*self.axes, f(F.col("value"), F.col("_v")).alias("value"), (F.col("mask") & F.col("_m")).alias("mask")))

    def statistics(self, masked: bool = False) -> DataFrame:
        """One row: n, min, max, mean and rms; of all elements, or the good ones."""
        rows = self.frame.filter("mask") if masked else self.frame
        v = F.col("value").cast("double")
        return rows.agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.sqrt(F.avg(v * v)).alias("rms"))

    def regrid(self, shape: tuple[int, ...], source_index: Callable[..., list[Column]]) -> Lattice:
        """Nearest neighbour: ``source_index`` gives the (fractional) index here for each index of the new shape; halves round away from zero, what lies outside is 0."""
        at = [F.col(f"i{k}") for k in range(len(shape))]
        target = Lattice.generate(self.frame.sparkSession, shape, lambda *_: F.lit(0.0))
        nearest = [F.round(c, 0).cast("long").alias(f"_s{k}") for k, c in enumerate(source_index(*at))]
        keys = target.frame.select(*[f"i{k}" for k in range(len(shape))], *nearest)
        source = self.frame.select(*[F.col(a).alias(f"_s{k}") for k, a in enumerate(self.axes)], F.col("value").alias("_v"))
        joined = keys.join(source, [f"_s{k}" for k in range(len(self.shape))], "left")
        return Lattice(joined.select(*[f"i{k}" for k in range(len(shape))], F.coalesce("_v", F.lit(0.0)).alias("value"), F.lit(True).alias("mask")), shape)

    def scaled(self, scale: float, offset: float = 0.0) -> Lattice:
        return self.apply(lambda v: v * scale + offset)

    def masked(self, condition: Column) -> Lattice:
        """Attaches a mask: good where the condition on the indices and the value holds."""
        return self.with_frame(self.frame.withColumn("mask", condition))

    def within(self, region) -> Lattice:
        """The mask cut down to a region."""
        return self.with_frame(self.frame.withColumn("mask", F.col("mask") & region.contains([F.col(a) for a in self.axes])))
