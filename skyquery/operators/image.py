"""Images: a masked lattice with coordinates, unit, and descriptions."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables as managed
from .coordinates import CoordinateSystem
from .expressions import evaluate
from .lattice import Lattice


@dataclass(frozen=True)
class Image:
    lattice: Lattice
    coordinates: CoordinateSystem = field(default_factory=CoordinateSystem)
    unit: str = ""
    info: dict = field(default_factory=dict)
    misc: dict = field(default_factory=dict)

    def statistics(self, masked: bool = False) -> DataFrame:
        return self.lattice.statistics(masked)

    def scaled(self, scale: float, offset: float = 0.0) -> Image:
        return replace(self, lattice=self.lattice.scaled(scale, offset))

    def sub(self, start: tuple[int, ...], length: tuple[int, ...], stride: tuple[int, ...] | None = None) -> Image:
        return replace(self, lattice=self.lattice.sub(start, length, stride))

    def concat(self, others: list[Image], axis: int) -> Image:
        return replace(self, lattice=self.lattice.concat([o.lattice for o in others], axis))

    def masked_by(self, region) -> Image:
        return replace(self, lattice=self.lattice.within(region))

    @staticmethod
    def expression(text: str, images: dict[str, Image]) -> Image | float:
        made = evaluate(text, {n: i.lattice for n, i in images.items()})
        return replace(next(iter(images.values())), lattice=made) if isinstance(made, Lattice) else made

    def regrid(self, shape: tuple[int, ...], coordinates: CoordinateSystem) -> Image:
        """On another grid by nearest neighbour: pixel there, world, pixel here; what lies outside is 0."""
        there = lambda *at: self.coordinates.to_pixel(coordinates.to_world([a.cast("double") for a in at]))
        return replace(self, lattice=self.lattice.regrid(shape, there), coordinates=coordinates)

    def summary(self) -> str:
        s = self.statistics().first().asDict()
        return f"shape {self.lattice.shape}, unit {self.unit or 'none'}, {len(self.coordinates.parts)} coordinates; " + ", ".join(f"{k} {v}" for k, v in s.items())

    def save(self, warehouse: str, name: str) -> None:
        """In long form, sorted by its slowest axis, so that planes and boxes are pruned when they are read."""
        keywords = {"shape": list(self.lattice.shape), "coordinates": self.coordinates.to_json(), "unit": self.unit, "info": json.dumps(self.info), "misc": json.dumps(self.misc)}
        frame = self.lattice.frame.repartitionByRange(F.col(self.lattice.axes[-1])).sortWithinPartitions(*reversed(self.lattice.axes))
        index, step = F.lit(0).cast("long"), 1
        for axis, n in zip(self.lattice.axes, self.lattice.shape, strict=True):
            index, step = index + F.col(axis) * step, step * n
        managed.Table.save(managed.by_key(frame, index), warehouse, name, keywords)

    @staticmethod
    def open(spark: SparkSession, warehouse: str, name: str) -> Image:
        t = managed.Table.open(spark, warehouse, name)
        k = t.keywords()
        shape = tuple(k["shape"])
        frame = t.frame().select(*[f"i{a}" for a in range(len(shape))], "value", "mask")
        return Image(Lattice(frame, shape), CoordinateSystem.from_json(k["coordinates"]), k["unit"], json.loads(k["info"]), json.loads(k["misc"]))
