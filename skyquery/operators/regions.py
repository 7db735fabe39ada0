"""Regions of pixels as predicates on the indices, with their set algebra and a JSON form."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Region:
    def contains(self, at: list[Column]) -> Column:
        """Whether the pixel of these indices lies inside."""
        raise NotImplementedError

    def __or__(self, other: Region) -> Region:
        return Union((self, other))

    def __and__(self, other: Region) -> Region:
        return Intersection((self, other))

    def __sub__(self, other: Region) -> Region:
        return Difference(self, other)

    def __invert__(self) -> Region:
        return Complement(self)


@dataclass(frozen=True)
class Box(Region):
    """From the bottom left corner to the top right one, both inside."""

    low: tuple[float, ...]
    high: tuple[float, ...]

    def contains(self, at):
        return reduce(Column.__and__, [c.between(a, b) for c, a, b in zip(at, self.low, self.high, strict=True)])


@dataclass(frozen=True)
class Ellipsoid(Region):
    """Axes of length 0 are not looked at."""

    centre: tuple[float, ...]
    axes: tuple[float, ...]

    def contains(self, at):
        terms = [((c - m) / F.lit(float(a))) * ((c - m) / F.lit(float(a))) for c, m, a in zip(at, self.centre, self.axes, strict=True) if a]
        return reduce(Column.__add__, terms, F.lit(0.0)) <= 1


@dataclass(frozen=True)
class Polygon(Region):
    """Pixels whose middle (index + 0.5) lies inside by the even-odd rule. Among world values ``middle`` is 0."""

    x: tuple[float, ...]
    y: tuple[float, ...]
    middle: float = 0.5

    def contains(self, at):
        px, py = at[0] + self.middle, at[1] + self.middle
        crossings = F.lit(0)
        points = list(zip(self.x, self.y, strict=True))
        for (x1, y1), (x2, y2) in zip(points, points[1:] + points[:1], strict=True):
            if y1 == y2:
                continue
            crosses = ((F.lit(float(y1)) > py) != (F.lit(float(y2)) > py)) & (px < (py - y1) * (float(x2 - x1) / float(y2 - y1)) + x1)
            crossings = crossings + crosses.cast("int")
        return crossings % 2 == 1


@dataclass(frozen=True)
class Pixels(Region):
    """Single pixels, few enough to list; many are a mask for ``by_mask``."""

    pixels: tuple[tuple[int, ...], ...]

    def contains(self, at):
        here = F.array(*[c.cast("long") for c in at])
        return reduce(Column.__or__, [here == F.array(*[F.lit(i).cast("long") for i in p]) for p in self.pixels], F.lit(False))


@dataclass(frozen=True)
class Union(Region):
    parts: tuple[Region, ...]

    def contains(self, at):
        return reduce(Column.__or__, [p.contains(at) for p in self.parts], F.lit(False))


@dataclass(frozen=True)
class Intersection(Region):
    parts: tuple[Region, ...]

    def contains(self, at):
        return reduce(Column.__and__, [p.contains(at) for p in self.parts], F.lit(True))


@dataclass(frozen=True)
class Difference(Region):
    first: Region
    second: Region

    def contains(self, at):
        return self.first.contains(at) & ~self.second.contains(at)


@dataclass(frozen=True)
class Complement(Region):
    inner: Region

    def contains(self, at):
        return ~self.inner.contains(at)


@dataclass(frozen=True)
class Extension(Region):
    """A region of some axes, whatever the others are."""

    inner: Region
    axes: tuple[int, ...]

    def contains(self, at):
        return self.inner.contains([at[k] for k in self.axes])


def by_mask(frame: DataFrame, mask: DataFrame, axes: list[str]) -> DataFrame:
    """Elements whose indices are listed in a table: the form of a region of very many pixels."""
    return frame.join(mask.select(*axes).distinct(), axes, "left_semi")


@dataclass(frozen=True)
class WorldBox(Region):
    """A box in world coordinates; ``pixels`` turns it into one of pixels by a linear coordinate for each axis."""

    low: tuple[float, ...]
    high: tuple[float, ...]

    def pixels(self, coordinates: list) -> Box:
        ends = [sorted((c.to_pixel(a), c.to_pixel(b))) for c, a, b in zip(coordinates, self.low, self.high, strict=True)]
        return Box(tuple(a for a, _ in ends), tuple(b for _, b in ends))


@dataclass(frozen=True)
class WorldEllipsoid(Region):
    centre: tuple[float, ...]
    axes: tuple[float, ...]

    def pixels(self, coordinates: list) -> Ellipsoid:
        return Ellipsoid(tuple(c.to_pixel(m) for c, m in zip(coordinates, self.centre, strict=True)), tuple(abs(a / c.increment) for c, a in zip(coordinates, self.axes, strict=True)))


@dataclass(frozen=True)
class WorldPolygon(Region):
    x: tuple[float, ...]
    y: tuple[float, ...]

    def pixels(self, coordinates: list) -> Polygon:
        return Polygon(tuple(coordinates[0].to_pixel(v) for v in self.x), tuple(coordinates[1].to_pixel(v) for v in self.y))


@dataclass(frozen=True)
class InWorld(Region):
    """The pixels whose world coordinates a region holds, on axes of any kind, the sky's too.

    ``inner`` is any region of world values, set operations included, such as ``Box(a, b) - Ellipsoid(c, d)`` in
    radians, polygons with ``middle=0``; ``system`` is the JSON of the coordinate system. Pixels without world values and those beyond the map's edge lie outside.
    Longitudes are those that the system gives, from 0 to a whole turn: a box across 0 is a union of two.
    """

    inner: Region
    system: str

    def contains(self, at):
        from .coordinates import CoordinateSystem

        system, at = CoordinateSystem.from_json(self.system), [a.cast("double") for a in at]
        world = system.to_world(at)
        known = reduce(Column.__and__, [w.isNotNull() & ~F.isnan(w) for w in world], system.on_map(at))
        return F.coalesce(known & self.inner.contains(world), F.lit(False))


_KINDS = {c.__name__: c for c in (Box, Ellipsoid, Polygon, Pixels, Union, Intersection, Difference, Complement, Extension, WorldBox, WorldEllipsoid, WorldPolygon, InWorld)}


def to_json(region: Region) -> str:
    def plain(x):
        if isinstance(x, Region):
            return {"region": type(x).__name__, **{k: plain(v) for k, v in vars(x).items()}}
        return [plain(v) for v in x] if isinstance(x, (tuple, list)) else x

    return json.dumps(plain(region))


def from_json(text: str) -> Region:
    def back(x):
        if isinstance(x, dict):
            return _KINDS[x["region"]](**{k: back(v) for k, v in x.items() if k != "region"})
        return tuple(back(v) for v in x) if isinstance(x, list) else x

    return back(json.loads(text))


@dataclass
class Registry:
    """Regions by name, one of which may be the default mask."""

    regions: dict[str, Region] = field(default_factory=dict)
    default: str | None = None

    def define(self, name: str, region: Region, overwrite: bool = False) -> None:
        if name in self.regions and not overwrite:
            raise KeyError(f"region {name} exists")
        self.regions[name] = region

    def get(self, name: str) -> Region:
        return self.regions[name]

    def remove(self, name: str) -> None:
        del self.regions[name]
        self.default = None if self.default == name else self.default

    def rename(self, old: str, new: str) -> None:
        self.define(new, self.regions[old])
        if self.default == old:
            self.default = new
        del self.regions[old]
