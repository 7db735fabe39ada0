"""Pixel and world coordinates: affine axes, tables, codes, and the tangent-plane projections."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import sky


@dataclass(frozen=True)
class Linear:
    """world = reference + (pixel - reference_pixel) * increment; numbers and Columns alike."""

    reference: float = 0.0
    increment: float = 1.0
    reference_pixel: float = 0.0
    unit: str = ""

    def to_world(self, pixel):
        return (pixel - self.reference_pixel) * self.increment + self.reference

    def to_pixel(self, world):
        return (world - self.reference) / self.increment + self.reference_pixel


@dataclass(frozen=True)
class Spectral(Linear):
    """A frequency axis in Hz, with a rest frequency for velocities."""

    rest: float = 0.0

    def velocity(self, pixel: Column, convention: str = "RADIO") -> Column:
        return sky.velocity(self.to_world(pixel), self.rest, convention)


@dataclass(frozen=True)
class Tabular:
    """Piecewise linear between listed pixels, and on beyond both ends."""

    pixels: tuple[float, ...]
    worlds: tuple[float, ...]

    def _piecewise(self, x: Column, a: tuple[float, ...], b: tuple[float, ...]) -> Column:
        down = a[0] > a[-1]
        points = sorted(zip(a, b, strict=True))
        del down
        out = None
        for (x0, y0), (x1, y1) in reversed(list(zip(points, points[1:]))):
            line = (x - x0) * ((y1 - y0) / (x1 - x0)) + y0
            out = line if out is None else F.when(x < x1, line).otherwise(out)
        return out

    def to_world(self, pixel: Column) -> Column:
        return self._piecewise(pixel, self.pixels, self.worlds)

    def to_pixel(self, world: Column) -> Column:
        return self._piecewise(world, self.worlds, self.pixels)


@dataclass(frozen=True)
class Codes:
    """An axis of codes (Stokes parameters, qualities): pixels are rounded to an index; what is unknown raises an error when it is read."""

    codes: tuple[int, ...]

    def to_world(self, pixel: Column) -> Column:
        listed = F.array(*[F.lit(c) for c in self.codes])
        at = F.round(pixel, 0).cast("int")
        return F.when((at < 0) | (at >= len(self.codes)), F.raise_error(F.lit("no such code"))).otherwise(F.get(listed, at))

    def to_pixel(self, world: Column) -> Column:
        out = F.raise_error(F.lit("no such code")).cast("int")
        for i, c in enumerate(self.codes):
            out = F.when(world == c, F.lit(i)).otherwise(out)
        return out


def _mollweide(lat: Column) -> Column:
    """The auxiliary angle g with 2g + sin 2g = pi sin(lat), by Newton's method from a start that keeps its side."""
    target = F.sin(lat) * math.pi
    step = lambda u, _: u - F.when(F.cos(u) > -1 + 1e-12, (u + F.sin(u) - target) / (1 + F.cos(u))).otherwise(0.0)
    return F.aggregate(F.array_repeat(F.lit(0), 24), 2 * F.asin(lat * (2 / math.pi)), step) / 2


def _from_radius(theta):
    """A projection about the pole: distance from it to native latitude, and azimuth to native longitude."""
    return lambda x, y: (F.atan2(x, -y), theta(F.hypot(x, y)))


def _to_radius(radius):
    return lambda phi, theta: (radius(theta) * F.sin(phi), -radius(theta) * F.cos(phi))


def _ait_out(x: Column, y: Column) -> tuple[Column, Column]:
    z = F.sqrt(1 - x * x / 16 - y * y / 4)
    return 2 * F.atan2(z * x / 2, 2 * z * z - 1), F.asin(y * z)


def _ait_in(phi: Column, theta: Column) -> tuple[Column, Column]:
    g = F.sqrt(2 / (1 + F.cos(theta) * F.cos(phi / 2)))
    return 2 * g * F.cos(theta) * F.sin(phi / 2), g * F.sin(theta)


def _mol_out(x: Column, y: Column) -> tuple[Column, Column]:
    g = F.asin(y / math.sqrt(2))
    return x * math.pi / (2 * math.sqrt(2) * F.cos(g)), F.asin((2 * g + F.sin(2 * g)) / math.pi)


_HALF = math.pi / 2
#: Rounding of native coordinates at the edge of a map, in radians.
_EDGE = 1e-12
#: Projections about the pole of their native sphere: plane to sphere, sphere to plane, in radians.
ZENITHAL = {
    "SIN": (_from_radius(F.acos), _to_radius(F.cos)),
    "TAN": (_from_radius(lambda r: F.atan2(F.lit(1.0), r)), _to_radius(lambda t: F.cos(t) / F.sin(t))),
    "STG": (_from_radius(lambda r: _HALF - 2 * F.atan(r / 2)), _to_radius(lambda t: 2 * F.tan((_HALF - t) / 2))),
    "ARC": (_from_radius(lambda r: _HALF - r), _to_radius(lambda t: _HALF - t)),
    "ZEA": (_from_radius(lambda r: _HALF - 2 * F.asin(r / 2)), _to_radius(lambda t: 2 * F.sin((_HALF - t) / 2))),
}
#: Projections about the origin of their native sphere.
EQUATORIAL = {
    "CAR": (lambda x, y: (x, y), lambda p, t: (p, t)),
    "CEA": (lambda x, y: (x, F.asin(y)), lambda p, t: (p, F.sin(t))),
    "MER": (lambda x, y: (x, 2 * F.atan(F.exp(y)) - _HALF), lambda p, t: (p, F.log(F.tan((_HALF + t) / 2)))),
    "SFL": (lambda x, y: (x / F.cos(y), y), lambda p, t: (p * F.cos(t), t)),
    "PAR": (lambda x, y: (x / (1 - 4 * (y / math.pi) * (y / math.pi)), 3 * F.asin(y / math.pi)), lambda p, t: (p * (2 * F.cos(2 * t / 3) - 1), math.pi * F.sin(t / 3))),
    "MOL": (_mol_out, lambda p, t: (p * (2 * math.sqrt(2) / math.pi) * F.cos(_mollweide(t)), math.sqrt(2) * F.sin(_mollweide(t)))),
    "AIT": (_ait_out, _ait_in),
}
PROJECTIONS = {**ZENITHAL, **EQUATORIAL}


@dataclass(frozen=True)
class Direction:
    """Two axes on the sky in radians, in one of PROJECTIONS about a reference. The native sphere lies as usual for the kind of projection."""

    longitude: float
    latitude: float
    increment: tuple[float, float]
    reference_pixel: tuple[float, float]
    projection: str = "SIN"

    def __post_init__(self):
        if self.projection not in PROJECTIONS:
            raise ValueError(f"projection {self.projection} is not known")

    def _pole(self) -> tuple[float, float, float]:
        """Longitude and latitude of the native pole, and the native longitude of the sky's pole."""
        lon, lat = self.longitude, self.latitude
        if self.projection in ZENITHAL:
            return lon, lat, 0.0 if lat >= _HALF else math.pi
        if lat == 0:
            return lon - math.pi, _HALF, 0.0
        return (lon + math.pi, _HALF - lat, 0.0) if lat > 0 else (lon, _HALF + lat, math.pi)

    def _native(self, px: Column, py: Column) -> tuple[Column, Column]:
        x, y = (px - self.reference_pixel[0]) * self.increment[0], (py - self.reference_pixel[1]) * self.increment[1]
        return PROJECTIONS[self.projection][0](x, y)

    def on_map(self, px: Column, py: Column) -> Column:
        """Whether a pixel lies on the map, edges included. The formulas of many projections go on beyond it, around the sphere once more."""
        phi, theta = self._native(px, py)
        return (F.abs(phi) <= math.pi + _EDGE) & (F.abs(theta) <= _HALF + _EDGE)

    def to_world(self, px: Column, py: Column) -> tuple[Column, Column]:
        """By the projection's formula, also beyond the map; ``on_map`` tells which pixels lie on it."""
        phi, theta = self._native(px, py)
        lon, lat, at = self._pole()
        s, c = math.sin(lat), math.cos(lat)
        turn = phi - at
        out = F.atan2(-F.cos(theta) * F.sin(turn), F.sin(theta) * c - F.cos(theta) * s * F.cos(turn))
        return F.pmod(out + lon, F.lit(2 * math.pi)), _asin(F.sin(theta) * s + F.cos(theta) * c * F.cos(turn))

    def to_pixel(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        l0, b0, at = self._pole()
        s, c = math.sin(b0), math.cos(b0)
        d = lon - l0
        phi = F.atan2(-F.cos(lat) * F.sin(d), F.sin(lat) * c - F.cos(lat) * s * F.cos(d)) + at
        # native longitudes run from minus to plus half a turn
        phi = F.pmod(phi + math.pi, F.lit(2 * math.pi)) - math.pi
        x, y = PROJECTIONS[self.projection][1](phi, _asin(F.sin(lat) * s + F.cos(lat) * c * F.cos(d)))
        return x / self.increment[0] + self.reference_pixel[0], y / self.increment[1] + self.reference_pixel[1]


def _asin(x: Column) -> Column:
    return F.asin(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), x)))


_KINDS = {c.__name__: c for c in (Linear, Spectral, Tabular, Codes, Direction)}


@dataclass
class CoordinateSystem:
    """Coordinates in the order of the pixel axes; a direction takes two."""

    parts: list = field(default_factory=list)
    telescope: str = ""
    observer: str = ""

    def axis_of(self, kind: type) -> int:
        """First pixel axis of the first coordinate of a kind, or -1."""
        at = 0
        for p in self.parts:
            if type(p) is kind:
                return at
            at += 2 if isinstance(p, Direction) else 1
        return -1

    def to_world(self, pixels: list[Column]) -> list[Column]:
        return self._each(pixels, "to_world")

    def to_pixel(self, worlds: list[Column]) -> list[Column]:
        return self._each(worlds, "to_pixel")

    def on_map(self, pixels: list[Column]) -> Column:
        """Whether a pixel lies on the maps of all directions; the other axes have no end."""
        out, at = F.lit(True), 0
        for p in self.parts:
            n = 2 if isinstance(p, Direction) else 1
            if n == 2:
                out = out & p.on_map(*pixels[at : at + n])
            at += n
        return out

    def _each(self, values: list[Column], method: str) -> list[Column]:
        out, at = [], 0
        for p in self.parts:
            n = 2 if isinstance(p, Direction) else 1
            got = getattr(p, method)(*values[at : at + n])
            out += list(got) if n == 2 else [got]
            at += n
        return out

    def to_json(self) -> str:
        return json.dumps({"telescope": self.telescope, "observer": self.observer, "parts": [{"kind": type(p).__name__, **asdict(p)} for p in self.parts]})

    @staticmethod
    def from_json(text: str) -> CoordinateSystem:
        given = json.loads(text)
        tuples = lambda d: {k: tuple(v) if isinstance(v, list) else v for k, v in d.items() if k != "kind"}
        return CoordinateSystem([_KINDS[p["kind"]](**tuples(p)) for p in given["parts"]], given["telescope"], given["observer"])

    def to_header(self) -> dict:
        """FITS-like cards of the linear, spectral and direction axes."""
        out, axis = {"TELESCOP": self.telescope, "OBSERVER": self.observer}, 1
        for p in self.parts:
            if isinstance(p, Direction):
                for k, (name, value) in enumerate((("RA", p.longitude), ("DEC", p.latitude))):
                    out |= {f"CTYPE{axis}": f"{name:-<5}{p.projection}"[:8], f"CRVAL{axis}": math.degrees(value), f"CDELT{axis}": math.degrees(p.increment[k]), f"CRPIX{axis}": p.reference_pixel[k] + 1, f"CUNIT{axis}": "deg"}
                    axis += 1
            elif isinstance(p, Linear):
                out |= {f"CTYPE{axis}": "FREQ" if isinstance(p, Spectral) else "LINEAR", f"CRVAL{axis}": p.reference, f"CDELT{axis}": p.increment, f"CRPIX{axis}": p.reference_pixel + 1, f"CUNIT{axis}": p.unit}
                if isinstance(p, Spectral):
                    out["RESTFRQ"] = p.rest
                axis += 1
            else:
                raise ValueError(f"{type(p).__name__} axes have no header form")
        return out

    @staticmethod
    def from_header(header: dict) -> CoordinateSystem:
        parts, axis = [], 1
        while f"CTYPE{axis}" in header:
            kind = header[f"CTYPE{axis}"]
            get = lambda k, a=axis: header.get(f"{k}{a}", {"CRVAL": 0.0, "CDELT": 1.0, "CRPIX": 1.0, "CUNIT": ""}[k])
            if kind.startswith("RA"):
                two = axis + 1
                if not str(header.get(f"CTYPE{two}", "")).startswith("DEC"):
                    raise ValueError("RA without DEC")
                parts.append(Direction(math.radians(get("CRVAL")), math.radians(header[f"CRVAL{two}"]), (math.radians(get("CDELT")), math.radians(header[f"CDELT{two}"])), (get("CRPIX") - 1, header[f"CRPIX{two}"] - 1), kind[-3:]))
                axis += 2
                continue
            linear = (get("CRVAL"), get("CDELT"), get("CRPIX") - 1, get("CUNIT"))
            parts.append(Spectral(*linear, header.get("RESTFRQ", 0.0)) if kind == "FREQ" else Linear(*linear))
            axis += 1
        return CoordinateSystem(parts, header.get("TELESCOP", ""), header.get("OBSERVER", ""))


def beam_to_pixels(major: float, minor: float, angle: float, increment: tuple[float, float]) -> tuple[float, float, float]:
    """A Gaussian's axes and position angle (radians, from the second axis) in pixels, through its covariance."""
    import numpy as np

    s, c = math.sin(angle), math.cos(angle)
    turn = np.array([[s, c], [c, -s]])
    scale = np.diag([1 / increment[0], 1 / increment[1]])
    covariance = scale @ turn @ np.diag([major**2, minor**2]) @ turn.T @ scale
    values, vectors = np.linalg.eigh(covariance)
    x, y = vectors[:, 1]
    return math.sqrt(values[1]), math.sqrt(values[0]), math.atan2(x, y) % math.pi
