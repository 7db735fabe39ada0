"""Angles, directions, epochs, positions and velocities as Column arithmetic."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Rotation from ICRS to galactic coordinates (rows), and from FK4 B1950 to FK5 J2000 without proper motion.
GALACTIC = ((-0.054875560416215368, -0.873437090234885049, -0.483835015548713226), (0.494109427875583674, -0.444829629960011178, 0.746982244497218891), (-0.867666149019004701, -0.198076373431201528, 0.455983776175066922))
B1950_TO_J2000 = ((0.9999256782, -0.0111820611, -0.0048579477), (0.0111820610, 0.9999374784, -0.0000271765), (0.0048579479, -0.0000271474, 0.9999881997))
#: Mean obliquity at J2000 in arc seconds.
OBLIQUITY = 84381.406
# MJD from which TAI-UTC has so many seconds.
LEAP_SECONDS = (
    (41317, 10), (41499, 11), (41683, 12), (42048, 13), (42413, 14), (42778, 15), (43144, 16), (43509, 17), (43874, 18), (44239, 19), (44786, 20), (45151, 21), (45516, 22), (46247, 23),
    (47161, 24), (47892, 25), (48257, 26), (48804, 27), (49169, 28), (49534, 29), (50083, 30), (50630, 31), (51179, 32), (53736, 33), (54832, 34), (56109, 35), (57204, 36), (57754, 37),
)
#: Seconds from TAI to TT.
TT_TAI = 32.184
# The WGS84 ellipsoid.
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563
LIGHT = 299792458.0


def hms(rad: Column) -> Column:
    """HH:MM:SS.sss; negative angles get 24 hours once."""
    h = rad * (12.0 / math.pi)
    h = F.when(h < 0, h + 24.0).otherwise(h)
    whole = F.floor(h)
    m = (h - whole) * 60.0
    return F.format_string("%02d:%02d:%06.3f", whole, F.floor(m), (m - F.floor(m)) * 60.0)


def dms(rad: Column) -> Column:
    """+DD.MM.SS.sss"""
    d = F.abs(rad) * (180.0 / math.pi)
    whole = F.floor(d)
    m = (d - whole) * 60.0
    return F.format_string("%s%02d.%02d.%06.3f", F.when(rad < 0, F.lit("-")).otherwise(F.lit("+")), whole, F.floor(m), (m - F.floor(m)) * 60.0)


def distance(l1: Column, b1: Column, l2: Column, b2: Column) -> Column:
    """Great-circle distance by Vincenty's formula, exact for small and for large angles."""
    d = l2 - l1
    y1 = F.cos(b2) * F.sin(d)
    y2 = F.cos(b1) * F.sin(b2) - F.sin(b1) * F.cos(b2) * F.cos(d)
    return F.atan2(F.sqrt(y1 * y1 + y2 * y2), F.sin(b1) * F.sin(b2) + F.cos(b1) * F.cos(b2) * F.cos(d))


def to_xyz(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    return F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)


def to_lonlat(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """Longitude in [0, 2 pi) and latitude."""
    return F.pmod(F.atan2(y, x), F.lit(2 * math.pi)), F.atan2(z, F.sqrt(x * x + y * y))


def matrix_to(frame: str) -> np.ndarray:
    """Rotation from J2000 (taken as ICRS) to a frame. Frames that need the time or the observer raise ValueError."""
    if frame in ("J2000", "ICRS"):
        return np.eye(3)
    if frame == "GALACTIC":
        return np.array(GALACTIC)
    if frame == "ECLIPTIC":
        e = math.radians(OBLIQUITY / 3600)
        return np.array([[1, 0, 0], [0, math.cos(e), math.sin(e)], [0, -math.sin(e), math.cos(e)]])
    if frame == "B1950":
        return np.array(B1950_TO_J2000).T
    raise ValueError(f"directions cannot be converted to {frame}")


def rotate(matrix: np.ndarray, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    return tuple(sum((v * float(m) for v, m in zip((y, z), row[1:], strict=True)), x * float(row[0])) for row in matrix)


def convert_direction(lon: Column, lat: Column, source: str, target: str) -> tuple[Column, Column]:
    matrix = matrix_to(target) @ matrix_to(source).T
    if np.array_equal(matrix, np.eye(3)):
        return lon, lat
    return to_lonlat(*rotate(matrix, *to_xyz(lon, lat)))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out, and stands in the plan, once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _leap(mjd: Column) -> Column:
    """TAI-UTC: one second more for each of the days passed, 10 before the second of them."""
    days = F.split(F.lit(",".join(str(day) for day, _ in LEAP_SECONDS)), ",").cast("array<double>")
    first = LEAP_SECONDS[0][1]
    return _let(mjd, lambda m: F.greatest(F.lit(float(first)), F.size(F.filter(days, lambda d: d <= m)) + float(first - 1)))


def _tdb_tt(tt: Column) -> Column:
    """Main terms of TDB - TT in seconds, from the earth's mean anomaly."""
    g = (357.53 + 0.98560028 * (tt - 51544.5)) * (math.pi / 180)
    return 0.001657 * F.sin(g) + 0.000014 * F.sin(2 * g)


def convert_epoch(mjd: Column, source: str, target: str, dut1: float = 0.0) -> Column:
    """Epochs in MJD days between UTC, UT1 (with UT1-UTC in seconds), TAI, TT and TDB; others raise ValueError."""
    day = 86400.0
    if source == target:
        return mjd
    if source == "UTC":
        tai = mjd + _leap(mjd) / day
    elif source == "UT1":
        utc = mjd - dut1 / day
        tai = utc + _leap(utc) / day
    elif source == "TAI":
        tai = mjd
    elif source in ("TT", "TDT"):
        tai = mjd - TT_TAI / day
    elif source == "TDB":
        tai = mjd - _tdb_tt(mjd) / day - TT_TAI / day
    else:
        raise ValueError(f"epochs cannot be converted from {source}")
    if target == "TAI":
        return tai
    if target in ("TT", "TDT"):
        return tai + TT_TAI / day
    if target == "TDB":
        tt = tai + TT_TAI / day
        return tt + _tdb_tt(tt) / day
    if target in ("UTC", "UT1"):
        # the seconds that held at the UTC found with those that would hold at TAI itself
        utc = tai - _leap(tai - _leap(tai) / day) / day
        return utc if target == "UTC" else utc + dut1 / day
    raise ValueError(f"epochs cannot be converted to {target}")


def itrf_to_wgs84(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Longitude, latitude (radians) and height (m), by Bowring's formula with one refinement."""
    e2 = WGS84_F * (2 - WGS84_F)
    b = WGS84_A * (1 - WGS84_F)

    def latitude(c: Column, u: Column) -> Column:
        return F.atan2(c["z"] + (e2 / (1 - e2)) * b * F.pow(F.sin(u), F.lit(3.0)), c["p"] - e2 * WGS84_A * F.pow(F.cos(u), F.lit(3.0)))

    def found(c: Column) -> Column:
        first = _let(F.atan2(c["z"] * WGS84_A, c["p"] * b), lambda u: latitude(c, u))
        lat = _let(_let(first, lambda t: F.atan2((1 - WGS84_F) * F.sin(t), F.cos(t))), lambda u: latitude(c, u))
        n = lambda t: WGS84_A / F.sqrt(1 - e2 * F.sin(t) * F.sin(t))
        height = lambda t: F.when(F.abs(t) < 1.3, c["p"] / F.cos(t) - n(t)).otherwise(c["z"] / F.sin(t) - n(t) * (1 - e2))
        return _let(lat, lambda t: F.struct(F.atan2(c["y"], c["x"]).alias("lon"), t.alias("lat"), height(t).alias("height")))

    place = _let(_let(F.struct(x.alias("x"), y.alias("y"), z.alias("z")), lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"), c["z"].alias("z"), F.sqrt(c["x"] * c["x"] + c["y"] * c["y"]).alias("p"))), found)
    return place["lon"], place["lat"], place["height"]


def wgs84_to_itrf(lon: Column, lat: Column, height: Column) -> tuple[Column, Column, Column]:
    e2 = WGS84_F * (2 - WGS84_F)
    n = WGS84_A / F.sqrt(1 - e2 * F.sin(lat) * F.sin(lat))
    return (n + height) * F.cos(lat) * F.cos(lon), (n + height) * F.cos(lat) * F.sin(lon), (n * (1 - e2) + height) * F.sin(lat)


def doppler(value: Column, source: str, target: str) -> Column:
    """Doppler values between RADIO, Z (OPTICAL), RATIO, BETA (TRUE, RELATIVISTIC) and GAMMA; impossible values give null."""
    names = {"OPTICAL": "Z", "TRUE": "BETA", "RELATIVISTIC": "BETA"}
    source, target = names.get(source, source), names.get(target, target)
    # by the ratio of observed to rest frequency
    if source == "RADIO":
        ratio = 1 - value
    elif source == "Z":
        ratio = 1 / F.when(value != -1, 1 + value)
    elif source == "RATIO":
        ratio = value
    elif source == "BETA":
        ratio = F.sqrt(F.when(F.abs(value) < 1, (1 - value) / (1 + value)))
    elif source == "GAMMA":
        beta = F.sqrt(F.when(value >= 1, 1 - 1 / (value * value)))
        ratio = F.sqrt((1 - beta) / (1 + beta))
    else:
        raise ValueError(f"doppler values cannot be converted from {source}")
    ratio = F.when(ratio > 0, ratio)
    r2 = ratio * ratio
    out = {"RADIO": 1 - ratio, "Z": 1 / ratio - 1, "RATIO": ratio, "BETA": (1 - r2) / (1 + r2), "GAMMA": (1 + r2) / (2 * ratio)}
    if target not in out:
        raise ValueError(f"doppler values cannot be converted to {target}")
    return out[target]


def velocity(frequency: Column, rest: Column | float, convention: str = "RADIO") -> Column:
    """Velocity in m/s of a line seen at a frequency."""
    return doppler(frequency / rest, "RATIO", convention) * LIGHT


def frequency(speed: Column, rest: Column | float, convention: str = "RADIO") -> Column:
    return doppler(speed / LIGHT, convention, "RATIO") * rest


def parallactic_angle(hour_angle: Column, declination: Column, latitude: Column) -> Column:
    return F.atan2(F.cos(latitude) * F.sin(hour_angle), F.sin(latitude) * F.cos(declination) - F.cos(latitude) * F.sin(declination) * F.cos(hour_angle))


def _toward(lon: float, lat: float) -> np.ndarray:
    """Rows: the u, v and w axes of a phase centre."""
    sl, cl, sb, cb = math.sin(lon), math.cos(lon), math.sin(lat), math.cos(lat)
    return np.array([[-sl, cl, 0], [-sb * cl, -sb * sl, cb], [cb * cl, cb * sl, sb]])


def rotate_uvw(u: Column, v: Column, w: Column, source: tuple[float, float], target: tuple[float, float]) -> tuple[Column, Column, Column]:
    """uvw coordinates for another phase centre (longitude, latitude)."""
    return rotate(_toward(*target) @ _toward(*source).T, u, v, w)


def rotate_baseline(x: Column, y: Column, z: Column, source: str, target: str) -> tuple[Column, Column, Column]:
    """Cartesian baselines, uvw or field vectors between direction frames."""
    return rotate(matrix_to(target) @ matrix_to(source).T, x, y, z)
