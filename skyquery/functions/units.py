"""Units: the literal suffixes of the query language, and general units as factors over base dimensions."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

# Units that may follow a literal, with the factor to the SI unit (flux: Jy).
LITERAL_UNITS = {
    "DEG": math.pi / 180, "RAD": 1.0, "ARCSEC": math.pi / 648000, "ARCMIN": math.pi / 10800, "MAS": math.pi / 648000000,
    "S": 1.0, "MS": 1e-3, "US": 1e-6, "NS": 1e-9, "MIN": 60.0, "H": 3600.0, "D": 86400.0,
    "M": 1.0, "KM": 1000.0, "CM": 0.01, "MM": 0.001, "AU": 1.495978707e11, "PC": 3.0856775814913673e16, "KPC": 3.0856775814913673e19, "MPC": 3.0856775814913673e22,
    "HZ": 1.0, "KHZ": 1e3, "MHZ": 1e6, "GHZ": 1e9, "JY": 1.0, "MJY": 1e-3, "KJY": 1e3, "K": 1.0, "MK": 1e-3,
    "M_S": 1.0, "KM_S": 1000.0, "PA": 1.0, "MBAR": 100.0, "LAMBDA": 1.0,
}

# SI prefixes.
PREFIXES = {"Q": 1e30, "R": 1e27, "Y": 1e24, "Z": 1e21, "E": 1e18, "P": 1e15, "T": 1e12, "G": 1e9, "M": 1e6, "k": 1e3, "h": 1e2, "da": 1e1, "d": 1e-1, "c": 1e-2, "m": 1e-3, "u": 1e-6, "n": 1e-9, "p": 1e-12, "f": 1e-15, "a": 1e-18, "z": 1e-21, "y": 1e-24, "r": 1e-27, "q": 1e-30}

# Base dimensions, in order.
DIMENSIONS = ("m", "kg", "s", "A", "K", "cd", "mol", "rad", "sr")


@dataclass(frozen=True)
class Unit:
    """A factor to SI, and the exponent of each base dimension."""

    factor: float
    powers: tuple[int, ...]

    def __mul__(self, other: Unit) -> Unit:
        return Unit(self.factor * other.factor, tuple(a + b for a, b in zip(self.powers, other.powers, strict=True)))

    def __truediv__(self, other: Unit) -> Unit:
        return self * other**-1

    def __pow__(self, n: int) -> Unit:
        return Unit(self.factor**n, tuple(a * n for a in self.powers))

    def conforms(self, other: Unit) -> bool:
        return self.powers == other.powers


def _base(name: str, factor: float = 1.0) -> Unit:
    return Unit(factor, tuple(int(d == name) for d in DIMENSIONS))


ONE = Unit(1.0, (0,) * len(DIMENSIONS))


def _named() -> dict[str, Unit]:
    m, kg, s, amp, kelvin, rad = (_base(x) for x in ("m", "kg", "s", "A", "K", "rad"))
    scaled = lambda u, f: Unit(u.factor * f, u.powers)
    newton = kg * m / s**2
    joule, pascal = newton * m, newton / m**2
    watt = joule / s
    volt = watt / amp
    tesla = volt * s / m**2
    return {
        "m": m, "g": scaled(kg, 1e-3), "kg": kg, "s": s, "A": amp, "K": kelvin, "cd": _base("cd"), "mol": _base("mol"), "rad": rad, "sr": _base("sr"), "_": ONE, "": ONE, "%": scaled(ONE, 0.01),
        "Hz": s**-1, "N": newton, "J": joule, "W": watt, "Pa": pascal, "C": amp * s, "V": volt, "Ohm": volt / amp, "S": amp / volt, "F": amp * s / volt, "Wb": volt * s, "T": tesla, "H": volt * s / amp,
        "lm": _base("cd") * _base("sr"), "lx": _base("cd") * _base("sr") / m**2, "Jy": scaled(watt / m**2 * s, 1e-26), "G": scaled(tesla, 1e-4), "eV": scaled(joule, 1.60217733e-19), "erg": scaled(joule, 1e-7),
        "dyn": scaled(newton, 1e-5), "bar": scaled(pascal, 1e5), "atm": scaled(pascal, 101325.0), "min": scaled(s, 60.0), "h": scaled(s, 3600.0), "d": scaled(s, 86400.0), "a": scaled(s, 31557600.0), "yr": scaled(s, 31557600.0), "cy": scaled(s, 3155760000.0),
        "deg": scaled(rad, math.pi / 180), "arcmin": scaled(rad, math.pi / 10800), "arcsec": scaled(rad, math.pi / 648000), "as": scaled(rad, math.pi / 648000), "'": scaled(rad, math.pi / 10800), "''": scaled(rad, math.pi / 648000),
        "AU": scaled(m, 149597870660.0), "UA": scaled(m, 149597870660.0), "pc": scaled(m, 3.0856775814913673e16), "ly": scaled(m, 9.46073047e15), "Angstrom": scaled(m, 1e-10), "l": scaled(m**3, 1e-3), "L": scaled(m**3, 1e-3),
        "in": scaled(m, 0.0254), "ft": scaled(m, 0.3048), "yd": scaled(m, 0.9144), "mile": scaled(m, 1609.344), "n_mile": scaled(m, 1852.0), "beam": ONE, "pixel": ONE, "count": ONE, "lambda": ONE, "t": scaled(kg, 1000.0), "u": scaled(kg, 1.661e-27),
    }


_UNITS = _named()
_USER: dict[str, Unit] = {}


class UnitError(ValueError):
    pass


def define(name: str, unit: Unit | str) -> None:
    """Makes a unit of one's own known under a name."""
    _USER[name] = parse(unit) if isinstance(unit, str) else unit


def _single(name: str) -> Unit:
    if name in _USER:
        return _USER[name]
    if name in _UNITS:
        return _UNITS[name]
    for prefix in sorted(PREFIXES, key=len, reverse=True):
        rest = name[len(prefix) :]
        if name.startswith(prefix) and rest and (rest in _UNITS or rest in _USER):
            unit = _USER.get(rest) or _UNITS[rest]
            return Unit(unit.factor * PREFIXES[prefix], unit.powers)
    raise UnitError(f"unknown unit {name!r}")


_TOKEN = re.compile(r"\s*(\*\*|\^|[./*()]|[A-Za-z_%'][A-Za-z_%']*|[+-]?\d+)")


def parse(text: str) -> Unit:
    """A unit such as ``km/s``, ``kg.m2/s2``, ``Jy.(m/s)**-1``. A quotient holds for the next factor only."""
    parts, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise UnitError(f"bad unit {text!r}")
        parts.append(m[1])
        at = m.end()
    pos = 0

    def power(u: Unit) -> Unit:
        nonlocal pos
        if pos < len(parts) and parts[pos] in ("**", "^"):
            pos += 1
            if pos >= len(parts) or not re.fullmatch(r"[+-]?\d+", parts[pos]):
                raise UnitError(f"bad power in {text!r}")
        if pos < len(parts) and re.fullmatch(r"[+-]?\d+", parts[pos]):
            u = u ** int(parts[pos])
            pos += 1
        return u

    def factor() -> Unit:
        nonlocal pos
        if pos >= len(parts):
            raise UnitError(f"bad unit {text!r}")
        part = parts[pos]
        pos += 1
        if part == "(":
            u = product()
            if pos >= len(parts) or parts[pos] != ")":
                raise UnitError(f"bad unit {text!r}")
            pos += 1
            return power(u)
        if not re.match(r"[A-Za-z_%']", part):
            raise UnitError(f"bad unit {text!r}")
        return power(_single(part))

    def product() -> Unit:
        nonlocal pos
        u = factor() if pos < len(parts) and parts[pos] != "/" else ONE
        while pos < len(parts) and parts[pos] != ")":
            if parts[pos] in (".", "*"):
                pos += 1
                u = u * factor()
            elif parts[pos] == "/":
                pos += 1
                u = u / factor()
            else:
                u = u * factor()
        return u

    if not parts:
        return ONE
    out = product()
    if pos != len(parts):
        raise UnitError(f"bad unit {text!r}")
    return out


def factor(source: str, target: str) -> float:
    """What a value in one unit is multiplied by to be in the other; raises UnitError if they do not conform."""
    a, b = parse(source), parse(target)
    if not a.conforms(b):
        raise UnitError(f"{source!r} does not conform to {target!r}")
    return a.factor / b.factor


@dataclass(frozen=True)
class Quantity:
    """A value with a unit. The value may be a number or a Column: arithmetic is the same."""

    value: object
    unit: str = ""

    def to(self, unit: str) -> Quantity:
        return Quantity(self.value * factor(self.unit, unit), unit)

    def __add__(self, other: Quantity) -> Quantity:
        return Quantity(self.value + other.to(self.unit).value, self.unit)

    def __sub__(self, other: Quantity) -> Quantity:
        return Quantity(self.value - other.to(self.unit).value, self.unit)

    def __mul__(self, other) -> Quantity:
        if isinstance(other, Quantity):
            return Quantity(self.value * other.value, ".".join(x for x in (self.unit, other.unit) if x))
        return Quantity(self.value * other, self.unit)

    def __truediv__(self, other) -> Quantity:
        if isinstance(other, Quantity):
            return Quantity(self.value / other.value, f"{self.unit}/({other.unit})" if other.unit else self.unit)
        return Quantity(self.value / other, self.unit)

    def _other(self, other: Quantity):
        return other.to(self.unit).value

    def __lt__(self, other):
        return self.value < self._other(other)

    def __gt__(self, other):
        return self.value > self._other(other)

    def __le__(self, other):
        return self.value <= self._other(other)

    def __ge__(self, other):
        return self.value >= self._other(other)
