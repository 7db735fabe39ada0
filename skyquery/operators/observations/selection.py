"""Observation selection: twelve short expressions, each a condition on main rows, ANDed.

Names are looked up in the dimension tables, which are small; each expression becomes one
Column, and all of them one filter.
"""

from __future__ import annotations

import dataclasses
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.aggregates import ROWNR
from ...plans.compiler import Compiler, Scope
from ...plans.lexer import QueryError
from ...plans.parser import parse_expression
from .dataset import Observation

CATEGORIES = ("antenna", "field", "spw", "scan", "time", "uvdist", "correlation", "state", "observation", "array", "feed", "expr")
# Frequency units and their factors to Hz.
FREQUENCIES = {"hz": 1.0, "khz": 1e3, "mhz": 1e6, "ghz": 1e9}


class SelectionError(QueryError):
    pass


@dataclass
class Selected:
    rows: DataFrame
    ids: dict[str, list]
    channels: list[tuple[int, int, int]]
    errors: list[str]


def _parts(text: str, by: str = ",") -> list[str]:
    out = [p.strip() for p in text.split(by)]
    if not all(out):
        raise SelectionError(f"an empty part in {text!r}")
    return out


def _pattern(text: str):
    """A test for names: a regular expression if it has signs of one, else a glob, else the very name."""
    if re.search(r"[\[\]()|+{}^$\\.]", text):
        try:
            return re.compile(text).search
        except re.error as e:
            raise SelectionError(f"bad pattern {text!r}: {e}") from None
    if "*" in text or "?" in text:
        return re.compile(re.escape(text).replace(r"\*", ".*").replace(r"\?", ".")).fullmatch
    return lambda name: name == text


def _ids(text: str, known: list[int] | range | None, names: list[str] | None = None, what: str = "id") -> tuple[set[int], bool]:
    """The ids that a list names, and whether it is negated as a whole."""
    text = text.strip()
    negated = text.startswith("!")
    if negated:
        text = text[1:].strip()
    found: set[int] = set()
    for part in _parts(text):
        if m := re.fullmatch(r"(\d+)\s*~\s*(\d+)", part):
            low, high = int(m[1]), int(m[2])
            if low > high:
                raise SelectionError(f"range {part} runs backwards")
            found |= set(range(low, high + 1)) if known is None or high - low < 10**6 else {k for k in known if low <= k <= high}
        elif m := re.fullmatch(r"([<>])\s*(\d+)", part):
            if known is None:
                raise SelectionError(f"{part} needs known ids")
            found |= {k for k in known if (k < int(m[2]) if m[1] == "<" else k > int(m[2]))}
        elif re.fullmatch(r"\d+", part):
            found.add(int(part))
        elif re.fullmatch(r"-\d+", part):
            raise SelectionError(f"negative {what} {part}")
        elif names is not None:
            test = _pattern(part)
            hits = {i for i, n in enumerate(names) if n is not None and test(n)}
            if not hits:
                raise SelectionError(f"no {what} is called {part}")
            found |= hits
        else:
            raise SelectionError(f"{part!r} is no {what}")
    return found, negated


def _time(text: str) -> float:
    """MJD seconds, as a number or as YYYY/MM/DD[/HH[:MM[:SS]]]."""
    if re.fullmatch(r"[+-]?\d+(\.\d*)?([eE][+-]?\d+)?", text):
        return float(text)
    m = re.fullmatch(r"(\d{4})/(\d{1,2})/(\d{1,2})(?:/(\d{1,2})(?::(\d{1,2})(?::(\d{1,2}(?:\.\d*)?))?)?)?", text)
    if not m:
        raise SelectionError(f"{text!r} is no time")
    import datetime

    try:
        day = datetime.date(int(m[1]), int(m[2]), int(m[3]))
    except ValueError as e:
        raise SelectionError(f"{text!r} is no time: {e}") from None
    days = (day - datetime.date(1858, 11, 17)).days
    return days * 86400.0 + int(m[4] or 0) * 3600 + int(m[5] or 0) * 60 + float(m[6] or 0)


def _bounded(text: str, number, of: str, what: str) -> str:
    """``>a``, ``<b`` and ``a~b`` over a value; lists are alternatives."""
    found = []
    for part in _parts(text):
        if part[0] in "<>":
            found.append(f"{of} {part[0]} {number(part[1:].strip())!r}")
        elif "~" in part:
            low, _, high = part.partition("~")
            a, b = number(low.strip()), number(high.strip())
            if a > b:
                raise SelectionError(f"range {part} runs backwards")
            found.append(f"{of} BETWEEN {a!r} AND {b!r}")
        else:
            raise SelectionError(f"{part!r} is no bound for {what}")
    return " OR ".join(found)


def _listed(column: str, ids: list[int]) -> str:
    return f"{column} IN [{', '.join(map(str, ids))}]" if ids else "FALSE"


def _distance(text: str) -> float:
    m = re.fullmatch(r"([+-]?\d+(?:\.\d*)?(?:[eE][+-]?\d+)?)\s*(m|km|lambda|klambda|%|)", text, re.IGNORECASE)
    if not m:
        raise SelectionError(f"{text!r} is no distance")
    return float(m[1]) * (1000.0 if m[2].lower() == "km" else 1.0)


@dataclass
class Selection:
    """Set categories by keyword: ``Selection(antenna="ANT0&ANT1", scan="1~3")``."""

    antenna: str = ""
    field: str = ""
    spw: str = ""
    scan: str = ""
    time: str = ""
    uvdist: str = ""
    correlation: str = ""
    state: str = ""
    observation: str = ""
    array: str = ""
    feed: str = ""
    expr: str = ""
    collect_errors: bool = False
    _ids: dict = dataclasses.field(default_factory=dict, repr=False)
    _channels: list = dataclasses.field(default_factory=list, repr=False)

    def has_selection(self) -> bool:
        return any(getattr(self, c).strip() for c in CATEGORIES)

    def clear(self) -> None:
        for c in CATEGORIES:
            setattr(self, c, "")

    # --- conditions ---
    def texts(self, o: Observation) -> tuple[dict[str, str], list[str]]:
        """The condition of each category that has one, in the query language, and the errors of those that have not (collect_errors)."""
        self._ids, self._channels = {}, []
        found, errors = {}, []
        for c in CATEGORIES:
            text = getattr(self, c).strip()
            if not text:
                continue
            try:
                made = getattr(self, "_on_" + c)(text, o)
                if made is not None:
                    found[c] = made
            except QueryError as e:
                if not self.collect_errors:
                    raise
                errors.append(f"{c}: {e}")
        return found, errors

    def where(self, o: Observation) -> str:
        """The selection as the WHERE text of a statement; empty if it chooses all rows. It gives the rows that ``evaluate`` gives."""
        return " AND ".join(f"({t})" for t in self.texts(o)[0].values())

    def conditions(self, o: Observation) -> tuple[dict[str, Column], list[str]]:
        """As ``texts``, compiled."""
        o = Observation(o.rows, o.sub)
        found, errors = self.texts(o)
        compiler = Compiler(Scope.of(o.main))
        return {c: compiler.condition(parse_expression(t)) for c, t in found.items()}, errors

    def condition(self, o: Observation) -> Column:
        return reduce(Column.__and__, self.conditions(o)[0].values(), F.lit(True))

    def evaluate(self, o: Observation) -> Selected:
        o = Observation(o.rows, o.sub)
        found, errors = self.conditions(o)
        rows = o.rows.filter(reduce(Column.__and__, found.values(), F.lit(True)))
        return Selected(rows, dict(self._ids), list(self._channels), errors)

    def row_numbers(self, o: Observation) -> DataFrame:
        return self.evaluate(o).rows.select(F.col(ROWNR).alias("row"))

    @staticmethod
    def _names(o: Observation, table: str, column: str = "NAME") -> list[str]:
        return [r[0] for r in o.table(table).orderBy(ROWNR).select(column).collect()] if table in o.sub else []

    def _pairs(self, text: str, one: str, two: str, names: list[str] | None, what: str, empty_is_all: bool) -> str:
        """``a``: either end; ``a&b``: between; ``a&&b``: also of one with itself; ``a&&&``: with itself only."""
        negated = text.startswith("!")
        text = text[1:].strip() if negated else text
        count = range(len(names)) if names is not None else None
        either = lambda s: f"{_listed(one, s)} OR {_listed(two, s)}"
        m = re.fullmatch(r"([^&]*?)\s*(&{1,3})\s*([^&]*)", text)
        if m is None:
            if "&" in text:
                raise SelectionError(f"too many & in {text!r}")
            s = self._note(what, _ids(text, count, names, what)[0])
            made = either(s)
        else:
            left, sign, right = m.groups()
            if not left.strip():
                raise SelectionError(f"nothing before & in {text!r}")
            a = self._note(what, _ids(left, count, names, what)[0]) if left.strip() != "*" else None
            if sign == "&&&":
                if right.strip():
                    raise SelectionError(f"something behind &&& in {text!r}")
                made = f"{one} = {two}" + (f" AND {_listed(one, a)}" if a is not None else "")
            else:
                if not right.strip() and not empty_is_all:
                    raise SelectionError(f"nothing behind {sign} in {text!r}")
                b = None if right.strip() in ("", "*") else self._note(what, _ids(right, count, names, what)[0])
                inside = lambda c, s: _listed(c, s) if s is not None else "TRUE"
                made = f"{inside(one, a)} AND {inside(two, b)} OR {inside(one, b)} AND {inside(two, a)}"
                if sign == "&":
                    made = f"({made}) AND {one} != {two}"
        return f"NOT ({made})" if negated else made

    def _note(self, what: str, ids: set[int]) -> list[int]:
        self._ids[what] = sorted({*self._ids.get(what, []), *ids})
        return sorted(ids)

    def _on_antenna(self, text: str, o: Observation) -> str:
        return self._pairs(text, "ANTENNA1", "ANTENNA2", self._names(o, "ANTENNA"), "antenna", False)

    def _on_feed(self, text: str, o: Observation) -> str:
        return self._pairs(text, "FEED1", "FEED2", None, "feed", True)

    def _by_id(self, text: str, what: str, column: str, o: Observation, names: list[str] | None = None) -> str:
        known = range(len(names)) if names is not None else None
        if known is None and re.search(r"[<>]", text):
            known = [r[0] for r in o.main.select(column).distinct().collect()]
        ids, negated = _ids(text, known, names, what)
        made = _listed(column, self._note(what, ids))
        return f"NOT ({made})" if negated else made

    def _on_field(self, text: str, o: Observation) -> str:
        return self._by_id(text, "field", "FIELD_ID", o, self._names(o, "FIELD"))

    def _on_scan(self, text: str, o: Observation) -> str:
        return self._by_id(text, "scan", "SCAN_NUMBER", o)

    def _on_observation(self, text: str, o: Observation) -> str:
        return self._by_id(text, "observation", "OBSERVATION_ID", o)

    def _on_array(self, text: str, o: Observation) -> str:
        return self._by_id(text, "array", "ARRAY_ID", o)

    def _on_state(self, text: str, o: Observation) -> str:
        plain = [p for p in _parts(text.lstrip("! ")) if re.fullmatch(r"[A-Za-z_]\w*", p)]
        if plain:
            raise SelectionError(f"{plain[0]!r} is neither an id nor a pattern of modes")
        return self._by_id(text, "state", "STATE_ID", o, self._names(o, "STATE", "OBS_MODE"))

    def _on_spw(self, text: str, o: Observation) -> str:
        windows = [r.asDict() for r in o.table("SPECTRAL_WINDOW").orderBy(ROWNR).select("NAME", "NUM_CHAN", "REF_FREQUENCY").collect()]
        wanted: set[int] = set()
        for part in _parts(text):
            head, _, channels = part.partition(":")
            head = head.strip()
            hertz = lambda s: (m := re.fullmatch(r"(\d+(?:\.\d*)?)\s*([kMGmg]?[hH][zZ])", s)) and float(m[1]) * FREQUENCIES[m[2].lower()]
            if head == "*":
                hit = set(range(len(windows)))
            elif f := hertz(head):
                hit = {i for i, w in enumerate(windows) if abs(w["REF_FREQUENCY"] - f) <= 0.01 * f}
            elif m := re.fullmatch(r"([\d.]+)\s*~\s*([\d.]+)\s*([kMGmg]?[hH][zZ])", head):
                low, high = (float(m[k]) * FREQUENCIES[m[3].lower()] for k in (1, 2))
                hit = {i for i, w in enumerate(windows) if low <= w["REF_FREQUENCY"] <= high}
            else:
                hit = _ids(head, range(len(windows)), [w["NAME"] for w in windows], "spw")[0]
            wanted |= hit
            for piece in _parts(channels, ";") if channels.strip() else []:
                m = re.fullmatch(r"(\d+)(?:\s*~\s*(\d+)(?:\s*\^\s*(\d+))?)?", piece)
                if not m:
                    raise SelectionError(f"{piece!r} is no range of channels")
                low, high = int(m[1]), int(m[2] or m[1])
                if low > high:
                    raise SelectionError(f"range {piece} runs backwards")
                self._channels += [(i, low, high) for i in sorted(hit)]
        ids = self._note("spw", wanted)
        described = [r[0] for r in o.table("DATA_DESCRIPTION").filter(F.col("SPECTRAL_WINDOW_ID").isin(*ids) if ids else F.lit(False)).select(F.col(ROWNR).cast("int")).collect()]
        return _listed("DATA_DESC_ID", sorted(described))

    def _on_time(self, text: str, o: Observation) -> str:
        return _bounded(text, _time, "TIME", "time")

    def _on_uvdist(self, text: str, o: Observation) -> str:
        return _bounded(text, _distance, "SQRT(UVW[0]*UVW[0] + UVW[1]*UVW[1])", "uvdist")

    def _on_correlation(self, text: str, o: Observation) -> None:
        """Correlations choose no rows; they are noted for who reads the data."""
        self._ids["correlation"] = _parts(text)

    def _on_expr(self, text: str, o: Observation) -> str:
        Compiler(Scope.of(o.rows)).condition(parse_expression(text))
        return text
