"""Columns of measures: values with a reference frame that is fixed or stands in another column.

A direction is an array of longitude and latitude in radians, an epoch a number of MJD days, a
position an array of three coordinates, a Doppler value, frequency or radial velocity a number. Cells may also
be arrays of measures. Frames are kept in the field's metadata. Frequencies and radial velocities keep their frame: going to another takes an observer and is refused.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sky

# The frames of frequencies and radial velocities.
REST_FRAMES = ("REST", "LSRK", "LSRD", "BARY", "GEO", "TOPO", "GALACTO", "LGROUP", "CMB")
# The frames of each kind.
FRAMES = {"direction": ("J2000", "ICRS", "GALACTIC", "ECLIPTIC", "B1950"), "epoch": ("UTC", "UT1", "TAI", "TT", "TDT", "TDB"), "position": ("ITRF", "WGS84"), "doppler": ("RADIO", "Z", "RATIO", "BETA", "GAMMA"), "frequency": REST_FRAMES, "radialvelocity": REST_FRAMES}


@dataclass(frozen=True)
class MeasureColumn:
    """``frame``: of all rows, unless ``frame_column`` names the column that has each row's. ``offset`` is added to the values first, and so is what ``offset_column`` has for the row.

    ``array``: each cell is an array of measures of one frame.
    """

    column: str
    kind: str
    frame: str = ""
    frame_column: str = ""
    offset: float | None = None
    offset_column: str = ""
    array: bool = False

    def __post_init__(self):
        if self.kind not in FRAMES:
            raise ValueError(f"measures of kind {self.kind} are not known")
        if self.frame and self.frame not in FRAMES[self.kind]:
            raise ValueError(f"{self.frame} is no frame of a {self.kind}")
        if not self.frame and not self.frame_column:
            raise ValueError("a frame, or a column of frames, is needed")
        if (self.offset is not None or self.offset_column) and self.kind in ("direction", "position"):
            raise ValueError(f"a {self.kind} has no offset")

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> MeasureColumn:
        return MeasureColumn(**json.loads(text))

    def attach(self, frame: DataFrame) -> DataFrame:
        """The frame with this description in the column's metadata."""
        return frame.withColumn(self.column, F.col(self.column).alias(self.column, metadata={**frame.schema[self.column].metadata, "measure": asdict(self)}))

    @staticmethod
    def of(frame: DataFrame, column: str) -> MeasureColumn:
        found = frame.schema[column].metadata.get("measure")
        if not found:
            raise ValueError(f"{column} has no measure")
        return MeasureColumn(**found)

    def _one(self, value: Column, source: str, target: str) -> Column:
        if source == target:
            return value
        if self.kind == "direction":
            return F.array(*sky.convert_direction(value[0], value[1], source, target))
        if self.kind == "epoch":
            return sky.convert_epoch(value, source, target)
        if self.kind in ("frequency", "radialvelocity"):
            raise ValueError(f"a {self.kind} cannot be converted from {source} to {target}")
        if self.kind == "doppler":
            return sky.doppler(value, source, target)
        convert = sky.itrf_to_wgs84 if source == "ITRF" else sky.wgs84_to_itrf
        return F.array(*convert(value[0], value[1], value[2]))

    def to(self, target: str) -> Column:
        """The values in another frame. Rows whose own frame is not known, or cannot be converted, are null."""
        if target not in FRAMES[self.kind]:
            raise ValueError(f"{target} is no frame of a {self.kind}")
        return F.transform(F.col(self.column), lambda v: self._converted(v, target)) if self.array else self._converted(F.col(self.column), target)

    def _converted(self, value: Column, target: str) -> Column:
        if self.offset is not None:
            value = value + self.offset
        if self.offset_column:
            value = value + F.col(self.offset_column)
        if not self.frame_column:
            return self._one(value, self.frame, target)
        out = F.lit(None)
        for source in FRAMES[self.kind] if self.kind not in ("frequency", "radialvelocity") else (target,):
            out = F.when(F.col(self.frame_column) == source, self._one(value, source, target)).otherwise(out)
        return out
