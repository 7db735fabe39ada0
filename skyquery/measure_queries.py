"""Registered queries of quantities, measures, world regions, files, and datasets that are stored and read again, with SQL that gives the same rows."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions import sky
from .functions.units import Quantity
from .operators import regions
from .operators.coordinates import CoordinateSystem, Direction, beam_to_pixels
from .operators.image import Image
from .operators.measures import MeasureColumn
from .operators.observations.dataset import Observation, add_history
from .operators.observations.selection import Selection
from .queries import _embedding_lattice, _LONG, _MAIN, _observation, query, table
from .sources import formats
from .statement_queries import workspace



def _part() -> tuple[Column, Column]:
    """Size and price of a part as doubles."""
    return F.col("p_size").cast("double"), F.col("p_retailprice").cast("double")


# --- quantities and measures ---
@query("quantity_arithmetic", "SELECT p_partkey, round(p_size + p_retailprice/1000,6) AS total, round(p_size*1000 - p_retailprice,6) AS difference, round(p_size*1000/p_retailprice,6) AS ratio, p_size*1000 > p_retailprice*20 AS above FROM part", 6)
def _quantities(spark, sf_dir):
    size, price = _part()
    far, near = Quantity(size, "km"), Quantity(price, "m")
    return table(spark, sf_dir, "part").select("p_partkey", (far + near).value.alias("total"), (far.to("m") - near).value.alias("difference"), (far / near).to("").value.alias("ratio"), (far > near * 20).alias("above"))


@query("measure_velocity", "SELECT p_partkey, round((1-f/1.42)*299792.458,4) AS radio, round((1.42/f-1)*299792.458,4) AS optical, round(f,6) AS back FROM (SELECT p_partkey, 1.3 + p_size/500.0 AS f FROM part)", 6)
def _velocity(spark, sf_dir):
    size = _part()[0]
    f = 1.3 + size / 500
    radio, optical = sky.velocity(f, 1.42), sky.velocity(f, 1.42, "OPTICAL")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(radio / 1000, 4).alias("radio"), F.round(optical / 1000, 4).alias("optical"), sky.frequency(optical, 1.42, "OPTICAL").alias("back"))


@query("measure_parallactic", "SELECT p_partkey, round(atan2(cos(0.6)*sin(p_size/20.0), sin(0.6)*cos(p_size/60.0) - cos(0.6)*sin(p_size/60.0)*cos(p_size/20.0)),7) AS angle FROM part", 7)
def _parallactic(spark, sf_dir):
    size = _part()[0]
    return table(spark, sf_dir, "part").select("p_partkey", sky.parallactic_angle(size / 20, size / 60, F.lit(0.6)).alias("angle"))


def _axes(lon: float, lat: float) -> list[str]:
    """SQL of the u, v and w axes of a phase centre, as three numbers each."""
    s, c, t, k = f"sin({lon})", f"cos({lon})", f"sin({lat})", f"cos({lat})"
    return [[f"-{s}", c, "0"], [f"-{t}*{c}", f"-{t}*{s}", k], [f"{k}*{c}", f"{k}*{s}", t]]


_FROM, _TO = _axes(1.0, 0.4), _axes(1.2, 0.3)
_XYZ = ", ".join(f"l_quantity*({_FROM[0][i]}) + l_tax*({_FROM[1][i]}) + l_discount*({_FROM[2][i]}) AS {n}" for i, n in enumerate("xyz"))
_UVW = ", ".join(f"round(x*({_TO[i][0]}) + y*({_TO[i][1]}) + z*({_TO[i][2]}),7) AS {n}" for i, n in enumerate("uvw"))


@query("measure_uvw", f"SELECT l_orderkey, l_linenumber, {_UVW} FROM (SELECT l_orderkey, l_linenumber, {_XYZ} FROM lineitem)", 7)
def _uvw(spark, sf_dir):
    made = sky.rotate_uvw(*(F.col(c).cast("double") for c in ("l_quantity", "l_tax", "l_discount")), (1.0, 0.4), (1.2, 0.3))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[c.alias(n) for c, n in zip(made, "uvw", strict=True)])


_N = "(6378137.0/sqrt(1 - (2 - 1/298.257223563)/298.257223563*sin(lat)*sin(lat)))"


@query("measure_position", f"SELECT p_partkey, round(({_N}+h)*cos(lat)*cos(lon),3) AS x, round(({_N}+h)*cos(lat)*sin(lon),3) AS y, round(({_N}*(1 - (2 - 1/298.257223563)/298.257223563)+h)*sin(lat),3) AS z, round(lon,6)::DOUBLE AS lon, round(lat,6)::DOUBLE AS lat, round(h,3) AS height FROM (SELECT p_partkey, p_size/30.0 AS lon, p_size/50.0 AS lat, p_retailprice AS h FROM part)", 6)
def _position(spark, sf_dir):
    size, price = _part()
    x, y, z = sky.wgs84_to_itrf(size / 30, size / 50, price)
    lon, lat, height = sky.itrf_to_wgs84(x, y, z)
    return table(spark, sf_dir, "part").select("p_partkey", *[F.round(c, 3).alias(n) for c, n in ((x, "x"), (y, "y"), (z, "z"))], lon.alias("lon"), lat.alias("lat"), F.round(height, 3).alias("height"))


@query("measure_columns", "SELECT p_partkey, round(58000 + p_size + p_partkey%7 + CASE WHEN p_partkey%2 = 0 THEN 37/86400.0 ELSE 0 END,9) AS tai, round(58000 + p_size + 37/86400.0,9) AS first, round(58001 + p_size + 37/86400.0,9) AS second, round(1.0/(1 - p_size/100.0) - 1,9) AS z, p_size*1e6 AS topo FROM part", 9)
def _measure_columns(spark, sf_dir):
    """Frames and offsets of each row, cells that hold several measures, and frequencies, which keep their frame."""
    size = _part()[0]
    days = 58000 + size
    frame = table(spark, sf_dir, "part").select(
        "p_partkey", days.alias("t"), (F.col("p_partkey") % 7).alias("late"), F.when(F.col("p_partkey") % 2 == 0, "UTC").otherwise("TAI").alias("ref"), F.array(days, days + 1).alias("ts"), (size / 100).alias("d"), (size * 1e6).alias("f"),
    )
    frame = MeasureColumn("t", "epoch", frame_column="ref", offset_column="late").attach(frame)
    several = MeasureColumn("ts", "epoch", "UTC", array=True).to("TAI")
    return frame.select("p_partkey", MeasureColumn.of(frame, "t").to("TAI").alias("tai"), several[0].alias("first"), several[1].alias("second"), MeasureColumn("d", "doppler", "RADIO").to("Z").alias("z"), MeasureColumn("f", "frequency", "TOPO").to("TOPO").alias("topo"))


@query("beam_pixels", "SELECT 4.0::DOUBLE AS major, 2.0::DOUBLE AS minor, round(pi()/2,6) AS angle, 3.0::DOUBLE AS round_major, 3.0::DOUBLE AS round_minor", 6)
def _beam(spark, sf_dir):
    along, circle = beam_to_pixels(0.04, 0.02, math.pi / 2, (0.01, 0.01)), beam_to_pixels(0.03, 0.03, 0.3, (-0.01, 0.01))
    return spark.range(1).select(*[F.lit(v).alias(n) for n, v in zip(("major", "minor", "angle", "round_major", "round_minor"), (*along, *circle[:2]), strict=True)])


# --- coordinates and images ---
_SKY = Direction(1.0, 0.0, (-0.01, 0.01), (10.0, 40.0), "CAR")
_LON, _LAT = "1.0 - (i0 - 10)*0.01", "(i1 - 40)*0.01"
_INBOX, _INOVAL, _INPOLY = f"{_LON} BETWEEN 0.905 AND 1.055 AND {_LAT} BETWEEN -0.205 AND 0.105", f"power(({_LON} - 1.0)/0.075,2) + power({_LAT}/0.155,2) <= 1", f"{_LON} > 0.951 AND {_LAT} > -0.1013 AND ({_LON} - 0.951)/0.1 + ({_LAT} + 0.1013)/0.3 < 1"


@query("region_world", f"SELECT count(*) FILTER (WHERE {_INBOX}) AS box, count(*) FILTER (WHERE {_INBOX} AND NOT {_INOVAL}) AS without, count(*) FILTER (WHERE {_INBOX} OR {_INOVAL}) AS both, count(*) FILTER (WHERE {_INPOLY}) AS polygon FROM {_LONG}")
def _region_world(spark, sf_dir):
    """Regions of the sky, and what is in one but not in another, on the pixels of an image."""
    system = CoordinateSystem([_SKY]).to_json()
    box, oval = regions.Box((0.905, -0.205), (1.055, 0.105)), regions.Ellipsoid((1.0, 0.0), (0.075, 0.155))
    polygon = regions.Polygon((0.951, 1.051, 0.951), (-0.1013, -0.1013, 0.1987), 0.0)
    at = [F.col("i0"), F.col("i1")]
    n = lambda r, name: F.count_if(regions.from_json(regions.to_json(regions.InWorld(r, system))).contains(at)).alias(name)
    return _embedding_lattice(spark, sf_dir).frame.agg(n(box, "box"), n(box - oval, "without"), n(box | oval, "both"), n(polygon, "polygon"))


@query("coordinate_header", "SELECT p_partkey, round(1.4e9 + (p_size - 1)*1e6,3) AS frequency, round(5.0 + (p_size - 3)*0.5,6)::DOUBLE AS linear, round((1.4e9 + (p_size - 1)*1e6 - 1.4e9)/1e6,6) AS pixel FROM part", 6)
def _header(spark, sf_dir):
    """A coordinate system from header cards, written to cards and read once more."""
    size = _part()[0]
    cards = {"CTYPE1": "FREQ", "CRVAL1": 1.4e9, "CDELT1": 1e6, "CRPIX1": 2.0, "CUNIT1": "Hz", "RESTFRQ": 1.42e9, "CTYPE2": "LINEAR", "CRVAL2": 5.0, "CDELT2": 0.5, "CRPIX2": 4.0, "TELESCOP": "T"}
    system = CoordinateSystem.from_header(CoordinateSystem.from_header(cards).to_header())
    f, x = system.to_world([size, size])
    return table(spark, sf_dir, "part").select("p_partkey", f.alias("frequency"), x.alias("linear"), (system.to_pixel([f, x])[0] - 1).alias("pixel"))


@query("image_stored", f"SELECT count(*) AS n, count(*) FILTER (WHERE (i0+i1)%4<>0) AS good, round(sum(v),4) AS s, 'Jy' AS unit FROM {_LONG}", 4)
def _image_stored(spark, sf_dir):
    folder = workspace(spark)
    Image(_embedding_lattice(spark, sf_dir), CoordinateSystem([_SKY]), "Jy").save(folder, "image")
    back = Image.open(spark, folder, "image")
    return back.lattice.frame.agg(F.count(F.lit(1)).alias("n"), F.count_if("mask").alias("good"), F.sum("value").alias("s"), F.lit(back.unit).alias("unit"))


# --- files ---
for _kind in formats.FORMATS[:4]:

    def _run(spark, sf_dir, kind=_kind):
        source = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
        path = f"{workspace(spark)}/part"
        formats.write(source, path, kind)
        return formats.read(spark, path, kind, source.schema)

    query(f"files_{_kind}", "SELECT p_partkey, p_name, p_size, round(p_retailprice,4) AS p_retailprice FROM part", 4)(_run)


# --- observations ---
@query("obs_stored", f"SELECT CAST(f AS INTEGER) AS FIELD_ID, count(*) AS n, round(sum(u),4) AS u FROM {_MAIN} GROUP BY 1", 4)
def _obs_stored(spark, sf_dir):
    folder = workspace(spark)
    _observation(spark, sf_dir).save(folder, "obs")
    return Observation.open(spark, folder, "obs").main.groupBy("FIELD_ID").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("UVW")[0]).alias("u"))


@query("obs_metadata", f"SELECT (SELECT count(*) FROM {_MAIN}) AS rows, (SELECT list(DISTINCT CAST(scan AS BIGINT) ORDER BY CAST(scan AS BIGINT)) FROM {_MAIN}) AS scans, ['F0', 'F1', 'F2', 'F3', 'F4'] AS fields, 7::BIGINT AS antennas, 'rows: ' || (SELECT count(*) FROM {_MAIN}) AS line")
def _obs_metadata(spark, sf_dir):
    o = _observation(spark, sf_dir)
    m = o.metadata()
    return spark.createDataFrame([(m["rows"], [int(s) for s in m["SCAN_NUMBER"]], [x["NAME"] for x in m["fields"]], len(m["antennas"]), o.summary().split("\n")[0])], "rows long, scans array<bigint>, fields array<string>, antennas long, line string")


@query("obs_references", f"SELECT count(*) FILTER (WHERE f + 2 >= 5) AS n, min(f + 2) FILTER (WHERE f + 2 >= 5) AS such FROM {_MAIN}")
def _obs_references(spark, sf_dir):
    """References that lead nowhere, here to fields, as the check reports them."""
    o = _observation(spark, sf_dir)
    found = Observation(o.main.withColumn("FIELD_ID", F.col("FIELD_ID") + 2), o.sub).violations()
    text = F.explode(F.array(*[F.lit(x) for x in found])) if found else F.lit("FIELD_ID: 0 rows (such as 0)")
    return spark.range(1).select(text.alias("x")).filter("x LIKE 'FIELD_ID:%'").select(F.regexp_extract("x", r": (\d+) rows", 1).cast("long").alias("n"), F.regexp_extract("x", r"such as (\d+)", 1).cast("long").alias("such"))


@query("obs_history", "SELECT unnest(['first', 'second', 'third']) AS MESSAGE")
def _obs_history(spark, sf_dir):
    o = _observation(spark, sf_dir)
    for line in ("first", "second", "third"):
        o = add_history(o, line)
    return o.sub["HISTORY"].select("MESSAGE")


@query("obs_chunk_rows", f"SELECT CAST(0 AS INTEGER) AS ARRAY_ID, CAST(f AS INTEGER) AS FIELD_ID, CAST(dd AS INTEGER) AS DATA_DESC_ID, CAST(r AS BIGINT) AS row FROM {_MAIN}")
def _obs_chunk_rows(spark, sf_dir):
    return _observation(spark, sf_dir).chunk_rows()


@query("select_errors_collected", f"SELECT CAST(r AS BIGINT) AS row, 1::BIGINT AS errors FROM {_MAIN} WHERE scan = 2")
def _select_errors(spark, sf_dir):
    """A category that cannot be read is left out and reported; the others choose."""
    got = Selection(antenna="NOPE", scan="2", collect_errors=True).evaluate(_observation(spark, sf_dir))
    return got.rows.select(F.col("_rownr").alias("row"), F.lit(len(got.errors)).cast("long").alias("errors"))
