"""Array expressions, lattices, regions, images, coordinates, units and measures."""

import math

import pytest
from pyspark.sql import functions as F

from skyquery.functions import sky, units
from skyquery.operators import regions
from skyquery.operators.coordinates import Codes, CoordinateSystem, Direction, Linear, PROJECTIONS, Spectral, Tabular, beam_to_pixels
from skyquery.operators.expressions import absolute, evaluate, form_complex, packed, real
from skyquery.operators.image import Image
from skyquery.operators.lattice import Lattice
from skyquery.plans.lexer import QueryError


@pytest.fixture(scope="module")
def a(spark):
    return Lattice.generate(spark, (8, 8), lambda i, j: (i + 8 * j + 1).cast("float"))


@pytest.fixture(scope="module")
def masked(spark):
    return Lattice.generate(spark, (16, 16), lambda i, j: (i + 16 * j + 1).cast("float"), lambda i, j: (i + 16 * j) % 4 != 0)


def values(lat):
    return {(r.i0, r.i1): r.value for r in lat.frame.collect()}


def test_lattice_expressions(a, masked):
    b = a.apply(lambda v: v * 3)
    names = {"a": a, "b": b, "m": masked}
    assert evaluate("a + b*2", names).at(2, 1) == 7.0 * 11
    assert evaluate("iif(a > 32, a, -a)", names).at(0, 0) == -1.0
    assert evaluate("sum(a)", names) == 64 * 65 / 2 and evaluate("mean(a)", names) == 32.5 and evaluate("median(a)", names) == 32.5
    assert evaluate("max(a) - min(a)", names) == 63.0 and evaluate("ntrue(a > 60)", names) == 4.0 and evaluate("any(a < 0)", names) == 0.0
    assert evaluate("ntrue(mask(m))", names) == 192.0
    assert evaluate("sum(m)", names) == sum(i + 1 for i in range(256) if i % 4)
    assert evaluate("sum(value(m))", names) == 256 * 257 / 2
    assert evaluate("variance(a)", names) == pytest.approx(sum((i - 31.5) ** 2 for i in range(64)) / 63)
    assert evaluate("a / (a - a)", names).at(0, 0) == math.inf
    assert evaluate("!(a > 3 || a == 1) && T", names).at(1, 0) is True
    for bad in ("a +", "a && b", "nosuch(a)", "c + 1", "a + m", "sum(a > 1)", "-(a > 1)", "Sin(a)", "a b"):
        with pytest.raises(QueryError):
            evaluate(bad, names)


def test_packed_expressions(spark):
    frame = spark.createDataFrame([([1.0, -2.0, 3.0], [True, True, False], [4.0, 5.0, 6.0])], "x array<double>, m array<boolean>, y array<double>")
    arrays = {"x": (F.col("x"), F.col("m")), "y": F.col("y")}
    v, m = packed("x*2 + y - 1", arrays)
    assert frame.select(v, m).first() == ([5.0, 0.0, 11.0], [True, True, False])
    assert frame.select(packed("sum(x)", arrays)[0]).first()[0] == [-1.0]
    assert frame.select(packed("y - mean(y)", arrays)[0]).first()[0] == [-1.0, 0.0, 1.0]
    assert frame.select(packed("iif(x > 0, y, x)", arrays)[0]).first()[0] == [4.0, -2.0, 6.0]
    with pytest.raises(QueryError):
        packed("z + 1", arrays)


def test_lattice_operators(a):
    sub = a.sub((1, 2), (3, 2), (2, 3))
    assert values(sub)[(1, 1)] == 3 + 8 * 5 + 1 and sub.shape == (3, 2)
    with pytest.raises(IndexError):
        a.sub((7, 0), (3, 1))
    assert a.put_at(99.0, 3, 3).at(3, 3) == 99.0 and a.put_sub(sub.apply(lambda v: v * 0), (0, 0)).at(2, 1) == 0.0
    rebin = a.rebin((3, 8))
    assert rebin.shape == (3, 1) and rebin.at(2, 0) == pytest.approx(sum(i + 8 * j + 1 for i in (6, 7) for j in range(8)) / 16)
    both = a.concat([a], 1)
    assert both.shape == (8, 16) and both.at(0, 8) == 1.0
    tiles = {(r.t0, r.t1): r["values"] for r in a.tiles((3, 8)).collect()}
    assert len(tiles[(2, 0)]) == 16 and tiles[(0, 0)][:4] == [1.0, 2.0, 3.0, 9.0]
    z = form_complex(a, a.apply(lambda v: v * 0 + 4))
    assert absolute(z).at(2, 0) == 5.0 and real(z).at(2, 0) == 3.0
    assert a.statistics().first().asDict()["mean"] == 32.5


def test_regions(a):
    inside = lambda r: a.within(r).frame.filter("mask").count()
    box, ellipse = regions.Box((1, 1), (3, 4)), regions.Ellipsoid((3.0, 3.0), (2.0, 2.0))
    assert inside(box) == 12 and inside(ellipse) == 13 and inside(~box) == 52
    assert inside(box | ellipse) + inside(box & ellipse) == 25 and inside(box - ellipse) == 12 - inside(box & ellipse)
    assert inside(regions.Polygon((0.0, 4.0, 4.0, 0.0), (0.0, 0.0, 4.0, 4.0))) == 16
    assert inside(regions.Pixels(((0, 0), (7, 7)))) == 2 and inside(regions.Extension(regions.Box((2,), (3,)), (1,))) == 16
    whole = (box | ellipse) - regions.Polygon((0.0, 1.0, 1.0), (0.0, 0.0, 1.0))
    assert regions.from_json(regions.to_json(whole)) == whole
    axes = [Linear(10.0, 2.0, 1.0), Linear(0.0, 1.0)]
    assert regions.WorldBox((10.0, 1.0), (14.0, 4.0)).pixels(axes) == regions.Box((1.0, 1.0), (3.0, 4.0))
    assert regions.by_mask(a.frame, a.frame.filter("value > 60"), a.axes).count() == 4
    registry = regions.Registry()
    registry.define("x", box)
    with pytest.raises(KeyError):
        registry.define("x", box)
    registry.rename("x", "y")
    assert registry.get("y") == box


def test_world_region_ends_with_the_map(spark):
    """Beyond the edges of a map the formulas come round the sphere to the same place again."""
    turn = round(2 * math.pi / 0.01)
    rows = spark.createDataFrame([(i, j) for i in (10, 10 + turn, 10 - turn) for j in (40, 40 + turn, 40 - turn)] + [(None, 40)], "i0 long, i1 long")
    at, box = [F.col("i0"), F.col("i1")], regions.Box((0.9, -0.1), (1.1, 0.1))
    for kind in ("CAR", "SFL", "PAR", "MER", "ARC", "AIT", "CEA", "MOL"):
        system = CoordinateSystem([Direction(1.0, 0.0, (-0.01, 0.01), (10.0, 40.0), kind)]).to_json()
        assert [tuple(r) for r in rows.filter(regions.InWorld(box, system).contains(at)).collect()] == [(10, 40)], kind
    # both poles and both ends of the equator, one degree a pixel, are on the map; a pixel further is not, also on axes after others
    d = math.radians(1)
    system = CoordinateSystem([Linear(), Direction(1.0, 0.0, (-d, d), (180.0, 90.0), "CAR")])
    ends = spark.createDataFrame([(180, 0), (180, 180), (0, 90), (360, 90), (180, -1), (180, 181), (-1, 90), (361, 90)], "i0 long, i1 long")
    shown = regions.InWorld(regions.Complement(regions.Box((5.0, -9.0, -9.0), (5.0, 9.0, 9.0))), system.to_json()).contains([F.lit(0), *at])
    assert [r[0] for r in ends.select(shown).collect()] == [True] * 4 + [False] * 4


def test_images(spark, a, tmp_path):
    image = Image(a, CoordinateSystem([Linear(0.0, 2.0), Linear(0.0, 2.0)]), "Jy/beam", {"beam": 1.0})
    fine = image.regrid((16, 16), CoordinateSystem([Linear(), Linear()]))
    got = values(fine.lattice)
    half = lambda x: math.floor(x / 2 + 0.5)
    assert all(v == (half(i) + 8 * half(j) + 1 if half(i) < 8 and half(j) < 8 else 0.0) for (i, j), v in got.items())
    image.save(f"file://{tmp_path}", "im")
    back = Image.open(spark, f"file://{tmp_path}", "im")
    assert values(back.lattice) == values(a) and back.unit == "Jy/beam" and back.coordinates.parts == image.coordinates.parts
    assert Image.expression("2*x", {"x": image}).lattice.at(1, 0) == 4.0 and "shape (8, 8)" in image.summary()


def test_coordinates(spark):
    one = lambda *cols: list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())
    for kind in PROJECTIONS:
        for latitude in (0.5, -0.5, 0.0):
            d = Direction(1.0, latitude, (-1e-2, 1e-2), (10.0, 20.0), kind)
            for at in ((15.0, 12.0), (-20.0, 55.0), (60.0, -30.0)):
                assert one(*d.to_pixel(*d.to_world(F.lit(at[0]), F.lit(at[1])))) == pytest.approx(at, abs=1e-6), kind
            assert one(*d.to_world(F.lit(10.0), F.lit(20.0))) == pytest.approx([1.0, latitude], abs=1e-9), kind
    with pytest.raises(ValueError):
        Direction(0, 0, (1, 1), (0, 0), "HPX")
    t = Tabular((0.0, 1.0, 3.0), (10.0, 20.0, 0.0))
    assert one(t.to_world(F.lit(0.5)), t.to_world(F.lit(2.0)), t.to_world(F.lit(4.0)), t.to_world(F.lit(-1.0))) == [15.0, 10.0, -10.0, 0.0]
    assert one(Codes((1, 5)).to_world(F.lit(1.2)), Codes((1, 5)).to_pixel(F.lit(5))) == [5, 1]
    system = CoordinateSystem([Direction(1.0, 0.5, (-1e-3, 1e-3), (10.0, 20.0)), Spectral(1.4e9, 1e6, 0.0, "Hz", 1.42e9)], "T")
    assert CoordinateSystem.from_json(system.to_json()).parts == system.parts and system.axis_of(Spectral) == 2
    again = CoordinateSystem.from_header(system.to_header())
    assert again.parts[1] == system.parts[1] and again.parts[0].longitude == pytest.approx(1.0)
    assert beam_to_pixels(4.0, 2.0, 0.3, (1.0, 1.0)) == pytest.approx((4.0, 2.0, 0.3))


def test_units():
    assert units.factor("km/h", "m/s") == pytest.approx(1 / 3.6) and units.factor("Jy", "W.m-2.Hz-1") == pytest.approx(1e-26)
    assert units.factor("arcsec", "deg") == pytest.approx(1 / 3600) and units.parse("kg.m2/s2").conforms(units.parse("J"))
    for bad in ("nosuch", "m/", "(m", "m**x"):
        with pytest.raises(units.UnitError):
            units.parse(bad)
    with pytest.raises(units.UnitError):
        units.factor("m", "s")
    q = units.Quantity(1.0, "km") + units.Quantity(500.0, "m")
    assert q.value == 1.5 and (q / units.Quantity(3.0, "s")).to("m/s").value == 500.0 and q > units.Quantity(1.0, "m")
    units.define("span", units.Unit(0.2286, units.parse("m").powers))
    assert units.factor("kspan", "m") == pytest.approx(228.6)


def test_measures(spark):
    one = lambda *cols: list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())
    # the galactic pole, and the way back
    pole = sky.convert_direction(F.lit(math.radians(192.85948)), F.lit(math.radians(27.12825)), "J2000", "GALACTIC")
    assert one(pole[1])[0] == pytest.approx(math.pi / 2, abs=1e-6)
    there = sky.convert_direction(F.lit(1.0), F.lit(0.3), "J2000", "B1950")
    assert one(*sky.convert_direction(*there, "B1950", "J2000")) == pytest.approx([1.0, 0.3], abs=1e-9)
    for scale in ("TAI", "TT", "TDB", "UT1"):
        assert one(sky.convert_epoch(sky.convert_epoch(F.lit(58000.3), "UTC", scale, 0.2), scale, "UTC", 0.2))[0] == pytest.approx(58000.3, abs=1e-10)
    with pytest.raises(ValueError):
        sky.convert_epoch(F.lit(1.0), "UTC", "LAST")
    with pytest.raises(ValueError):
        sky.matrix_to("AZEL")
    xyz = sky.wgs84_to_itrf(F.lit(0.2), F.lit(0.9), F.lit(150.0))
    assert one(*sky.itrf_to_wgs84(*xyz)) == pytest.approx([0.2, 0.9, 150.0], abs=1e-6)
    for kind in ("RADIO", "Z", "RATIO", "BETA", "GAMMA"):
        assert one(sky.doppler(sky.doppler(F.lit(0.1), "BETA", kind), kind, "RADIO"), sky.doppler(F.lit(0.1), "BETA", "RADIO"))[0] == pytest.approx(1 - math.sqrt(0.9 / 1.1))
    assert one(sky.frequency(sky.velocity(F.lit(1.3e9), 1.42e9, "Z"), 1.42e9, "Z"))[0] == pytest.approx(1.3e9)
    uvw = sky.rotate_uvw(F.lit(1.0), F.lit(2.0), F.lit(3.0), (0.1, 0.2), (0.1, 0.2))
    assert one(*uvw) == pytest.approx([1.0, 2.0, 3.0])


def test_measure_columns(spark):
    from skyquery.operators.measures import MeasureColumn

    frame = spark.createDataFrame([([1.0, 0.5], "J2000", 58000.0), ([1.0, 0.5], "GALACTIC", 58001.0), ([1.0, 0.5], "NONE", 58002.0)], "dir array<double>, ref string, t double")
    m = MeasureColumn("dir", "direction", frame_column="ref")
    assert MeasureColumn.from_json(m.to_json()) == m and MeasureColumn.of(m.attach(frame), "dir") == m
    got = frame.select(m.to("J2000").alias("x"), MeasureColumn("t", "epoch", "UTC", offset=1.0).to("TAI").alias("t")).collect()
    assert got[0].x == [1.0, 0.5] and got[1].x != [1.0, 0.5] and got[2].x is None
    assert got[0].t == pytest.approx(58001.0 + 37 / 86400)
    for bad in (("x", "nosuch", "J2000"), ("x", "epoch", "LAST"), ("x", "epoch")):
        with pytest.raises(ValueError):
            MeasureColumn(*bad)
