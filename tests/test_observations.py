"""Observation datasets: selection, chunks, flags, merging, checking."""

import pytest
from pyspark.sql import functions as F

from skyquery.functions.aggregates import ROWNR
from skyquery.operators.observations.dataset import Observation, Writer, add_history, concatenate, to_stokes
from skyquery.operators.observations.schema import MAIN, REQUIRED, SUBTABLES
from skyquery.operators.observations.selection import Selection, SelectionError
from skyquery.plans.statements import Session

T0 = 4.8e9
ROWS = [
    (0, 1, 0, 0, 1, 0, 0, (100, 200, 50)), (0, 2, 0, 0, 1, 0, 0, (300, 400, 100)), (1, 2, 0, 0, 1, 0, 0, (200, 100, 30)), (0, 3, 0, 1, 1, 0, 0, (500, 600, 150)), (0, 1, 1, 0, 2, 1, 100, (110, 210, 55)),
    (0, 2, 1, 0, 2, 1, 100, (310, 410, 105)), (1, 3, 1, 1, 2, 1, 100, (400, 300, 80)), (2, 3, 0, 0, 1, 0, 50, (50, 30, 10)), (0, 1, 0, 0, 1, 0, 50, (10, 10, 5)), (0, 1, 1, 1, 2, 1, 200, (800, 900, 200)),
]


@pytest.fixture(scope="module")
def o(spark):
    w = Writer(spark)
    for i in range(4):
        w.add("ANTENNA", NAME=f"ANT{i}", STATION=f"PAD{i}", DISH_DIAMETER=25.0)
    for name in ("3C273", "M31"):
        w.add("FIELD", NAME=name)
    for i, (n, f) in enumerate(((64, 1.4e9), (128, 3.0e9))):
        w.add("SPECTRAL_WINDOW", NAME=f"SPW{i}", NUM_CHAN=n, REF_FREQUENCY=f)
        w.add("DATA_DESCRIPTION", SPECTRAL_WINDOW_ID=i, POLARIZATION_ID=0)
    w.add("POLARIZATION", NUM_CORR=2, CORR_TYPE=[5, 8])
    w.add("OBSERVATION", TELESCOPE_NAME="VLA", OBSERVER="x")
    for mode in ("OBSERVE_TARGET.ON_SOURCE", "CALIBRATE_BANDPASS.ON_SOURCE"):
        w.add("STATE", OBS_MODE=mode)
    for a1, a2, field, dd, scan, state, t, uvw in ROWS:
        w.add("MAIN", ANTENNA1=a1, ANTENNA2=a2, FIELD_ID=field, DATA_DESC_ID=dd, SCAN_NUMBER=scan, STATE_ID=state, TIME=T0 + t, UVW=[float(x) for x in uvw], ARRAY_ID=0, FEED1=0, FEED2=0, OBSERVATION_ID=0, FLAG_ROW=False)
    return w.write()


@pytest.mark.parametrize(
    "given, expected",
    [
        ({"antenna": "0"}, [0, 1, 3, 4, 5, 8, 9]), ({"antenna": "ANT1&ANT2"}, [2]), ({"antenna": "!ANT0"}, [2, 6, 7]), ({"antenna": "0~1&&"}, None), ({"antenna": "0&*"}, [0, 1, 3, 4, 5, 8, 9]), ({"antenna": "ANT[12]&ANT3"}, [6, 7]), ({"antenna": "1&&&"}, []),
        ({"field": "M31"}, [4, 5, 6, 9]), ({"field": "3C*"}, [0, 1, 2, 3, 7, 8]), ({"field": "<1"}, [0, 1, 2, 3, 7, 8]), ({"field": "!0"}, [4, 5, 6, 9]), ({"spw": "1"}, [3, 6, 9]), ({"spw": "SPW0:0~10^2;20"}, [0, 1, 2, 4, 5, 7, 8]), ({"spw": "1.0~2.0GHz"}, [0, 1, 2, 4, 5, 7, 8]), ({"spw": "*"}, list(range(10))),
        ({"scan": "2"}, [4, 5, 6, 9]), ({"scan": "1~2"}, list(range(10))), ({"scan": ">1"}, [4, 5, 6, 9]), ({"time": f">{T0 + 60}"}, [4, 5, 6, 9]), ({"time": f"{T0 + 40}~{T0 + 110}"}, [4, 5, 6, 7, 8]), ({"uvdist": ">1km"}, [9]), ({"uvdist": "0~100"}, [7, 8]), ({"uvdist": "<100m"}, [7, 8]),
        ({"state": "1"}, [4, 5, 6, 9]), ({"state": "*TARGET*"}, [0, 1, 2, 3, 7, 8]), ({"observation": "0"}, list(range(10))), ({"array": ">0"}, []), ({"feed": "0&&&"}, list(range(10))), ({"feed": "0&"}, []), ({"correlation": "RR,LL"}, list(range(10))),
        ({"expr": "ANTENNA1 = 0 AND SCAN_NUMBER = 2"}, [4, 5, 9]), ({"antenna": "0", "scan": "2", "spw": "0"}, [4, 5]), ({}, list(range(10))),
    ],
)
def test_selection(o, given, expected):
    if expected is None:
        with pytest.raises(SelectionError):
            Selection(**given).row_numbers(o)
    else:
        assert sorted(r[0] for r in Selection(**given).row_numbers(o).collect()) == expected
        where = Selection(**given).where(o)
        got = Session(o.rows.sparkSession, {"main": o.rows}).sql("SELECT ROWNR() AS r FROM main" + (f" WHERE {where}" if where else ""))
        assert sorted(r[0] for r in got.collect()) == expected


@pytest.mark.parametrize("given", [{"antenna": "-1"}, {"antenna": "NOPE"}, {"antenna": "0&"}, {"antenna": "0&&&1"}, {"field": "1~0"}, {"scan": "x"}, {"time": "5"}, {"time": ">2024/13/01"}, {"uvdist": "5x"}, {"state": "OBSERVE"}, {"spw": "0:x"}, {"expr": "NOPE = 1"}, {"antenna": "0,,1"}])
def test_selection_errors(o, given):
    with pytest.raises(Exception):  # noqa: B017
        Selection(**given).row_numbers(o).collect()
    got = Selection(**given, collect_errors=True).evaluate(o)
    assert len(got.errors) == 1 and got.rows.count() == 10


def test_selected_ids(o):
    got = Selection(antenna="ANT0&ANT1", spw="0:3~7", correlation="RR").evaluate(o)
    assert got.ids["antenna"] == [0, 1] and got.channels == [(0, 3, 7)] and got.ids["correlation"] == ["RR"]
    s = Selection(scan="1")
    assert s.has_selection()
    s.clear()
    assert not s.has_selection()


def test_chunks_flags_summary(o):
    assert [(r.FIELD_ID, r.DATA_DESC_ID, r.rows) for r in o.chunks().collect()] == [(0, 0, [0, 1, 2, 7, 8]), (0, 1, [3]), (1, 0, [4, 5]), (1, 1, [6, 9])]
    assert [(r.bin, r.centre - T0, len(r.rows)) for r in o.time_chunks(60.0).collect()] == [(0, 30.0, 6), (1, 90.0, 3), (3, 210.0, 1)]
    with pytest.raises(ValueError):
        o.time_chunks(0)
    flagged = o.flagged([0, 3, 99])
    assert flagged.flag_stats().first() == (10, 2) and flagged.flagged([0], False).flag_stats().first() == (10, 1)
    m = o.metadata()
    assert m["rows"] == 10 and m["SCAN_NUMBER"] == [1, 2] and [a["NAME"] for a in m["antennas"]] == ["ANT0", "ANT1", "ANT2", "ANT3"]
    assert "3C273, M31" in o.summary()
    assert add_history(add_history(o, "one"), "two").sub["HISTORY"].count() == 2


def test_references(spark, o):
    o.validate()
    bad = Observation(o.rows.withColumn("FIELD_ID", F.col("FIELD_ID") + 1), o.sub)
    assert len(bad.violations()) == 1
    with pytest.raises(ValueError):
        bad.validate()
    w = Writer(spark)
    w.add("MAIN", ANTENNA1=0, ANTENNA2=5)
    with pytest.raises(ValueError, match="ANTENNA1.*ANTENNA2"):
        w.write()
    with pytest.raises(ValueError):
        w.add("MAIN", NOPE=1)


def test_concatenate(spark):
    def make(antennas, fields, pairs):
        w = Writer(spark)
        for n in antennas:
            w.add("ANTENNA", NAME=n)
        for n in fields:
            w.add("FIELD", NAME=n)
        w.add("SPECTRAL_WINDOW", NAME="L-band", NUM_CHAN=4, REF_FREQUENCY=1e9)
        w.add("POLARIZATION", NUM_CORR=1, CORR_TYPE=[5])
        w.add("DATA_DESCRIPTION", SPECTRAL_WINDOW_ID=0, POLARIZATION_ID=0)
        w.add("OBSERVATION", TELESCOPE_NAME="T")
        w.add("STATE", OBS_MODE="M")
        for a1, a2, f in pairs:
            w.add("MAIN", ANTENNA1=a1, ANTENNA2=a2, FIELD_ID=f, DATA_DESC_ID=0, OBSERVATION_ID=0, STATE_ID=0, TIME=0.0)
        return w.write()

    both = concatenate(make(["ANT0", "ANT1"], ["3C273"], [(0, 1, 0)]), make(["ANT0", "ANT2"], ["3C273", "M31"], [(0, 1, 1), (1, 0, 0)]))
    both.validate()
    named = [(r.ANTENNA1_NAME, r.ANTENNA2_NAME, r.FIELD_NAME) for r in both.with_dimensions().orderBy(ROWNR).collect()]
    assert named == [("ANT0", "ANT1", "3C273"), ("ANT0", "ANT2", "M31"), ("ANT2", "ANT0", "3C273")]
    assert both.sub["ANTENNA"].count() == 3 and both.sub["FIELD"].count() == 2 and both.sub["SPECTRAL_WINDOW"].count() == 1 and both.sub["DATA_DESCRIPTION"].count() == 1 and both.sub["OBSERVATION"].count() == 2


def test_stokes(spark):
    data = F.array(*[F.struct(F.lit(re).alias("re"), F.lit(im).alias("im")) for re, im in ((3.0, 0.0), (1.0, 2.0), (1.0, -2.0), (1.0, 0.0))])
    got = spark.range(1).select(to_stokes(data, ["RR", "RL", "LR", "LL"], ["I", "Q", "U", "V", "RR", "XX"]).alias("x")).first().x
    assert [(z.re, z.im) for z in got] == [(2.0, 0.0), (1.0, 0.0), (2.0, 0.0), (1.0, 0.0), (3.0, 0.0), (0.0, 0.0)]


def test_storage_and_schema(spark, o, tmp_path):
    o.save(f"file://{tmp_path}", "ms")
    back = Observation.open(spark, f"file://{tmp_path}", "ms")
    assert back.main.count() == 10 and set(back.sub) == set(o.sub)
    assert len(MAIN.fields) == 29 and len(SUBTABLES) == 17 and set(REQUIRED) <= set(SUBTABLES)
    assert Observation.create(spark).main.count() == 0
