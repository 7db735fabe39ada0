"""Managed tables: statements that change them, keywords, locks; views; files; streams."""

import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyquery.functions.aggregates import ROWNR
from skyquery.operators import views
from skyquery.plans.lexer import QueryError
from skyquery.plans.statements import Session
from skyquery.sources import formats
from skyquery.sources import tables as managed
from skyquery.streaming import windows


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.fixture
def session(spark, tmp_path):
    s = Session(spark, {}, f"file://{tmp_path}/warehouse")
    s.sql("CREATE TABLE t (ID INT, NAME STRING, VALUE DOUBLE COMMENT='v', A DOUBLE NDIM=1 UNIT='m')")
    s.sql("INSERT INTO t (ID,NAME,VALUE) VALUES (1,'item_1',10.0),(2,'item_2',20.0),(3,'item_3',30.0),(4,'item_4',40.0),(5,'item_5',50.0)")
    return s


def test_changes(session):
    assert session.sql("UPDATE t SET VALUE = VALUE * 2, NAME = NAME + '!' WHERE ID >= 4").first()[0] == 2
    assert rows(session.sql("SELECT ID, VALUE, NAME FROM t WHERE ID > 2"), "ID") == [(3, 30.0, "item_3"), (4, 80.0, "item_4!"), (5, 100.0, "item_5!")]
    assert session.sql("DELETE FROM t WHERE ID > 1 LIMIT 2").first()[0] == 2
    assert rows(session.sql("SELECT ID, ROWNR() AS r FROM t"), "r") == [(1, 0), (4, 1), (5, 2)]
    session.sql("INSERT INTO t (ID, A) VALUES (8, [1,2,3])")
    session.sql("UPDATE t SET A[1] = 7 WHERE ID = 8")
    assert session.sql("SELECT A FROM t WHERE ID = 8").first()[0] == [1.0, 7.0, 3.0]
    session.sql("DELETE FROM t WHERE ID = 8")
    session.sql("INSERT INTO t SET ID = 9")
    assert rows(session.sql("SELECT ID, NAME, ROWNR() AS r FROM t WHERE ID = 9"), "r") == [(9, None, 3)]
    session.sql("INSERT INTO t (ID, VALUE) SELECT ID + 100, VALUE FROM t WHERE ID < 5")
    assert session.sql("COUNT FROM t").first()[0] == 6
    session.sql("ALTER TABLE t ADDROW 2")
    assert session.sql("COUNT FROM t WHERE ISNULL(ID)").first()[0] == 2
    session.sql("DELETE FROM t")
    assert session.sql("COUNT FROM t").first()[0] == 0


def test_columns_and_keywords(session, spark):
    session.sql("ALTER TABLE t SETKEY version = 3, SETKEY name = 'x'")
    assert session.sql("SELECT ::version AS v, t::name AS n FROM t LIMIT 1").first() == (3, "x")
    session.sql("ALTER TABLE t RENAMEKEY version TO v2 DROPKEY name")
    again = managed.Table.open(spark, session.warehouse, "t")
    assert again.keywords()["v2"] == 3 and "name" not in again.keywords()
    assert again.column_keywords("A")["unit"] == "m"
    session.sql("ALTER TABLE t ADD COLUMN N INT RENAME COLUMN NAME TO LABEL COPY COLUMN ID TO ID2 DROP COLUMN A")
    assert set(session.table("t").frame().columns) == {"ID", "LABEL", "VALUE", "N", "ID2", ROWNR}
    session.sql("CREATE TABLE LIKE t DROP COLUMN N AS u")
    assert session.sql("COUNT FROM u").first()[0] == 0 and "N" not in session.table("u").frame().columns
    assert managed.difference(session.table("t"), session.table("u"))
    session.sql("DROP TABLE u")
    with pytest.raises(QueryError):
        session.sql("COUNT FROM u")


@pytest.mark.parametrize("text", ["INSERT INTO t (ID, NAME) VALUES (1)", "INSERT INTO t (NOPE) VALUES (1)", "UPDATE t SET NOPE = 1", "CREATE TABLE t (A INT)", "CREATE TABLE u (A NOTYPE)", "ALTER TABLE t DROP COLUMN NOPE", "DROP TABLE nope", "DELETE FROM nope", "SHOW nothing"])
def test_refused(session, text):
    with pytest.raises(QueryError):
        session.sql(text)


def test_cells_locks_and_paths(session, spark):
    t = session.table("t")
    t.put_cells("VALUE", {0: 1.5, 3: 2.5})
    assert t.cell("VALUE", 3) == 2.5 and t.row(1)["VALUE"] == 20.0
    t.remove_rows([0, 2])
    assert [r[0] for r in t.frame().orderBy(ROWNR).select("ID").collect()] == [2, 4, 5]
    assert t.lock("me") and not t.lock("you") and t.is_locked()
    with pytest.raises(QueryError):
        t.drop()
    t.unlock()
    assert not t.is_locked()
    t.set_info("measurements", "raw")
    assert managed.Table.open(spark, session.warehouse, "t").info() == {"type": "measurements", "subtype": "raw"}
    with pytest.raises(QueryError):
        managed.Table.create(spark, session.warehouse, "../outside", T.StructType([]))
    session.sql("SELECT ID FROM t GIVING picked")
    assert session.sql("COUNT FROM picked").first()[0] == 3


@pytest.fixture(scope="module")
def iter_table(spark):
    return managed.by_key(spark.createDataFrame([(i, f, s) for i, (f, s) in enumerate(zip([0, 1, 0, 0, 1, 1, 0, 1], [1, 1, 2, 1, 2, 1, 2, 2], strict=True))], "i int, FIELD_ID int, SCAN int"), F.col("i")).drop("i")


def test_views(spark, iter_table):
    assert [tuple(r) for r in views.groups(iter_table, ["FIELD_ID", "SCAN"]).collect()] == [(0, 1, [0, 3]), (0, 2, [2, 6]), (1, 1, [1, 5]), (1, 2, [4, 7])]
    assert [(k["SCAN"], part.count()) for k, part in views.iterate(iter_table, ["SCAN"])] == [(1, 4), (2, 4)]
    with pytest.raises(ValueError):
        views.groups(iter_table, [])
    picked = views.rows_view(iter_table, [5, 2, 5])
    assert rows(picked.select("_base", ROWNR), ROWNR) == [(5, 0), (2, 1), (5, 2)]
    assert views.mask_view(iter_table, F.col("SCAN") == 2).count() == 4
    both = views.concatenate([iter_table, iter_table.filter("SCAN = 1")])
    assert both.count() == 12 and both.agg(F.max(ROWNR)).first()[0] >= 11
    with pytest.raises(ValueError):
        views.concatenate([])
    index = views.ColumnsIndex(iter_table, ["FIELD_ID", "SCAN"])
    assert [r[0] for r in index.rows(FIELD_ID=0, SCAN=1).collect()] == [0, 3] and index.unique_keys() == 4
    assert index.contains(FIELD_ID=1, SCAN=2) and not index.contains(FIELD_ID=9, SCAN=2)
    with pytest.raises(KeyError):
        index.row(FIELD_ID=0, SCAN=1)
    with pytest.raises(KeyError):
        index.row(FIELD_ID=7, SCAN=1)
    assert index.lookup(spark.createDataFrame([(0, 2)], "FIELD_ID int, SCAN int")).count() == 2


def test_row_numbers_have_no_gaps(spark, tmp_path):
    spark.range(0, 1000, 1, 7).write.parquet(f"{tmp_path}/x")
    got = managed.numbered(spark.read.parquet(f"{tmp_path}/x"))
    assert sorted(r[0] for r in got.select(ROWNR).collect()) == list(range(1000))


def test_row_numbers_of_shuffled_rows(spark):
    """Partitions that are laid out anew at run time neither lose a number nor give one twice."""
    mixed = spark.range(0, 5000, 1, 7).withColumn("k", F.col("id") % 13).repartition(29, "k").join(spark.range(13).withColumnRenamed("id", "k"), "k")
    got = managed.numbered(mixed)
    assert sorted(r[0] for r in got.select(ROWNR).collect()) == list(range(5000))
    assert got.filter("k = 3").agg(F.countDistinct(ROWNR)).first()[0] == mixed.filter("k = 3").count()
    ordered = managed.numbered(spark.range(0, 1000, 1, 5).orderBy(F.col("id").desc()))
    assert ordered.filter(F.col(ROWNR) + F.col("id") != 999).count() == 0
    assert managed.numbered(mixed.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["parquet", "orc", "csv", "json"])
def test_files(spark, tmp_path, kind):
    frame = spark.createDataFrame([(1, "a"), (2, None)], "x long, s string")
    formats.write(frame, f"{tmp_path}/f", kind)
    assert rows(formats.read(spark, f"{tmp_path}/f", kind, "x long, s string"), "x") == [(1, "a"), (2, None)]
    with pytest.raises(ValueError):
        formats.read(spark, "x", "nosuch")


def test_records():
    record = {"a": 1, "b": [1.5, "x"], "c": {"d": True, "z": 1 + 2j}}
    assert formats.record_from_json(formats.record_to_json(record)) == record
    schema = formats.schema_from_text("TIME double unit=s # when\nDATA complex 2-D\nnonsense line here to skip")
    assert schema.fieldNames() == ["TIME", "DATA"] and schema["TIME"].metadata["unit"] == "s"


def test_joins_on_ranges(spark):
    left = spark.createDataFrame([(1, 5.0), (1, 9.0), (2, 1.0)], "k int, t double")
    right = spark.createDataFrame([(1, 4.0, "a"), (1, 5.0, "b"), (1, 8.0, "c"), (2, 3.0, "d")], "k int, t double, v string")
    assert rows(views.as_of_join(left, right, ["k"], "t", "t", ["v"]), "k", "t") == [(1, 5.0, "b"), (1, 9.0, "c"), (2, 1.0, None)]
    spans = spark.createDataFrame([("p", 0.0, 6.0), ("q", 5.0, 20.0)], "n string, lo double, hi double")
    assert rows(views.range_join(left.select("t"), spans, "t", "lo", "hi", 4.0).select("t", "n"), "t", "n") == [(1.0, "p"), (5.0, "p"), (5.0, "q"), (9.0, "q")]


def _pairs_of(frame, *cols):
    return sorted(tuple(r) for r in frame.select(*cols).collect())


@pytest.mark.parametrize("bucket", [None, 10.0, 1000.0])
def test_as_of_of_hot_and_null_keys(spark, bucket):
    rng = random.Random(3)
    key = lambda: rng.choice([1, 1, 1, 1, 2, 3, None])
    when = lambda: rng.choice([None, *[x / 2 for x in range(400)]])
    left = [(i, key(), when()) for i in range(300)]
    right = [(key(), t, f"v{i}") for i, t in enumerate(rng.sample([x / 2 for x in range(400)], 60))] + [(1, None, "never")]
    cut = (lambda t: F.floor(t / bucket)) if bucket else None
    got = views.as_of_join(spark.createDataFrame(left, "i int, k int, t double"), spark.createDataFrame(right, "k int, s double, v string"), ["k"], "t", "s", ["v"], cut)
    best = lambda k, t: max(((s, v) for q, s, v in right if None not in (k, t, s) and q == k and s <= t), default=(0, None))[1]
    assert {r.i: r.v for r in got.collect()} == {i: best(k, t) for i, k, t in left}
    rows_ = [(i, key(), rng.choice([None, None, None, float(i)])) for i in range(300)]
    got = views.carried_forward(spark.createDataFrame(rows_, "i int, k int, v double"), ["v"], ["i"], ["k"], F.floor(F.col("i") / bucket) if bucket else None)
    assert got.columns == ["i", "k", "v"]
    assert {r.i: r.v for r in got.collect()} == {i: next((w for j, q, w in reversed(rows_) if j <= i and q == k and w is not None), None) for i, k, _ in rows_}


def test_range_join_of_long_and_endless_spans(spark):
    rng = random.Random(4)
    points = [rng.uniform(-500, 500) for _ in range(200)] + [0.0, 8.0, float("inf"), None]
    spans = [(i, a, a + rng.choice([0.0, 1.0, 4.0, 9.0, 100.0, 800.0])) for i, a in enumerate(rng.uniform(-500, 500) for _ in range(80))] + [(100, float("-inf"), 3.0), (101, 5.0, float("inf")), (102, 9.0, 8.0), (103, None, 1.0), (104, 0.0, 8.0), (105, -1e300, 1e300)]
    left, right = spark.createDataFrame([(x,) for x in points], "x double"), spark.createDataFrame(spans, "n int, lo double, hi double")
    got = views.range_join(left, right, "x", "lo", "hi", 4.0)
    assert got.columns == ["x", "n", "lo", "hi"]
    assert _pairs_of(got, "n", "x") == sorted((n, x) for x in points for n, a, b in spans if None not in (x, a, b) and a <= x <= b)
    assert views.range_join(left, right.limit(0), "x", "lo", "hi", 4.0).count() == 0


def test_cone_join_over_the_whole_sky(spark):
    rng = random.Random(5)
    half = math.pi / 2
    at = [(i, rng.uniform(-7, 14), rng.choice([rng.uniform(-half, half), half - 0.01, -half, 0.03 * rng.random()])) for i in range(600)] + [(600, None, 0.0), (601, 0.0, None)]
    cones = [(i, rng.uniform(-7, 7), rng.choice([rng.uniform(-half, half), half, -half + 0.02]), rng.choice([0.05, 0.2, 0.0, 2.0])) for i in range(60)] + [(60, at[0][1], at[0][2], 0.001)]
    got = views.cone_join(spark.createDataFrame(at, "p int, lon double, lat double"), spark.createDataFrame(cones, "c int, clon double, clat double, r double"), "lon", "lat", "clon", "clat", "r", 0.2)
    far = lambda a, b, c, d: math.acos(max(-1.0, min(1.0, math.sin(b) * math.sin(d) + math.cos(b) * math.cos(d) * math.cos(a - c))))
    expected = [(c, p) for p, a, b in at for c, x, y, r in cones if a is not None and b is not None and r > 0 and far(a, b, x, y) <= r]
    assert len(expected) > 500 and _pairs_of(got.filter("r > 0"), "c", "p") == sorted(expected)


def test_group_sizes_and_rows(spark, iter_table):
    assert [tuple(r) for r in views.group_sizes(iter_table, ["FIELD_ID", "SCAN"]).collect()] == [(0, 1, 2, 0, 3), (0, 2, 2, 2, 6), (1, 1, 2, 1, 5), (1, 2, 2, 4, 7)]
    assert [tuple(r) for r in views.group_rows(iter_table, ["SCAN"]).collect()] == [(1, 0), (1, 1), (1, 3), (1, 5), (2, 2), (2, 4), (2, 6), (2, 7)]


def test_streams(spark, tmp_path):
    schema = "k string, ts timestamp, v double"
    frame = spark.sql("SELECT * FROM VALUES ('a', TIMESTAMP'2024-01-01 00:00:05', 1.0D), ('a', TIMESTAMP'2024-01-01 00:00:09', 2.0D), ('b', TIMESTAMP'2024-01-01 00:00:31', 4.0D) t(k, ts, v)")
    frame.write.parquet(f"{tmp_path}/in")
    total = [F.sum("v").alias("v")]
    batch = rows(windows.tumbling(frame, "ts", "10 seconds", total), "window_start")
    stream = windows.tumbling(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "ts", "10 seconds", total, late="5 seconds")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("w").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("w"), "window_start") == batch and [r[2] for r in batch] == [3.0, 4.0]
    assert windows.sessions(frame, "ts", "10 seconds", total, keys=["k"]).count() == 2
    assert windows.first_seen(frame, "k", "ts", "1 minute").count() == 2


def test_two_handles_lose_nothing(spark, tmp_path):
    """A handle that was opened before a change sees it and keeps it; of two changes from one version the second is refused."""
    warehouse = f"file://{tmp_path}/w"
    first = managed.Table.save(spark.range(3).select(F.col("id").alias("a")), warehouse, "t")
    second = managed.Table.open(spark, warehouse, "t")
    first.add_rows(2)
    second.set_keyword("k", 1)
    assert first.count() == second.count() == second.frame().count() == 5 and first.keyword("k") == 1
    mine, theirs = first.frame(), second.frame()
    first.replace(mine.withColumn("a", F.lit(7).cast("long")))
    with pytest.raises(QueryError):
        second.replace(theirs.withColumn("a", F.lit(8).cast("long")))
    # the version before is still there for those who read it
    assert theirs.count() == 5 and {r.a for r in second.frame().collect()} == {7} and second.keyword("k") == 1
    second.set_column_keyword("a", "unit", "m")
    second.add_rows(1)
    assert first.count() == 6 and first.column_keywords("a") == {"unit": "m"}


def test_drop_of_several_tables_is_all_or_nothing(session):
    session.sql("CREATE TABLE u (A INT)")
    session.table("u").lock("me")
    with pytest.raises(QueryError):
        session.sql("DROP TABLE t, u")
    assert session.sql("COUNT FROM t").first()[0] == 5
    session.table("u").unlock()
    session.sql("DROP TABLE t, u")


def test_many_values_in_one_statement(session):
    session.sql("INSERT INTO t (ID) VALUES " + ",".join(f"({i})" for i in range(100, 1100)))
    assert session.sql("SELECT gcount() AS n, gsum(ID) AS s FROM t WHERE ID >= 100").first() == (1000, float(sum(range(100, 1100))))
