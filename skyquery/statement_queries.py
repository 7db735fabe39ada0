"""Registered queries of the statements that change tables: each makes managed tables of its input, changes them, and reads them back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.statements import Session
from .queries import query, rounded, table
from .sources.tables import Table, by_key, difference, shared_folder


def workspace(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; on a single machine where none is set a temporary one will do."""
    return f"{shared_folder(spark)}/skyquery-tables-{uuid.uuid4().hex}"


#: Row numbers of the tables that are changed.
KEYS = {"part": "p_partkey", "nation": "n_nationkey", "embeddings": "vec_id", "region": "r_regionkey", "supplier": "s_suppkey"}


def session(spark: SparkSession, sf_dir: str, *names: str) -> Session:
    """A session with managed tables that are copies of the named ones."""
    made = Session(spark, {}, workspace(spark))
    for name in names:
        made.add(name, Table.save(by_key(table(spark, sf_dir, name), F.col(KEYS[name])), made.warehouse, name))
    return made


def changed(name: str, tables: str, *statements: str, sql: str, digits: int = 4) -> None:
    """Registers a query that runs the statements, of which the last one reads."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = session(spark, sf_dir, *tables.split())
        for text in statements[:-1]:
            s.sql(text)
        return rounded(s.sql(statements[-1]), digits)

    query(name, sql)(run)


_PART = "p_partkey, p_brand, p_size, p_retailprice"
changed("update_where", "part", "UPDATE part SET p_size = p_size + 100, p_brand = p_brand + '!' WHERE p_retailprice > 1200", f"SELECT {_PART} FROM part",
        sql="SELECT p_partkey, CASE WHEN p_retailprice > 1200 THEN p_brand || '!' ELSE p_brand END AS p_brand, CAST(CASE WHEN p_retailprice > 1200 THEN p_size + 100 ELSE p_size END AS BIGINT) AS p_size, round(p_retailprice,4) AS p_retailprice FROM part")
changed("update_count", "part", "UPDATE part SET p_size = 0 WHERE p_size < 10", sql="SELECT count(*) AS n_rows FROM part WHERE p_size < 10")
changed("update_order_limit", "part", "UPDATE part SET p_size = -1 ORDERBY p_retailprice DESC, p_partkey LIMIT 20", "SELECT p_partkey FROM part WHERE p_size = -1", sql="SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
changed("update_element", "embeddings", "UPDATE embeddings SET embedding[1] = 7 WHERE vec_id % 3 = 0", "SELECT vec_id, embedding[0] AS a, embedding[1] AS b FROM embeddings",
        sql="SELECT vec_id, round(CAST(embedding[1] AS DOUBLE),4) AS a, round(CASE WHEN vec_id % 3 = 0 THEN 7.0 ELSE CAST(embedding[2] AS DOUBLE) END,4) AS b FROM embeddings")
changed("insert_values", "nation", "INSERT INTO nation (n_nationkey, n_name) VALUES (100, 'one'), (101, 'two' + '!'), (102, 'three')", "SELECT ROWNR() AS r, n_nationkey, n_name, ISNULL(n_regionkey) AS empty FROM nation",
        sql="SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS BIGINT) AS r, CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, empty FROM (SELECT n_nationkey, n_name, n_regionkey IS NULL AS empty FROM nation UNION ALL VALUES (100, 'one', true), (101, 'two!', true), (102, 'three', true))")
changed("insert_set", "nation", "INSERT INTO nation SET n_nationkey = 77, n_name = 'set'", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey > 20", sql="SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation WHERE n_nationkey > 20 UNION ALL SELECT 77, 'set'")
changed("insert_select", "nation region", "INSERT INTO nation (n_nationkey, n_name) SELECT r_regionkey + 50, r_name FROM region WHERE r_regionkey > 1", "SELECT n_nationkey, n_name FROM nation",
        sql="SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation UNION ALL SELECT r_regionkey + 50, r_name FROM region WHERE r_regionkey > 1")
changed("delete_where", "part", "DELETE FROM part WHERE p_size > 20", "SELECT ROWNR() AS r, p_partkey FROM part", sql="SELECT CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS BIGINT) AS r, p_partkey FROM part WHERE NOT p_size > 20")
changed("delete_limit", "part", "DELETE FROM part WHERE p_size > 20 LIMIT 30", "COUNT FROM part", sql="SELECT count(*) - least(30, count(*) FILTER (WHERE p_size > 20)) AS n_rows FROM part")
changed("create_table", "region", "CREATE TABLE made (ID INT, NAME STRING, VALUE DOUBLE)", "INSERT INTO made SELECT r_regionkey, r_name, r_regionkey / 4.0 FROM region", "SELECT ID, NAME, VALUE FROM made",
        sql="SELECT CAST(r_regionkey AS BIGINT) AS ID, r_name AS NAME, round(r_regionkey/4.0,4)::DOUBLE AS VALUE FROM region")
changed("create_like", "nation", "CREATE TABLE LIKE nation DROP COLUMN n_regionkey AS bare", "INSERT INTO bare (n_nationkey, n_name) SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 3", "SELECT * FROM bare",
        sql="SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 3")
changed("alter_addrow", "nation", "ALTER TABLE nation ADDROW 4", "SELECT ROWNR() AS r, n_name FROM nation WHERE ROWNR() > 20", sql="SELECT CAST(r AS BIGINT) AS r, n_name FROM (SELECT unnest(range(21, 29)) AS r) LEFT JOIN nation ON n_nationkey = r")
changed("alter_keywords", "region", "ALTER TABLE region SETKEY version = 3, SETKEY old = 'x'", "ALTER TABLE region RENAMEKEY old TO fresh", "ALTER TABLE region SETKEY gone = 1", "ALTER TABLE region DROPKEY gone", "SELECT r_name, ::version AS v, region::fresh AS f FROM region",
        sql="SELECT r_name, CAST(3 AS BIGINT) AS v, 'x' AS f FROM region")
changed("alter_columns", "nation", "ALTER TABLE nation ADD COLUMN n_extra INT RENAME COLUMN n_name TO n_label COPY COLUMN n_nationkey TO n_copy DROP COLUMN n_regionkey", "SELECT * FROM nation",
        sql="SELECT n_nationkey, n_name AS n_label, CAST(NULL AS INTEGER) AS n_extra, n_nationkey AS n_copy FROM nation")
changed("giving_table", "part", "SELECT p_partkey, p_size FROM part WHERE p_size > 40 GIVING picked", "SELECT gcount() AS n, gsum(p_size) AS s FROM picked", sql="SELECT count(*) AS n, CAST(sum(p_size) AS DOUBLE) AS s FROM part WHERE p_size > 40")


@query("drop_tables", "SELECT CAST(2 AS BIGINT) AS dropped, false AS left_over")
def _drop(spark, sf_dir):
    s = session(spark, sf_dir, "nation", "region")
    dropped = s.sql("DROP TABLE nation, region").first()[0]
    from .sources.tables import exists

    return spark.range(1).select(F.lit(dropped).cast("long").alias("dropped"), F.lit(exists(spark, s.warehouse, "nation") or exists(spark, s.warehouse, "region")).alias("left_over"))


@query("table_cells", "SELECT (SELECT n_name FROM nation WHERE n_nationkey = 3) AS cell, (SELECT CAST(count(*) AS BIGINT) + 2 FROM nation) AS n, 'put' AS written, CAST(1 AS BIGINT) AS differences")
def _cells(spark, sf_dir):
    """Cells read and written, rows added and removed, tables compared."""
    s = session(spark, sf_dir, "nation")
    t = s.table("nation")
    cell = t.cell("n_name", 3)
    t.put_cells("n_name", {5: "put"})
    written = t.cell("n_name", 5)
    other = Table.save(t.frame(), s.warehouse, "other")
    t.add_rows(3)
    t.remove_rows([0])
    return spark.range(1).select(F.lit(cell).alias("cell"), F.lit(t.count()).cast("long").alias("n"), F.lit(written).alias("written"), F.lit(len(difference(t, other))).cast("long").alias("differences"))


@query("table_locks", "SELECT true AS taken, false AS again, true AS held, false AS after")
def _locks(spark, sf_dir):
    t = session(spark, sf_dir, "region").table("region")
    taken, again, held = t.lock("a"), t.lock("b"), t.is_locked()
    t.unlock()
    return spark.range(1).select(*[F.lit(v).alias(n) for n, v in (("taken", taken), ("again", again), ("held", held), ("after", t.is_locked()))])


@query("table_info", "SELECT 'Measurement' AS kind, 'sub' AS subtype, 'm' AS unit, count(*) AS n FROM supplier")
def _info(spark, sf_dir):
    s = session(spark, sf_dir, "supplier")
    t = s.table("supplier")
    t.set_info("Measurement", "sub")
    t.set_column_keyword("s_acctbal", "unit", "m")
    again = Table.open(spark, s.warehouse, "supplier")
    return spark.range(1).select(F.lit(again.info()["type"]).alias("kind"), F.lit(again.info()["subtype"]).alias("subtype"), F.lit(again.column_keywords("s_acctbal")["unit"]).alias("unit"), F.lit(again.count()).cast("long").alias("n"))
