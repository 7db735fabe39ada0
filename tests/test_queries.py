"""The registered queries against their SQL in DuckDB, at the smallest scale."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__
from skyquery import queries as library

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{data}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return str([plain(x) for x in v])
    if v is None or v is pd.NA or v is pd.NaT:
        return "null"
    if isinstance(v, (float, np.floating)):
        return "null" if np.isnan(v) else f"{v + 0.0:.5f}"
    if isinstance(v, (int, np.integer)) and not isinstance(v, (bool, np.bool_)):
        return f"{float(v):.5f}"
    return str(v)


def shown(frame):
    cols = sorted(frame.columns)
    return cols, sorted(str([plain(v) for v in x]) for x in frame[cols].itertuples(index=False))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(library.oracle_sql()))
def test_query(spark, con, data, name):
    assert shown(library.queries()[name](spark, data).toPandas()) == shown(con.execute(library.oracle_sql()[name]).df())


def test_region_world_with_ids_around_the_sphere(spark, tmp_path):
    """Rows past a quarter turn of latitude, upwards and downwards, are not on the map; some would come round to the box again."""
    ids = [*range(-700, 1400), 1400, 50_000, None]
    vectors = pd.DataFrame({"vec_id": pd.array(ids, "Int64"), "embedding": [[0.5] * 64] * len(ids), "label": 0})
    spark.createDataFrame([(i, [0.5] * 64, 0) for i in ids], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    c = duckdb.connect()
    c.register("embeddings", vectors)
    assert shown(library.queries()["region_world"](spark, str(tmp_path)).toPandas()) == shown(c.execute(library.oracle_sql()["region_world"]).df())


def test_every_query_has_sql():
    assert set(library.queries()) == set(library.oracle_sql())
