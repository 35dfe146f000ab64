import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", "file://" + str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return DATA


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


def plain(x):
    """A value in a form that both engines share."""
    import math

    import pandas as pd

    if x is pd.NA or x is None or x != x if not hasattr(x, "__len__") else False:
        return "NULL"
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return str([plain(v) for v in x])
    if isinstance(x, bool):
        return str(x)
    if type(x).__name__ in ("float", "Decimal"):
        return "NULL" if math.isnan(x) else repr(round(float(x), 5) + 0.0)
    return str(x)


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted(tuple(map(plain, r)) for r in frame[cols].itertuples(index=False))


def same_as_sql(df, duck, sql):
    a, b = rows(df.toPandas()), rows(duck.sql(sql).df())
    assert a[0] == b[0]
    assert len(a[1]) == len(b[1])
    assert a[1] == b[1]
