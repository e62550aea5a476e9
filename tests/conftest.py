import math
import os

import duckdb
import pytest
from pyspark.sql import SparkSession

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    os.environ["TZ"] = "UTC"
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "America/New_York").config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


def _plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def rows_of(df):
    names = sorted(df.columns)
    return sorted((tuple(_plain(r[c]) for c in names) for r in df.collect()), key=repr)


def oracle_rows(sql, sf=SF, tables=None):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, frame in (tables or {}).items():
        con.execute(f"DROP VIEW IF EXISTS {name}")
        con.register(name, frame)
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = [names.index(c) for c in sorted(names)]
    return sorted((tuple(_plain(r[i]) for i in order) for r in got.fetchall()), key=repr)


@pytest.fixture(scope="session")
def same():
    def check(df, sql, **kw):
        assert rows_of(df) == oracle_rows(sql, **kw)

    return check
