import os
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    base = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{base}/checkpoint")
        .config("spark.sql.warehouse.dir", f"{base}/warehouse")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SMALL


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if value != value else round(value, 6)
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return float(value) if type(value).__name__ == "Decimal" else value


def rows_of(df):
    return sorted(repr([plain(v) for v in r]) for r in df.select(*sorted(df.columns)).collect())


@pytest.fixture(scope="session")
def same_as_sql(spark, duck, sf_dir):
    def compare(query, sql):
        found = query(spark, sf_dir)
        wanted = duck.sql(sql)
        assert sorted(found.columns) == sorted(wanted.columns)
        order = sorted(range(len(wanted.columns)), key=lambda i: wanted.columns[i])
        assert rows_of(found) == sorted(repr([plain(r[i]) for i in order]) for r in wanted.fetchall())

    return compare
