import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(shared))
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    return SF


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}"
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    return con


def assert_same(got, expected):
    """Two pandas frames with the same rows in any order."""
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    whole = lambda d: d[columns].convert_dtypes()  # whole numbers beside nulls are floats in one of them
    text = lambda d: whole(d).astype(str).sort_values(columns).reset_index(drop=True)
    a, b = text(got), text(expected)
    assert len(a) == len(b)
    assert (a == b).all().all(), (a[(a != b).any(axis=1)].head(), b[(a != b).any(axis=1)].head())
