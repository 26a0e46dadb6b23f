import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH", "")]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def same_rows(got, want):
    """Both pandas frames hold the same rows, whatever their order and that of the columns."""
    import numpy as np
    import pandas as pd

    def cell(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and np.isnan(x)):
            return None
        if isinstance(x, (bool, np.bool_)):
            return int(x)
        return round(float(x), 9) if isinstance(x, (int, float, np.integer, np.floating)) else str(x)

    def rows(df):
        return sorted(repr([cell(x) for x in r]) for r in df[sorted(df.columns)].itertuples(index=False))

    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.fixture(scope="session")
def duck():
    """DuckDB with the views of the smallest test tables."""
    import glob

    import duckdb

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return folder, con
