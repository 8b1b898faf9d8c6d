import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.local.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


def same_as_duckdb(df, sql: str, sf_dir: str) -> None:
    import glob

    import duckdb
    import pandas as pd

    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    a, b = df.toPandas(), c.execute(sql).df()
    assert sorted(a.columns) == sorted(b.columns)

    def cell(x):
        if x is None or x is pd.NA or x != x:
            return "null"
        return f"{float(x):.5f}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    rows = lambda t: sorted(tuple(map(cell, r)) for r in t[sorted(t.columns)].astype(object).itertuples(index=False))
    assert rows(a) == rows(b)
