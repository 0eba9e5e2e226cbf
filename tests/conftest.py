from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
# Read when numpy is first imported, as tuneline's own import sets it.
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    held = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    held.sparkContext.setLogLevel("ERROR")
    yield held
    held.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


def rows(df) -> list[tuple]:
    """Rows of a Spark or DuckDB result as text, columns by name, sorted; whole floats as integers."""

    def text(v) -> str:
        if isinstance(v, float):
            return "null" if v != v else repr(int(v)) if v == int(v) else repr(v)
        return "null" if v is None else str(v)

    if hasattr(df, "collect"):
        names, found = df.columns, [tuple(r) for r in df.collect()]
    else:
        names, found = df.columns, df.fetchall()
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(names[i] for i in order), *(tuple(text(r[i]) for i in order) for r in found)])
