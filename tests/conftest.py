import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows_of(columns, rows):
    tidy = lambda v: round(v, 6) if isinstance(v, float) else v
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(tidy(r[k]) for k in order) for r in rows), key=str)


@pytest.fixture(scope="session")
def same_rows(spark, duck):
    """Asserts that a query and its SQL give the same columns and rows."""

    def check(frame, sql):
        found = duck.sql(sql)
        assert sorted(frame.columns) == sorted(found.columns)
        assert rows_of(frame.columns, frame.collect()) == rows_of(found.columns, found.fetchall())

    return check
