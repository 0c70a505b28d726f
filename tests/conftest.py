"""One local session for all tests, and a comparison with DuckDB over the same files."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.sql.warehouse.dir", f"{tmp_path_factory.mktemp('warehouse')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    """A DuckDB connection with a view for each table of the test data."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in sorted(Path(SF).glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def settled(value):
    """Values in a form that compares across engines: doubles to nine digits, nested values as tuples."""
    if isinstance(value, float):
        return None if value != value else float(f"{value:.9g}")
    if isinstance(value, dict):
        return tuple(settled(x) for x in value.values())
    if isinstance(value, (list, tuple)):
        return tuple(settled(x) for x in value)
    return value


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted((tuple(settled(r[k]) for k in order) for r in rows), key=repr)


@pytest.fixture(scope="session")
def same(spark, duck):
    """Asserts that a query and its SQL give the same columns and rows."""

    def check(build, sql):
        df = build(spark, SF)
        found = duck.execute(sql)
        names = [c[0] for c in found.description]
        want = table_of(names, found.fetchall())
        got = table_of(df.columns, [tuple(r) for r in df.collect()])
        assert got[0] == want[0]
        assert len(got[1]) == len(want[1])
        wrong = [(a, b) for a, b in zip(got[1], want[1], strict=True) if a != b]
        assert not wrong, wrong[:3]
        return got[1]

    return check
