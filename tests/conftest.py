"""One session for all tests, and the comparison of a query with its SQL."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).parent.parent))

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for path in sorted(Path(DATA).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _plain(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].astype(object)
    return frame.where(frame.notna(), None)


def differences(got: pd.DataFrame, want: pd.DataFrame) -> str:
    """What differs between two results, rows in any order; empty if nothing."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}"
    key = lambda r: tuple((x is None, str(type(x)) if isinstance(x, (bytes, dict)) else "", x if x is not None else 0) for x in r)
    a, b = (sorted(map(tuple, _plain(f).to_numpy().tolist()), key=key) for f in (got, want))
    off = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(off)} rows, as {off[0]}" if off else ""
