"""Every registered query against its SQL, on whole tables."""

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points
from tidewatch.plans.oracles import ORACLES
from tidewatch.plans.queries import QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for file in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def plain(frame):
    """Rows as sorted tuples of columns in name order, floats rounded."""
    def cell(value):
        if value is None or value != value:
            return "null"
        return repr(round(value, 6) + 0.0) if isinstance(value, float) else str(value)

    columns = sorted(frame.columns)
    return columns, sorted(tuple(cell(v) for v in row) for row in frame[columns].itertuples(index=False))


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES) <= set(entry_points.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sql, name):
    found = plain(entry_points.queries()[name](spark, FOLDER).toPandas())
    assert found == plain(sql.execute(ORACLES[name]).fetchdf())


def test_entry_has_rows(spark):
    assert entry_points.entry(spark).count() > 0
