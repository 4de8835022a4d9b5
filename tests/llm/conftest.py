"""Fixtures of odd documents."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from conftest_odd import CLASH, ODD  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, *[f"x{i}"] * len(CLASH)) for i, t in ODD]
    schema = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASH)
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


@pytest.fixture
def make(spark):
    def frame(*texts, schema="doc_id long, text string"):
        return spark.createDataFrame(list(enumerate(texts)), schema).repartition(2)
    return frame
