"""Every registered query equals its SQL twin on the smallest data folder."""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry
from tools.check_oracle import compare, duck
from vigilframe import suite

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", list(suite.load()[0]))
def test_query_equals_sql(spark, con, name):
    # An empty result counts as a problem: no query is empty at the smallest scale.
    assert compare(spark, con, FOLDER, name) is None


def test_every_query_has_a_twin():
    queries, twins = suite.load()
    assert set(queries) == set(twins)


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 1 and rows[0]["status"] == "error"
