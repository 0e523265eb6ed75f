"""Queries against their DuckDB oracles.  The default run takes a spread of them at scale 0.01; TIDEMARK_FULL=1 runs all (``python check.py`` does the same and prints timings)."""

import os

import pytest

import __spark_entry__ as entry
from check import compare, connect

SF = "/root/testdata/sf0.01"
NAMES = sorted(entry.oracle_sql())
SHOW = NAMES if os.environ.get("TIDEMARK_FULL") else NAMES[::12]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", SHOW)
def test_oracle(spark, con, name):
    msg = compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name])
    assert msg.startswith("ok"), msg


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
