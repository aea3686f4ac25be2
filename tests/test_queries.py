"""Every query beside its SQL on the smallest tables."""

import os

import pytest
from compare import differs, duck

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = [n for n in entry.oracle_sql() if not n.startswith("op")]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    assert differs(spark, con, entry.queries()[name], entry.oracle_sql()[name], SF) is None


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
