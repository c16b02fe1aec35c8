"""Every query against its SQL, on the smallest tables."""

import os
from pathlib import Path

import pytest

import __spark_entry__ as entry
from readforge.plans import catalog

from . import compare

SF = os.environ.get("READFORGE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def connection():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, connection, name):
    assert compare.difference(catalog.queries()[name](spark, SF), connection, catalog.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(catalog.queries().keys() - catalog.oracle_sql().keys()))
def test_query_gives_rows(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert entry.oracle_sql().keys() <= entry.queries().keys()
