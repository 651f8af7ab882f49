"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest

from tests.oracle import connect, differences
from tracksmith.plans import catalog

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, con, name):
    assert differences(spark, con, catalog.QUERIES[name], catalog.ORACLES[name], SF_DIR) is None


def test_whole_tables_have_a_query(spark):
    """Rows of g_8, in both forms, and tasks of a_6."""
    assert catalog.QUERIES["g_8"](spark, SF_DIR).count() == catalog.QUERIES["g_8_all"](spark, SF_DIR).count() == spark.read.parquet(f"{SF_DIR}/conversations.parquet").count()
    assert catalog.QUERIES["a_6_all"](spark, SF_DIR).first()["n"] == catalog.QUERIES["a_1"](spark, SF_DIR).where("composition IS NULL").first()["expected"]


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(spark, name):
    """Their results are held against brute force and cases in the other tests; here, that there are some over whole tables."""
    df = catalog.QUERIES[name](spark, SF_DIR)
    assert df.columns and df.count() > 0
