"""Every registered query against DuckDB on the smallest tables."""

import os

import pytest

import __spark_entry__ as contract
import check

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return check.duck(FOLDER)


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, con, name):
    ok, note = check.compare(spark, con, FOLDER, name)
    assert ok, note


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() > 0 and df.columns[:2] == ["doc_id", "page_number"]
