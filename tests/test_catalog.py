"""Every registered query against its SQL."""

import pytest
from compare import connect, differences

import __spark_entry__ as entry_points
from keyferry.plans.catalog import QUERIES
from keyferry.plans.oracle import ORACLE


@pytest.fixture(scope="module")
def db(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, sf_dir, db, name):
    assert differences(QUERIES[name](spark, sf_dir), db, ORACLE[name]) == []


def test_entry(spark):
    row = entry_points.entry(spark).first()
    assert row.keys_total == row.keys_migrated + row.keys_skipped + row.keys_filtered + row.keys_failed
