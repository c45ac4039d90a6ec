"""Every registered query against its SQL on the smallest given tables."""

import pytest

import __spark_entry__ as entry
from glyphstat.plans.catalog import QUERIES
from glyphstat.plans.oracles import ORACLES
from tests.oracle import connect, difference

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    assert difference(QUERIES[name](spark, SF_DIR), con, ORACLES[name]) is None


def test_every_query_has_sql_and_is_registered():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_absent_types_are_all_listed(spark):
    """As many rows a corpus as vocab_gap_types counts, also of types that its column of names leaves out."""
    sf_dir = "/root/testdata/sf0.01"
    listed = [r["dataset"] for r in QUERIES["absent_types"](spark, sf_dir).collect()]
    missing = {r["dataset"]: r["missing"] for r in QUERIES["vocab_gap_types"](spark, sf_dir).collect()}
    assert listed and all(listed.count(dataset) == n for dataset, n in missing.items())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert [r["dataset"] for r in rows] and all(0 <= r["diff_sum"] <= 2 for r in rows)
