"""Every registered query against its SQL twin on the smallest tables."""

import os

import pytest

import oracle
from __spark_entry__ import entry, oracle_sql, queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in SQL:
        assert oracle.compare(spark, con, QUERIES[name], SQL[name], SF_DIR) is None
    else:
        assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    rows = {r["severity"]: r["n_findings"] for r in entry(spark).collect()}
    assert rows["total"] == rows["high"] + rows["medium"] + rows["low"] + rows["other"] > 0
