"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry_points
from check_oracles import compare, connect
from workloads import all_oracles, all_queries

QUERIES, ORACLES = all_queries(), all_oracles()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_every_query_has_a_twin():
    assert sorted(QUERIES) == sorted(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, con, name):
    assert compare(spark, con, sf, name, QUERIES[name], ORACLES[name]).startswith("ok")


def test_entry(spark):
    assert entry_points.entry(spark).columns == ["o_orderkey", "o_orderstatus", "o_totalprice", "l_linenumber", "l_quantity", "l_returnflag"]
