import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as contract
from check_oracle import compare, connect
from cohortry.plans.catalog import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(DATA)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE)
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).columns == ["sample_rank", "c_custkey", "r_name", "n_name", "c_mktsegment", "c_acctbal"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_twin(spark, connection, name):
    problem = compare(spark, connection, DATA, name)
    assert problem == "", problem
