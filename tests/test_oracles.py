import os

import pytest

import __spark_entry__
from tests.oracle import connect, difference

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
ORACLES = {k: v for k, v in __spark_entry__.catalog.ORACLES.items()}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, con, name):
    assert difference(con, __spark_entry__.catalog.QUERIES[name](spark, FOLDER), ORACLES[name]) == ""


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
