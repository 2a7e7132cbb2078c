import os

import pytest

from meshlake.llm import registry
from tests.oracle import connect, difference

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_oracle(spark, con, name):
    assert difference(con, registry.QUERIES[name](spark, FOLDER), registry.ORACLES[name]) == ""
