import pytest

from parchment.llm.queries import ORACLES, QUERIES
from tests.compare import connect, differences

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, name):
    assert differences(spark, con, QUERIES[name], ORACLES[name], SF) == ""
