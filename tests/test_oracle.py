import pytest
from oracle import connect, same

from assayer.plans import registry

SF = "/root/testdata/sf0.001"
Q, S = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(S))
def test_same_rows_as_sql(spark, con, name):
    same(spark, con, SF, Q[name], S[name])
