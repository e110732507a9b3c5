"""Every registered query against its SQL, on the smallest tables; those without SQL must run."""

import pytest

from millrace.plans import catalogue
from tests.oracle import connect, difference

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    if name in SQL:
        assert difference(spark, con, SF, QUERIES[name], SQL[name]) is None
    else:
        assert QUERIES[name](spark, SF).toArrow().num_columns > 0
