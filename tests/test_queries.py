"""Every query of the library against its SQL; those without SQL must give rows."""

import pytest

from crawlight import queries as Q
from tests.compare import assert_same, database
from tests.conftest import DATA

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return database(DATA)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_matches_sql(spark, con, name):
    assert_same(Q.queries()[name](spark, str(DATA)).toPandas(), con.execute(Q.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql())))
def test_gives_rows(spark, name):
    assert Q.queries()[name](spark, str(DATA)).count() > 0


def test_entry(spark):
    import __spark_entry__ as E

    assert E.entry(spark).count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
