import pytest

from factmill.plans import catalogue, parsed  # noqa: F401 - parsed adds its queries
from tests.oracle import connection, same


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query_gives_what_sql_gives(spark, sf, con, name):
    same(catalogue.QUERIES[name](spark, sf), con, catalogue.ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
