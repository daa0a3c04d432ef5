import pytest

from marlspan.plans import catalog
from oracle import check, connection


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_its_sql(spark, sf, con, name):
    check(catalog.QUERIES[name](spark, sf), con, catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_has_rows(spark, sf, name):
    rows = catalog.QUERIES[name](spark, sf).count()
    assert rows > 0 or name == "simhash_pairs"  # 200 texts may have no near ones


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
