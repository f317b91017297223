import duckdb
import pytest

from loam import catalogue, catalogue_more, catalogue_pages, catalogue_time  # noqa: F401
from tests.compare import same_rows


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_against_sql(spark, sf, name):
    same_rows(catalogue.QUERIES[name](spark, sf), catalogue.ORACLE_SQL[name], duckdb.connect(), sf)


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL)
