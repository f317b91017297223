import duckdb
import pytest

from loam.llm import queries
from tests.compare import same_rows


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, sf, name):
    same_rows(queries.QUERIES[name](spark, sf), queries.ORACLE_SQL[name], duckdb.connect(), sf)
