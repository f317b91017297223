import pytest

from __spark_entry__ import queries
from loam.operators import etl


@pytest.mark.parametrize("name", ["document_tables", "document_sections", "document_questions"])
def test_lines_are_rewritten_once(spark, sf, name):
    """No filter that Spark infers rewrites a document's lines once more for each of its tables or pages."""
    plan = queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan()
    assert not any(line.lstrip(" :+-").startswith("Filter") and "transform(" in line for line in plan.toString().splitlines())


def test_tables_without_rows(spark):
    """Pages without tables, null or empty, and tables without a row or a cell give nothing."""
    pages = spark.createDataFrame([(1, 1, None), (2, 1, []), (3, 1, [[], [[]], [["a ", " b"], ["c"]]])], "doc_id long, page int, tables array<array<array<string>>>")
    assert [tuple(r) for r in etl.tables(pages).collect()] == [(3, 1, 2, ["a", "b"], [["c"]], 2, 2, 1)]
