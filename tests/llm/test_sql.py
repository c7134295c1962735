"""The queries of the llm subpackage that SQL can express give the same rows in DuckDB."""

import pytest
from compare import differences, duck

from docweave.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, small, name):
    assert differences(queries.queries()[name](spark, small), duck(small), queries.oracle_sql()[name]) == []
