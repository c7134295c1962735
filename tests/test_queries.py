"""Every core query with SQL gives the same rows in DuckDB; those without run and have rows."""

import pytest
from compare import differences, duck

from docweave import registry
from docweave.plans import search

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, small, name):
    assert differences(registry.queries()[name](spark, small), duck(small), SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_runs_without_sql(spark, small, name):
    assert registry.queries()[name](spark, small).count() > 0


def test_every_asked_query_has_its_context(spark, small):
    every = search.HYBRID.replace(" and cast('0x' || substr(query_id, 3, 4) as integer) % 20 = 0", "")
    assert every != search.HYBRID
    best = duck(small).execute(f"select distinct query_id from ({every})").fetchall()
    mine = registry.queries()["answer_contexts"](spark, small).collect()
    assert sorted(r["query_id"] for r in mine) == sorted(q for (q,) in best) and len(mine) == 20
    assert all(r["context"].startswith("[Context 1]\n") for r in mine)


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "rrf" in df.columns
