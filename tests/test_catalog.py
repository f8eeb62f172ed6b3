"""Every registered query against its SQL on DuckDB, on the smallest data set."""

import compare
import pytest
from conftest import SF

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_sql(spark, con, name):
    state, rows, note = compare.compare(spark, con, SF, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert state in ("ok", "rows"), note
    assert rows >= 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["projeto_id", "edital_id", "node_path", "depth", "item_id", "texto", "full_path", "count"]
    assert df.count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rows_not_kept_are_not_counted_again(spark):
    plan = entry.queries()["except_removed"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and "replicaterows" not in plan.lower()
