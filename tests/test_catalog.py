import pytest

from compare import connect, spark_rows, sql_rows
from feedback_signals.catalog import ORACLES, QUERIES

# Distances, and the pass over lines that carries the quoting of a feedback file.
PYTHON_ALLOWED = {"nearest_neighbor", "eps_neighbors", "dbscan", "dbscan_sampled", "csv_round_trip", "read_by_own_header"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    assert spark_rows(df) == sql_rows(duck, ORACLES[name])
    plan = df._jdf.queryExecution().executedPlan().toString()
    if name not in PYTHON_ALLOWED:
        assert "EvalPython" not in plan and "InPandas" not in plan and "InArrow" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["isolation_outliers", "embed_texts", "rate_cap", "score_texts", "run_minority", "export_report_row"])
def test_query_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert rows and entry.queries().keys() >= entry.oracle_sql().keys()
    assert any(r.needs_attention for r in rows)
