"""Differential check: every queries() key against its DuckDB oracle."""

import pytest

import __spark_entry__ as E
from tools.compare import compare

from .conftest import SF_SMALL

TRAINING_DATA = set(E._training_data()[0])      # tested in tests/llm
ORACLE_KEYS = sorted(set(E.oracle_sql()) - TRAINING_DATA)


def test_every_query_is_registered():
    qs = E.queries()
    assert set(ORACLE_KEYS) <= set(qs)
    rows_only = set(qs) - set(ORACLE_KEYS) - TRAINING_DATA
    assert rows_only == {"facility_lr", "facility_rf", "feature_importance", "model_report"}


@pytest.mark.parametrize("key", ORACLE_KEYS)
def test_matches_duckdb(spark, key):
    res = compare(spark, SF_SMALL, [key], verbose=False)[key]
    assert res.startswith("OK"), res
    plan = E.queries()[key](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    for node in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF"):
        assert node not in plan, f"{key}: {node} in plan"


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns[0] == "priority_rank" and df.count() > 0
