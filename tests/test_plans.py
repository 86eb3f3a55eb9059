"""Plan assertions: no Python UDF, pruned scans, broadcast geography,
windows only above aggregates."""

import __spark_entry__ as E

from .conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_are_pruned_and_filters_pushed(spark):
    df = E.queries()["composite_risk"](spark, SF_SMALL)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(c_nationkey)" in text
    assert "ReadSchema: struct<c_custkey:bigint,c_nationkey:int" in text


def test_geography_is_broadcast(spark):
    text = _plan(E.queries()["zone_summary_published"](spark, SF_SMALL))
    assert "BroadcastHashJoin" in text


def _bracket_groups(text: str) -> int:
    """Top-level ``[...]`` groups: a window prints (expressions, [partition
    spec,] order spec), the partition group only when it is not empty."""
    depth, groups = 0, 0
    for ch in text:
        if ch == "[":
            groups += depth == 0
            depth += 1
        elif ch == "]":
            depth -= 1
    return groups


def _global_windows_over_raw_rows(tree: str) -> list[str]:
    """Windows without a partition spec whose first-child chain reaches a
    scan before any aggregate (i.e. a single task over raw rows)."""
    import re
    lines = tree.splitlines()
    bad = []
    for i, line in enumerate(lines):
        body = re.sub(r"^[\s:+\-]*(\*\(\d+\) )?", "", line)
        if not body.startswith("Window [") or _bracket_groups(body) != 2:
            continue                       # not a window, or a partitioned one
        for below in lines[i + 1:]:
            b = re.sub(r"^[\s:+\-]*(\*\(\d+\) )?", "", below)
            if b.startswith(("HashAggregate", "SortAggregate", "ObjectHashAggregate")):
                break
            if "Scan" in b.split(" ")[0] or b.startswith(("FileScan", "Scan", "LocalTableScan")):
                bad.append(body[:80])
                break
    return bad


def test_global_windows_only_over_aggregates(spark):
    """Every window without a partition spec, in every registered query, runs
    above an aggregate: at most one row per group reaches its single task."""
    seen = 0
    for key, fn in E.queries().items():
        if key in {"facility_lr", "facility_rf", "feature_importance", "model_report"} \
                or key in E._training_data()[0]:
            continue
        tree = fn(spark, SF_SMALL)._jdf.queryExecution().executedPlan().treeString()
        seen += tree.count("Window [")
        assert _global_windows_over_raw_rows(tree) == [], key
    assert seen > 10


def test_window_checker_flags_raw_rows(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    raw = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    bad = raw.select("o_orderkey", F.rank().over(Window.orderBy("o_totalprice")).alias("r"))
    tree = bad._jdf.queryExecution().executedPlan().treeString()
    assert _global_windows_over_raw_rows(tree)
    ok = raw.groupBy("o_orderstatus").count() \
        .select("o_orderstatus", F.rank().over(Window.orderBy("count")).alias("r"))
    assert not _global_windows_over_raw_rows(ok._jdf.queryExecution().executedPlan().treeString())
