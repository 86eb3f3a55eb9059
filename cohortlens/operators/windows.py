"""Window operators over *aggregated* frames (a few dozen rows).

A window without ``partitionBy`` moves every row into one task, so these are
only applied after a group-by has reduced the data to one row per group (state,
zone, year, stage).  Row-level ranks over raw data use
:mod:`cohortlens.operators.ranking` instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_desc(col: str) -> Column:
    """``RANK() OVER (ORDER BY col DESC)`` — gaps after ties, NULLs last."""
    return F.rank().over(Window.orderBy(F.col(col).desc_nulls_last()))


def lag_change(df: DataFrame, value: str, order: str, prev_name: str = "previous",
               change_name: str = "change") -> DataFrame:
    """Previous row's value in ``order`` and the difference (previous *row*)."""
    prev = F.lag(value).over(Window.orderBy(order))
    return df.withColumn(prev_name, prev) \
        .withColumn(change_name, F.col(value) - F.col(prev_name))


def share_within(df: DataFrame, count_col: str, group: list[str], name: str,
                 digits: int = 1) -> DataFrame:
    """``ROUND(n * 100.0 / SUM(n) OVER (PARTITION BY group), digits)``."""
    total = F.sum(count_col).over(Window.partitionBy(*group))
    return df.withColumn(name, F.round(F.col(count_col) * F.lit(100.0) / total, digits))


def lead_drop(df: DataFrame, value: str, order: str, name: str = "drop_to_next",
              digits: int = 1) -> DataFrame:
    """Stage-to-stage drop ``value[i] - value[i+1]`` (half-even rounding)."""
    nxt = F.lead(value).over(Window.orderBy(order))
    return df.withColumn(name, F.bround(F.col(value) - nxt, digits))


def order_small(df: DataFrame, *cols) -> DataFrame:
    """Final ``ORDER BY`` of an aggregated result (rows bounded by its group
    count: states, zones, years, stages).  One single-partition exchange and a
    local sort — a global ``orderBy`` would add a range-sampling job."""
    return df.repartition(1).sortWithinPartitions(*cols)
