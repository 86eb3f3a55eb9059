"""Consecutive numbers and ordered files for distributed rows.

``row_number() OVER (ORDER BY ...)`` moves every row into one task.  Here the rows are
dealt out by ranges of the order, numbered inside their partition, and the counts of the
earlier partitions (one row a partition) are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def in_order(df: DataFrame, order: list[Column | str]) -> DataFrame:
    """Rows range-partitioned and sorted: partition after partition they are in order."""
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def numbered(df: DataFrame, order: list[Column | str], name: str = "position",
             start: int = 0) -> DataFrame:
    """Adds ``name``: ``start``, ``start + 1``, ... in the given order.

    Rows that tie in the whole order are numbered in any order.  The dealt rows are
    checkpointed, since a range boundary is sampled and must not move between the count
    and the numbering, nor when a lost task is run again."""
    checkpoint_dir(df.sparkSession)
    dealt = in_order(df, order).withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_held")).select(
        "_part", F.coalesce(F.sum("_held").over(before), F.lit(0)).alias("_before"))
    return dealt.join(starts, part == F.col("_part")).select(
        *df.columns, (place + F.col("_before") + start).alias(name))


def write_ordered(df: DataFrame, order: list[Column | str], path: str, fmt: str = "csv") -> None:
    """Publish rows in order: the part files, by name, follow one another."""
    in_order(df, order).write.mode("overwrite").option("header", True).format(fmt).save(path)
