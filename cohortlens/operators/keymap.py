"""A persisted map from natural keys to surrogate keys, extended load by load.

The map is a Parquet folder with one partition a load: the natural key's columns and
``key``.  A load looks its natural keys up, numbers those it does not find from the largest
key on, in the order of the natural key, and writes them as its own partition.  Keys are
consecutive integers, never change, and are compared by value, so no two natural keys can
share one, however their hashes fall.

Running a load again replaces its partition and finds the same keys.  A load before one
that is already there is refused, since its new keys would collide with the later ones.
A natural key whose parts are all null is no key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .numbering import numbered


def _same(left: DataFrame, right: DataFrame, natural: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in natural])


def read_keys(spark: SparkSession, root: str) -> DataFrame | None:
    """(natural columns, key, load) of every load, or None before the first."""
    try:
        return spark.read.option("basePath", root).parquet(root)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def extend_keys(rows: DataFrame, natural: list[str], root: str, load: int) -> DataFrame:
    """Add the natural keys of ``rows`` that no load before ``load`` (1, 2, ...) holds.

    Returns the map as of this load: natural columns, key, load."""
    spark = rows.sparkSession
    asked = rows.select(*natural).where(F.coalesce(*[F.col(c).cast("string") for c in natural])
                                        .isNotNull()).distinct()
    known, first = read_keys(spark, root), 1
    if known is not None:
        last, later = known.where(F.col("load") < load).agg(F.max("key")).first()[0], \
            known.where(F.col("load") > load).limit(1).count()
        if later:
            raise ValueError(f"load {load} comes before a load that {root} holds already")
        known = known.where(F.col("load") < load)
        first = 1 + (last or 0)
        asked = asked.join(known, _same(asked, known, natural), "left_anti")
    numbered(asked, natural, "key", first).write.mode("overwrite").parquet(f"{root}/load={load}")
    return read_keys(spark, root).where(F.col("load") <= load)


def with_key(rows: DataFrame, keys: DataFrame, natural: dict[str, str], name: str) -> DataFrame:
    """``rows`` with the surrogate ``name`` (null where the map lacks the natural key).

    ``natural`` maps the map's columns to expressions over the rows, one row of the map
    for each, so the join adds no row."""
    side = keys.select(*[F.col(c).alias(f"_n_{c}") for c in natural], F.col("key").alias(name))
    same = [F.expr(e).eqNullSafe(F.col(f"_n_{c}")) for c, e in natural.items()]
    return rows.join(side, reduce(lambda a, b: a & b, same), "left").drop(
        *[f"_n_{c}" for c in natural])
