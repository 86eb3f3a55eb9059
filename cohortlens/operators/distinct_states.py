"""Distinct counts whose partial states survive merging.

A state is a set of bitmaps: integer ids fall into buckets of 32,768, and a bucket of a group and
a measure is one bitmap.  States of two loads, or of the states of a zone, merge by
OR; the counts come from the bits alone, so rows that were delivered twice count once and no
row is read again.  With consecutive ids (``keymap``) a group's state takes a bit an id in its
range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BUCKET = "bucket"


def distinct_state(rows: DataFrame, groups: list[str], id_col: str,
                   measures: dict[str, Column | None]) -> DataFrame:
    """(groups, bucket, one bitmap a measure) of the ids that meet a measure's condition
    (``None``: every id).  Map-side bitmaps are combined, so the shuffle carries bitmaps."""
    place = F.bitmap_bit_position(F.col(id_col))
    return rows.where(F.col(id_col).isNotNull()).groupBy(
        *groups, F.bitmap_bucket_number(F.col(id_col)).alias(_BUCKET)).agg(*[
            F.bitmap_construct_agg(place if c is None else F.when(c, place)).alias(name)
            for name, c in measures.items()])


def merged(states: list[DataFrame], groups: list[str]) -> DataFrame:
    """One state of several, by fewer groups where ``groups`` leaves some out."""
    every = reduce(DataFrame.unionByName, states)
    measures = [c for c in states[0].columns if c not in groups and c != _BUCKET
                and states[0].schema[c].dataType.simpleString() == "binary"]
    return every.groupBy(*groups, _BUCKET).agg(*[F.bitmap_or_agg(m).alias(m) for m in measures])


def distinct_counts(state: DataFrame, groups: list[str]) -> DataFrame:
    """The counts of a state by ``groups``."""
    one = merged([state], groups)
    measures = [c for c in one.columns if c not in groups and c != _BUCKET]
    return one.groupBy(*groups).agg(*[F.sum(F.bitmap_count(m)).alias(m) for m in measures])
