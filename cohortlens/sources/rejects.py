"""Indicator files with a reject table: a bad line becomes a row with its reason, not a null.

A line goes when its number of cells is not the header's, or a typed cell is filled with
something its type cannot hold.  Empty cells are nulls, as in ``io.read_indicator``.  A file
set with more than ``most`` rejects among its lines stops the load.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import TABLE_SCHEMAS, conform

#: The publisher's columns, our names and types.
COLUMNS = {
    "mmr": {"Period": ("year", "int"), "FactValueNumeric": ("mmr_value", "double"),
            "FactValueNumericLow": ("mmr_value_low", "double"),
            "FactValueNumericHigh": ("mmr_value_high", "double"), "Location": ("location", "string"),
            "IndicatorCode": ("indicator_code", "string")},
    "sba": {"Period": ("year", "int"), "FactValueNumeric": ("value", "double"),
            "Value": ("value_display", "int"), "Location": ("location", "string"),
            "IndicatorCode": ("indicator_code", "string")}}
_TABLES = {"mmr": "who_nigeria_mmr", "sba": "who_nigeria_sba"}


class RejectError(RuntimeError):
    """Raised when too many lines of a file cannot be read."""


@dataclass(frozen=True)
class Checked:
    """``rows``: the typed lines; ``rejects``: file, line and reason of every other one."""
    rows: DataFrame
    rejects: DataFrame


def read_indicator_checked(spark: SparkSession, path: str, kind: str, most: float = 0.05) -> Checked:
    """The indicator lines under ``path`` (CSV with a header in each file)."""
    if kind not in COLUMNS:
        raise ValueError("kind must be 'mmr' or 'sba'")
    header = spark.read.option("header", True).csv(path).columns
    wanted = {c: own for c, own in COLUMNS[kind].items() if c in header}
    schema = ", ".join(f"`{c}` string" for c in header) + ", _bad string"
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"),
                                         F.col("value").alias("line")).where("trim(line) <> ''")
    cells = lines.select("file", "line", F.from_csv("line", F.lit(schema), {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("c"))
    is_header = F.lit(True)
    for c in header:
        is_header = is_header & F.col("c")[c].eqNullSafe(F.lit(c))
    cells = cells.where(~is_header)
    faults = [F.when(F.col("c._bad").isNotNull(), "number of cells")]
    for c, (_, kind_of) in wanted.items():
        cell = F.col("c")[c]
        faults.append(F.when((F.trim(cell) != "") & cell.try_cast(kind_of).isNull(), f"{c}: no {kind_of}"))
    checked = cells.withColumn("reason", F.coalesce(*faults))
    counts = checked.agg(F.count("reason").alias("bad"), F.count(F.lit(1)).alias("n")).first()
    if counts.bad > most * counts.n:
        raise RejectError(f"{counts.bad} of {counts.n} lines of {path} cannot be read")
    good = checked.where(F.col("reason").isNull()).select(*[
        F.col("c")[c].try_cast(t).alias(name) for c, (name, t) in wanted.items()])
    for name, t in COLUMNS[kind].values():
        if name not in good.columns:
            good = good.withColumn(name, F.lit(None).cast(t))
    return Checked(conform(good, TABLE_SCHEMAS[_TABLES[kind]]),
                   checked.where(F.col("reason").isNotNull()).select("file", "line", "reason"))
