"""Readers and sinks.

* ``read_wide``       wide survey extract (Parquet or CSV, all columns as text),
                      pruned to the needed columns before anything else runs
* ``apply_labels``    replace digit codes by value labels from a small label map
* ``read_indicator``  WHO-style indicator CSV -> typed series with our names
* ``read_star`` / ``write_star``   conformed tables as Parquet (idempotent)
* ``read_sql``        SQL text over the conformed tables registered as views
* ``write_extract``   result tables as CSV for dashboards
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import LOAD_ORDER, TABLE_SCHEMAS, Star, conform


def read_wide(spark: SparkSession, path: str, needed: list[str] | None = None,
              fmt: str = "parquet") -> DataFrame:
    """Read a wide extract and keep only ``needed`` columns that exist (missing
    ones are reported by :func:`cohortlens.operators.quality.column_presence`)."""
    if fmt == "csv":
        df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    else:
        df = spark.read.parquet(path)
    if needed is not None:
        df = df.select(*[c for c in needed if c in df.columns])
    return df


def apply_labels(df: DataFrame, labels: DataFrame, columns: list[str]) -> DataFrame:
    """Decode digit codes with a value-label codebook ``(variable, code, label)``.
    Codes without a label keep their raw value; of several labels of a code the least
    counts.  Every column of ``columns`` comes back as text, whatever the codebook
    holds: one join per column, broadcast by the planner where its size allows."""
    book = labels.where(F.col("variable").isin(*columns)) \
        .groupBy("variable", F.col("code").cast("string").alias("code")) \
        .agg(F.min("label").alias("label"))
    out = df
    for c in columns:
        own = book.where(F.col("variable") == c).select(F.col("code").alias(f"_{c}_code"),
                                                        F.col("label").alias(f"_{c}_label"))
        out = out.join(own, F.col(c).cast("string") == F.col(f"_{c}_code"), "left") \
            .withColumn(c, F.coalesce(F.col(f"_{c}_label"), F.col(c).cast("string"))) \
            .drop(f"_{c}_code", f"_{c}_label")
    return out.select(*df.columns)


def read_indicator(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Indicator CSV -> ``who_nigeria_mmr`` (kind='mmr') or ``who_nigeria_sba``
    (kind='sba').  Columns are matched by header name, so either file layout
    (with or without the uncertainty bounds) reads with one schema."""
    raw = spark.read.option("header", True).option("enforceSchema", False) \
        .option("mode", "PERMISSIVE").csv(path)
    cols = set(raw.columns)

    def col(name: str, typ: str):
        return F.col(name).try_cast(typ) if name in cols else F.lit(None).cast(typ)

    if kind == "mmr":
        out = raw.select(col("Period", "int").alias("year"),
                         col("FactValueNumeric", "double").alias("mmr_value"),
                         col("FactValueNumericLow", "double").alias("mmr_value_low"),
                         col("FactValueNumericHigh", "double").alias("mmr_value_high"),
                         col("Location", "string").alias("location"),
                         col("IndicatorCode", "string").alias("indicator_code"))
        return conform(out, TABLE_SCHEMAS["who_nigeria_mmr"])
    if kind == "sba":
        out = raw.select(col("Period", "int").alias("year"),
                         col("FactValueNumeric", "double").alias("value"),
                         col("Value", "int").alias("value_display"),
                         col("Location", "string").alias("location"),
                         col("IndicatorCode", "string").alias("indicator_code"))
        return conform(out, TABLE_SCHEMAS["who_nigeria_sba"])
    raise ValueError("kind must be 'mmr' or 'sba'")


_FIELDS = {"dim_geography": "geography", "dim_woman": "woman", "fact_birth": "birth",
           "fact_anc_delivery": "anc", "fact_maternal_mortality": "mortality",
           "who_nigeria_sba": "who_sba", "who_nigeria_mmr": "who_mmr"}


def write_star(star: Star, root: str, mode: str = "overwrite") -> None:
    """Write the seven tables as Parquet in foreign-key order (overwrite makes
    re-runs idempotent; a failed run leaves no half-appended table)."""
    tables = star.tables()
    for name in LOAD_ORDER:
        tables[name].write.mode(mode).parquet(f"{root.rstrip('/')}/{name}")


def read_star(spark: SparkSession, root: str) -> Star:
    kw = {}
    for name, field in _FIELDS.items():
        df = spark.read.schema(TABLE_SCHEMAS[name]).parquet(f"{root.rstrip('/')}/{name}")
        kw[field] = df
    return Star(**kw)


def register_views(star: Star, prefix: str = "") -> None:
    for name, df in star.tables().items():
        df.createOrReplaceTempView(prefix + name)


def read_sql(spark: SparkSession, star: Star, text: str) -> DataFrame:
    """Run SQL text over the conformed tables (registered as temp views)."""
    register_views(star)
    return spark.sql(text)


def write_extract(df: DataFrame, path: str) -> None:
    """Publish a result as a folder of CSV files with a header: one file for an
    aggregate that fits a partition, more for a larger one."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_star_tables(star: Star, database: str, root: str, buckets: int,
                      mode: str = "overwrite") -> None:
    """Write the seven tables as catalog tables, the woman dimension and the
    facts bucketed (and sorted) by ``woman_id`` into the same number of buckets.

    Readers then aggregate facts to woman grain and join them to the woman
    dimension without any shuffle: the bucketed scans already provide the
    hash partitioning on ``woman_id`` that the aggregate and the sort-merge
    join require.  Needs a persistent catalog (metastore) to be reused across
    sessions; files live under ``root``."""
    spark = next(iter(star.tables().values())).sparkSession
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{root.rstrip('/')}/_catalog'")
    for name in LOAD_ORDER:
        df = star.tables()[name]
        w = df.write.mode(mode).format("parquet").option("path", f"{root.rstrip('/')}/{name}")
        if "woman_id" in df.columns:
            w = w.bucketBy(buckets, "woman_id").sortBy("woman_id")
        w.saveAsTable(f"{database}.{name}")


def read_star_tables(spark: SparkSession, database: str) -> Star:
    return Star(**{field: spark.table(f"{database}.{name}") for name, field in _FIELDS.items()})
