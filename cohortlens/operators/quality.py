"""Data-quality and verification operators.

All checks are aggregates that return small DataFrames (one row per check):
required-column presence, referential integrity (anti joins), null report,
plausibility metrics, row-count reconciliation, value frequencies, numeric
summaries with exact quartiles, duplicate keys, and rows per entity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rates import count_pct, flag
from ..schemas import Star
from .ranking import exact_quantiles


def column_presence(spark: SparkSession, df: DataFrame, required: list[str]) -> DataFrame:
    """FOUND / MISSING per required column (schema metadata only, no job)."""
    present = set(df.columns)
    rows = [(c, "FOUND" if c in present else "MISSING") for c in required]
    return spark.createDataFrame(rows, "column_name string, status string")


def orphan_rows(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Rows of ``child`` whose ``key`` has no parent, counted per key first
    (partial aggregation: a hot key is one row per map task, not a skewed join)."""
    per_key = child.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    return per_key.join(parent.select(key), key, "left_anti") \
        .agg(F.coalesce(F.sum("_rows"), F.lit(0)).cast("bigint").alias("orphan_count"))


def orphan_checks(star: Star) -> DataFrame:
    """Referential integrity: rows whose key has no parent (LEFT JOIN ... IS NULL)."""
    facts = {"fact_birth": star.birth, "fact_anc_delivery": star.anc,
             "fact_maternal_mortality": star.mortality}
    per_key = None       # rows per key and fact: a hot key is one row per map task
    for name, df in facts.items():
        one = df.groupBy("woman_id").agg(F.count(F.lit(1)).alias("_rows")).select(
            F.lit(f"{name} with no valid woman_id").alias("check_name"), "woman_id", "_rows")
        per_key = one if per_key is None else per_key.unionByName(one)
    lost = per_key.join(star.woman.select("woman_id"), "woman_id", "left_anti") \
        .groupBy("check_name").agg(F.sum("_rows").alias("n"))
    names = star.geography.sparkSession.createDataFrame(
        [(f"{name} with no valid woman_id",) for name in facts], "check_name string")
    out = orphan_rows(star.woman, star.geography, "state_id").select(
        F.lit("dim_woman with no valid state_id").alias("check_name"), "orphan_count").unionByName(
        names.join(lost, "check_name", "left").select(
            "check_name", F.coalesce("n", F.lit(0)).cast("bigint").alias("orphan_count")))
    return out.withColumn("status", F.when(F.col("orphan_count") == 0, "PASS").otherwise("FAIL"))


CRITICAL_COLUMNS = [
    ("dim_woman", "survey_weight"), ("dim_woman", "state_id"), ("dim_woman", "education_level"),
    ("fact_birth", "birth_year"), ("fact_birth", "skilled_attendant"),
    ("fact_anc_delivery", "facility_delivery"), ("fact_maternal_mortality", "pregnancy_related"),
]


def null_report(star: Star, columns: list[tuple[str, str]] = CRITICAL_COLUMNS) -> DataFrame:
    """NULL count per critical column (one aggregate per table), OK / NOTE."""
    tables = star.tables()
    out = None
    by_table: dict[str, list[str]] = {}
    for t, c in columns:
        by_table.setdefault(t, []).append(c)
    for t, cols in by_table.items():
        agg = tables[t].agg(*[F.sum(flag(F.col(c).isNull())).alias(c) for c in cols])
        one = agg.select(F.inline(F.array(*[F.struct(
            F.lit(t).alias("table_name"), F.lit(c).alias("column_name"),
            F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias("null_count")) for c in cols])))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("status", F.when(F.col("null_count") == 0, "OK").otherwise("NOTE"))


def null_profile(df: DataFrame, table: str) -> DataFrame:
    """NULL count for every column of one table (one scan + unpivot)."""
    agg = df.agg(*[F.sum(flag(F.col(c).isNull())).cast("bigint").alias(c) for c in df.columns])
    return agg.unpivot([], df.columns, "column_name", "null_count") \
        .select(F.lit(table).alias("table_name"), "column_name", "null_count")


def clinical_checks(star: Star, recent_from: int = 2019) -> DataFrame:
    """Plausibility metrics as (check_name, value) rows."""
    a, b = star.anc, star.birth
    fac, vis = F.col("facility_delivery"), F.col("anc_visits")
    anc_agg = a.agg(
        count_pct(F.sum(flag(fac == 1)), F.sum(flag(fac.isNotNull()))).alias("fac"),
        F.round(F.avg(vis), 1).alias("mean_visits"),
        count_pct(F.sum(flag(fac.isNotNull() & (vis == 0))), F.sum(flag(fac.isNotNull())))
        .alias("zero"))
    recent = F.when(F.col("birth_year") >= recent_from, F.col("skilled_attendant"))
    birth_agg = b.agg(F.round(F.avg(recent) * F.lit(100.0), 1).alias("sba"),
                      (F.count(F.lit(1)) / F.count_distinct("woman_id")).alias("bpw"))
    deaths = star.mortality.agg(F.sum(flag(F.col("pregnancy_related") == 1)).alias("deaths"))
    states = star.geography.agg(F.count_distinct("state_name").alias("states"))
    one = anc_agg.crossJoin(birth_agg).crossJoin(deaths).crossJoin(states)
    rows = F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(c).cast("double").alias("value"))
                     for n, c in [("National facility delivery rate (%)", "fac"),
                                  ("National skilled attendant rate (%)", "sba"),
                                  ("Mean ANC visits (recent births)", "mean_visits"),
                                  ("Women with zero ANC visits (%)", "zero"),
                                  ("Confirmed maternal deaths (count)", "deaths"),
                                  ("States in database", "states"),
                                  ("Births per woman", "bpw")]])
    return one.select(F.inline(rows))


def row_counts(star: Star) -> DataFrame:
    """Row count per table (the reference's verification check 1)."""
    out = None
    for name, df in star.tables().items():
        one = df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count")
        out = one if out is None else out.unionByName(one)
    return out


def value_frequency(df: DataFrame, col: str, table: str | None = None) -> DataFrame:
    """``value_counts(dropna=False)``: NULL is its own value."""
    out = df.groupBy(F.col(col).cast("string").alias("value")).agg(
        F.count(F.lit(1)).alias("n"))
    return out.select(F.lit(table or "").alias("table_name"), F.lit(col).alias("column_name"),
                      "value", "n")


SUMMARY_STATS = [("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"),
                 ("25%", "q25"), ("50%", "q50"), ("75%", "q75"), ("max", "max")]


def numeric_summary(df: DataFrame, col: str, table: str = "") -> DataFrame:
    """count / mean / std (sample) / min / 25% / 50% / 75% / max of one column."""
    return numeric_summaries([(table, df, col)])


def numeric_summaries(items: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """``describe()`` of several (table, DataFrame, column) items in one pass:
    the columns are stacked as (table_name, column_name, x) rows, so the exact
    quartiles of all of them come from one segmented running count (one
    checkpoint) and the moments from one grouped aggregate.

    Quartiles are exact with linear interpolation between order statistics;
    no raw values are collected.  When every column is integral the variance
    comes from exact integer sums, so it is reproducible bit for bit."""
    integral = all(dict(df.dtypes)[c] in ("int", "bigint", "smallint", "tinyint")
                   for _t, df, c in items)
    typ = "bigint" if integral else "double"
    long = None
    for table, df, c in items:
        part = df.select(F.lit(table).alias("table_name"), F.lit(c).alias("column_name"),
                         F.col(c).cast(typ).alias("x"))
        long = part if long is None else long.unionByName(part)
    keys = ["table_name", "column_name"]
    x = F.col("x")
    if integral:
        xd = x.cast("decimal(38,0)")
        n, s_, ss = F.count(x), F.sum(xd), F.sum(xd * xd)
        std = F.sqrt((n * ss - s_ * s_).cast("double")
                     / (n.cast("double") * (n - 1).cast("double")))
    else:
        std = F.stddev_samp(x)
    base = long.groupBy(*keys).agg(
        F.count(x).cast("double").alias("count"), F.avg(x).alias("mean"), std.alias("std"),
        F.min(x).cast("double").alias("min"), F.max(x).cast("double").alias("max"))
    q = exact_quantiles(long, "x", [0.25, 0.5, 0.75], group_cols=keys)
    qwide = q.groupBy(*keys).agg(*[F.max(F.when(F.col("p") == p, F.col("value"))).alias(name)
                                   for p, name in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))])
    one = base.join(qwide, keys, "left")            # one row per profiled column
    rows = F.array(*[F.struct(F.lit(lab).alias("statistic"), F.col(c).cast("double").alias("value"))
                     for lab, c in SUMMARY_STATS])
    return one.select(*keys, F.inline(rows))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Rows minus distinct keys (``duplicated().sum()``)."""
    return df.agg((F.count(F.lit(1)) - F.count_distinct(key)).alias("duplicate_rows"),
                  F.count(F.lit(1)).alias("rows"), F.count_distinct(key).alias("distinct_keys"))
