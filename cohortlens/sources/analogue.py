"""Analogue views: the conformed star schema derived from the generic driver
tables (region, nation, customer, orders, events, lineitem, documents, labels).

The survey microdata are not public, so every analysis is exercised on a
deterministic mapping of the driver's tables onto the star schema:

=================  =====================================================
view               derived from
=================  =====================================================
dim_geography      nation JOIN region (state = nation, zone = region)
dim_woman          customer (one woman per customer)
fact_birth         orders (one birth per order, years shifted to 2021+)
fact_anc_delivery  orders (one care record per order, many per woman)
fact_mortality     events (one death per event, many per woman)
who_nigeria_mmr    lineitem by ship year and line status
who_nigeria_sba    lineitem by ship year
scored             labels JOIN documents (label + tied integer score)
wide               customer + order slots + event slots as raw labels
=================  =====================================================

Each view's columns are SQL expressions written in the dialect subset shared by
Spark SQL and DuckDB, so the DuckDB oracle builds byte-identical inputs.  Weights
are integer-valued doubles so weighted sums are exact in any summation order.
"""

from __future__ import annotations

import os
import weakref
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import (DIM_GEOGRAPHY, DIM_WOMAN, FACT_ANC, FACT_BIRTH, FACT_MORTALITY,
                       WHO_MMR, WHO_SBA, Star, conform)

# ---------------------------------------------------------------------------
# Column expressions (shared with the DuckDB oracle).  Fixed values.
# ---------------------------------------------------------------------------

GEOGRAPHY_COLS = {
    "state_id": "CAST(n_nationkey AS BIGINT)",
    "dhs_cluster_id": "CAST(n_nationkey AS INT)",
    "state_name": "n_name",
    "geopolitical_zone": "r_name",
    "urban_rural": "CASE WHEN n_nationkey % 2 = 0 THEN 'Urban' ELSE 'Rural' END",
}

WOMAN_COLS = {
    "woman_id": "c_custkey",
    "dhs_case_id": "CAST(c_custkey AS STRING)",
    "state_id": "CAST(c_nationkey AS BIGINT)",
    "age_at_survey": "CAST(15 + c_custkey % 35 AS INT)",
    "education_level": (
        "CASE WHEN c_custkey % 31 = 0 THEN NULL "
        "WHEN c_custkey % 4 = 0 THEN 'None' WHEN c_custkey % 4 = 1 THEN 'Primary' "
        "WHEN c_custkey % 4 = 2 THEN 'Secondary' ELSE 'Higher' END"),
    "wealth_index": (
        "CASE WHEN c_custkey % 37 = 0 THEN NULL "
        "WHEN c_mktsegment = 'AUTOMOBILE' THEN 'Poorest' "
        "WHEN c_mktsegment = 'BUILDING' THEN 'Poor' "
        "WHEN c_mktsegment = 'FURNITURE' THEN 'Middle' "
        "WHEN c_mktsegment = 'HOUSEHOLD' THEN 'Rich' "
        "WHEN c_mktsegment = 'MACHINERY' THEN 'Richest' END"),
    "has_insurance": (
        "CASE WHEN c_custkey % 23 = 0 THEN NULL WHEN c_custkey % 10 = 0 THEN 1 ELSE 0 END"),
    "distance_barrier": (
        "CASE WHEN c_custkey % 29 = 0 THEN NULL WHEN c_acctbal < 2000 THEN 1 ELSE 0 END"),
    "survey_weight": "CAST(50 + c_custkey % 101 AS DOUBLE)",
}

BIRTH_COLS = {
    "birth_id": "o_orderkey",
    "woman_id": "o_custkey",
    "birth_order": "CAST(1 + o_orderkey % 7 AS INT)",
    "birth_year": "CAST(year(o_orderdate) + 26 AS INT)",
    "child_alive": (
        "CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN 0 ELSE 1 END"),
    "delivery_location": (
        "CASE WHEN o_orderstatus = 'F' THEN 'Home' "
        "WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 0 THEN 'Government Facility' "
        "WHEN o_orderstatus = 'O' THEN 'Private Facility' END"),
    "skilled_attendant": (
        "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 1 ELSE 0 END"),
}

# ANC: one care record per order (several per woman).
ANC_COLS = {
    "anc_id": "o_orderkey",
    "woman_id": "o_custkey",
    "anc_visits": "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderkey % 9 AS INT) END",
    "first_anc_trimester": (
        "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(1 + o_orderkey % 3 AS INT) END"),
    "facility_delivery": (
        "CASE WHEN o_orderstatus = 'O' THEN 1 WHEN o_orderstatus = 'F' THEN 0 END"),
    "delivery_assisted_by": (
        "CASE WHEN o_orderpriority = '1-URGENT' THEN 'Doctor' "
        "WHEN o_orderpriority = '2-HIGH' THEN 'Nurse or Midwife' "
        "WHEN o_orderpriority = '3-MEDIUM' THEN 'Auxiliary Midwife' "
        "WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'Traditional Birth Attendant' "
        "WHEN o_orderkey % 2 = 0 THEN 'None' ELSE 'Other' END"),
    "postnatal_check": (
        "CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END"),
}

MORTALITY_COLS = {
    "mortality_id": "event_id",
    "woman_id": "user_id",
    "sibling_sex": "'Female'",
    "sibling_alive": "CAST(0 AS INT)",
    "sibling_age_at_death": (
        "CASE WHEN event_id % 7 = 0 THEN NULL "
        "ELSE CAST(15 + CAST(floor(value) AS BIGINT) % 35 AS DOUBLE) END"),
    "years_since_death": "CAST(event_id % 8 AS DOUBLE)",
    "pregnancy_related": (
        "CASE WHEN event_id % 3 = 0 THEN 0 WHEN event_id % 3 = 1 THEN 1 END"),
    "death_year": "CAST(year(ts) AS INT)",
}

# Indicator series from lineitem (grouped by the key expressions).
MMR_KEYS = {
    "year": "CAST(year(l_shipdate) + 22 AS INT)",
    "indicator_code": (
        "CASE WHEN l_linestatus = 'O' THEN 'MDG_0000000026' ELSE 'MORT_MATERNALNUM' END"),
}
MMR_AGGS = {
    "mmr_value": "CAST(40 AS DOUBLE) * avg(l_quantity)",
    "mmr_value_low": "CAST(30 AS DOUBLE) * avg(l_quantity)",
    "mmr_value_high": "CAST(50 AS DOUBLE) * avg(l_quantity)",
}
SBA_KEYS = {"year": "CAST(year(l_shipdate) + 23 AS INT)"}
SBA_AGGS = {
    "value": (
        "CAST(sum(CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END) AS DOUBLE) * 100 / count(*)"),
}
INDICATOR_LOCATION = "Nigeria"
SBA_CODE = "MDG_0000000025"

SCORED_COLS = {
    "doc_id": "doc_id",
    "label": "quality",
    "score": "CAST(n_chars AS DOUBLE) / (n_chars + 2000)",
}


def _select(df: DataFrame, cols: dict[str, str], schema=None) -> DataFrame:
    """One projection of SQL expressions, cast to ``schema`` when given."""
    if schema is None:
        return df.select(*[F.expr(expr).alias(name) for name, expr in cols.items()])
    types = {f.name: f.dataType.simpleString() for f in schema.fields}
    return df.select(*[F.expr(f"CAST(({cols[n]}) AS {types[n]})").alias(n)
                       for n in types])


_SCHEMAS: dict[tuple[str, float], object] = {}


def read_parquet_cached(spark: SparkSession, path: str) -> DataFrame:
    """``spark.read.parquet`` that infers a file's schema once per process
    (keyed by path and modification time) and passes it explicitly afterwards,
    so repeated plans skip the footer read on the driver."""
    try:
        key = (path, os.path.getmtime(path))
    except OSError:              # not a local path (object store): no cache
        return spark.read.parquet(path)
    schema = _SCHEMAS.get(key)
    if schema is None:
        df = spark.read.parquet(path)
        _SCHEMAS[key] = df.schema
        return df
    return spark.read.schema(schema).parquet(path)


class DriverTables:
    """Lazily opened driver tables under one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = read_parquet_cached(self.spark, f"{self.sf_dir}/{name}.parquet")
        return self._cache[name]


class AnalogueStar:
    """The star schema (plus scored/wide views) derived from the driver tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.t = DriverTables(spark, sf_dir)
        self.extras: dict[str, DataFrame] = {}

    @cached_property
    def geography(self) -> DataFrame:
        # nation (25 rows) and region (5 rows) have a fixed size at every scale factor.
        geo = self.t["nation"].join(
            F.broadcast(self.t["region"]), F.col("n_regionkey") == F.col("r_regionkey"))
        return _select(geo, GEOGRAPHY_COLS, DIM_GEOGRAPHY)

    @cached_property
    def woman(self) -> DataFrame:
        return _select(self.t["customer"], WOMAN_COLS, DIM_WOMAN)

    @cached_property
    def birth(self) -> DataFrame:
        return _select(self.t["orders"], BIRTH_COLS, FACT_BIRTH)

    @cached_property
    def anc(self) -> DataFrame:
        # One care record per order: a woman has as many as she has orders.
        return _select(self.t["orders"], ANC_COLS, FACT_ANC)

    @cached_property
    def mortality(self) -> DataFrame:
        return _select(self.t["events"], MORTALITY_COLS, FACT_MORTALITY)

    @cached_property
    def _lineitem_years(self) -> DataFrame:
        """One lineitem aggregate by (ship year, line status) feeding both
        indicator series (exact integer sums; avg = sum / count)."""
        li = self.t["lineitem"]
        return li.groupBy(F.year("l_shipdate").alias("ship_year"), "l_linestatus").agg(
            F.sum(F.col("l_quantity").cast("double")).alias("q_sum"),
            F.count(F.lit(1)).alias("n"),
            F.sum(F.when(F.col("l_discount") >= 0.05, 1).otherwise(0)).alias("disc_n"))

    @cached_property
    def who_mmr(self) -> DataFrame:
        y = self._lineitem_years
        code = F.when(F.col("l_linestatus") == "O", "MDG_0000000026") \
            .otherwise("MORT_MATERNALNUM")
        avg_q = F.col("q_sum") / F.col("n")
        out = y.select(
            (F.col("ship_year") + 22).cast("int").alias("year"),
            (F.lit(40.0) * avg_q).alias("mmr_value"),
            (F.lit(30.0) * avg_q).alias("mmr_value_low"),
            (F.lit(50.0) * avg_q).alias("mmr_value_high"),
            F.lit(INDICATOR_LOCATION).alias("location"), code.alias("indicator_code"))
        return conform(out, WHO_MMR)

    @cached_property
    def who_sba(self) -> DataFrame:
        y = self._lineitem_years.groupBy("ship_year").agg(
            F.sum("disc_n").alias("disc_n"), F.sum("n").alias("n"))
        value = F.col("disc_n").cast("double") * F.lit(100.0) / F.col("n")
        out = y.select((F.col("ship_year") + 23).cast("int").alias("year"), value.alias("value"))
        out = out.select(
            "year", "value", F.round("value", 0).cast("int").alias("value_display"),
            F.lit(INDICATOR_LOCATION).alias("location"), F.lit(SBA_CODE).alias("indicator_code"))
        return conform(out, WHO_SBA)

    @cached_property
    def scored(self) -> DataFrame:
        joined = self.t["labels"].join(self.t["documents"].select("doc_id", "n_chars"), "doc_id")
        return _select(joined, SCORED_COLS)

    @property
    def star(self) -> "AnalogueStar":
        """The star schema itself: this object exposes the same attributes as
        :class:`~cohortlens.schemas.Star`, but builds each view only when an
        analysis touches it."""
        return self

    def tables(self) -> dict[str, DataFrame]:
        return Star.tables(self)   # same mapping, evaluated lazily per attribute

    def materialise(self) -> Star:
        return Star(geography=self.geography, woman=self.woman, birth=self.birth,
                    anc=self.anc, mortality=self.mortality, who_sba=self.who_sba,
                    who_mmr=self.who_mmr)


_STARS: "weakref.WeakKeyDictionary[SparkSession, dict[str, AnalogueStar]]" = \
    weakref.WeakKeyDictionary()


def analogue_star(spark: SparkSession, sf_dir: str) -> AnalogueStar:
    """The analogue views of one folder, built once per session (like
    registering views once) and shared by every query of that session."""
    per_session = _STARS.setdefault(spark, {})
    key = sf_dir.rstrip("/")
    if key not in per_session:
        per_session[key] = AnalogueStar(spark, key)
    return per_session[key]
