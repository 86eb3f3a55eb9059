"""Reports kept up to date from one load, instead of a recount of all rows.

Two mergeable partials are kept under a folder, each as one immutable part a load:

* ``profiles``: the full profile of every respondent the load touched (her attributes,
  place, and the sums of her care and death records), in hash buckets;
* ``sums``: the sums over respondents by state, as of the load.

A respondent's part in a state's sums is not additive in her records (her attributes count
once a joined row, see ``operators.fanout``), so a load takes the old profiles of the
respondents it touches, adds its own records, and moves the sums by the difference of their
old and new parts.  It reads the buckets that hold touched respondents, its own rows, and
one row a state.  Weighted sums are exact decimals: subtracting an old part leaves no
rounding behind.

``sums`` is written last and is the load's commit.  A load that runs again replaces its
parts and counts from the loads before it.  Facts of respondents that no load has brought
are left out, as by the inner join of the reports; the mapping gate runs before.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rates import count_pct, mean, per_thousand, weight_pct
from ..operators.fanout import _PROFILES, anc_profile, mortality_profile
from ..operators.windows import rank_desc
from ..schemas import POOR_QUINTILES, Star

BUCKETS = 64
PLACE = ["state_name", "geopolitical_zone"]
_TRAITS = ["age_at_survey", "education_level", "wealth_index", "has_insurance", "distance_barrier",
           "survey_weight", *PLACE]
_COUNTS = _PROFILES["anc"][1] + _PROFILES["mort"][1]
_EXACT = "decimal(38,6)"


def _read(spark: SparkSession, path: str, load: int) -> DataFrame | None:
    """The parts of the loads before ``load``."""
    try:
        return spark.read.option("basePath", path).parquet(path).where(F.col("load") < load)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _arrived(batch: Star) -> DataFrame:
    """One row a touched respondent: traits (null when only facts came) and her new records."""
    geo = batch.geography.select("state_id", *PLACE)
    women = batch.woman.join(geo, "state_id").select("woman_id", F.lit(True).alias("new"), *_TRAITS)
    out = women.join(anc_profile(batch.anc), "woman_id", "full") \
        .join(mortality_profile(batch.mortality), "woman_id", "full")
    return out.select("woman_id", F.coalesce("new", F.lit(False)).alias("new"), *_TRAITS,
                      *[F.coalesce(c, F.lit(0)).cast("double" if "age_sum" in c else "long").alias(c)
                        for c in _COUNTS])


def _parts() -> dict[str, Column]:
    """What one respondent adds to the sums of her state."""
    times = F.greatest(F.lit(1), F.col("mort_n")).cast("decimal(20,0)")
    rows = times * F.greatest(F.lit(1), F.col("anc_n")).cast("decimal(18,0)")
    weight = F.col("survey_weight").cast("decimal(18,6)")

    def weighted(condition: Column) -> Column:
        return F.when(condition, (weight * rows.cast("decimal(19,0)")).cast(_EXACT)).otherwise(0)

    return {
        "women": F.lit(1).cast("long"), "maternal": F.col("mort_mat"), "known": F.col("mort_known"),
        "records": F.col("anc_n"), "age": F.when(F.col("age_at_survey").isNotNull(), (F.col(
            "age_at_survey") * rows).cast("decimal(38,0)")).otherwise(0),
        "age_rows": F.when(F.col("age_at_survey").isNotNull(), rows.cast("decimal(38,0)")).otherwise(0),
        "weight": weighted(F.lit(True)), "unschooled": weighted(F.col("education_level") == "None"),
        "poor": weighted(F.col("wealth_index").isin(*POOR_QUINTILES)),
        "insured": weighted(F.col("has_insurance") == 1),
        "far": weighted(F.col("distance_barrier") == 1),
        "facility": (F.col("anc_fac1") * times).cast("decimal(38,0)"),
        "zero": (F.col("anc_zero") * times).cast("decimal(38,0)"),
        "skilled": (F.col("anc_skilled") * times).cast("decimal(38,0)")}


def _summed(profiles: DataFrame, sign: int) -> DataFrame:
    return profiles.groupBy(*PLACE).agg(*[(F.sum(part) * sign).alias(name)
                                          for name, part in _parts().items()])


def _together(tables: list[DataFrame]) -> DataFrame:
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    kinds = {n: "long" if n in ("women", "maternal", "known", "records") else
             _EXACT if n in ("weight", "unschooled", "poor", "insured", "far") else "decimal(38,0)"
             for n in _parts()}
    return every.groupBy(*PLACE).agg(*[F.sum(n).cast(k).alias(n) for n, k in kinds.items()])


def add_load(batch: Star, root: str, load: int) -> None:
    """Bring the partials under ``root`` up to date with the rows of load ``load`` (1, 2, ...).

    ``batch`` holds the load's new respondents and facts, and the geography dimension."""
    spark = batch.woman.sparkSession
    bucket = F.pmod(F.xxhash64("woman_id"), F.lit(BUCKETS)).cast("int")
    arrived = _arrived(batch).withColumn("bucket", bucket).persist()
    earlier, before = _read(spark, f"{root}/profiles", load), _read(spark, f"{root}/sums", load)
    try:
        old = None
        if earlier is not None:
            touched = [r.bucket for r in arrived.select("bucket").distinct().collect()]  # BUCKETS at most
            newest = Window.partitionBy("woman_id").orderBy(F.desc("load"))  # one row a load
            old = earlier.where(F.col("bucket").isin(touched)).join(
                arrived.select("woman_id"), "woman_id", "left_semi") \
                .withColumn("_n", F.row_number().over(newest)).where("_n = 1") \
                .select("woman_id", *_TRAITS, *_COUNTS)
        now = arrived if old is None else arrived.join(
            old.select("woman_id", F.lit(True).alias("_had"), *[F.col(c).alias(f"_old_{c}")
                                                                for c in _TRAITS + _COUNTS]),
            "woman_id", "left")
        if old is not None:
            now = now.select(
                "woman_id", "bucket", (F.col("new") | F.coalesce("_had", F.lit(False))).alias("new"),
                *[F.when(F.col("new"), F.col(c)).otherwise(F.col(f"_old_{c}")).alias(c) for c in _TRAITS],
                *[(F.col(c) + F.coalesce(f"_old_{c}", F.lit(0))).alias(c) for c in _COUNTS])
        kept, path = now.where("new").select("woman_id", "bucket", *_TRAITS, *_COUNTS), \
            f"{root}/profiles/load={load}"
        kept.write.mode("overwrite").partitionBy("bucket").parquet(path)
        written = spark.read.schema(kept.schema).parquet(path)  # an empty load has no file
        moved = [_summed(written, 1)] + ([_summed(old, -1)] if old is not None else [])
        if before is not None:
            last = before.agg(F.max("load")).first()[0]
            moved.append(before.where(F.col("load") == last).drop("load"))
        _together(moved).write.mode("overwrite").parquet(f"{root}/sums/load={load}")
    finally:
        arrived.unpersist()


def current_sums(spark: SparkSession, root: str) -> DataFrame:
    """The sums by state as of the newest load."""
    sums = _read(spark, f"{root}/sums", 1 << 31)
    if sums is None:
        raise LookupError(f"{root} holds no load")
    return sums.where(F.col("load") == sums.agg(F.max("load")).first()[0]).drop("load")


def state_burden_rank(sums: DataFrame) -> DataFrame:
    """``analyses.state_burden_rank`` from the sums."""
    return _together([sums]).select(  # one row a state, also where sums of parts are given
        rank_desc("maternal").alias("mortality_rank"), *PLACE, F.col("women").alias("total_respondents"),
        F.col("maternal").alias("maternal_deaths"), F.col("known").alias("total_female_deaths"),
        per_thousand(F.col("maternal"), F.col("women")).alias("deaths_per_1000_respondents"))


def zone_summary(sums: DataFrame) -> DataFrame:
    """``analyses.zone_summary`` (as published) from the sums."""
    z = sums.groupBy("geopolitical_zone").agg(*[F.sum(n).alias(n) for n in _parts()])
    share = {n: weight_pct(F.col(n).cast("double"), F.col("weight").cast("double"))
             for n in ("unschooled", "poor", "insured", "far")}
    out = z.select(
        "geopolitical_zone", F.col("women").alias("total_women"),
        mean(F.col("age"), F.col("age_rows")).alias("mean_age"),
        share["unschooled"].alias("pct_no_education_wtd"), share["poor"].alias("pct_poorest_poor_wtd"),
        share["insured"].alias("pct_insured_wtd"), share["far"].alias("pct_distance_barrier_wtd"),
        count_pct(F.col("facility"), F.col("records")).alias("pct_facility_delivery"),
        count_pct(F.col("zero"), F.col("records")).alias("pct_zero_anc"),
        count_pct(F.col("skilled"), F.col("records")).alias("pct_skilled_attendant"),
        F.col("maternal").alias("maternal_deaths"),
        per_thousand(F.col("maternal"), F.col("women")).alias("maternal_death_rate"))
    return out.withColumn("zone_risk_rank", rank_desc("maternal_death_rate"))
