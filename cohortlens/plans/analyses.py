"""Named analyses: the twelve analytical queries and the published extracts.

Every function takes conformed tables (a :class:`~cohortlens.schemas.Star` or a
single table) and returns a lazy DataFrame.  Fact tables are pre-aggregated to
woman grain (:mod:`cohortlens.operators.fanout`) so the only large shuffles are
one co-partitioned join on ``woman_id`` and the final (tiny) group-by; the
geography dimension is broadcast after a row-count check; windows
(rank, lag, share) run only on aggregated rows.

``mode='as_published'`` reproduces the reference's figures including the
fan-out of multi-fact joins; ``mode='per_entity'`` counts each woman once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rates import count_pct, flag, mean, per_thousand, weight_pct
from ..functions.scoring import (benchmark_verdict, care_gap_category, composite_score,
                                 min_visits_verdict, sdg_verdict, trend_direction,
                                 trend_label)
from ..operators.fanout import multiplicity, woman_grain
from ..operators.windows import lag_change, lead_drop, order_small, rank_desc, share_within
from ..schemas import POOR_QUINTILES, SKILLED_ATTENDANTS, Star

WEIGHT = "survey_weight"
# Fixed values (the reference's filters, windows and target): indicator
# location and code, the recent-birth window, the SDG maternal mortality target.
LOCATION = "Nigeria"
MMR_CODE = "MDG_0000000026"
RECENT_YEARS = (2021, 2024)
SDG_MMR_TARGET = 70.0


def _wsum(mult: Column, cond: Column | None = None) -> Column:
    """Weighted sum over the (virtual) joined rows: ``SUM(CASE WHEN c THEN w)``."""
    x = F.col(WEIGHT) * mult
    return F.sum(x if cond is None else F.when(cond, x).otherwise(F.lit(0.0)))


def _no_edu() -> Column:
    return F.col("education_level") == "None"


def _poor() -> Column:
    return F.col("wealth_index").isin(*POOR_QUINTILES)


def _double_barrier() -> Column:
    return (F.col("distance_barrier") == 1) & (F.col("has_insurance") == 0)


# ---------------------------------------------------------------------------
# Q1 — indicator trend with year-on-year change
# ---------------------------------------------------------------------------

def indicator_series(who_mmr: DataFrame, location: str = LOCATION,
                     indicator_code: str = MMR_CODE) -> DataFrame:
    return who_mmr.where((F.col("location") == location)
                         & (F.col("indicator_code") == indicator_code))


def trend_change(who_mmr: DataFrame, location: str = LOCATION,
                 indicator_code: str = MMR_CODE) -> DataFrame:
    """Year, value, band width, previous value, change and direction."""
    s = indicator_series(who_mmr, location, indicator_code)
    prev = F.lag("mmr_value").over(Window.orderBy("year"))   # one row per year
    base = s.select("year", "mmr_value", "mmr_value_low", "mmr_value_high",
                    F.round(F.col("mmr_value_high") - F.col("mmr_value_low"), 0)
                    .alias("uncertainty_range"),
                    prev.alias("prev_mmr"))
    v, p = F.col("mmr_value"), F.col("prev_mmr")
    return base.select(
        "year", "mmr_value", "mmr_value_low", "mmr_value_high", "uncertainty_range",
        p.alias("previous_mmr"),
        F.round(v - p, 0).alias("absolute_change"),
        F.round((v - p) / F.nullif(p, F.lit(0.0)) * F.lit(100.0), 1).alias("pct_change"),
        trend_direction(v, p).alias("trend_direction"),
    ).orderBy("year")


def trend_band(who_mmr: DataFrame, location: str = LOCATION,
               indicator_code: str = MMR_CODE, target: float = SDG_MMR_TARGET) -> DataFrame:
    """Series with its uncertainty band and a constant target line (chart table)."""
    return indicator_series(who_mmr, location, indicator_code).select(
        "year", "mmr_value", "mmr_value_low", "mmr_value_high",
        F.lit(float(target)).alias("target")).transform(order_small, "year")


# ---------------------------------------------------------------------------
# Q2 — state burden rank
# ---------------------------------------------------------------------------

def state_burden_rank(star: Star) -> DataFrame:
    g = woman_grain(star, ("mort",), with_geography=True)
    agg = g.groupBy("state_name", "geopolitical_zone").agg(
        F.count(F.lit(1)).alias("total_respondents"),
        F.sum("mort_mat").alias("maternal_deaths"),
        F.sum("mort_known").alias("total_female_deaths"))
    return agg.select(
        rank_desc("maternal_deaths").alias("mortality_rank"),
        "state_name", "geopolitical_zone", "total_respondents", "maternal_deaths",
        "total_female_deaths",
        per_thousand(F.col("maternal_deaths"), F.col("total_respondents"))
        .alias("deaths_per_1000_respondents"),
    ).orderBy("mortality_rank")


# ---------------------------------------------------------------------------
# Q3 — care pathway by state (single fact: rows joined directly, no fan-out)
# ---------------------------------------------------------------------------

def care_pathway_by_state(star: Star) -> DataFrame:
    """ANC rows are first summed to woman grain (partial aggregation, so a
    woman with many rows cannot skew the join), then joined to the woman and
    (broadcast) geography dimensions; the inner join keeps women with anc rows."""
    g = woman_grain(star, ("anc",), with_geography=True, mode="per_entity") \
        .where(F.col("anc_n") > 0)
    n = F.sum("anc_n")         # COUNT(DISTINCT anc_id): anc_id is the key
    agg = g.groupBy("state_name", "geopolitical_zone").agg(
        n.alias("women_with_recent_birth"),
        mean(F.sum("anc_visits_sum"), F.sum("anc_visits_known")).alias("mean_anc_visits"),
        count_pct(F.sum("anc_zero"), n).alias("pct_zero_anc"),
        count_pct(F.sum("anc_tri1"), F.sum("anc_tri_known")).alias("pct_first_trimester_anc"),
        count_pct(F.sum("anc_fac1"), n).alias("pct_facility_delivery"),
        count_pct(F.sum("anc_skilled"), n).alias("pct_skilled_attendant"),
        count_pct(F.sum("anc_post1"), F.sum("anc_post_known")).alias("pct_postnatal_check"),
    )
    return agg.withColumn(
        "care_gap_category",
        care_gap_category(F.col("pct_facility_delivery"), F.col("pct_zero_anc")),
    ).transform(order_small, F.col("pct_facility_delivery").asc_nulls_first())


# ---------------------------------------------------------------------------
# Q4 / extract — zone summary (woman x anc x mortality, fan-out aware)
# ---------------------------------------------------------------------------

def zone_summary(star: Star, mode: str = "as_published") -> DataFrame:
    g = woman_grain(star, ("anc", "mort"), with_geography=True, mode=mode)
    r = multiplicity("anc", "mort")
    m = multiplicity("mort")
    age = F.col("age_at_survey")
    agg = g.groupBy("geopolitical_zone").agg(
        F.count(F.lit(1)).alias("total_women"),
        mean(F.sum(age * r), F.sum(F.when(age.isNotNull(), r))).alias("mean_age"),
        weight_pct(_wsum(r, _no_edu()), _wsum(r)).alias("pct_no_education_wtd"),
        weight_pct(_wsum(r, _poor()), _wsum(r)).alias("pct_poorest_poor_wtd"),
        weight_pct(_wsum(r, F.col("has_insurance") == 1), _wsum(r)).alias("pct_insured_wtd"),
        weight_pct(_wsum(r, F.col("distance_barrier") == 1), _wsum(r))
        .alias("pct_distance_barrier_wtd"),
        count_pct(F.sum(F.col("anc_fac1") * m), F.sum("anc_n")).alias("pct_facility_delivery"),
        count_pct(F.sum(F.col("anc_zero") * m), F.sum("anc_n")).alias("pct_zero_anc"),
        count_pct(F.sum(F.col("anc_skilled") * m), F.sum("anc_n"))
        .alias("pct_skilled_attendant"),
        F.sum("mort_mat").alias("maternal_deaths"),
        per_thousand(F.sum("mort_mat"), F.count(F.lit(1))).alias("maternal_death_rate"),
    )
    return agg.withColumn("zone_risk_rank", rank_desc("maternal_death_rate")) \
        .orderBy(F.col("maternal_death_rate").desc_nulls_last())


def zone_extract(star: Star, mode: str = "as_published") -> DataFrame:
    """Zone extract for the dashboard (subset of Q4 with NULLIF-guarded weights)."""
    g = woman_grain(star, ("anc", "mort"), with_geography=True, mode=mode)
    r = multiplicity("anc", "mort")
    m = multiplicity("mort")
    return g.groupBy("geopolitical_zone").agg(
        F.count(F.lit(1)).alias("total_women"),
        count_pct(F.sum(F.col("anc_fac1") * m), F.sum("anc_n")).alias("pct_facility_delivery"),
        count_pct(F.sum(F.col("anc_zero") * m), F.sum("anc_n")).alias("pct_zero_anc"),
        count_pct(F.sum(F.col("anc_skilled") * m), F.sum("anc_n"))
        .alias("pct_skilled_attendant"),
        weight_pct(_wsum(r, F.col("has_insurance") == 1), _wsum(r)).alias("pct_insured"),
        weight_pct(_wsum(r, F.col("distance_barrier") == 1), _wsum(r))
        .alias("pct_distance_barrier"),
        F.sum("mort_mat").alias("maternal_deaths"),
        per_thousand(F.sum("mort_mat"), F.count(F.lit(1))).alias("death_rate"),
    ).transform(order_small, F.col("death_rate").desc_nulls_last())


# ---------------------------------------------------------------------------
# Q5 / Q6 — care utilisation by wealth quintile / education
# ---------------------------------------------------------------------------

def _care_by(star: Star, key: str, mode: str, with_age: bool) -> DataFrame:
    g = woman_grain(star, ("anc",), mode=mode)
    a = multiplicity("anc")
    # per woman: attended at least once; as published: every attended record
    skilled = F.col("anc_skilled") if mode == "as_published" else F.least(F.col("anc_skilled"), F.lit(1))
    aggs = [F.count(F.lit(1)).alias("total_women")]
    if with_age:
        age = F.col("age_at_survey")
        aggs.append(mean(F.sum(age * a), F.sum(F.when(age.isNotNull(), a))).alias("mean_age"))
    aggs += [
        mean(F.sum("anc_visits_sum"), F.sum("anc_visits_known")).alias("mean_anc_visits"),
        weight_pct(_wsum(F.col("anc_zero")), _wsum(F.col("anc_visits_known")))
        .alias("pct_zero_anc_wtd"),
        weight_pct(_wsum(F.col("anc_fac1")), _wsum(F.col("anc_fac_known")))
        .alias("pct_facility_delivery_wtd"),
        weight_pct(_wsum(skilled), _wsum(a)).alias("pct_skilled_wtd"),
        weight_pct(_wsum(a, F.col("distance_barrier") == 1), _wsum(a))
        .alias("pct_distance_barrier_wtd"),
        weight_pct(_wsum(a, F.col("has_insurance") == 1), _wsum(a)).alias("pct_insured_wtd"),
    ]
    agg = g.groupBy(key).agg(*aggs)
    return agg.withColumn("facility_delivery_rank", rank_desc("pct_facility_delivery_wtd")) \
        .orderBy("facility_delivery_rank")


def rates_by_quintile(star: Star, mode: str = "as_published") -> DataFrame:
    return _care_by(star, "wealth_index", mode, with_age=False)


def rates_by_education(star: Star, mode: str = "as_published") -> DataFrame:
    return _care_by(star, "education_level", mode, with_age=True)


def _care_extract(star: Star, key: str, mode: str, with_insured: bool) -> DataFrame:
    g = woman_grain(star, ("anc",), mode=mode)
    a = multiplicity("anc")
    aggs = [
        weight_pct(_wsum(F.col("anc_fac1")), _wsum(F.col("anc_fac_known")))
        .alias("pct_facility_delivery"),
        weight_pct(_wsum(F.col("anc_zero")), _wsum(F.col("anc_visits_known")))
        .alias("pct_zero_anc"),
        mean(F.sum("anc_visits_sum"), F.sum("anc_visits_known")).alias("mean_anc_visits"),
    ]
    if with_insured:
        aggs.append(weight_pct(_wsum(a, F.col("has_insurance") == 1), _wsum(a))
                    .alias("pct_insured"))
    return g.groupBy(key).agg(*aggs).transform(order_small, F.col("pct_facility_delivery").desc_nulls_last())


def wealth_extract(star: Star, mode: str = "as_published") -> DataFrame:
    return _care_extract(star, "wealth_index", mode, with_insured=True)


def education_extract(star: Star, mode: str = "as_published") -> DataFrame:
    return _care_extract(star, "education_level", mode, with_insured=False)


# ---------------------------------------------------------------------------
# Q7 — yearly skilled-attendance coverage (two-level aggregate + lag)
# ---------------------------------------------------------------------------

def yearly_coverage_by_zone(star: Star, years: tuple[int, int] = RECENT_YEARS) -> DataFrame:
    """Births are summed to (woman, year) before the join: the join input is
    bounded by women x years and a woman with many births is reduced map-side."""
    geo = star.geography.select("state_id", "geopolitical_zone")
    per_woman_year = (star.birth.where(F.col("birth_year").between(*years)
                                       & F.col("delivery_location").isNotNull())
                      .groupBy("woman_id", "birth_year")
                      .agg(F.count("birth_id").alias("n"),
                           F.sum("skilled_attendant").alias("skilled")))
    rows = (per_woman_year.join(star.woman.select("woman_id", "state_id"), "woman_id")
            .join(geo, "state_id"))
    return rows.groupBy("birth_year", "geopolitical_zone").agg(
        F.sum("n").alias("total_births"),
        F.sum("skilled").alias("skilled_births"),
        count_pct(F.sum("skilled"), F.sum("n")).alias("pct_skilled"))


def yearly_coverage(star: Star, years: tuple[int, int] = RECENT_YEARS) -> DataFrame:
    yz = yearly_coverage_by_zone(star, years)
    nat = yz.groupBy("birth_year").agg(
        F.sum("total_births").alias("total_births"),
        count_pct(F.sum("skilled_births"), F.sum("total_births")).alias("national_pct_skilled"))
    nat = lag_change(nat, "national_pct_skilled", "birth_year",
                     prev_name="prev_year_pct", change_name="yoy_change")
    return nat.select("birth_year", "total_births", "national_pct_skilled", "prev_year_pct",
                      "yoy_change", trend_label(F.col("yoy_change")).alias("trend")) \
        .orderBy("birth_year")


# ---------------------------------------------------------------------------
# Q8 — barriers by zone
# ---------------------------------------------------------------------------

def barriers_by_zone(star: Star, mode: str = "as_published") -> DataFrame:
    g = woman_grain(star, ("anc",), with_geography=True, mode=mode)
    a = multiplicity("anc")
    distant = F.col("distance_barrier") == 1
    agg = g.groupBy("geopolitical_zone").agg(
        F.count(F.lit(1)).alias("total_women"),
        weight_pct(_wsum(a, distant), _wsum(a)).alias("pct_distance_barrier"),
        weight_pct(_wsum(a, F.col("has_insurance") == 1), _wsum(a)).alias("pct_insured"),
        weight_pct(_wsum(a, _double_barrier()), _wsum(a)).alias("pct_double_barrier"),
        weight_pct(_wsum(a, (F.col("wealth_index") == "Poorest") & (F.col("has_insurance") == 0)),
                   _wsum(a)).alias("pct_poorest_uninsured"),
        weight_pct(_wsum(F.col("anc_zero"), distant), _wsum(F.col("anc_visits_known"), distant))
        .alias("pct_zero_anc_among_distant"),
        weight_pct(_wsum(F.col("anc_fac1"), distant), _wsum(F.col("anc_fac_known"), distant))
        .alias("pct_facility_among_distant"),
    )
    return agg.withColumn("barrier_rank", rank_desc("pct_double_barrier")) \
        .orderBy("barrier_rank")


# ---------------------------------------------------------------------------
# Q9 / extract — composite risk score by state (join of two aggregates)
# ---------------------------------------------------------------------------

def _score() -> Column:
    return composite_score(F.col("death_rate"), F.col("pct_zero_anc"),
                           F.col("pct_facility_delivery"), F.col("pct_double_barrier"))


def composite_risk(star: Star, mode: str = "as_published") -> DataFrame:
    """Both source aggregates group by state over the same woman grain, and the
    woman-grain profiles carry no fan-out between the two facts, so their join
    on ``state_name`` is one aggregate here (one pass over the women)."""
    g = woman_grain(star, ("anc", "mort"), with_geography=True, mode=mode)
    a = multiplicity("anc")
    women = F.count(F.lit(1))
    scored = g.groupBy("state_name").agg(
        women.alias("total_women"),
        F.sum("mort_mat").alias("maternal_deaths"),
        per_thousand(F.sum("mort_mat"), women).alias("death_rate"),
        count_pct(F.sum("anc_fac1"), F.sum("anc_n")).alias("pct_facility_delivery"),
        count_pct(F.sum("anc_zero"), F.sum("anc_n")).alias("pct_zero_anc"),
        weight_pct(_wsum(a, _double_barrier()), _wsum(a)).alias("pct_double_barrier"),
    ).withColumn("composite_risk_score", _score())
    return scored.select(
        rank_desc("composite_risk_score").alias("priority_rank"),
        "state_name", "total_women", "maternal_deaths", "death_rate", "pct_facility_delivery",
        "pct_zero_anc", "pct_double_barrier", "composite_risk_score",
    ).orderBy("priority_rank")


def state_risk_extract(star: Star, mode: str = "as_published") -> DataFrame:
    """Deaths by (state, zone) and care figures by state from one pass over the women:
    sums by (state, zone), then the state's sums by a window over those few rows."""
    g = woman_grain(star, ("anc", "mort"), with_geography=True, mode=mode)
    a = multiplicity("anc")
    places = g.groupBy("state_name", "geopolitical_zone").agg(
        F.count(F.lit(1)).alias("total_women"), F.sum("mort_mat").alias("maternal_deaths"),
        *[F.sum(c).alias(c) for c in ("anc_n", "anc_fac1", "anc_zero", "anc_skilled", "anc_post1",
                                      "anc_post_known")],
        _wsum(a).alias("_w"), _wsum(a, _double_barrier()).alias("_w_double"),
        _wsum(a, _poor()).alias("_w_poor"))

    def of_state(c: str) -> Column:
        return F.sum(c).over(Window.partitionBy("state_name"))

    scored = places.select(
        "state_name", "geopolitical_zone", "total_women", "maternal_deaths",
        per_thousand(F.col("maternal_deaths"), F.col("total_women")).alias("death_rate"),
        count_pct(of_state("anc_fac1"), of_state("anc_n")).alias("pct_facility_delivery"),
        count_pct(of_state("anc_zero"), of_state("anc_n")).alias("pct_zero_anc"),
        count_pct(of_state("anc_skilled"), of_state("anc_n")).alias("pct_skilled_attendant"),
        weight_pct(of_state("_w_double"), of_state("_w")).alias("pct_double_barrier"),
        weight_pct(of_state("_w_poor"), of_state("_w")).alias("pct_poorest_poor"),
        count_pct(of_state("anc_post1"), of_state("anc_post_known")).alias("pct_postnatal_check"))
    return scored.withColumn("composite_risk_score", _score()).transform(
        order_small, F.col("composite_risk_score").desc_nulls_last())


# ---------------------------------------------------------------------------
# Q10 / extract — death profile by zone and outcome category
# ---------------------------------------------------------------------------

DEATH_CATEGORIES = ("Maternal Death", "Non-Maternal Death", "No Death Recorded", "Unknown")


def _category_rows(category: str) -> tuple[Column, Column, Column]:
    """(joined mortality rows, age sum, age count) of one woman in ``category``."""
    if category == "Maternal Death":
        return F.col("mort_mat"), F.col("mort_mat_age_sum"), F.col("mort_mat_age_n")
    if category == "Non-Maternal Death":
        return F.col("mort_nonmat"), F.col("mort_nonmat_age_sum"), F.col("mort_nonmat_age_n")
    if category == "Unknown":
        return (F.col("mort_n") - F.col("mort_known"), F.col("mort_unk_age_sum"),
                F.col("mort_unk_age_n"))
    if category == "No Death Recorded":
        none = F.when(F.col("mort_n") == 0, F.lit(1)).otherwise(F.lit(0))
        return none, F.lit(0.0), F.lit(0)
    raise ValueError(f"unknown death category {category!r}")


def death_profile_all(star: Star, mode: str = "as_published") -> DataFrame:
    """Profile of women by zone and sister-death outcome, all four categories
    in one pass: each woman emits at most one row per category present in her
    record (``inline`` of <= 4 structs), then one group-by."""
    g = woman_grain(star, ("anc", "mort"), with_geography=True, mode=mode)
    a = multiplicity("anc")
    cats = []
    for cat in DEATH_CATEGORIES:
        rows, age_sum, age_n = _category_rows(cat)
        if mode == "as_published":      # joined rows: deaths x anc rows
            r, k, s_, n_ = rows * a, rows, age_sum * a, age_n * a
        else:                           # each woman once
            r, k, s_, n_ = F.lit(1).cast("bigint"), F.lit(1).cast("bigint"), age_sum, age_n
        cats.append(F.when(rows > 0, F.struct(
            F.lit(cat).alias("death_category"), r.cast("decimal(38,0)").alias("_r"),
            k.cast("decimal(38,0)").alias("_k"), s_.cast("double").alias("_age_sum"),
            n_.cast("decimal(38,0)").alias("_age_n"))))
    long = g.select("geopolitical_zone", "survey_weight", "education_level", "wealth_index",
                    "has_insurance", "distance_barrier", "anc_fac1", "anc_fac_known", "anc_zero",
                    "anc_visits_known", F.inline(F.filter(F.array(*cats), lambda x: x.isNotNull())))
    r, k = F.col("_r"), F.col("_k")
    return long.groupBy("geopolitical_zone", "death_category").agg(
        F.count(F.lit(1)).alias("women_count"),
        mean(F.sum("_age_sum"), F.sum("_age_n")).alias("mean_age_at_death"),
        weight_pct(_wsum(r, _no_edu()), _wsum(r)).alias("pct_no_education"),
        weight_pct(_wsum(r, _poor()), _wsum(r)).alias("pct_poorest_poor"),
        weight_pct(_wsum(r, F.col("has_insurance") == 1), _wsum(r)).alias("pct_insured"),
        weight_pct(_wsum(r, F.col("distance_barrier") == 1), _wsum(r))
        .alias("pct_distance_barrier"),
        weight_pct(_wsum(k * F.col("anc_fac1")), _wsum(k * F.col("anc_fac_known")))
        .alias("pct_facility_delivery"),
        weight_pct(_wsum(k * F.col("anc_zero")), _wsum(k * F.col("anc_visits_known")))
        .alias("pct_zero_anc"),
    )


def death_profile(star: Star, category: str = "Maternal Death",
                  mode: str = "as_published") -> DataFrame:
    """The reference's report: one outcome category (filter on the group key)."""
    if category not in DEATH_CATEGORIES:
        raise ValueError(f"unknown death category {category!r}")
    return death_profile_all(star, mode).where(F.col("death_category") == category) \
        .transform(order_small, "geopolitical_zone", F.col("women_count").desc())


def death_profile_extract(star: Star, mode: str = "as_published") -> DataFrame:
    """Maternal deaths by zone: counts deaths (not women), fan-out over anc rows."""
    g = woman_grain(star, ("anc", "mort"), with_geography=True, mode=mode) \
        .where(F.col("mort_mat") > 0)
    a = multiplicity("anc")
    r = F.col("mort_mat") * a if mode == "as_published" else F.lit(1)
    k = F.col("mort_mat") if mode == "as_published" else F.lit(1)
    ages = (F.col("mort_mat_age_sum") * a, F.col("mort_mat_age_n") * a) \
        if mode == "as_published" else (F.col("mort_mat_age_sum"), F.col("mort_mat_age_n"))
    return g.groupBy("geopolitical_zone").agg(
        mean(F.sum(ages[0]), F.sum(ages[1])).alias("mean_age_at_death"),
        weight_pct(_wsum(r, _no_edu()), _wsum(r)).alias("pct_no_education"),
        weight_pct(_wsum(r, _poor()), _wsum(r)).alias("pct_poorest_poor"),
        weight_pct(_wsum(k * F.col("anc_fac1")), _wsum(k * F.col("anc_fac_known")))
        .alias("pct_facility_delivery"),
        F.sum("mort_mat").alias("total_deaths"),
    ).transform(order_small, F.col("total_deaths").desc())


# ---------------------------------------------------------------------------
# Q11 — national figures vs indicator benchmarks (7 rows)
# ---------------------------------------------------------------------------

def national_figures(star: Star, years: tuple[int, int] = RECENT_YEARS,
                     mode: str = "as_published") -> DataFrame:
    """One row of national survey figures (woman x anc x recent births x deaths)."""
    recent = F.col("birth_year").between(*years) & F.col("delivery_location").isNotNull()
    g = woman_grain(star, ("anc", "birth", "mort"), birth_where=recent, mode=mode)
    r = multiplicity("anc", "birth", "mort")
    bm = multiplicity("birth", "mort")
    am = multiplicity("anc", "mort")
    if mode == "as_published":
        skilled = weight_pct(_wsum(am * F.col("birth_skilled")), _wsum(r))
    else:
        skilled = weight_pct(_wsum(F.col("birth_skilled")), _wsum(F.col("birth_n")))
    return g.agg(
        weight_pct(_wsum(bm * F.col("anc_fac1")), _wsum(bm * F.col("anc_fac_known")))
        .alias("dhs_facility_delivery"),
        skilled.alias("dhs_skilled_attendant"),
        weight_pct(_wsum(bm * F.col("anc_zero")), _wsum(bm * F.col("anc_visits_known")))
        .alias("dhs_zero_anc"),
        mean(F.sum(bm * F.col("anc_visits_sum")), F.sum(bm * F.col("anc_visits_known")))
        .alias("dhs_mean_anc"),
        weight_pct(_wsum(r, F.col("has_insurance") == 1), _wsum(r)).alias("dhs_insurance"),
        F.sum("mort_mat").alias("dhs_maternal_deaths"),
        weight_pct(_wsum(bm * F.col("anc_post1")), _wsum(bm * F.col("anc_post_known")))
        .alias("dhs_postnatal_care"),
    )


def year_pivot(series: DataFrame, value: str, years: list[int], prefix: str) -> DataFrame:
    """``MAX(CASE WHEN year = Y THEN value END)`` for each year: one row."""
    return series.agg(*[F.max(F.when(F.col("year") == y, F.col(value))).alias(f"{prefix}_{y}")
                        for y in years])


def benchmark_report(star: Star, years: tuple[int, int] = RECENT_YEARS,
                     location: str = LOCATION, mmr_code: str = MMR_CODE,
                     mode: str = "as_published") -> DataFrame:
    dn = national_figures(star, years, mode)
    wr = year_pivot(star.who_sba.where(F.col("location") == location), "value",
                    [2024, 2022, 2018], "who_sba")
    wm = year_pivot(indicator_series(star.who_mmr, location, mmr_code), "mmr_value",
                    [2023, 2020, 2015], "who_mmr")
    one = dn.crossJoin(wr).crossJoin(wm)          # 1 x 1 x 1 rows
    null = F.lit(None).cast("double")
    specific = F.lit("DHS specific -- no direct WHO equivalent")

    def row(name: str, value: Column, w24: Column, w22: Column, w18: Column,
            verdict: Column) -> Column:
        return F.struct(F.lit(name).alias("indicator"), value.cast("double").alias("dhs_value"),
                        w24.alias("who_2024"), w22.alias("who_2022"), w18.alias("who_2018"),
                        verdict.alias("vs_who_2024"))

    c = F.col
    rows = F.array(
        row("Skilled Birth Attendant (%)", c("dhs_skilled_attendant"), c("who_sba_2024"),
            c("who_sba_2022"), c("who_sba_2018"),
            benchmark_verdict(c("dhs_skilled_attendant"), c("who_sba_2024"))),
        row("Facility Delivery (%)", c("dhs_facility_delivery"), null, null, null, specific),
        row("Zero ANC Attendance (%)", c("dhs_zero_anc"), null, null, null, specific),
        row("Mean ANC Visits", c("dhs_mean_anc"), null, null, null,
            min_visits_verdict(c("dhs_mean_anc"))),
        row("Health Insurance Coverage (%)", c("dhs_insurance"), null, null, null,
            F.lit("Critically low -- systemic failure")),
        row("Postnatal Care Within 2 Days (%)", c("dhs_postnatal_care"), null, null, null,
            specific),
        row("MMR per 100,000 (WHO 2023)", c("who_mmr_2023"), c("who_mmr_2023"),
            c("who_mmr_2020"), c("who_mmr_2015"), sdg_verdict(c("who_mmr_2023"))),
    )
    return one.select(F.inline(rows))


# ---------------------------------------------------------------------------
# Q12 — attendant share within zone
# ---------------------------------------------------------------------------

def share_within_zone(star: Star) -> DataFrame:
    geo = star.geography.select("state_id", "geopolitical_zone")
    per_woman = (star.anc.where(F.col("delivery_assisted_by").isNotNull())
                 .groupBy("woman_id", "delivery_assisted_by")
                 .agg(F.count(F.lit(1)).alias("n")))
    rows = (per_woman.join(star.woman.select("woman_id", "state_id"), "woman_id")
            .join(geo, "state_id"))
    counts = rows.groupBy("geopolitical_zone", "delivery_assisted_by") \
        .agg(F.sum("n").alias("deliveries"))
    return share_within(counts, "deliveries", ["geopolitical_zone"], "pct_within_zone") \
        .transform(order_small, "geopolitical_zone", F.col("deliveries").desc())


# ---------------------------------------------------------------------------
# Care pathway funnel (one scan, six stages)
# ---------------------------------------------------------------------------

FUNNEL_STAGES = [
    ("Women with Recent Birth", 1),
    ("Any ANC Attendance", 2),
    ("4+ ANC Visits", 3),
    ("Facility Delivery", 4),
    ("Skilled Birth Attendant", 5),
    ("Postnatal Check Within 2 Days", 6),
]


def care_funnel(star: Star) -> DataFrame:
    """Stage counts over the cohort with a known delivery place, in one scan:
    the cohort's ANC rows are summed per woman first (so a woman with many
    rows is one row before the semi-join to the woman dimension), then one
    global aggregate gives all six stages."""
    vis = F.col("anc_visits")
    per_woman = star.anc.where(F.col("facility_delivery").isNotNull()) \
        .groupBy("woman_id").agg(
            F.sum(flag(vis > 0)).alias("s2"),
            F.sum(flag(vis >= 4)).alias("s3"),
            F.sum(flag(F.col("facility_delivery") == 1)).alias("s4"),
            F.sum(flag(F.col("delivery_assisted_by").isin(*SKILLED_ATTENDANTS))).alias("s5"),
            F.sum(flag(F.col("postnatal_check") == 1)).alias("s6"))
    cohort = per_woman.join(star.woman.select("woman_id"), "woman_id", "left_semi")
    one = cohort.agg(F.count(F.lit(1)).alias("s1"),
                     *[F.sum(f"s{i}").alias(f"s{i}") for i in range(2, 7)])
    stages = F.array(*[
        F.struct(F.lit(name).alias("stage"), F.coalesce(F.col(f"s{i}"), F.lit(0))
                 .cast("bigint").alias("women_count"), F.lit(i).alias("stage_order"))
        for name, i in FUNNEL_STAGES])
    return one.select(F.inline(stages)).orderBy("stage_order")


def care_funnel_drop(star: Star) -> DataFrame:
    """Funnel with percentage of the first stage and the drop to the next stage
    (half-even rounding, as the chart code rounds)."""
    first = F.max(F.when(F.col("stage_order") == 1, F.col("women_count"))).over(
        Window.partitionBy(F.lit(0)))                            # six rows
    pct = F.bround(F.col("women_count") / F.nullif(first, F.lit(0)) * F.lit(100.0), 1)
    out = care_funnel(star).withColumn("pct_of_first", pct)
    out = lead_drop(out, "pct_of_first", "stage_order", "drop_to_next")
    return out.select("stage", "stage_order", "women_count", "pct_of_first", "drop_to_next") \
        .orderBy("stage_order")


# ---------------------------------------------------------------------------
# National KPI table (computed, not hard-coded)
# ---------------------------------------------------------------------------

def national_kpis(star: Star, years: tuple[int, int] = RECENT_YEARS,
                  location: str = LOCATION, mmr_code: str = MMR_CODE) -> DataFrame:
    """Eight headline indicators as (indicator, value) rows.

    Definitions: MMR = latest value of the indicator series; facility delivery
    = unweighted share of known delivery places; zero ANC, insurance and
    postnatal = survey-weighted, one count per woman, known-value
    denominators; skilled attendant = births in ``years`` with a known place;
    deaths = pregnancy-related sister deaths; women = respondents.
    """
    mmr = indicator_series(star.who_mmr, location, mmr_code).agg(
        F.max_by("mmr_value", "year").alias("k1"))
    g = woman_grain(star, ("anc",), mode="per_entity")
    women = g.agg(
        count_pct(F.sum("anc_fac1"), F.sum("anc_fac_known")).alias("k2"),
        weight_pct(_wsum(F.col("anc_zero")), _wsum(F.col("anc_visits_known"))).alias("k3"),
        weight_pct(_wsum(F.lit(1), F.col("has_insurance") == 1), _wsum(F.lit(1))).alias("k5"),
        weight_pct(_wsum(F.col("anc_post1")), _wsum(F.col("anc_post_known"))).alias("k6"),
        F.count(F.lit(1)).alias("k8"))
    births = star.birth.where(F.col("birth_year").between(*years)
                              & F.col("delivery_location").isNotNull()) \
        .agg(count_pct(F.sum("skilled_attendant"), F.count(F.lit(1))).alias("k4"))
    deaths = star.mortality.agg(F.sum(flag(F.col("pregnancy_related") == 1)).alias("k7"))
    one = mmr.crossJoin(women).crossJoin(births).crossJoin(deaths)
    names = ["MMR per 100,000 (WHO 2023)", "Facility Delivery Rate (%)",
             "Zero ANC Attendance (%)", "Skilled Attendant 2021-2024 (%)",
             "Health Insurance Coverage (%)", "Postnatal Care Within 2 Days (%)",
             "Confirmed Maternal Deaths (DHS)", "Women Surveyed"]
    rows = F.array(*[F.struct(F.lit(n).alias("indicator"),
                              F.col(f"k{i}").cast("double").alias("value"))
                     for i, n in enumerate(names, start=1)])
    return one.select(F.inline(rows))
