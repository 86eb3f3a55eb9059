"""DuckDB oracle SQL for every checkable ``queries()`` key.

The analogue views (conformed star schema over the driver tables) are emitted
as CTEs from the same column expressions the Spark side uses
(:mod:`cohortlens.sources.analogue`).  The queries themselves are written
independently, as plain joins and aggregates — multi-fact joins really fan out
here, so they check the woman-grain algebra of the Spark plans.

DuckDB typing notes: SUM over integers is HUGEINT and RANK is BIGINT, so both
are cast to the Spark result types; every denominator is NULLIF-guarded;
NULL ordering in windows is explicit.
"""

from __future__ import annotations

from cohortlens.schemas import TABLE_SCHEMAS
from cohortlens.sources import analogue as A
from cohortlens.sources import rawviews as RV


def _cols(cols: dict[str, str]) -> str:
    return ", ".join(f"{expr} AS {name}" for name, expr in cols.items())


def _views() -> str:
    anc_src = "orders AS o"
    mmr_keys = ", ".join(f"{e} AS {k}" for k, e in A.MMR_KEYS.items())
    mmr_aggs = ", ".join(f"{e} AS {k}" for k, e in A.MMR_AGGS.items())
    sba_keys = ", ".join(f"{e} AS {k}" for k, e in A.SBA_KEYS.items())
    sba_aggs = ", ".join(f"{e} AS {k}" for k, e in A.SBA_AGGS.items())
    parts = {
        "dim_geography": f"SELECT {_cols(A.GEOGRAPHY_COLS)} FROM nation "
                         "JOIN region ON n_regionkey = r_regionkey",
        "dim_woman": f"SELECT {_cols(A.WOMAN_COLS)} FROM customer",
        "fact_birth": f"SELECT {_cols(A.BIRTH_COLS)} FROM orders",
        "fact_anc_delivery": f"SELECT {_cols(A.ANC_COLS)} FROM {anc_src}",
        "fact_maternal_mortality": f"SELECT {_cols(A.MORTALITY_COLS)} FROM events",
        "who_nigeria_mmr": f"SELECT {mmr_keys}, {mmr_aggs}, '{A.INDICATOR_LOCATION}' AS location "
                           "FROM lineitem GROUP BY ALL",
        "who_sba_raw": f"SELECT {sba_keys}, {sba_aggs} FROM lineitem GROUP BY ALL",
        "who_nigeria_sba": "SELECT year, value, CAST(round(value, 0) AS INT) AS value_display, "
                           f"'{A.INDICATOR_LOCATION}' AS location, "
                           f"'{A.SBA_CODE}' AS indicator_code FROM who_sba_raw",
        "scored": f"SELECT {_cols(A.SCORED_COLS)} FROM labels JOIN documents USING (doc_id)",
    }
    parts.update(RV.oracle_views())
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in parts.items())


def _wrap(body: str) -> str:
    return f"{_views()}\nSELECT * FROM ({body}) AS q"


def cpct(num: str, den: str, d: int = 1, scale: int = 100) -> str:
    return f"ROUND(CAST({num} AS DOUBLE) * {scale} / NULLIF({den}, 0), {d})"


def wpct(num: str, den: str, d: int = 1) -> str:
    return f"ROUND({num} / NULLIF({den}, 0) * 100, {d})"


def ws(cond: str | None = None, w: str = "dw.survey_weight") -> str:
    return f"SUM({w})" if cond is None else f"SUM(CASE WHEN {cond} THEN {w} ELSE 0 END)"


def flagsum(cond: str) -> str:
    return f"CAST(SUM(CASE WHEN {cond} THEN 1 ELSE 0 END) AS BIGINT)"


def rank_desc(col: str) -> str:
    return f"CAST(RANK() OVER (ORDER BY {col} DESC NULLS LAST) AS INTEGER)"


SKILLED = "('Doctor', 'Nurse or Midwife', 'Auxiliary Midwife')"
GEO_JOIN = "dim_woman dw JOIN dim_geography dg ON dw.state_id = dg.state_id"
SERIES = ("FROM who_nigeria_mmr WHERE location = 'Nigeria' "
          "AND indicator_code = 'MDG_0000000026'")

Q: dict[str, str] = {}

# ---------------------------------------------------------------------------
# Measures over the joined tables.  A measure is a condition and the rows it is a
# share of; ``_weighted`` and ``_counted`` turn it into a percentage.  The tables are
# really joined here (woman x care records x deaths x births), so a woman with many
# records counts many times, as the published figures do.
# ---------------------------------------------------------------------------

_PEOPLE = "dim_woman JOIN dim_geography USING (state_id)"
_WITH_CARE = "LEFT JOIN fact_anc_delivery USING (woman_id)"
_WITH_DEATHS = "LEFT JOIN fact_maternal_mortality USING (woman_id)"
_WITH_RECENT_BIRTHS = ("LEFT JOIN (SELECT woman_id, skilled_attendant FROM fact_birth WHERE birth_year "
                       "BETWEEN 2021 AND 2024 AND delivery_location IS NOT NULL) USING (woman_id)")

_SHARES = {
    "unschooled": ("education_level = 'None'", "TRUE"),
    "poor": ("wealth_index IN ('Poorest', 'Poor')", "TRUE"),
    "insured": ("has_insurance = 1", "TRUE"),
    "far": ("distance_barrier = 1", "TRUE"),
    "far and uninsured": ("distance_barrier = 1 AND has_insurance = 0", "TRUE"),
    "in a facility": ("facility_delivery = 1", "facility_delivery IS NOT NULL"),
    "no visit": ("anc_visits = 0", "anc_visits IS NOT NULL"),
    "checked after": ("postnatal_check = 1", "postnatal_check IS NOT NULL"),
    "attended": (f"delivery_assisted_by IN {SKILLED}", "TRUE"),
    "attended birth": ("skilled_attendant = 1", "TRUE"),
    "early visit": ("first_anc_trimester = 1", "first_anc_trimester IS NOT NULL"),
    "poorest and uninsured": ("wealth_index = 'Poorest' AND has_insurance = 0", "TRUE"),
    "far, no visit": ("distance_barrier = 1 AND anc_visits = 0",
                      "distance_barrier = 1 AND anc_visits IS NOT NULL"),
    "far, in a facility": ("distance_barrier = 1 AND facility_delivery = 1",
                           "distance_barrier = 1 AND facility_delivery IS NOT NULL"),
}


def _weighted(share: str) -> str:
    """Weighted percentage of a share."""
    condition, base = _SHARES[share]
    return wpct(f"SUM(survey_weight * CAST(coalesce({condition}, FALSE) AS INT))",
                f"SUM(survey_weight) FILTER ({base})")


def _counted(share: str, of: str | None = None) -> str:
    """Percentage of rows; ``of`` replaces the rows of the share's own base."""
    condition, base = _SHARES[share]
    return cpct(f"COUNT(*) FILTER ({condition})", of or f"COUNT(*) FILTER ({base})")


_DEATHS = "COUNT(DISTINCT mortality_id) FILTER (pregnancy_related = 1)"
_ANY_RECORD = "COUNT(DISTINCT anc_id)"
_WOMEN = "COUNT(DISTINCT woman_id)"
_PLACES = "state_name, geopolitical_zone"


def _mean(column: str) -> str:
    return f"ROUND(AVG({column}), 1)"


def _grouped(keys: str, rows: str, **measures: str) -> str:
    named = ", ".join(f"{m} AS {name}" for name, m in measures.items())
    return f"SELECT {keys}, {named} FROM {rows} GROUP BY {keys}"


def _ranked(body: str, by: str, name: str) -> str:
    return f"SELECT *, {rank_desc(by)} AS {name} FROM ({body})"


def _after(body: str, key: str, value: str) -> str:
    """Rows of ``body`` beside the row before by ``key``: its value is ``earlier``."""
    return (f"(WITH steps AS ({body}) SELECT now.*, past.{value} AS earlier FROM steps AS now "
            f"ASOF LEFT JOIN steps AS past ON now.{key} > past.{key})")


def _direction(change: str, down: str, same: str, up: str) -> str:
    """The label of a change by its sign; the first row has none to compare with."""
    return f"coalesce(['{down}', '{same}', '{up}'][CAST(sign({change}) AS INT) + 2], 'Baseline')"


# Labels of the directions, care gaps and their limits.
Q["trend_change"] = f"""
SELECT * EXCLUDE (location, indicator_code, earlier), earlier AS previous_mmr,
       ROUND(mmr_value_high - mmr_value_low, 0) AS uncertainty_range,
       ROUND(mmr_value - earlier, 0) AS absolute_change,
       ROUND((mmr_value - earlier) / NULLIF(earlier, 0) * 100, 1) AS pct_change,
       {_direction('mmr_value - earlier', 'Improving', 'No Change', 'Worsening')} AS trend_direction
FROM {_after(f"SELECT * {SERIES}", "year", "mmr_value")}"""

Q["trend_band"] = f"""
SELECT year, mmr_value, mmr_value_low, mmr_value_high, CAST(70 AS DOUBLE) AS target {SERIES}"""

Q["state_burden_rank"] = _ranked(_grouped(
    _PLACES, f"{_PEOPLE} {_WITH_DEATHS}", total_respondents=_WOMEN, maternal_deaths=_DEATHS,
    total_female_deaths="COUNT(DISTINCT mortality_id) FILTER (pregnancy_related IN (0, 1))",
    deaths_per_1000_respondents=cpct(_DEATHS, _WOMEN, 2, 1000)), "maternal_deaths", "mortality_rank")

_STATE_CARE = _grouped(
    _PLACES, f"{_PEOPLE} JOIN fact_anc_delivery USING (woman_id)", women_with_recent_birth="COUNT(*)",
    mean_anc_visits=_mean("anc_visits"), pct_zero_anc=_counted("no visit", "COUNT(*)"),
    pct_first_trimester_anc=_counted("early visit"),
    pct_facility_delivery=_counted("in a facility", "COUNT(*)"),
    pct_skilled_attendant=_counted("attended"), pct_postnatal_check=_counted("checked after"))
Q["care_pathway_by_state"] = f"""
SELECT *, CASE least(if(pct_facility_delivery < 20 AND pct_zero_anc > 30, 1, 3),
                     if(pct_facility_delivery < 40 AND pct_zero_anc > 20, 2, 3))
          WHEN 1 THEN 'Critical Care Gap' WHEN 2 THEN 'Significant Care Gap'
          ELSE 'Moderate' END AS care_gap_category
FROM ({_STATE_CARE})"""

# A zone's women as they come out of a join: with one row each, or with one a record.
_ZONE_WOMEN = {
    "total_women": _WOMEN, "mean_age": _mean("age_at_survey"),
    "pct_no_education_wtd": _weighted("unschooled"), "pct_poorest_poor_wtd": _weighted("poor"),
    "pct_insured_wtd": _weighted("insured"), "pct_distance_barrier_wtd": _weighted("far")}
_ZONE_CARE = {
    "pct_facility_delivery": _counted("in a facility", _ANY_RECORD),
    "pct_zero_anc": _counted("no visit", _ANY_RECORD),
    "pct_skilled_attendant": _counted("attended", _ANY_RECORD)}
_ALL_RECORDS = f"{_PEOPLE} {_WITH_CARE} {_WITH_DEATHS}"

Q["zone_summary_published"] = _ranked(_grouped(
    "geopolitical_zone", _ALL_RECORDS, **_ZONE_WOMEN, **_ZONE_CARE, maternal_deaths=_DEATHS,
    maternal_death_rate=cpct(_DEATHS, _WOMEN, 2, 1000)), "maternal_death_rate", "zone_risk_rank")

_ZONE_ONCE = f"""
SELECT * FROM ({_grouped("geopolitical_zone", _PEOPLE, **_ZONE_WOMEN)})
LEFT JOIN ({_grouped("geopolitical_zone", f"{_PEOPLE} JOIN fact_anc_delivery USING (woman_id)",
                     **_ZONE_CARE)}) USING (geopolitical_zone)
LEFT JOIN (SELECT geopolitical_zone, COUNT(*) AS died FROM {_PEOPLE}
           JOIN fact_maternal_mortality USING (woman_id) WHERE pregnancy_related = 1
           GROUP BY geopolitical_zone) USING (geopolitical_zone)"""
Q["zone_summary_per_entity"] = _ranked(f"""
SELECT * EXCLUDE (died), coalesce(died, 0) AS maternal_deaths,
       {cpct('coalesce(died, 0)', 'total_women', 2, 1000)} AS maternal_death_rate
FROM ({_ZONE_ONCE})""", "maternal_death_rate", "zone_risk_rank")

Q["zone_extract"] = _grouped(
    "geopolitical_zone", _ALL_RECORDS, total_women=_WOMEN, **_ZONE_CARE,
    pct_insured=_weighted("insured"), pct_distance_barrier=_weighted("far"), maternal_deaths=_DEATHS,
    death_rate=cpct(_DEATHS, _WOMEN, 2, 1000))


def _care_by(key: str, **more: str) -> str:
    return _ranked(_grouped(
        key, f"dim_woman {_WITH_CARE}", total_women=_WOMEN, mean_anc_visits=_mean("anc_visits"),
        pct_zero_anc_wtd=_weighted("no visit"), pct_facility_delivery_wtd=_weighted("in a facility"),
        pct_skilled_wtd=_weighted("attended"), pct_distance_barrier_wtd=_weighted("far"),
        pct_insured_wtd=_weighted("insured"), **more),
        "pct_facility_delivery_wtd", "facility_delivery_rank")


def _care_once(key: str, with_age: bool) -> str:
    """Every woman once; an attendance rate is the share of women attended at all."""
    age = "ROUND(AVG(age_at_survey), 1) AS mean_age," if with_age else ""
    return f"""
WITH w AS (
  SELECT d.woman_id, ANY_VALUE(d.{key}) AS {key}, ANY_VALUE(age_at_survey) AS age_at_survey,
         ANY_VALUE(survey_weight) AS weight, ANY_VALUE(has_insurance) AS insured,
         ANY_VALUE(distance_barrier) AS far, SUM(anc_visits) AS visits, COUNT(anc_visits) AS known,
         COUNT(*) FILTER (anc_visits = 0) AS zero, COUNT(*) FILTER (facility_delivery = 1) AS fac,
         COUNT(facility_delivery) AS fac_known,
         bool_or(coalesce(delivery_assisted_by IN {SKILLED}, false)) AS attended
  FROM dim_woman d LEFT JOIN fact_anc_delivery a ON a.woman_id = d.woman_id GROUP BY d.woman_id),
c AS (
  SELECT {key}, COUNT(*) AS total_women, {age}
         ROUND(CAST(SUM(visits) AS DOUBLE) / NULLIF(SUM(known), 0), 1) AS mean_anc_visits,
         ROUND(SUM(weight * zero) / NULLIF(SUM(weight * known), 0) * 100, 1) AS pct_zero_anc_wtd,
         ROUND(SUM(weight * fac) / NULLIF(SUM(weight * fac_known), 0) * 100, 1)
           AS pct_facility_delivery_wtd,
         ROUND(SUM(weight * CAST(attended AS INT)) / SUM(weight) * 100, 1) AS pct_skilled_wtd,
         ROUND(coalesce(SUM(weight) FILTER (far = 1), 0) / SUM(weight) * 100, 1) AS pct_distance_barrier_wtd,
         ROUND(coalesce(SUM(weight) FILTER (insured = 1), 0) / SUM(weight) * 100, 1) AS pct_insured_wtd
  FROM w GROUP BY {key})
SELECT *, {rank_desc('pct_facility_delivery_wtd')} AS facility_delivery_rank FROM c"""


Q["rates_by_quintile"] = _care_by("wealth_index")
Q["rates_by_education"] = _care_by("education_level", mean_age=_mean("age_at_survey"))
Q["rates_by_quintile_per_entity"] = _care_once("wealth_index", False)
Q["rates_by_education_per_entity"] = _care_once("education_level", True)

_EXTRACT = {"pct_facility_delivery": _weighted("in a facility"), "pct_zero_anc": _weighted("no visit"),
            "mean_anc_visits": _mean("anc_visits")}
Q["wealth_extract"] = _grouped("wealth_index", f"dim_woman {_WITH_CARE}", **_EXTRACT,
                               pct_insured=_weighted("insured"))
Q["education_extract"] = _grouped("education_level", f"dim_woman {_WITH_CARE}", **_EXTRACT)

# Births with a known place in the four years of the report.
_REPORTED_BIRTHS = (f"(SELECT * FROM fact_birth JOIN ({_PEOPLE}) USING (woman_id) WHERE birth_year "
                    "IN (2021, 2022, 2023, 2024) AND length(delivery_location) >= 0)")
Q["yearly_coverage_by_zone"] = _grouped(
    "birth_year, geopolitical_zone", _REPORTED_BIRTHS, total_births="COUNT(*)",
    skilled_births="COUNT(*) FILTER (skilled_attendant = 1)", pct_skilled=_counted("attended birth"))

_COVERAGE = _grouped("birth_year", _REPORTED_BIRTHS, total_births="COUNT(*)",
                     national_pct_skilled=_counted("attended birth"))
Q["yearly_coverage"] = f"""
SELECT * EXCLUDE (earlier), earlier AS prev_year_pct, national_pct_skilled - earlier AS yoy_change,
       {_direction('national_pct_skilled - earlier', 'Declining', 'Stable', 'Improving')} AS trend
FROM {_after(_COVERAGE, "birth_year", "national_pct_skilled")}"""

Q["barriers_by_zone"] = _ranked(_grouped(
    "geopolitical_zone", f"{_PEOPLE} {_WITH_CARE}", total_women=_WOMEN,
    pct_distance_barrier=_weighted("far"), pct_insured=_weighted("insured"),
    pct_double_barrier=_weighted("far and uninsured"),
    pct_poorest_uninsured=_weighted("poorest and uninsured"),
    pct_zero_anc_among_distant=_weighted("far, no visit"),
    pct_facility_among_distant=_weighted("far, in a facility")), "pct_double_barrier", "barrier_rank")


def _state_scores(columns: str, places: str) -> str:
    """Deaths per 1,000 women and care shares of each of ``places``, with the weighted
    composite of four of them."""
    risk = " + ".join(f"{part} * CAST({weight} AS DOUBLE)" for part, weight in (
        ("death_rate / CAST(30 AS DOUBLE) * 100", 0.35), ("pct_zero_anc", 0.25),
        ("(100 - pct_facility_delivery)", 0.25), ("pct_double_barrier", 0.15)))
    return f"""
WITH death_side AS (
  SELECT {places}, COUNT(DISTINCT woman_id) AS total_women, {_DEATHS} AS maternal_deaths,
         {cpct(_DEATHS, 'COUNT(DISTINCT woman_id)', 2, 1000)} AS death_rate
  FROM {_PEOPLE} {_WITH_DEATHS} GROUP BY {places}),
care_side AS (
  SELECT state_name, {_counted('in a facility', _ANY_RECORD)} AS pct_facility_delivery,
         {_counted('no visit', _ANY_RECORD)} AS pct_zero_anc,
         {_counted('attended', _ANY_RECORD)} AS pct_skilled_attendant,
         {_weighted('far and uninsured')} AS pct_double_barrier,
         {_weighted('poor')} AS pct_poorest_poor,
         {_counted('checked after')} AS pct_postnatal_check
  FROM {_PEOPLE} {_WITH_CARE} GROUP BY state_name),
scored_places AS (SELECT *, ROUND({risk}, 1) AS composite_risk_score
                  FROM death_side JOIN care_side USING (state_name))
SELECT {columns} FROM scored_places"""


Q["composite_risk"] = _state_scores(
    f"{rank_desc('composite_risk_score')} AS priority_rank, state_name, total_women, "
    "maternal_deaths, death_rate, pct_facility_delivery, pct_zero_anc, pct_double_barrier, "
    "composite_risk_score", "state_name")
Q["state_risk_extract"] = _state_scores("*", "state_name, geopolitical_zone")

# A death's outcome names the group that its (woman x care record) rows belong to.
_OUTCOME = """CASE pregnancy_related WHEN 1 THEN 'Maternal Death' WHEN 0 THEN 'Non-Maternal Death'
              ELSE if(mortality_id IS NULL, 'No Death Recorded', 'Unknown') END"""
Q["death_profile_all"] = f"""
SELECT geopolitical_zone, {_OUTCOME} AS death_category, COUNT(DISTINCT woman_id) AS women_count,
       ROUND(AVG(sibling_age_at_death), 1) AS mean_age_at_death,
       {_weighted('unschooled')} AS pct_no_education, {_weighted('poor')} AS pct_poorest_poor,
       {_weighted('insured')} AS pct_insured, {_weighted('far')} AS pct_distance_barrier,
       {_weighted('in a facility')} AS pct_facility_delivery, {_weighted('no visit')} AS pct_zero_anc
FROM {_PEOPLE} {_WITH_CARE} {_WITH_DEATHS} GROUP BY ALL"""
Q["death_profile"] = (f"SELECT * FROM ({Q['death_profile_all']}) WHERE death_category = "
                      "'Maternal Death'")
Q["death_profile_extract"] = f"""
SELECT geopolitical_zone, ROUND(AVG(sibling_age_at_death), 1) AS mean_age_at_death,
       {_weighted('unschooled')} AS pct_no_education, {_weighted('poor')} AS pct_poorest_poor,
       {_weighted('in a facility')} AS pct_facility_delivery,
       COUNT(DISTINCT mortality_id) AS total_deaths
FROM {_PEOPLE} {_WITH_CARE} {_WITH_DEATHS} WHERE pregnancy_related = 1 GROUP BY geopolitical_zone"""

Q["national_figures"] = f"""
SELECT {_weighted('in a facility')} AS dhs_facility_delivery,
       {_weighted('attended birth')} AS dhs_skilled_attendant, {_weighted('no visit')} AS dhs_zero_anc,
       ROUND(AVG(anc_visits), 1) AS dhs_mean_anc, {_weighted('insured')} AS dhs_insurance,
       {_DEATHS} AS dhs_maternal_deaths, {_weighted('checked after')} AS dhs_postnatal_care
FROM dim_woman {_WITH_CARE} {_WITH_RECENT_BIRTHS} {_WITH_DEATHS}"""

# Indicator names and verdicts of the report.
_NO_EQUIVALENT = "'DHS specific -- no direct WHO equivalent'"
Q["benchmark_report"] = f"""
WITH survey AS ({Q['national_figures']}),
attendance AS (PIVOT (SELECT year, value FROM who_nigeria_sba WHERE location = 'Nigeria')
               ON year IN (2024, 2022, 2018) USING max(value)),
mortality AS (PIVOT (SELECT year, mmr_value {SERIES}) ON year IN (2023, 2020, 2015)
              USING max(mmr_value)),
lines AS (
  SELECT unnest([
    {{'indicator': 'Skilled Birth Attendant (%)', 'dhs_value': CAST(dhs_skilled_attendant AS DOUBLE),
      'verdict': NULL}},
    {{'indicator': 'Facility Delivery (%)', 'dhs_value': dhs_facility_delivery,
      'verdict': {_NO_EQUIVALENT}}},
    {{'indicator': 'Zero ANC Attendance (%)', 'dhs_value': dhs_zero_anc, 'verdict': {_NO_EQUIVALENT}}},
    {{'indicator': 'Mean ANC Visits', 'dhs_value': dhs_mean_anc, 'verdict': if(dhs_mean_anc >= 4,
      'Meets', 'Below') || ' WHO minimum of 4 visits'}},
    {{'indicator': 'Health Insurance Coverage (%)', 'dhs_value': dhs_insurance,
      'verdict': 'Critically low -- systemic failure'}},
    {{'indicator': 'Postnatal Care Within 2 Days (%)', 'dhs_value': dhs_postnatal_care,
      'verdict': {_NO_EQUIVALENT}}}], recursive := true) FROM survey)
SELECT indicator, dhs_value, if(verdict IS NULL, "2024", NULL) AS who_2024,
       if(verdict IS NULL, "2022", NULL) AS who_2022, if(verdict IS NULL, "2018", NULL) AS who_2018,
       coalesce(verdict, CASE WHEN abs(dhs_value - "2024") <= 5 THEN 'Consistent with WHO'
                              WHEN dhs_value < "2024" THEN 'Below WHO estimate'
                              ELSE 'Above WHO estimate' END) AS vs_who_2024
FROM lines, attendance
UNION ALL SELECT 'MMR per 100,000 (WHO 2023)', "2023", "2023", "2020", "2015",
       if("2023" > 70, 'Far above SDG target of 70', 'Meets SDG target') FROM mortality"""

Q["national_figures_per_entity"] = f"""
WITH wa AS (
  SELECT {wpct(ws('fa.facility_delivery = 1'), ws('fa.facility_delivery IS NOT NULL'))} AS dhs_facility_delivery,
         {wpct(ws('fa.anc_visits = 0'), ws('fa.anc_visits IS NOT NULL'))} AS dhs_zero_anc,
         ROUND(AVG(fa.anc_visits), 1) AS dhs_mean_anc,
         (SELECT {wpct(ws('dw.has_insurance = 1'), ws())} FROM dim_woman dw) AS dhs_insurance,
         {wpct(ws('fa.postnatal_check = 1'), ws('fa.postnatal_check IS NOT NULL'))} AS dhs_postnatal_care
  FROM dim_woman dw LEFT JOIN fact_anc_delivery fa ON dw.woman_id = fa.woman_id),
wb AS (
  SELECT {wpct(ws('fb.skilled_attendant = 1'), ws())} AS dhs_skilled_attendant
  FROM dim_woman dw JOIN fact_birth fb ON dw.woman_id = fb.woman_id
  WHERE fb.birth_year BETWEEN 2021 AND 2024 AND fb.delivery_location IS NOT NULL),
wm AS (
  SELECT CAST(COUNT(*) AS BIGINT) AS dhs_maternal_deaths
  FROM fact_maternal_mortality fm JOIN dim_woman dw ON dw.woman_id = fm.woman_id
  WHERE fm.pregnancy_related = 1)
SELECT wa.dhs_facility_delivery, wb.dhs_skilled_attendant, wa.dhs_zero_anc, wa.dhs_mean_anc,
       wa.dhs_insurance, wm.dhs_maternal_deaths, wa.dhs_postnatal_care
FROM wa, wb, wm"""

_CARE_PER_WOMAN = """
  SELECT woman_id, COUNT(*) FILTER (facility_delivery = 1) AS fac, COUNT(facility_delivery) AS fac_known,
         COUNT(*) FILTER (anc_visits = 0) AS zero, COUNT(anc_visits) AS visits_known
  FROM fact_anc_delivery GROUP BY woman_id"""

Q["death_profile_per_entity"] = f"""
WITH cat AS (SELECT DISTINCT woman_id FROM fact_maternal_mortality WHERE pregnancy_related = 1),
women AS (
  SELECT dw.*, dg.geopolitical_zone, care.* EXCLUDE (woman_id)
  FROM {GEO_JOIN} JOIN cat ON cat.woman_id = dw.woman_id
       LEFT JOIN ({_CARE_PER_WOMAN}) care ON dw.woman_id = care.woman_id),
ages AS (
  SELECT dg.geopolitical_zone, ROUND(AVG(fm.sibling_age_at_death), 1) AS mean_age_at_death
  FROM {GEO_JOIN} JOIN fact_maternal_mortality fm ON dw.woman_id = fm.woman_id
  WHERE fm.pregnancy_related = 1 GROUP BY dg.geopolitical_zone),
z AS (
  SELECT geopolitical_zone, 'Maternal Death' AS death_category, COUNT(*) AS women_count,
         {wpct(ws("education_level = 'None'", 'survey_weight'), ws(None, 'survey_weight'))} AS pct_no_education,
         {wpct(ws("wealth_index IN ('Poorest', 'Poor')", 'survey_weight'), ws(None, 'survey_weight'))}
           AS pct_poorest_poor,
         {wpct(ws('has_insurance = 1', 'survey_weight'), ws(None, 'survey_weight'))} AS pct_insured,
         {wpct(ws('distance_barrier = 1', 'survey_weight'), ws(None, 'survey_weight'))} AS pct_distance_barrier,
         {wpct('SUM(survey_weight * fac)', 'SUM(survey_weight * fac_known)')} AS pct_facility_delivery,
         {wpct('SUM(survey_weight * zero)', 'SUM(survey_weight * visits_known)')} AS pct_zero_anc
  FROM women GROUP BY geopolitical_zone)
SELECT z.*, ages.mean_age_at_death FROM z LEFT JOIN ages USING (geopolitical_zone)"""

Q["share_within_zone"] = f"""
WITH attendants AS (SELECT geopolitical_zone, delivery_assisted_by, COUNT(anc_id) AS deliveries
                    FROM {_PEOPLE} JOIN fact_anc_delivery USING (woman_id)
                    WHERE delivery_assisted_by <> '' GROUP BY ALL),
zones AS (SELECT geopolitical_zone, SUM(deliveries) AS every FROM attendants GROUP BY ALL)
SELECT geopolitical_zone, delivery_assisted_by, deliveries,
       ROUND(deliveries * 100.0 / every, 1) AS pct_within_zone
FROM attendants JOIN zones USING (geopolitical_zone)"""

# The stages of the funnel.
_STAGES = [("Women with Recent Birth", "COUNT(DISTINCT woman_id)"),
           ("Any ANC Attendance", "COUNT(*) FILTER (anc_visits >= 1)"),
           ("4+ ANC Visits", "COUNT(*) FILTER (anc_visits >= 4)"),
           ("Facility Delivery", "COUNT(*) FILTER (facility_delivery = 1)"),
           ("Skilled Birth Attendant", f"COUNT(*) FILTER (delivery_assisted_by IN {SKILLED})"),
           ("Postnatal Check Within 2 Days", "COUNT(*) FILTER (postnatal_check = 1)")]
_FUNNEL = f"""
WITH counts AS (SELECT [{', '.join(c for _, c in _STAGES)}] AS n FROM dim_woman
                JOIN fact_anc_delivery USING (woman_id) WHERE facility_delivery >= 0),
f AS (SELECT unnest({[name for name, _ in _STAGES]}) AS stage, unnest(n) AS women_count,
             unnest(range(1, {len(_STAGES) + 1})) AS stage_order FROM counts)"""

Q["care_funnel"] = _FUNNEL + "\nSELECT stage, CAST(women_count AS BIGINT) AS women_count, " \
    "CAST(stage_order AS INTEGER) AS stage_order FROM f"

Q["care_funnel_drop"] = _FUNNEL + """,
p AS (
  SELECT stage, CAST(stage_order AS INTEGER) AS stage_order, CAST(women_count AS BIGINT) AS women_count,
         round_even(women_count / NULLIF(MAX(CASE WHEN stage_order = 1 THEN women_count END) OVER (), 0)
                    * 100.0, 1) AS pct_of_first
  FROM f)
SELECT *, round_even(pct_of_first - LEAD(pct_of_first) OVER (ORDER BY stage_order), 1) AS drop_to_next
FROM p"""

# The names of the indicators.
_KPIS = [
    ("MMR per 100,000 (WHO 2023)", f"SELECT arg_max(mmr_value, year) {SERIES}"),
    ("Facility Delivery Rate (%)", f"SELECT {_counted('in a facility')} FROM fact_anc_delivery"),
    ("Zero ANC Attendance (%)", f"SELECT {_weighted('no visit')} FROM dim_woman {_WITH_CARE}"),
    ("Skilled Attendant 2021-2024 (%)",
     f"SELECT {_counted('attended birth')} FROM dim_woman {_WITH_RECENT_BIRTHS} "
     "WHERE skilled_attendant IS NOT NULL"),
    ("Health Insurance Coverage (%)", f"SELECT {_weighted('insured')} FROM dim_woman"),
    ("Postnatal Care Within 2 Days (%)",
     f"SELECT {_weighted('checked after')} FROM dim_woman {_WITH_CARE}"),
    ("Confirmed Maternal Deaths (DHS)",
     "SELECT COUNT(*) FROM fact_maternal_mortality WHERE pregnancy_related = 1"),
    ("Women Surveyed", "SELECT COUNT(*) FROM dim_woman")]
Q["national_kpis"] = " UNION ALL ".join(
    f"SELECT '{name}' AS indicator, CAST(({figure}) AS DOUBLE) AS value" for name, figure in _KPIS)

Q["year_pivot"] = f"""
SELECT (SELECT MAX(CASE WHEN year = 2024 THEN value END) FROM who_nigeria_sba WHERE location = 'Nigeria') AS who_sba_2024,
       (SELECT MAX(CASE WHEN year = 2022 THEN value END) FROM who_nigeria_sba WHERE location = 'Nigeria') AS who_sba_2022,
       (SELECT MAX(CASE WHEN year = 2018 THEN value END) FROM who_nigeria_sba WHERE location = 'Nigeria') AS who_sba_2018,
       (SELECT MAX(CASE WHEN year = 2023 THEN mmr_value END) {SERIES}) AS who_mmr_2023,
       (SELECT MAX(CASE WHEN year = 2020 THEN mmr_value END) {SERIES}) AS who_mmr_2020,
       (SELECT MAX(CASE WHEN year = 2015 THEN mmr_value END) {SERIES}) AS who_mmr_2015"""

Q["latest_value"] = """
SELECT year, value FROM who_nigeria_sba WHERE location = 'Nigeria' ORDER BY year DESC LIMIT 1"""


def oracle_sql() -> dict[str, str]:
    out = {k: _wrap(v) for k, v in Q.items()}
    return out


# ---------------------------------------------------------------------------
# ETL layer (raw wide extract)
# ---------------------------------------------------------------------------

from cohortlens.sources.rawviews import (N_BIRTH_SLOTS, N_DELIVERY_SLOTS,  # noqa: E402
                                         N_SISTER_SLOTS)


def TITLE(x: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all(lower(trim({x})), "
            f"'(\\p{{L}}+|\\P{{L}}+)'), lambda s: upper(s[1]) || s[2:]), '')")


# Survey answers and the words that name a place, an attendant or a cause.
EDUCATION = [("None", ["0", "no education"]), ("Primary", ["1", "primary"]),
             ("Secondary", ["2", "secondary"]), ("Higher", ["3", "higher"])]
WEALTH = [("Poorest", ["1", "poorest"]), ("Poor", ["2", "poorer"]), ("Middle", ["3", "middle"]),
          ("Rich", ["4", "richer"]), ("Richest", ["5", "richest"])]
ANSWER = [(0, ["0", "no"]), (1, ["1", "yes"])]
ALIVE = [(1, ["1", "yes"]), (0, ["0", "no", "dead"])]
BARRIER = [(1, ["1", "big problem"]), (0, ["2", "3", "not a big problem", "not a problem"])]
AT_HOME = ["home", "respondent", "her home", "other home", "parents"]
GOVERNMENT = ["government", "public", "health centre", "health post", "hospital", "maternity",
              "dispensary"]
PRIVATE = ["private", "clinic", "ngo", "mission"]
FACILITIES = ["government", "public", "private", "clinic", "hospital", "health centre",
              "health post", "ngo", "mission"]
MATERNAL_CAUSES = ["pregnant", "delivery", "6 weeks", "2 months", "died while", "died during"]
ATTENDANTS = [("m3a", "Doctor"), ("m3b", "Nurse or Midwife"), ("m3c", "Auxiliary Midwife"),
              ("m3d", "Traditional Birth Attendant"), ("m3e", "Other")]


def KEY(x: str) -> str:
    return f"lower(trim(CAST({x} AS VARCHAR)))"


def TXT(x: str) -> str:
    return f"coalesce({KEY(x)}, 'nan')"


def _lit(v) -> str:
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


def RECODE(x: str, answers: list) -> str:
    return ("CASE " + " ".join(f"WHEN {KEY(x)} IN ({', '.join(map(_lit, codes))}) THEN {_lit(v)}"
                               for v, codes in answers) + " END")


def ANY(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({TXT(x)}, {_lit(w)})" for w in words) + ")"


def INTOF(x: str) -> str:
    d = f"CASE WHEN NOT isnan(TRY_CAST(trim(CAST({x} AS VARCHAR)) AS DOUBLE)) " \
        f"THEN TRY_CAST(trim(CAST({x} AS VARCHAR)) AS DOUBLE) END"
    return f"CASE WHEN {d} = floor({d}) THEN CAST({d} AS INTEGER) END"


def RAWDBL(x: str) -> str:
    return f"TRY_CAST(trim(CAST({x} AS VARCHAR)) AS DOUBLE)"


def DBL(x: str) -> str:
    return f"CASE WHEN NOT isnan({RAWDBL(x)}) THEN {RAWDBL(x)} END"


def LOCATION(x: str) -> str:
    return (f"CASE WHEN {ANY(x, AT_HOME)} THEN 'Home' "
            f"WHEN {ANY(x, GOVERNMENT)} THEN 'Government Facility' "
            f"WHEN {ANY(x, PRIVATE)} THEN 'Private Facility' "
            f"WHEN {TXT(x)} IN ('nan', 'none', '') THEN NULL ELSE 'Other' END")


def FACILITY(x: str) -> str:
    return (f"CASE WHEN {ANY(x, FACILITIES)} THEN 1 "
            f"WHEN {TXT(x)} IN ('nan', 'none', '') THEN NULL ELSE 0 END")


def YES(x: str) -> str:
    return f"{TXT(x)} IN ('1', 'yes')"


SKILLED_FLAG = "CASE WHEN " + " OR ".join(YES(c) for c in ("m3a", "m3b", "m3c")) \
    + " THEN 1 ELSE 0 END"
PRIORITY = ("CASE " + " ".join(f"WHEN {YES(k)} THEN {_lit(v)}" for k, v in ATTENDANTS)
            + " ELSE 'None' END")


def VISITS(x: str) -> str:
    v, d = TXT(x), f"TRY_CAST({TXT(x)} AS DOUBLE)"
    return (f"CASE WHEN {v} IN ('no antenatal visits', '0') THEN 0 "
            f"WHEN {d} IS NULL OR isnan({d}) THEN NULL WHEN {d} >= 98 THEN NULL "
            f"ELSE CAST(trunc({d}) AS INTEGER) END")


def TRIMESTER(x: str) -> str:
    d = RAWDBL(x)
    return (f"CASE WHEN {d} IS NULL THEN NULL WHEN isnan({d}) THEN 3 WHEN {d} >= 98 THEN NULL "
            f"WHEN {d} <= 3 THEN 1 WHEN {d} <= 6 THEN 2 ELSE 3 END")


def CAUSE(x: str) -> str:
    return (f"CASE WHEN {ANY(x, MATERNAL_CAUSES)} THEN 1 "
            f"WHEN contains({TXT(x)}, 'not related') THEN 0 END")


def _birth_slot(i: int) -> str:
    if i <= N_DELIVERY_SLOTS:
        dl = (f"m15_{i} AS delivery_location_raw, m3a_{i} AS m3a, m3b_{i} AS m3b, "
              f"m3c_{i} AS m3c, m3d_{i} AS m3d, m3e_{i} AS m3e")
    else:
        dl = ", ".join(f"CAST(NULL AS VARCHAR) AS {c}"
                       for c in ("delivery_location_raw", "m3a", "m3b", "m3c", "m3d", "m3e"))
    return (f"SELECT trim(caseid) AS dhs_case_id, {i} AS birth_number, bord_{i:02d} AS bo, "
            f"b2_{i:02d} AS byr, b5_{i:02d} AS ca, {dl} FROM wide WHERE bord_{i:02d} IS NOT NULL")


_BIRTHS = " UNION ALL ".join(_birth_slot(i) for i in range(1, N_BIRTH_SLOTS + 1))
_SISTERS = " UNION ALL ".join(
    f"SELECT trim(caseid) AS dhs_case_id, {j} AS sibling_number, CAST(v008 AS DOUBLE) AS icmc, "
    f"{KEY(f'mm1_{j:02d}')} AS sex, {KEY(f'mm2_{j:02d}')} AS alive, "
    f"{DBL(f'mm8_{j:02d}')} AS dcmc, {DBL(f'mm4_{j:02d}')} AS bcmc, mm9_{j:02d} AS cause_raw "
    f"FROM wide" for j in range(1, N_SISTER_SLOTS + 1))
_YEARS = "round_even((icmc - dcmc) / 12.0, 1)"
_SIS = f"""sis AS (
  SELECT *, CASE WHEN {_YEARS} >= 0 THEN {_YEARS} END AS years_since_death FROM ({_SISTERS}) t),
sis2 AS (
  SELECT *, CASE WHEN round_even((icmc - years_since_death * 12.0 - bcmc) / 12.0, 0) BETWEEN 10 AND 80
                 THEN round_even((icmc - years_since_death * 12.0 - bcmc) / 12.0, 0) END
              AS sibling_age_at_death,
            CASE WHEN dcmc > 0 THEN 1900 + CAST(trunc((dcmc - 1) / 12.0) AS INTEGER) END AS death_year,
            {CAUSE('cause_raw')} AS pregnancy_related
  FROM sis)"""
_MORT_FILTER = ("sex IN ('2', 'female') AND alive IN ('0', 'no', 'dead') "
                "AND years_since_death IS NOT NULL AND years_since_death <= 7")

Q["project_woman"] = """
SELECT caseid AS dhs_case_id, sstate AS state_name, v102 AS urban_rural, v012 AS age_at_survey,
       v106 AS education_level, v190 AS wealth_index, v481 AS has_insurance,
       v467d AS distance_barrier, v005 AS survey_weight FROM wide"""

Q["text_normalise"] = f"""
SELECT trim(caseid) AS dhs_case_id, {TITLE('sstate')} AS state_name,
       {TITLE('v024')} AS geopolitical_zone, {TITLE('v102')} AS urban_rural FROM wide"""

Q["recode_map"] = f"""
SELECT trim(caseid) AS dhs_case_id, {RECODE('v106', EDUCATION)} AS education_level,
       {RECODE('v190', WEALTH)} AS wealth_index, {RECODE('v481', ANSWER)} AS has_insurance,
       {RECODE('v467d', BARRIER)} AS distance_barrier,
       {DBL('v005')} / CAST(1000000 AS DOUBLE) AS survey_weight FROM wide"""

Q["coerce_numeric"] = f"""
SELECT trim(caseid) AS dhs_case_id, {INTOF('v012')} AS age_at_survey, {INTOF('b2_01')} AS birth_year_1,
       {DBL('mm8_01')} AS death_cmc_1, {DBL('m13_1')} AS months_first_anc FROM wide"""

Q["classify_text"] = f"""
SELECT dhs_case_id, birth_number, delivery_location_raw, {LOCATION('delivery_location_raw')} AS delivery_location,
       {FACILITY('delivery_location_raw')} AS facility_delivery FROM ({_BIRTHS}) b"""

Q["any_flag"] = f"SELECT dhs_case_id, birth_number, {SKILLED_FLAG} AS skilled_attendant FROM ({_BIRTHS}) b"
Q["priority_label"] = f"SELECT dhs_case_id, birth_number, {PRIORITY} AS delivery_assisted_by FROM ({_BIRTHS}) b"
Q["wide_to_long"] = f"""
SELECT dhs_case_id, birth_number, {INTOF('bo')} AS birth_order, {INTOF('byr')} AS birth_year,
       {RECODE('ca', ALIVE)} AS child_alive FROM ({_BIRTHS}) b"""

Q["clean_counts"] = f"""
SELECT trim(caseid) AS dhs_case_id, m14_1 AS anc_visits_raw, {VISITS('m14_1')} AS anc_visits FROM wide"""
Q["bin_months"] = f"""
SELECT trim(caseid) AS dhs_case_id, m13_1 AS months_raw, {TRIMESTER('m13_1')} AS first_anc_trimester FROM wide"""

Q["classify_cause"] = f"""
WITH {_SIS} SELECT dhs_case_id, sibling_number, cause_raw, pregnancy_related FROM sis2"""
Q["cmc_dates"] = f"""
WITH {_SIS} SELECT dhs_case_id, sibling_number, years_since_death, death_year, sibling_age_at_death FROM sis2"""

_GEO_RAW = f"""
g AS (SELECT CAST(v001 AS INTEGER) AS c, {TITLE('sstate')} AS state_name,
             {TITLE('v024')} AS zone, {TITLE('v102')} AS urban_rural FROM wide),
m AS (SELECT state_name, urban_rural, min(c) AS c FROM g GROUP BY ALL),
geo AS (SELECT m.state_name, m.urban_rural, m.c AS dhs_cluster_id, min(g.zone) AS geopolitical_zone
        FROM m JOIN g USING (state_name, urban_rural, c) GROUP BY ALL)"""

Q["dim_dedupe"] = f"WITH {_GEO_RAW} SELECT * FROM geo"

Q["etl_row_counts"] = f"""
WITH {_GEO_RAW}, {_SIS}
SELECT 'who_nigeria_sba' AS table_name, (SELECT COUNT(*) FROM who_nigeria_sba) AS row_count
UNION ALL SELECT 'who_nigeria_mmr', (SELECT COUNT(*) FROM who_nigeria_mmr)
UNION ALL SELECT 'dim_geography', (SELECT COUNT(*) FROM geo)
UNION ALL SELECT 'dim_woman', (SELECT COUNT(*) FROM wide)
UNION ALL SELECT 'fact_birth', (SELECT COUNT(*) FROM ({_BIRTHS}) b)
UNION ALL SELECT 'fact_anc_delivery', (SELECT COUNT(*) FROM wide WHERE m15_1 IS NOT NULL)
UNION ALL SELECT 'fact_maternal_mortality', (SELECT COUNT(*) FROM sis2 WHERE {_MORT_FILTER})"""

Q["fk_lookup_unmapped"] = f"""
WITH {_GEO_RAW}, {_SIS},
known AS (SELECT DISTINCT trim(caseid) AS dhs_case_id FROM wide)
SELECT 'dim_woman.state_id' AS foreign_key, (SELECT COUNT(*) FROM wide WHERE NOT EXISTS (
    SELECT 1 FROM geo WHERE state_name = {TITLE('sstate')} AND urban_rural = {TITLE('v102')}))
    AS unmapped_rows
UNION ALL SELECT 'fact_birth.woman_id', (SELECT COUNT(*) FROM ({_BIRTHS}) b ANTI JOIN known USING (dhs_case_id))
UNION ALL SELECT 'fact_anc_delivery.woman_id', (SELECT COUNT(*) FROM (
    SELECT trim(caseid) AS dhs_case_id FROM wide WHERE m15_1 IS NOT NULL) a ANTI JOIN known USING (dhs_case_id))
UNION ALL SELECT 'fact_maternal_mortality.woman_id', (SELECT COUNT(*) FROM (
    SELECT * FROM sis2 WHERE {_MORT_FILTER}) m ANTI JOIN known USING (dhs_case_id))"""

Q["repeated_keys"] = f"""
WITH {_GEO_RAW}
SELECT 'dim_geography' AS table_name, CAST(COUNT(*) - COUNT(DISTINCT (state_name, urban_rural)) AS BIGINT)
       AS rows FROM geo
UNION ALL SELECT 'dim_woman', CAST(COALESCE(SUM(n) FILTER (n > 1), 0) AS BIGINT)
FROM (SELECT COUNT(*) AS n FROM wide GROUP BY trim(caseid))"""

Q["surviving_deaths"] = f"""
WITH {_SIS} SELECT dhs_case_id, sibling_number, sex AS sibling_sex, alive AS sibling_alive,
       years_since_death, sibling_age_at_death, death_year, pregnancy_related
FROM sis2 WHERE {_MORT_FILTER}"""

Q["wide_csv_labels"] = """
SELECT trim(caseid) AS caseid, CAST(v012 AS VARCHAR) AS v012,
       CASE trim(v106) WHEN '0' THEN 'no schooling' WHEN '1' THEN 'primary school' ELSE trim(v106) END AS v106,
       CASE trim(v190) WHEN '5' THEN 'top fifth' ELSE trim(v190) END AS v190,
       CASE trim(v481) WHEN '1' THEN 'covered' ELSE trim(v481) END AS v481 FROM wide"""

Q["indicator_csv"] = """
SELECT year, mmr_value, mmr_value_low, mmr_value_high, location, indicator_code FROM who_nigeria_mmr"""

Q["csv_backup"] = "SELECT COLUMNS(*)::VARCHAR FROM fact_birth"

Q["null_counts"] = "SELECT 'dim_woman' AS table_name, column_name, null_count FROM (" \
    "SELECT " + ", ".join(f"COUNT(*) - COUNT({c}) AS {c}" for c in A.WOMAN_COLS) \
    + " FROM dim_woman) UNPIVOT (null_count FOR column_name IN (" + ", ".join(A.WOMAN_COLS) + "))"

Q["column_presence"] = """
SELECT c AS column_name, CASE WHEN EXISTS (
    SELECT 1 FROM information_schema.columns WHERE table_name = 'customer' AND column_name = c)
  THEN 'FOUND' ELSE 'MISSING' END AS status
FROM (VALUES ('c_custkey'), ('c_acctbal'), ('c_birthday'), ('c_mktsegment')) AS needed(c)"""

Q["top_births"] = """
SELECT CAST(row_number() OVER (ORDER BY birth_id DESC) - 1 AS INTEGER) AS position, birth_id, woman_id
FROM fact_birth QUALIFY position < 10"""

Q["report_order"] = f"""
SELECT CAST(row_number() OVER (ORDER BY pct_facility_delivery NULLS FIRST) - 1 AS INTEGER) AS position,
       pct_facility_delivery FROM ({Q['care_pathway_by_state']}) t"""

Q["report_order_two_keys"] = f"""
SELECT CAST(row_number() OVER (ORDER BY geopolitical_zone, women_count DESC) - 1 AS INTEGER) AS position,
       geopolitical_zone, women_count FROM ({Q['death_profile']}) t"""

# ---------------------------------------------------------------------------
# persisted keys: numbered by load, then by natural key
# ---------------------------------------------------------------------------

_KEYS = """
SELECT dhs_case_id, if(dhs_case_id LIKE '% 1', 1, 2) AS load,
       row_number() OVER (ORDER BY load, dhs_case_id) AS key
FROM (SELECT DISTINCT trim(caseid) AS dhs_case_id FROM wide)"""
Q["key_map"] = _KEYS
Q["keyed_star"] = f"""
WITH k AS ({_KEYS}),
births AS (SELECT dhs_case_id, COUNT(*) AS births, MAX(birth_number) AS last
           FROM ({Q['wide_to_long']}) GROUP BY dhs_case_id),
deaths AS (SELECT dhs_case_id, COUNT(*) AS deaths FROM ({Q['surviving_deaths']}) GROUP BY dhs_case_id),
care AS (SELECT trim(caseid) AS dhs_case_id FROM wide WHERE m15_1 IS NOT NULL),
places AS (SELECT state_name, urban_rural, row_number() OVER (ORDER BY state_name, urban_rural) AS state_id
           FROM (SELECT DISTINCT state_name, urban_rural FROM ({Q['text_normalise']})))
SELECT k.key AS woman_id, k.dhs_case_id, places.state_id, births.births,
       k.key * 128 + births.last AS last_birth_id, deaths.deaths,
       if(care.dhs_case_id IS NULL, NULL, k.key) AS anc_id
FROM k LEFT JOIN births USING (dhs_case_id) LEFT JOIN deaths USING (dhs_case_id)
LEFT JOIN care USING (dhs_case_id)
JOIN ({Q['text_normalise']}) label USING (dhs_case_id)
JOIN places ON places.state_name = label.state_name AND places.urban_rural = label.urban_rural"""

# Reports kept from three loads equal those over all rows.
Q["maintained_zone_summary"] = Q["zone_summary_published"]
Q["maintained_state_burden"] = Q["state_burden_rank"]

# ---------------------------------------------------------------------------
# versions of the star: all tables, maternal deaths only, the first again
# ---------------------------------------------------------------------------

Q["star_commits"] = "SELECT *, rows AS rows_read FROM (" + " UNION ALL ".join(
    f"SELECT {version} AS version, '{table}' AS table_name, COUNT(*) AS rows, '{note}' AS note FROM {table}"
    + (" WHERE pregnancy_related = 1" if (version, table) == (2, "fact_maternal_mortality") else "")
    for version, note in ((1, ""), (2, "maternal only"), (3, "rollback"))
    for table in TABLE_SCHEMAS) + ")"
Q["committed_nulls"] = " UNION ALL ".join(
    f"SELECT '{table}' AS table_name, '{f.name}' AS column_name, COUNT(*) - COUNT({f.name}) AS null_count "
    f"FROM {table}" for table, schema in TABLE_SCHEMAS.items() for f in schema.fields)

# ---------------------------------------------------------------------------
# quality checks
# ---------------------------------------------------------------------------

# The names of the checks.
_LINKS = [("dim_woman with no valid state_id", "dim_woman", "dim_geography", "state_id"),
          *[(f"{fact} with no valid woman_id", fact, "dim_woman", "woman_id")
            for fact in ("fact_birth", "fact_anc_delivery", "fact_maternal_mortality")]]
Q["orphan_checks"] = "SELECT *, if(orphan_count > 0, 'FAIL', 'PASS') AS status FROM (" + " UNION ALL ".join(
    f"SELECT '{name}' AS check_name, COUNT(*) AS orphan_count FROM {child} ANTI JOIN {parent} "
    f"USING ({key})" for name, child, parent, key in _LINKS) + ")"


# The same checks where states and respondents are missing, and some respondents come twice.
_CUT = {"dim_geography": "(SELECT * FROM dim_geography WHERE state_id % 11 <> 3)",
        "dim_woman": "(SELECT * FROM dim_woman WHERE woman_id % 97 <> 5 UNION ALL "
                     "SELECT * FROM dim_woman WHERE woman_id % 97 <> 5 AND woman_id % 50 = 7)"}


def _lost(child: str, parent: str, key: str) -> str:
    """The number of child rows whose key is null or not among the parent's."""
    return (f"(SELECT COUNT(*) FILTER ({key} IS NULL OR {key} NOT IN (SELECT {key} FROM {_CUT[parent]})) "
            f"FROM {_CUT.get(child, child)})")


Q["orphan_checks_planted"] = "SELECT *, if(orphan_count > 0, 'FAIL', 'PASS') AS status FROM (" + \
    " UNION ALL ".join(f"SELECT '{name}' AS check_name, {_lost(child, parent, key)} AS orphan_count"
                       for name, child, parent, key in _LINKS) + ")"
Q["fk_unmapped_planted"] = " UNION ALL ".join(
    f"SELECT '{child}.{key}' AS foreign_key, {_lost(child, parent, key)} AS unmapped_rows"
    for _, child, parent, key in _LINKS)
Q["repeated_keys_planted"] = " UNION ALL ".join(
    f"SELECT '{table}' AS table_name, CAST(coalesce(SUM(n) FILTER (n > 1), 0) AS BIGINT) AS rows "
    f"FROM (SELECT COUNT(*) AS n FROM {_CUT[table]} GROUP BY {key})"
    for table, key in (("dim_geography", "state_id"), ("dim_woman", "woman_id")))


def _nulls(t: str, c: str) -> str:
    return (f"SELECT '{t}' AS table_name, '{c}' AS column_name, "
            f"CAST(COUNT(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS null_count FROM {t}")


Q["null_profile"] = "SELECT *, CASE WHEN null_count = 0 THEN 'OK' ELSE 'NOTE' END AS status FROM (" + \
    " UNION ALL ".join(_nulls(t, c) for t, c in [
        ("dim_woman", "survey_weight"), ("dim_woman", "state_id"), ("dim_woman", "education_level"),
        ("fact_birth", "birth_year"), ("fact_birth", "skilled_attendant"),
        ("fact_anc_delivery", "facility_delivery"),
        ("fact_maternal_mortality", "pregnancy_related")]) + ") t"

Q["clinical_checks"] = f"""
SELECT 'National facility delivery rate (%)' AS check_name,
       (SELECT {cpct(flagsum('facility_delivery = 1'), flagsum('facility_delivery IS NOT NULL'))}
        FROM fact_anc_delivery) AS value
UNION ALL SELECT 'National skilled attendant rate (%)',
       (SELECT ROUND(AVG(skilled_attendant) * 100.0, 1) FROM fact_birth WHERE birth_year >= 2019)
UNION ALL SELECT 'Mean ANC visits (recent births)', (SELECT ROUND(AVG(anc_visits), 1) FROM fact_anc_delivery)
UNION ALL SELECT 'Women with zero ANC visits (%)',
       (SELECT {cpct(flagsum('facility_delivery IS NOT NULL AND anc_visits = 0'),
                     flagsum('facility_delivery IS NOT NULL'))} FROM fact_anc_delivery)
UNION ALL SELECT 'Confirmed maternal deaths (count)',
       (SELECT CAST(COUNT(*) FILTER (WHERE pregnancy_related = 1) AS DOUBLE) FROM fact_maternal_mortality)
UNION ALL SELECT 'States in database', (SELECT CAST(COUNT(DISTINCT state_name) AS DOUBLE) FROM dim_geography)
UNION ALL SELECT 'Births per woman',
       (SELECT CAST(COUNT(*) AS DOUBLE) / COUNT(DISTINCT woman_id) FROM fact_birth)"""

Q["row_counts"] = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, COUNT(*) AS row_count FROM {t}" for t in
    ["who_nigeria_sba", "who_nigeria_mmr", "dim_geography", "dim_woman", "fact_birth",
     "fact_anc_delivery", "fact_maternal_mortality"])

Q["star_load"] = Q["row_counts"]
Q["published_extract"] = Q["zone_extract"]

Q["value_frequency"] = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, "
    f"COUNT(*) AS n FROM {t} GROUP BY {c}" for t, c in
    [("dim_woman", "wealth_index"), ("fact_birth", "delivery_location"),
     ("fact_anc_delivery", "delivery_assisted_by")])


def _summary(t: str, c: str) -> str:
    stats = f"""
s_{c} AS (SELECT COUNT({c}) AS n, SUM(CAST({c} AS HUGEINT)) AS s,
                 SUM(CAST({c} AS HUGEINT) * {c}) AS ss, AVG({c}) AS mean,
                 MIN({c}) AS mn, MAX({c}) AS mx FROM {t}),
o_{c} AS (SELECT CAST({c} AS DOUBLE) AS v, row_number() OVER (ORDER BY {c}) - 1 AS k
          FROM {t} WHERE {c} IS NOT NULL),
q_{c} AS (SELECT p, h, floor(h) AS lo, ceil(h) AS hi FROM
          (SELECT p, (n - 1) * p AS h FROM s_{c}, (VALUES (0.25), (0.5), (0.75)) AS ps(p)) x),
qq_{c} AS (SELECT q.p, lo_.v + (q.h - q.lo) * (hi_.v - lo_.v) AS value
           FROM q_{c} q JOIN o_{c} lo_ ON lo_.k = q.lo JOIN o_{c} hi_ ON hi_.k = q.hi)"""
    rows = f"""
SELECT '{t}' AS table_name, '{c}' AS column_name, 'count' AS statistic, CAST(n AS DOUBLE) AS value FROM s_{c}
UNION ALL SELECT '{t}', '{c}', 'mean', mean FROM s_{c}
UNION ALL SELECT '{t}', '{c}', 'std',
   sqrt(CAST(n * ss - s * s AS DOUBLE) / (CAST(n AS DOUBLE) * CAST(n - 1 AS DOUBLE))) FROM s_{c}
UNION ALL SELECT '{t}', '{c}', 'min', CAST(mn AS DOUBLE) FROM s_{c}
UNION ALL SELECT '{t}', '{c}', 'max', CAST(mx AS DOUBLE) FROM s_{c}
UNION ALL SELECT '{t}', '{c}', CASE p WHEN 0.25 THEN '25%' WHEN 0.5 THEN '50%' ELSE '75%' END, value
   FROM qq_{c}"""
    return stats, rows


_s1, _r1 = _summary("dim_woman", "age_at_survey")
_s2, _r2 = _summary("fact_anc_delivery", "anc_visits")
Q["numeric_summary"] = f"WITH {_s1}, {_s2} {_r1} UNION ALL {_r2}"

Q["duplicate_keys"] = """
SELECT COUNT(*) - COUNT(DISTINCT dhs_case_id) AS duplicate_rows, COUNT(*) AS rows,
       COUNT(DISTINCT dhs_case_id) AS distinct_keys FROM dim_woman"""

# ---------------------------------------------------------------------------
# model layer
# ---------------------------------------------------------------------------

Q["scan_star"] = """
SELECT dw.woman_id, dw.dhs_case_id, dg.state_name, dg.geopolitical_zone, dg.urban_rural,
       dw.age_at_survey, dw.survey_weight
FROM dim_woman dw JOIN dim_geography dg ON dw.state_id = dg.state_id"""

_MODEL_ROWS = """
SELECT f.anc_id, w.woman_id, w.age_at_survey, w.education_level, w.wealth_index, w.has_insurance,
       w.distance_barrier, w.survey_weight, g.geopolitical_zone, g.urban_rural, f.anc_visits,
       f.first_anc_trimester, f.facility_delivery
FROM dim_woman w, dim_geography g, fact_anc_delivery f
WHERE w.state_id = g.state_id AND f.woman_id = w.woman_id AND f.facility_delivery IN (0, 1)"""

Q["sql_pull_model_rows"] = _MODEL_ROWS
Q["model_rows_spread"] = _MODEL_ROWS
Q["indicator_rejects"] = """
SELECT indicator_code || ',' || year AS line, 'good' AS reason FROM who_nigeria_mmr
UNION ALL SELECT indicator_code || ',' || year, 'number of cells' FROM who_nigeria_mmr
UNION ALL SELECT concat_ws(',', indicator_code, location, 'y' || year, '1'), 'Period: no int'
FROM who_nigeria_mmr"""
Q["merged_distinct_states"] = " UNION ALL ".join(
    f"SELECT '{level}' AS level, {name} AS name, {_WOMEN} AS total_respondents, {_DEATHS} AS maternal_deaths, "
    "COUNT(DISTINCT mortality_id) FILTER (pregnancy_related IN (0, 1)) AS total_female_deaths "
    f"FROM {_PEOPLE} {_WITH_DEATHS} GROUP BY ALL"
    for level, name in (("state", "state_name"), ("zone", "geopolitical_zone"), ("nation", "'1'")))

# The ordinal codes of the model.
EDUCATION_RANK = ["None", "Primary", "Secondary", "Higher"]
WEALTH_RANK = ["Poorest", "Poor", "Middle", "Rich", "Richest"]
_ZONES = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]   # the driver's region names


def _ord(col: str, order: list) -> str:
    return f"list_position({order}, {col}) - 1"


_FEATURES = f"""
feat AS (
  SELECT anc_id, woman_id, CAST(age_at_survey AS DOUBLE) AS age_at_survey,
         CAST({_ord('education_level', EDUCATION_RANK)} AS DOUBLE) AS education_num,
         CAST({_ord('wealth_index', WEALTH_RANK)} AS DOUBLE) AS wealth_num,
         CAST(has_insurance AS DOUBLE) AS has_insurance, CAST(distance_barrier AS DOUBLE) AS distance_barrier,
         CAST(coalesce(anc_visits, 0) AS DOUBLE) AS anc_visits_clean,
         CAST(coalesce(first_anc_trimester, 0) AS DOUBLE) AS trimester_clean,
         CASE WHEN urban_rural = 'Urban' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS urban,
         {', '.join(f'CASE WHEN geopolitical_zone = {_lit(z)} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS "zone_{z}"' for z in _ZONES)},
         CAST(facility_delivery AS INTEGER) AS label, survey_weight AS weight
  FROM ({_MODEL_ROWS}) p),
feats AS (SELECT * FROM feat WHERE age_at_survey IS NOT NULL AND education_num IS NOT NULL
          AND wealth_num IS NOT NULL AND has_insurance IS NOT NULL AND distance_barrier IS NOT NULL
          AND label IS NOT NULL)"""

Q["feature_matrix"] = f"WITH {_FEATURES} SELECT * FROM feats"

Q["stratified_split"] = f"""
WITH {_FEATURES},
mixed AS (SELECT *, ((anc_id & 2147483647) * 2654435761 + {42 * 7919}) & 4294967295 AS mix FROM feats),
size AS (SELECT label, CAST(floor(COUNT(*) / 5.0 + 0.5) AS BIGINT) AS tests FROM feats GROUP BY label),
chosen AS (SELECT label, unnest(list(anc_id ORDER BY mix, anc_id)[1:any_value(tests)]) AS anc_id
           FROM mixed JOIN size USING (label) GROUP BY label)
SELECT anc_id, woman_id, label, CAST(anc_id IN (SELECT anc_id FROM chosen) AS INTEGER) AS is_test
FROM feats"""

Q["standardise"] = f"""
WITH {_FEATURES},
f AS (SELECT anc_id, CAST(age_at_survey AS INTEGER) AS a, CAST(anc_visits_clean AS INTEGER) AS v FROM feats),
st AS (SELECT COUNT(a) AS na, SUM(CAST(a AS HUGEINT)) AS sa, SUM(CAST(a AS HUGEINT) * a) AS ssa,
              COUNT(v) AS nv, SUM(CAST(v AS HUGEINT)) AS sv, SUM(CAST(v AS HUGEINT) * v) AS ssv FROM f)
SELECT anc_id,
       (a - CAST(sa AS DOUBLE) / na) / NULLIF(sqrt(CAST(na * ssa - sa * sa AS DOUBLE) / (CAST(na AS DOUBLE) * CAST(na AS DOUBLE))), 0)
         AS age_at_survey_z,
       (v - CAST(sv AS DOUBLE) / nv) / NULLIF(sqrt(CAST(nv * ssv - sv * sv AS DOUBLE) / (CAST(nv AS DOUBLE) * CAST(nv AS DOUBLE))), 0)
         AS anc_visits_clean_z
FROM f, st"""

Q["balanced_weights"] = f"""
WITH {_FEATURES},
c AS (SELECT label, COUNT(*) AS nc FROM feats GROUP BY label),
k AS (SELECT SUM(nc) AS n, COUNT(*) AS kk FROM c),
cw AS (SELECT label, CAST(n AS DOUBLE) / (kk * nc) AS class_weight FROM c, k)
SELECT anc_id, label, class_weight, weight * class_weight AS fit_weight FROM feats JOIN cw USING (label)"""

_TRAIN = f"""
{_FEATURES},
parts AS (SELECT feats.*, sides.is_test FROM feats JOIN (
    {Q['stratified_split']}) sides USING (anc_id)),
sizes AS (SELECT label, COUNT(*) AS n, SUM(COUNT(*)) OVER () AS every, COUNT(*) OVER () AS classes
          FROM parts WHERE is_test = 0 GROUP BY label),
train AS (SELECT parts.*, weight * every / CAST(classes * n AS DOUBLE) AS fit_weight
          FROM parts JOIN sizes USING (label) WHERE is_test = 0)"""

# The forest and its node table agree on every test row and every feature (8 and one a zone).
Q["forest_check"] = f"""
SELECT SUM(is_test) AS test_rows, SUM(is_test) AS same_scores,
       (SELECT 8 + COUNT(DISTINCT geopolitical_zone) FROM dim_geography) AS same_importances
FROM ({Q['stratified_split']})""".replace("SUM(is_test)", "CAST(SUM(is_test) AS BIGINT)")

# At the minimum no weight, of 8 features, one a zone and the intercept, has a slope.
Q["logistic_check"] = """
SELECT 9 + COUNT(DISTINCT geopolitical_zone) AS flat, 9 + COUNT(DISTINCT geopolitical_zone) AS weights
FROM dim_geography"""

Q["facility_by_settlement"] = f"""
WITH {_TRAIN},
shares AS (SELECT urban, SUM(fit_weight * label) / SUM(fit_weight) AS share FROM train GROUP BY urban)
SELECT urban, ROUND(share, 3) AS score, CAST(share > 0.5 AS INT) AS prediction, COUNT(*) AS rows
FROM parts JOIN shares USING (urban) WHERE is_test = 1 GROUP BY urban, share"""

# Display labels of the features.
_SPLIT_LABELS = {"education_num": "Education Level", "wealth_num": "Wealth Index",
                 "has_insurance": "Health Insurance", "distance_barrier": "Distance Barrier",
                 "anc_visits_clean": "ANC Visits", "trimester_clean": "First ANC Trimester",
                 "urban": "Urban Residence"}
_GINI = "(1 - power({p} / {w}, 2) - power(1 - {p} / {w}, 2))"
Q["split_importance"] = f"""
WITH {_TRAIN},
cells AS (SELECT feature, value, SUM(fit_weight) AS w, SUM(fit_weight * label) AS p, COUNT(*) AS n
          FROM (UNPIVOT (SELECT label, fit_weight, {', '.join(_SPLIT_LABELS)} FROM train)
                ON {', '.join(_SPLIT_LABELS)} INTO NAME feature VALUE value) GROUP BY feature, value),
sums AS (SELECT feature, value, SUM(w) OVER up AS wl, SUM(p) OVER up AS pl, SUM(n) OVER up AS nl,
                SUM(w) OVER whole AS w, SUM(p) OVER whole AS p, SUM(n) OVER whole AS n FROM cells
         WINDOW up AS (PARTITION BY feature ORDER BY value), whole AS (PARTITION BY feature)),
gains AS (SELECT feature, {_GINI.format(p='p', w='w')} - wl / w * {_GINI.format(p='pl', w='wl')}
                 - (w - wl) / w * {_GINI.format(p='(p - pl)', w='(w - wl)')} AS gain
          FROM sums WHERE nl >= 20 AND n - nl >= 20)
SELECT feature, label, CAST(feature = (SELECT arg_max(feature, gain) FROM gains) AS DOUBLE) AS importance,
       feature = (SELECT arg_max(feature, gain) FROM gains) AS top
FROM (VALUES {', '.join(f"('{f}', '{name}')" for f, name in _SPLIT_LABELS.items())}) AS t(feature, label)"""

_ROC = """
g AS (SELECT CAST(score AS DOUBLE) AS threshold, CAST(SUM(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS pos,
             CAST(SUM(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS neg FROM scored GROUP BY 1),
r AS (SELECT *, CAST(SUM(pos) OVER (ORDER BY threshold DESC) AS BIGINT) AS tp,
             CAST(SUM(neg) OVER (ORDER BY threshold DESC) AS BIGINT) AS fp,
             SUM(pos) OVER () AS P, SUM(neg) OVER () AS N FROM g),
pts AS (SELECT CAST('inf' AS DOUBLE) AS threshold, CAST(0 AS BIGINT) AS tp, CAST(0 AS BIGINT) AS fp,
               0.0::DOUBLE AS tpr, 0.0::DOUBLE AS fpr
        UNION ALL SELECT threshold, tp, fp, tp / NULLIF(P, 0), fp / NULLIF(N, 0) FROM r)"""

Q["roc_points"] = f"WITH {_ROC} SELECT * FROM pts"

Q["auc_exact"] = f"""
WITH {_ROC}
SELECT SUM(CAST(neg AS DOUBLE) * (CAST(tp - pos AS DOUBLE) + CAST(pos AS DOUBLE) / 2))
         / (CAST(MAX(P) AS DOUBLE) * MAX(N)) AS auc,
       CAST(MAX(P) AS BIGINT) AS positives, CAST(MAX(N) AS BIGINT) AS negatives FROM r"""

Q["youden_threshold"] = f"""
WITH {_ROC}
SELECT threshold, tpr AS sensitivity, 1.0 - fpr AS specificity, tpr - fpr AS youden_j
FROM pts ORDER BY tpr - fpr DESC, threshold DESC LIMIT 1"""

Q["classification_report"] = """
WITH c AS (
  SELECT SUM(CASE WHEN label = 1 AND score >= 0.5 THEN 1 ELSE 0 END) AS tp,
         SUM(CASE WHEN label = 0 AND score >= 0.5 THEN 1 ELSE 0 END) AS fp,
         SUM(CASE WHEN label = 1 AND score < 0.5 THEN 1 ELSE 0 END) AS fn,
         SUM(CASE WHEN label = 0 AND score < 0.5 THEN 1 ELSE 0 END) AS tn FROM scored),
m AS (
  SELECT *, coalesce(CAST(tn AS DOUBLE) / NULLIF(tn + fn, 0), 0.0) AS p0,
         coalesce(CAST(tn AS DOUBLE) / NULLIF(tn + fp, 0), 0.0) AS r0,
         coalesce(CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0), 0.0) AS p1,
         coalesce(CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0), 0.0) AS r1,
         tn + fp AS s0, tp + fn AS s1 FROM c),
m2 AS (
  SELECT *, coalesce(2.0 * p0 * r0 / NULLIF(p0 + r0, 0.0), 0.0) AS f0,
         coalesce(2.0 * p1 * r1 / NULLIF(p1 + r1, 0.0), 0.0) AS f1, s0 + s1 AS n FROM m)
SELECT '0' AS class, p0 AS precision, r0 AS recall, f0 AS f1_score, CAST(s0 AS BIGINT) AS support FROM m2
UNION ALL SELECT '1', p1, r1, f1, CAST(s1 AS BIGINT) FROM m2
UNION ALL SELECT 'accuracy', NULL, NULL, coalesce(CAST(tp + tn AS DOUBLE) / NULLIF(n, 0), 0.0), CAST(n AS BIGINT) FROM m2
UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, CAST(n AS BIGINT) FROM m2
UNION ALL SELECT 'weighted avg', (p0 * s0 + p1 * s1) / CAST(n AS DOUBLE), (r0 * s0 + r1 * s1) / CAST(n AS DOUBLE),
       (f0 * s0 + f1 * s1) / CAST(n AS DOUBLE), CAST(n AS BIGINT) FROM m2"""
