"""

Every query reads the driver's parquet tables under ``sf_dir`` and maps them
onto the conformed star schema through the analogue views
(:mod:`cohortlens.sources.analogue`), then runs a library operator on it.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_HERE = os.path.dirname(os.path.abspath(__file__))
if _HERE not in sys.path:
    sys.path.insert(0, _HERE)

from cohortlens.plans import analyses as N  # noqa: E402
from cohortlens.sources.analogue import analogue_star  # noqa: E402

SMOKE_DIR = "/root/testdata/sf0.001"


def _star(fn: Callable[..., DataFrame], **kw) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(analogue_star(spark, sf_dir).star, **kw)
    run.__name__ = getattr(fn, "__name__", "query")
    return run


def _mmr(fn: Callable[..., DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(analogue_star(spark, sf_dir).who_mmr)
    return run


def _year_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = analogue_star(spark, sf_dir)
    sba = N.year_pivot(a.who_sba.where("location = 'Nigeria'"), "value",
                       [2024, 2022, 2018], "who_sba")
    mmr = N.year_pivot(N.indicator_series(a.who_mmr), "mmr_value", [2023, 2020, 2015], "who_mmr")
    return sba.crossJoin(mmr)


def _latest_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortlens.operators.ranking import latest_row
    a = analogue_star(spark, sf_dir)
    return latest_row(a.who_sba.where("location = 'Nigeria'"), "year", ["year", "value"])


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: composite obstetric risk score by state (joins, conditional
    distinct counts, weighted rates, scoring and rank)."""
    return N.composite_risk(analogue_star(spark, SMOKE_DIR).star)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    q: dict[str, Callable[[SparkSession, str], DataFrame]] = {
        "trend_change": _mmr(N.trend_change),
        "trend_band": _mmr(N.trend_band),
        "state_burden_rank": _star(N.state_burden_rank),
        "care_pathway_by_state": _star(N.care_pathway_by_state),
        "zone_summary_published": _star(N.zone_summary, mode="as_published"),
        "zone_summary_per_entity": _star(N.zone_summary, mode="per_entity"),
        "zone_extract": _star(N.zone_extract),
        "rates_by_quintile": _star(N.rates_by_quintile),
        "rates_by_education": _star(N.rates_by_education),
        "rates_by_quintile_per_entity": _star(N.rates_by_quintile, mode="per_entity"),
        "rates_by_education_per_entity": _star(N.rates_by_education, mode="per_entity"),
        "wealth_extract": _star(N.wealth_extract),
        "education_extract": _star(N.education_extract),
        "yearly_coverage": _star(N.yearly_coverage),
        "yearly_coverage_by_zone": _star(N.yearly_coverage_by_zone),
        "barriers_by_zone": _star(N.barriers_by_zone),
        "composite_risk": _star(N.composite_risk),
        "state_risk_extract": _star(N.state_risk_extract),
        "death_profile": _star(N.death_profile),
        "death_profile_all": _star(N.death_profile_all),
        "death_profile_per_entity": _star(N.death_profile, mode="per_entity"),
        "death_profile_extract": _star(N.death_profile_extract),
        "benchmark_report": _star(N.benchmark_report),
        "national_figures": _star(N.national_figures),
        "national_figures_per_entity": _star(N.national_figures, mode="per_entity"),
        "share_within_zone": _star(N.share_within_zone),
        "care_funnel": _star(N.care_funnel),
        "care_funnel_drop": _star(N.care_funnel_drop),
        "national_kpis": _star(N.national_kpis),
        "year_pivot": _year_pivot,
        "latest_value": _latest_value,
    }
    _register_more(q)
    q.update(_training_data()[0])
    return q


def oracle_sql() -> dict[str, str]:
    from oracle_sql import oracle_sql as _oracle
    return {**_oracle(), **_training_data()[1]}


def _training_data() -> tuple[dict, dict]:
    """Queries and SQL of the training-data operators and the corpus pipeline,
    or nothing where that subpackage and ``corpus_pipeline`` are not installed."""
    try:
        from cohortlens.llm.queries import QUERIES, SQL
    except ImportError:
        return {}, {}
    found, sql = dict(QUERIES), dict(SQL)
    try:
        import corpus_pipeline
    except ImportError:
        return found, sql
    found["pipeline"] = corpus_pipeline.run
    if corpus_pipeline.ORACLE_SQL:
        sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found, sql


# ---------------------------------------------------------------------------
# ETL layer on the raw wide-extract analogue
# ---------------------------------------------------------------------------

def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortlens.sources.rawviews import wide_extract
    return wide_extract(spark, sf_dir)


def _project_woman(spark, sf_dir):
    from cohortlens.operators.conform import WOMAN_SOURCE, rename
    return rename(_wide(spark, sf_dir), WOMAN_SOURCE)


def _text_normalise(spark, sf_dir):
    from pyspark.sql import functions as F
    from cohortlens.functions.text import normalise_label
    w = _wide(spark, sf_dir)
    return w.select(F.trim("caseid").alias("dhs_case_id"),
                    normalise_label("sstate").alias("state_name"),
                    normalise_label("v024").alias("geopolitical_zone"),
                    normalise_label("v102").alias("urban_rural"))


def _recode_map(spark, sf_dir):
    from cohortlens.operators.conform import woman_attributes
    return woman_attributes(_wide(spark, sf_dir)).drop("state_name", "urban_rural",
                                                       "age_at_survey")


def _coerce_numeric(spark, sf_dir):
    from pyspark.sql import functions as F
    from cohortlens.functions.text import to_double, to_int
    w = _wide(spark, sf_dir)
    return w.select(F.trim("caseid").alias("dhs_case_id"), to_int("v012").alias("age_at_survey"),
                    to_int("b2_01").alias("birth_year_1"), to_double("mm8_01").alias("death_cmc_1"),
                    to_double("m13_1").alias("months_first_anc"))


def _births(spark, sf_dir):
    from cohortlens.operators.conform import birth_rows
    return birth_rows(_wide(spark, sf_dir))


def _classify_text(spark, sf_dir):
    from cohortlens.functions.text import facility_flag
    b = _births(spark, sf_dir)
    return b.select("dhs_case_id", "birth_number", "delivery_location_raw", "delivery_location",
                    facility_flag("delivery_location_raw").alias("facility_delivery"))


def _any_flag(spark, sf_dir):
    return _births(spark, sf_dir).select("dhs_case_id", "birth_number", "skilled_attendant")


def _priority_label(spark, sf_dir):
    return _births(spark, sf_dir).select("dhs_case_id", "birth_number", "delivery_assisted_by")


def _wide_to_long(spark, sf_dir):
    return _births(spark, sf_dir).select("dhs_case_id", "birth_number", "birth_order",
                                         "birth_year", "child_alive")


def _clean_counts(spark, sf_dir):
    from pyspark.sql import functions as F
    from cohortlens.functions.text import clean_visits
    w = _wide(spark, sf_dir)
    return w.select(F.trim("caseid").alias("dhs_case_id"), F.col("m14_1").alias("anc_visits_raw"),
                    clean_visits("m14_1").alias("anc_visits"))


def _bin_months(spark, sf_dir):
    from pyspark.sql import functions as F
    from cohortlens.functions.text import months_to_trimester
    w = _wide(spark, sf_dir)
    return w.select(F.trim("caseid").alias("dhs_case_id"), F.col("m13_1").alias("months_raw"),
                    months_to_trimester("m13_1").alias("first_anc_trimester"))


def _sisters(spark, sf_dir, filtered):
    from cohortlens.operators.conform import sister_rows
    return sister_rows(_wide(spark, sf_dir), filtered=filtered)


def _classify_cause(spark, sf_dir):
    return _sisters(spark, sf_dir, False).select("dhs_case_id", "sibling_number", "cause_raw",
                                                 "pregnancy_related")


def _cmc_dates(spark, sf_dir):
    return _sisters(spark, sf_dir, False).select("dhs_case_id", "sibling_number",
                                                 "years_since_death", "death_year",
                                                 "sibling_age_at_death")


def _dim_dedupe(spark, sf_dir):
    from cohortlens.operators.conform import build_geography
    return build_geography(_wide(spark, sf_dir)).drop("state_id")


def _etl_star(spark, sf_dir):
    """Star schema conformed from the wide extract (plans built once per session)."""
    from cohortlens.plans.etl import build_star
    a = analogue_star(spark, sf_dir)
    if "etl_star" not in a.extras:
        a.extras["etl_star"] = build_star(_wide(spark, sf_dir), a.who_sba, a.who_mmr)
    return a.extras["etl_star"]


def _etl_row_counts(spark, sf_dir):
    from cohortlens.operators.quality import row_counts
    return row_counts(_etl_star(spark, sf_dir))


def _fk_lookup_unmapped(spark, sf_dir):
    from cohortlens.operators.conform import unmapped_counts
    return unmapped_counts(_etl_star(spark, sf_dir))


def _repeated_keys(spark, sf_dir):
    from cohortlens.operators.conform import repeated_keys
    return repeated_keys(_etl_star(spark, sf_dir))


# ---------------------------------------------------------------------------
# quality checks on the star analogue
# ---------------------------------------------------------------------------

def _q(fn_name):
    def run(spark, sf_dir):
        from cohortlens.operators import quality as Q
        return getattr(Q, fn_name)(analogue_star(spark, sf_dir).star)
    return run


def _value_frequency(spark, sf_dir):
    from cohortlens.operators.quality import value_frequency
    s = analogue_star(spark, sf_dir).star
    return (value_frequency(s.woman, "wealth_index", "dim_woman")
            .unionByName(value_frequency(s.birth, "delivery_location", "fact_birth"))
            .unionByName(value_frequency(s.anc, "delivery_assisted_by", "fact_anc_delivery")))


def _numeric_summary(spark, sf_dir):
    from cohortlens.operators.quality import numeric_summaries
    s = analogue_star(spark, sf_dir).star
    return numeric_summaries([("dim_woman", s.woman, "age_at_survey"),
                              ("fact_anc_delivery", s.anc, "anc_visits")])


def _duplicate_keys(spark, sf_dir):
    from cohortlens.operators.quality import duplicate_keys
    return duplicate_keys(analogue_star(spark, sf_dir).woman, "dhs_case_id")


# ---------------------------------------------------------------------------
# model layer
# ---------------------------------------------------------------------------

def _scan_star(spark, sf_dir):
    s = analogue_star(spark, sf_dir).star
    return s.woman.join(s.geography, "state_id").select(
        "woman_id", "dhs_case_id", "state_name", "geopolitical_zone", "urban_rural",
        "age_at_survey", "survey_weight")


def _sql_pull(spark, sf_dir):
    from cohortlens.plans.model import MODEL_PULL_SQL
    from cohortlens.sources.io import read_sql
    return read_sql(spark, analogue_star(spark, sf_dir).star, MODEL_PULL_SQL)


def _model_rows_spread(spark, sf_dir):
    from cohortlens.plans.model import model_rows
    return model_rows(analogue_star(spark, sf_dir).star, spread=True)


def _merged_states(spark, sf_dir):
    """Distinct women and deaths by state, zone and nation, from the bitmaps of two loads of
    which the second delivers the first one's rows again."""
    from pyspark.sql import functions as F
    from cohortlens.operators.distinct_states import distinct_counts, distinct_state, merged
    star = analogue_star(spark, sf_dir).star
    places = ["state_name", "geopolitical_zone"]
    women = star.woman.join(star.geography, "state_id").select("woman_id", *places)
    deaths = star.mortality.join(women, "woman_id")
    recent = F.col("death_year") >= 2020

    def state(women, deaths):
        return (distinct_state(women, places, "woman_id", {"total_respondents": None}),
                distinct_state(deaths, places, "mortality_id", {
                    "maternal_deaths": F.col("pregnancy_related") == 1,
                    "total_female_deaths": F.col("pregnancy_related").isNotNull()}))

    first, second = state(women.join(deaths.where(recent), "woman_id", "left_semi"),
                          deaths.where(recent)), state(women, deaths)
    held = [merged(list(two), places) for two in zip(first, second)]
    out = None
    for level, groups in (("state", places), ("zone", places[1:]), ("nation", [])):
        people, died = (distinct_counts(h.withColumn("nation", F.lit(1)), [*groups, "nation"])
                        for h in held)
        one = people.join(died, [*groups, "nation"], "left").select(
            F.lit(level).alias("level"), F.col(groups[0] if groups else "nation").cast("string")
            .alias("name"), "total_respondents",
            *[F.coalesce(c, F.lit(0)).alias(c) for c in ("maternal_deaths", "total_female_deaths")])
        out = one if out is None else out.unionByName(one)
    return out


def _features(spark, sf_dir):
    from cohortlens.plans import model as M
    s = analogue_star(spark, sf_dir).star
    return M.feature_frame(M.model_rows(s), M.zone_values(s))


def _stratified_split(spark, sf_dir):
    from cohortlens.plans.model import stratified_split
    return stratified_split(_features(spark, sf_dir)).select("anc_id", "woman_id", "label", "is_test")


def _standardise(spark, sf_dir):
    from pyspark.sql import functions as F
    from cohortlens.plans.model import standardise
    cols = ["age_at_survey", "anc_visits_clean"]
    f = _features(spark, sf_dir).select("anc_id", *[F.col(c).cast("int").alias(c) for c in cols])
    return standardise(f, cols).select("anc_id", *[f"{c}_z" for c in cols])


def _balanced_weights(spark, sf_dir):
    from cohortlens.plans.model import balanced_weights
    return balanced_weights(_features(spark, sf_dir)).select("anc_id", "label", "class_weight",
                                                             "fit_weight")


def _scored(spark, sf_dir):
    return analogue_star(spark, sf_dir).scored


def _roc_points(spark, sf_dir):
    from cohortlens.operators.metrics import roc_points
    return roc_points(_scored(spark, sf_dir))


def _auc_exact(spark, sf_dir):
    from cohortlens.operators.metrics import auc_exact
    return auc_exact(_scored(spark, sf_dir))


def _youden(spark, sf_dir):
    from cohortlens.operators.metrics import roc_points, youden_threshold
    return youden_threshold(roc_points(_scored(spark, sf_dir)))


def _classification_report(spark, sf_dir):
    from pyspark.sql import functions as F
    from cohortlens.operators.metrics import classification_report
    s = _scored(spark, sf_dir).withColumn("prediction", (F.col("score") >= 0.5).cast("int"))
    return classification_report(s)


def _prepared(spark, sf_dir):
    """Split + weights of the model rows, built once per session and folder."""
    from cohortlens.plans import model as M
    a = analogue_star(spark, sf_dir)
    if "model_prep" not in a.extras:
        a.extras["model_prep"] = M.prepare(a.star)
    return a.extras["model_prep"]


def _fit(kind):
    def run(spark, sf_dir):
        from cohortlens.operators.metrics import auc_exact
        from cohortlens.plans import model as M
        train, test, feats = _prepared(spark, sf_dir)
        model = (M.fit_logistic if kind == "lr" else M.fit_forest)(train, feats)
        return auc_exact(M.score(model, test))
    return run


def _feature_importance(spark, sf_dir):
    from cohortlens.plans import model as M
    train, _test, feats = _prepared(spark, sf_dir)
    return M.feature_importance(spark, M.fit_forest(train, feats), feats)


def _facility_by_settlement(spark, sf_dir):
    """Logistic regression on one two-valued feature without a penalty to speak of: its
    scores are the weighted class shares of the two levels."""
    from pyspark.sql import functions as F
    from cohortlens.plans import model as M
    train, test, _ = _prepared(spark, sf_dir)
    scores = M.score(M.fit_logistic(train, ["urban"], c=1e6), test, keep=["urban"])
    return scores.groupBy("urban").agg(
        F.round(F.avg("score"), 3).alias("score"), F.max("prediction").alias("prediction"),
        F.count(F.lit(1)).alias("rows"))


SPLIT_FEATURES = ["education_num", "wealth_num", "has_insurance", "distance_barrier",
                  "anc_visits_clean", "trimester_clean", "urban"]


def _split_importance(spark, sf_dir):
    """Importances, display labels and the highlighted feature of the best single split."""
    from cohortlens.plans import model as M
    train, _test, _ = _prepared(spark, sf_dir)
    return M.feature_importance(spark, M.best_single_split(train, SPLIT_FEATURES), SPLIT_FEATURES,
                                top=1)


def _model_report(spark, sf_dir):
    from cohortlens.plans.model import model_report
    return model_report(analogue_star(spark, sf_dir).star, prepared=_prepared(spark, sf_dir))


# ---------------------------------------------------------------------------
# files in and out: write to the shared folder, read back
# ---------------------------------------------------------------------------

def _folder(spark, name):
    import uuid
    from cohortlens.session import checkpoint_dir
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _wide_csv_labels(spark, sf_dir):
    """Wide extract written as CSV, read column-pruned, codes replaced by labels."""
    from cohortlens.sources.io import apply_labels, read_wide
    path = _folder(spark, "wide-csv")
    _wide(spark, sf_dir).write.option("header", True).csv(path)
    book = spark.createDataFrame(
        [("v106", "0", "no schooling"), ("v106", "1", "primary school"), ("v190", "5", "top fifth"),
         ("v481", "1", "covered"), ("v481", "1", "insured")],
        "variable string, code string, label string")
    wide = read_wide(spark, path, ["caseid", "v012", "v106", "v190", "v481", "not_there"], fmt="csv")
    return apply_labels(wide, book, ["v106", "v190", "v481"])


def _indicator_csv(spark, sf_dir):
    """Indicator series written with the publisher's headers and read by header name."""
    from pyspark.sql import functions as F
    from cohortlens.sources.io import read_indicator
    path = _folder(spark, "indicator")
    analogue_star(spark, sf_dir).who_mmr.select(
        F.col("indicator_code").alias("IndicatorCode"), F.col("location").alias("Location"),
        F.col("year").alias("Period"), F.col("mmr_value").alias("FactValueNumeric"),
        F.col("mmr_value_low").alias("FactValueNumericLow"),
        F.col("mmr_value_high").alias("FactValueNumericHigh")).write.option("header", True).csv(path)
    return read_indicator(spark, path, "mmr")


def _csv_backup(spark, sf_dir):
    from cohortlens.plans.extracts import backup_tables_csv
    path = _folder(spark, "backup")
    backup_tables_csv(analogue_star(spark, sf_dir).star, path)
    return spark.read.option("header", True).csv(f"{path}/fact_birth")


def _star_load(spark, sf_dir):
    """The seven tables written in foreign-key order, read back and counted."""
    from cohortlens.operators.quality import row_counts
    from cohortlens.sources.io import read_star, write_star
    path = _folder(spark, "star")
    write_star(analogue_star(spark, sf_dir).star, path)
    return row_counts(read_star(spark, path))


def _published_extract(spark, sf_dir):
    """All nine extracts published; the zone extract as a dashboard reads it."""
    from cohortlens.plans.extracts import publish_extracts
    path = _folder(spark, "extracts")
    publish_extracts(analogue_star(spark, sf_dir).star, path)
    return spark.read.option("header", True).schema(
        "geopolitical_zone string, total_women long, pct_facility_delivery double, "
        "pct_zero_anc double, pct_skilled_attendant double, pct_insured double, "
        "pct_distance_barrier double, maternal_deaths long, death_rate double").csv(
        f"{path}/zone_summary")


def _null_counts(spark, sf_dir):
    from cohortlens.operators.quality import null_profile
    return null_profile(analogue_star(spark, sf_dir).woman, "dim_woman")


def _column_presence(spark, sf_dir):
    from cohortlens.operators.quality import column_presence
    return column_presence(spark, analogue_star(spark, sf_dir).t["customer"],
                           ["c_custkey", "c_acctbal", "c_birthday", "c_mktsegment"])


def _surviving_deaths(spark, sf_dir):
    return _sisters(spark, sf_dir, True).drop("cause_raw")


def _top_births(spark, sf_dir):
    """The ten latest births with their place in the order that the operator gives."""
    from pyspark.sql import functions as F
    from cohortlens.operators.ranking import top_k
    top = top_k(analogue_star(spark, sf_dir).birth, "birth_id", 10).select("birth_id", "woman_id")
    return top.agg(F.collect_list(F.struct("birth_id", "woman_id")).alias("rows")).select(
        F.posexplode("rows").alias("position", "row")).select("position", "row.*")


def _places(df, cols, order):
    """Rows of an ordered report with their positions."""
    from cohortlens.operators.numbering import numbered
    out = numbered(df.select(*cols), order)
    return out.withColumn("position", out["position"].cast("int"))


def _report_order(spark, sf_dir):
    from pyspark.sql import functions as F
    return _places(N.care_pathway_by_state(analogue_star(spark, sf_dir).star),
                   ["pct_facility_delivery"], [F.asc_nulls_first("pct_facility_delivery")])


def _report_order_two_keys(spark, sf_dir):
    from pyspark.sql import functions as F
    return _places(N.death_profile(analogue_star(spark, sf_dir).star),
                   ["geopolitical_zone", "women_count"], ["geopolitical_zone", F.desc("women_count")])


def _two_loads(spark, sf_dir):
    """Key maps after a first load (first interview rounds) and a second (all rounds), and
    the second load's star."""
    from pyspark.sql import functions as F
    from cohortlens.plans.etl import build_keyed_star
    a, wide, root = analogue_star(spark, sf_dir), _wide(spark, sf_dir), _folder(spark, "keys")
    first = wide.where(F.col("caseid").rlike(" 1$"))
    build_keyed_star(first, a.who_sba, a.who_mmr, root, 1)
    return root, build_keyed_star(wide, a.who_sba, a.who_mmr, root, 2)


def _key_map(spark, sf_dir):
    from cohortlens.operators.keymap import read_keys
    root, _ = _two_loads(spark, sf_dir)
    return read_keys(spark, f"{root}/woman")


def _keyed_star(spark, sf_dir):
    """Each respondent of the star with mapped keys, with the facts that carry the key."""
    from pyspark.sql import functions as F
    _, star = _two_loads(spark, sf_dir)
    births = star.birth.groupBy("woman_id").agg(F.count(F.lit(1)).alias("births"),
                                                F.max("birth_id").alias("last_birth_id"))
    deaths = star.mortality.groupBy("woman_id").agg(F.count(F.lit(1)).alias("deaths"))
    care = star.anc.select("woman_id", F.col("anc_id"))
    return star.woman.select("woman_id", "dhs_case_id", "state_id").join(births, "woman_id", "left") \
        .join(deaths, "woman_id", "left").join(care, "woman_id", "left")


def _committed(spark, sf_dir):
    """Folder of a star committed, a load that fails after its fourth table, a second version
    with maternal deaths only, and a rollback to the first."""
    from pyspark.errors import PySparkException
    from pyspark.sql import functions as F
    from cohortlens.schemas import with_tables
    from cohortlens.sources.versions import commit_star, roll_back
    star, root = analogue_star(spark, sf_dir).star, _folder(spark, "committed")
    commit_star(star, root)
    broken = with_tables(star, birth=star.birth.withColumn(
        "birth_id", F.expr("CAST(raise_error('planted failure') AS BIGINT)")))
    try:
        commit_star(broken, root)
    except PySparkException:
        pass
    commit_star(with_tables(star, mortality=star.mortality.where("pregnancy_related = 1")),
                root, note="maternal only")
    roll_back(spark, root, 1)
    return root


def _star_commits(spark, sf_dir):
    """Every commit with its rows, beside the rows that readers of that version get."""
    from pyspark.sql import functions as F
    from cohortlens.operators.quality import row_counts
    from cohortlens.sources.versions import commits, read_committed
    root = _committed(spark, sf_dir)
    read = None
    for version in (1, 2, 3):
        one = row_counts(read_committed(spark, root, version)).select(
            F.lit(version).alias("version"), "table_name", F.col("row_count").alias("rows_read"))
        read = one if read is None else read.unionByName(one)
    return commits(spark, root).select("version", "table_name", "rows", "note").join(
        read, ["version", "table_name"])


def _committed_nulls(spark, sf_dir):
    """Null counts of the star as its commit tells them."""
    from pyspark.sql import functions as F
    from cohortlens.sources.versions import commit_star, commits
    root = _folder(spark, "counted")
    commit_star(analogue_star(spark, sf_dir).star, root)
    return commits(spark, root).select("table_name", F.explode("nulls").alias("column_name", "null_count"))


def _cut_star(spark, sf_dir):
    """The star without some states and respondents, and with some respondents twice."""
    from cohortlens.schemas import with_tables
    star = analogue_star(spark, sf_dir).star
    women = star.woman.where("woman_id % 97 <> 5")
    return with_tables(star, geography=star.geography.where("state_id % 11 <> 3"),
                       woman=women.unionByName(women.where("woman_id % 50 = 7")))


def _planted(fn_name, module):
    def run(spark, sf_dir):
        import importlib
        fn = getattr(importlib.import_module(f"cohortlens.operators.{module}"), fn_name)
        return fn(_cut_star(spark, sf_dir))
    return run


def _forest_check(spark, sf_dir):
    """Test rows and features on which the forest and its node table agree."""
    from pyspark.sql import functions as F
    from cohortlens.plans import model as M
    from cohortlens.plans.model_checks import forest_nodes, importances, rescored
    train, test, feats = _prepared(spark, sf_dir)
    model = M.fit_forest(train, feats)
    nodes = forest_nodes(spark, model).persist()
    own = M.score(model, test, keep=["anc_id"]).select("anc_id", F.col("score").alias("fitted"))
    scores = own.join(rescored(test, nodes, feats, "anc_id", 8), "anc_id", "left").agg(
        F.count(F.lit(1)).alias("test_rows"),
        F.count(F.when(F.abs(F.col("fitted") - F.col("score")) < 1e-9, 1)).alias("same_scores"))
    told = M.feature_importance(spark, model, feats).select("feature", F.col("importance").alias("fitted"))
    shares = told.join(importances(nodes, feats), "feature", "left").agg(
        F.count(F.when(F.abs(F.col("fitted") - F.coalesce("importance", F.lit(0.0))) < 1e-9, 1))
        .alias("same_importances"))
    return scores.crossJoin(shares)  # one row each


def _logistic_check(spark, sf_dir):
    """Features, and the intercept, along which the loss has no slope at the fitted weights."""
    from pyspark.sql import functions as F
    from cohortlens.plans import model as M
    from cohortlens.plans.model_checks import logistic_slopes
    train, _test, feats = _prepared(spark, sf_dir)
    slopes = logistic_slopes(train, M.fit_logistic(train, feats))
    return slopes.agg(F.count(F.when(F.abs("slope") < 1e-4, 1)).alias("flat"),
                      F.count(F.lit(1)).alias("weights"))


def _indicator_rejects(spark, sf_dir):
    """The indicator file with a bad year and a cut line planted for every good line; what is
    rejected, and the number of good lines."""
    from pyspark.sql import functions as F
    from cohortlens.sources.rejects import read_indicator_checked
    path = _folder(spark, "indicator-bad")
    mmr = analogue_star(spark, sf_dir).who_mmr
    good = mmr.select(
        F.col("indicator_code").alias("IndicatorCode"), F.col("location").alias("Location"),
        F.col("year").cast("string").alias("Period"),
        F.col("mmr_value").cast("string").alias("FactValueNumeric"))
    bad = mmr.select(F.col("indicator_code").alias("IndicatorCode"), F.col("location").alias("Location"),
                     F.concat(F.lit("y"), F.col("year")).alias("Period"), F.lit("1").alias("FactValueNumeric"))
    good.unionByName(bad).write.option("header", True).csv(path)
    mmr.select(F.concat_ws(",", "indicator_code", "year").alias("value")).write.mode("append").text(path)
    checked = read_indicator_checked(spark, path, "mmr", most=0.7)
    return checked.rejects.select("line", "reason").unionByName(checked.rows.select(
        F.concat_ws(",", "indicator_code", "year").alias("line"), F.lit("good").alias("reason")))


def _third(star, number):
    """One of three loads: a third of the respondents, and the facts that can come by then."""
    from pyspark.sql import functions as F
    from cohortlens.schemas import with_tables

    def own(df, key):
        return df.where(F.greatest(F.pmod("woman_id", F.lit(3)), F.pmod(key, F.lit(3))) == number - 1)

    return with_tables(star, woman=star.woman.where(F.pmod("woman_id", F.lit(3)) == number - 1),
                       anc=own(star.anc, "anc_id"), mortality=own(star.mortality, "mortality_id"))


def _maintained(report):
    def run(spark, sf_dir):
        from cohortlens.plans import maintained
        star, root = analogue_star(spark, sf_dir).star, _folder(spark, "maintained")
        for number in (1, 2, 3):
            maintained.add_load(_third(star, number), root, number)
        return getattr(maintained, report)(maintained.current_sums(spark, root))
    return run


def _register_more(q):
    q.update({
        "wide_csv_labels": _wide_csv_labels,
        "indicator_csv": _indicator_csv,
        "csv_backup": _csv_backup,
        "star_load": _star_load,
        "published_extract": _published_extract,
        "null_counts": _null_counts,
        "column_presence": _column_presence,
        "surviving_deaths": _surviving_deaths,
        "top_births": _top_births,
        "report_order": _report_order,
        "report_order_two_keys": _report_order_two_keys,
        "key_map": _key_map,
        "keyed_star": _keyed_star,
        "star_commits": _star_commits,
        "committed_nulls": _committed_nulls,
        "orphan_checks_planted": _planted("orphan_checks", "quality"),
        "fk_unmapped_planted": _planted("unmapped_counts", "conform"),
        "repeated_keys_planted": _planted("repeated_keys", "conform"),
        "forest_check": _forest_check,
        "logistic_check": _logistic_check,
        "indicator_rejects": _indicator_rejects,
        "maintained_zone_summary": _maintained("zone_summary"),
        "maintained_state_burden": _maintained("state_burden_rank"),
        "project_woman": _project_woman,
        "text_normalise": _text_normalise,
        "recode_map": _recode_map,
        "coerce_numeric": _coerce_numeric,
        "classify_text": _classify_text,
        "classify_cause": _classify_cause,
        "any_flag": _any_flag,
        "priority_label": _priority_label,
        "clean_counts": _clean_counts,
        "bin_months": _bin_months,
        "cmc_dates": _cmc_dates,
        "wide_to_long": _wide_to_long,
        "dim_dedupe": _dim_dedupe,
        "etl_row_counts": _etl_row_counts,
        "fk_lookup_unmapped": _fk_lookup_unmapped,
        "repeated_keys": _repeated_keys,
        "orphan_checks": _q("orphan_checks"),
        "null_profile": _q("null_report"),
        "clinical_checks": _q("clinical_checks"),
        "row_counts": _q("row_counts"),
        "value_frequency": _value_frequency,
        "numeric_summary": _numeric_summary,
        "duplicate_keys": _duplicate_keys,
        "scan_star": _scan_star,
        "sql_pull_model_rows": _sql_pull,
        "model_rows_spread": _model_rows_spread,
        "merged_distinct_states": _merged_states,
        "feature_matrix": _features,
        "stratified_split": _stratified_split,
        "standardise": _standardise,
        "balanced_weights": _balanced_weights,
        "roc_points": _roc_points,
        "auc_exact": _auc_exact,
        "youden_threshold": _youden,
        "classification_report": _classification_report,
        "facility_by_settlement": _facility_by_settlement,
        "split_importance": _split_importance,
        "facility_lr": _fit("lr"),
        "facility_rf": _fit("rf"),
        "feature_importance": _feature_importance,
        "model_report": _model_report,
    })
    return q
