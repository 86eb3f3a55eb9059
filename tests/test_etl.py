"""Wide extract -> star schema pipeline on a literal fixture."""

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import conform as C
from cohortlens.operators.quality import column_presence, orphan_checks, row_counts
from cohortlens.plans.etl import build_star, run_etl
from cohortlens.sources.io import read_star, write_star

from .fixtures import fanout_star, wide_frame


@pytest.fixture()
def star(spark):
    w = wide_frame(spark)
    ref = fanout_star(spark)
    return build_star(w, ref.who_sba, ref.who_mmr)


def test_dimension_rows_and_recodes(star):
    geo = {(r.state_name, r.urban_rural): r for r in star.geography.collect()}
    assert set(geo) == {("Kano", "Urban"), ("Kano", "Rural"), ("Lagos", "Urban")}
    assert geo[("Kano", "Rural")].dhs_cluster_id == 12          # min cluster kept
    assert geo[("Kano", "Urban")].geopolitical_zone == "North West"
    women = {r.dhs_case_id: r for r in star.woman.collect()}
    assert set(women) == {"1 1", "2 1", "3 1", "4 1", "5 1"}
    w1, w2, w5 = women["1 1"], women["2 1"], women["5 1"]
    assert (w1.education_level, w1.wealth_index, w1.has_insurance, w1.distance_barrier) == \
        ("None", "Poorest", 0, 1)
    assert (w2.education_level, w2.wealth_index, w2.has_insurance, w2.distance_barrier) == \
        ("Secondary", "Richest", 1, 0)
    assert (w5.education_level, w5.wealth_index, w5.has_insurance) == (None, None, None)
    assert w1.survey_weight == 1.5 and w1.state_id is not None


def test_births_reshape(star):
    b = star.birth.orderBy("woman_id", "birth_order").collect()
    assert len(b) == 7       # 3 + 1 + 0 + 2 + 1 recorded births
    by_year = {r.birth_year: r for r in b}
    assert by_year[2015].delivery_location is None and by_year[2015].skilled_attendant == 0
    assert by_year[2023].delivery_location == "Government Facility"
    assert by_year[2023].skilled_attendant == 1
    assert by_year[2019].delivery_location == "Home"
    assert by_year[2021].delivery_location == "Private Facility"
    assert by_year[2018].delivery_location == "Private Facility"
    assert by_year[2024].child_alive is None and by_year[2023].child_alive == 1


def test_anc_rows(star):
    a = {r.woman_id: r for r in star.anc.collect()}
    assert len(a) == 4            # women with a recent delivery place
    vals = {(r.anc_visits, r.first_anc_trimester, r.facility_delivery,
             r.delivery_assisted_by, r.postnatal_check) for r in a.values()}
    assert vals == {(0, None, 1, "Doctor", 1), (4, 2, 0, "None", 0),
                    (8, 3, 1, "Nurse or Midwife", 1),
                    (0, None, None, "Traditional Birth Attendant", None)}


def test_sister_filters_and_dates(star):
    m = star.mortality.collect()
    assert len(m) == 2           # female+dead+recent: case 1 sister 1 and case 5
    assert all(r.sibling_sex == "Female" and r.sibling_alive == 0 for r in m)
    got = sorted((r.years_since_death, r.sibling_age_at_death, r.death_year, r.pregnancy_related)
                 for r in m)
    assert got == [(0.8, 23.0, 2023, 1), (3.0, 33.0, 2021, 1)]


def test_keys_unique_and_gate(spark, star):
    assert C.key_collisions(star.woman, "woman_id", ["dhs_case_id"]).count() == 0
    assert star.birth.select("birth_id").distinct().count() == star.birth.count()
    C.assert_mapped(star)
    orphan = star.birth.limit(1).withColumn("woman_id", F.lit(-42).cast("long")) \
        .withColumn("birth_id", F.lit(-1).cast("long"))
    bad = star.__class__(**{**star.__dict__, "birth": star.birth.unionByName(orphan)})
    with pytest.raises(C.MappingError):
        C.assert_mapped(bad)
    checks = {r.check_name: r.status for r in orphan_checks(bad).collect()}
    assert checks["fact_birth with no valid woman_id"] == "FAIL"


def test_write_is_idempotent(spark, star, tmp_out):
    write_star(star, tmp_out)
    write_star(star, tmp_out)
    counts = {r.table_name: r.row_count for r in row_counts(read_star(spark, tmp_out)).collect()}
    assert counts["dim_woman"] == 5 and counts["fact_birth"] == 7


def test_run_etl_end_to_end(spark, tmp_out):
    ref = fanout_star(spark)
    report = run_etl(spark, wide_frame(spark), ref.who_sba, ref.who_mmr, tmp_out)
    counts = {r.table_name: r.row_count for r in report.collect()}
    assert counts == {"who_nigeria_sba": 1, "who_nigeria_mmr": 1, "dim_geography": 3,
                      "dim_woman": 5, "fact_birth": 7, "fact_anc_delivery": 4,
                      "fact_maternal_mortality": 2}


def test_column_presence(spark):
    w = wide_frame(spark)
    rep = {r.column_name: r.status for r in
           column_presence(spark, w, ["caseid", "v005", "m14_1", "m14_2"]).collect()}
    assert rep == {"caseid": "FOUND", "v005": "FOUND", "m14_1": "FOUND", "m14_2": "MISSING"}


def test_bucketed_star_joins_without_shuffle(spark, tmp_out):
    from cohortlens.plans.analyses import zone_summary
    from cohortlens.sources.analogue import analogue_star
    from cohortlens.sources.io import read_star_tables, write_star_tables
    src = analogue_star(spark, "/root/testdata/sf0.001").materialise()
    write_star_tables(src, "cl_bucketed", tmp_out, buckets=4)
    star = read_star_tables(spark, "cl_bucketed")
    got = sorted(tuple(r) for r in zone_summary(star).collect())
    exp = sorted(tuple(r) for r in zone_summary(src).collect())
    assert got == exp
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = zone_summary(star)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "SortMergeJoin" in plan
    assert "hashpartitioning(woman_id" not in plan


def test_bucketed_tables_give_identical_analyses(spark, tmp_out):
    from cohortlens.plans import analyses as N
    from cohortlens.sources.analogue import analogue_star
    from cohortlens.sources.io import read_star_tables, write_star_tables
    from tools.compare import rows_of
    src = analogue_star(spark, "/root/testdata/sf0.001").materialise()
    write_star_tables(src, "cl_roundtrip", tmp_out, buckets=3)
    star = read_star_tables(spark, "cl_roundtrip")
    for fn in (N.composite_risk, N.state_risk_extract, N.death_profile_all, N.benchmark_report,
               N.yearly_coverage, N.share_within_zone, N.care_funnel, N.national_kpis):
        a, b = fn(src), fn(star)
        assert rows_of(a.columns, a.collect()) == rows_of(b.columns, b.collect()), fn.__name__


def test_gate_catches_unknown_state_label(spark):
    from pyspark.sql import functions as F
    w = wide_frame(spark)
    odd = w.where("caseid = '  3 1'").withColumn("caseid", F.lit("  9 1")) \
        .withColumn("sstate", F.lit("atlantis"))
    geo = C.build_geography(w)                        # geography without the new label
    women = C.build_woman(w.unionByName(odd), geo)
    star = build_star(w, fanout_star(spark).who_sba, fanout_star(spark).who_mmr)
    bad = star.__class__(**{**star.__dict__, "woman": women})
    got = {r.foreign_key: r.unmapped_rows for r in C.unmapped_counts(bad).collect()}
    assert got["dim_woman.state_id"] == 1
    with pytest.raises(C.MappingError):
        C.assert_mapped(bad)


def test_etl_stops_on_a_repeated_case_id(spark, tmp_out):
    from cohortlens.operators.conform import MappingError
    from cohortlens.plans.etl import run_etl
    wide = wide_frame(spark)
    again = wide.unionByName(wide.limit(1))
    empty = spark.createDataFrame([], "year int")
    with pytest.raises(MappingError, match="dim_woman=2"):
        run_etl(spark, again, empty, empty, tmp_out)
