"""Skewed fixture: one woman holds a third of all death rows and some women
have two ANC rows, so both multiplicities exceed 1.  The fan-out algebra must
equal the literal joins (the oracle SQL, run by DuckDB on the same rows)."""

import duckdb
import numpy as np
import pandas as pd
import pytest

import oracle_sql as O
from cohortlens.plans import analyses as N
from cohortlens.schemas import (DIM_GEOGRAPHY, DIM_WOMAN, FACT_ANC, FACT_BIRTH, FACT_MORTALITY,
                                WHO_MMR, WHO_SBA, Star)
from tools.compare import rows_of


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(9)
    zones = ["Zone A", "Zone B", "Zone C"]
    geo = pd.DataFrame({"state_id": range(6), "dhs_cluster_id": range(6),
                        "state_name": [f"S{i}" for i in range(6)],
                        "geopolitical_zone": [zones[i % 3] for i in range(6)],
                        "urban_rural": ["Urban", "Rural"] * 3})
    n = 60
    edu = np.array(["None", "Primary", "Secondary", "Higher", None], dtype=object)
    wealth = np.array(["Poorest", "Poor", "Middle", "Rich", "Richest"], dtype=object)
    woman = pd.DataFrame({
        "woman_id": range(n), "dhs_case_id": [f"c{i}" for i in range(n)],
        "state_id": rng.integers(0, 6, n), "age_at_survey": rng.integers(15, 50, n),
        "education_level": edu[rng.integers(0, 5, n)], "wealth_index": wealth[rng.integers(0, 5, n)],
        "has_insurance": rng.integers(0, 2, n), "distance_barrier": rng.integers(0, 2, n),
        "survey_weight": rng.integers(1, 9, n).astype(float)})
    anc_w = list(range(0, n, 2)) + [0, 4, 8]                 # women 0, 4, 8 have two rows
    m = len(anc_w)
    att = np.array(["Doctor", "Nurse or Midwife", "Auxiliary Midwife", "None", "Other"], dtype=object)
    anc = pd.DataFrame({
        "anc_id": range(1000, 1000 + m), "woman_id": anc_w,
        "anc_visits": pd.array(rng.integers(0, 9, m), dtype="Int32"),
        "first_anc_trimester": pd.array(rng.integers(1, 4, m), dtype="Int32"),
        "facility_delivery": pd.array(rng.integers(0, 2, m), dtype="Int32"),
        "delivery_assisted_by": att[rng.integers(0, 5, m)],
        "postnatal_check": pd.array(rng.integers(0, 2, m), dtype="Int32")})
    anc.loc[anc.index % 7 == 3, "anc_visits"] = pd.NA
    hot = [0] * 30                                           # a third of all death rows
    other = list(rng.integers(1, n, 60))
    mw = hot + other
    k = len(mw)
    pr = rng.integers(0, 3, k).astype(object)
    pr[pr == 2] = None
    mort = pd.DataFrame({
        "mortality_id": range(5000, 5000 + k), "woman_id": mw, "sibling_sex": "Female",
        "sibling_alive": 0, "sibling_age_at_death": rng.integers(15, 50, k).astype(float),
        "years_since_death": 1.0, "pregnancy_related": pd.array(pr, dtype="Int32"),
        "death_year": 2020})
    bw = [0] * 20 + list(rng.integers(0, n, 40))
    b = len(bw)
    birth = pd.DataFrame({
        "birth_id": range(9000, 9000 + b), "woman_id": bw, "birth_order": 1,
        "birth_year": rng.integers(2019, 2026, b), "child_alive": 1,
        "delivery_location": np.array(["Home", "Government Facility", None],
                                      dtype=object)[rng.integers(0, 3, b)],
        "skilled_attendant": rng.integers(0, 2, b)})
    sba = pd.DataFrame({"year": [2018, 2022, 2024], "value": [40.0, 45.0, 46.0],
                        "value_display": [40, 45, 46], "location": "Nigeria",
                        "indicator_code": "MDG_0000000025"})
    mmr = pd.DataFrame({"year": [2015, 2020, 2023], "mmr_value": [1168.0, 1065.0, 992.8],
                        "mmr_value_low": [900.0, 800.0, 718.3],
                        "mmr_value_high": [1500.0, 1550.0, 1540.0], "location": "Nigeria",
                        "indicator_code": "MDG_0000000026"})
    frames = {"dim_geography": (geo, DIM_GEOGRAPHY), "dim_woman": (woman, DIM_WOMAN),
              "fact_anc_delivery": (anc, FACT_ANC), "fact_maternal_mortality": (mort, FACT_MORTALITY),
              "fact_birth": (birth, FACT_BIRTH), "who_nigeria_sba": (sba, WHO_SBA),
              "who_nigeria_mmr": (mmr, WHO_MMR)}
    con = duckdb.connect()
    sdfs = {}
    for name, (pdf, schema) in frames.items():
        rows = [tuple(None if (v is pd.NA or (isinstance(v, float) and np.isnan(v))) else
                      (v.item() if hasattr(v, "item") else v) for v in r)
                for r in pdf[[f.name for f in schema.fields]].itertuples(index=False)]
        sdfs[name] = spark.createDataFrame(rows, schema)
        con.register(f"{name}_pdf", pdf)
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM {name}_pdf")
    star = Star(geography=sdfs["dim_geography"], woman=sdfs["dim_woman"],
                birth=sdfs["fact_birth"], anc=sdfs["fact_anc_delivery"],
                mortality=sdfs["fact_maternal_mortality"], who_sba=sdfs["who_nigeria_sba"],
                who_mmr=sdfs["who_nigeria_mmr"])
    return star, con


CASES = {
    "zone_summary_published": lambda s: N.zone_summary(s, "as_published"),
    "zone_extract": N.zone_extract,
    "state_burden_rank": N.state_burden_rank,
    "composite_risk": N.composite_risk,
    "state_risk_extract": N.state_risk_extract,
    "death_profile_all": N.death_profile_all,
    "death_profile_extract": N.death_profile_extract,
    "national_figures": N.national_figures,
    "benchmark_report": N.benchmark_report,
    "rates_by_quintile": N.rates_by_quintile,
    "rates_by_education": N.rates_by_education,
    "barriers_by_zone": N.barriers_by_zone,
    "care_pathway_by_state": N.care_pathway_by_state,
    "share_within_zone": N.share_within_zone,
    "care_funnel": N.care_funnel,
}


@pytest.mark.parametrize("key", sorted(CASES))
def test_fanout_algebra_equals_literal_joins(skewed, key):
    star, con = skewed
    sdf = CASES[key](star)
    got = rows_of(sdf.columns, sdf.collect())
    rel = con.sql(O.Q[key])
    exp = rows_of(rel.columns, rel.fetchall())
    assert sorted(sdf.columns) == sorted(rel.columns)
    assert got == exp


# -- joins that deal out heavy keys, distinct states that merge ----------------

def _hot_rows(spark, n=12_000):
    from pyspark.sql import functions as F
    return spark.range(0, n, numPartitions=6).select(
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None)
        .otherwise(F.col("id") % 900).alias("woman_id"), F.col("id").alias("anc_id"))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_equals_the_plain_join_and_is_even(spark, how):
    from pyspark.sql import functions as F
    from cohortlens.operators.skew import heavy_keys, spread_join
    left = _hot_rows(spark)
    right = spark.range(0, 800).select(F.col("id").alias("woman_id"), (F.col("id") * 2).alias("w"))
    right = right.unionByName(right.where("woman_id < 20").withColumn("w", F.lit(-1)))  # not unique
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled",
                                           "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plain, spread = left.join(right, "woman_id", how), spread_join(left, right, "woman_id", how)
        assert [r.woman_id for r in heavy_keys(left, "woman_id").collect()] == [7]
        assert sorted(map(str, spread.select(plain.columns).collect())) == sorted(map(str, plain.collect()))

        def held(df):
            return sorted(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())

        even, uneven = held(spread), held(plain)
        assert uneven[-1] > 2 * uneven[len(uneven) // 2]
        assert even[-1] <= 2 * even[len(even) // 2] and len(even) == 8
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_spread_join_without_heavy_keys_and_of_nothing(spark):
    from cohortlens.operators.skew import heavy_keys, spread_join
    left = _hot_rows(spark).where("woman_id <> 7")
    right = spark.createDataFrame([(1, "a"), (None, "b")], "woman_id long, w string")
    assert heavy_keys(left, "woman_id").count() == 0
    assert spread_join(left, right, "woman_id").count() == left.where("woman_id = 1").count()
    assert spread_join(left.where("false"), right, "woman_id", "left").collect() == []
    with pytest.raises(ValueError):
        spread_join(left, right, "woman_id", "full")


def test_distinct_states_merge(spark):
    from pyspark.sql import functions as F
    from cohortlens.operators.distinct_states import distinct_counts, distinct_state, merged
    rng = np.random.default_rng(3)
    rows = [(f"s{g}", f"z{g % 2}", int(i), int(f)) for g, i, f in zip(
        rng.integers(0, 5, 3000), rng.integers(0, 70_000, 3000), rng.integers(0, 3, 3000), strict=True)]
    df = spark.createDataFrame([*rows, ("s9", "z1", None, 1)], "state string, zone string, id long, f int")
    measures = {"every": None, "ones": F.col("f") == 1}
    places = ["state", "zone"]
    halves = [distinct_state(df.where(c), places, "id", measures)
              for c in ("f < 2", "f > 0")]  # rows with f = 1 are delivered twice
    state = merged(halves, places)
    for groups in (places, ["zone"], []):
        got = {tuple(r[g] for g in groups): (r.every, r.ones)
               for r in distinct_counts(state, groups).collect()}
        want = {}
        for s, z, i, f in rows:
            k = tuple({"state": s, "zone": z}[g] for g in groups)
            a, b = want.setdefault(k, (set(), set()))
            a.add(i)
            if f == 1:
                b.add(i)
        assert got == {k: (len(a), len(b)) for k, (a, b) in want.items()}
