"""Edge tables for the recodes, classifiers and CMC expressions."""

import pytest
from pyspark.sql import functions as F

from cohortlens.functions import dates as D
from cohortlens.functions import scoring as S
from cohortlens.functions import text as T


def one_col(spark, values, expr, typ="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {typ}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_delivery_location_rules_are_ordered(spark):
    raw = ["Her home", "nursing home", "Government Hospital", "private hospital",
           "private clinic", "mission", "dispensary", "on the road", None, "nan", "none", ""]
    assert one_col(spark, raw, T.delivery_location) == [
        "Home", "Home", "Government Facility", "Government Facility", "Private Facility",
        "Private Facility", "Government Facility", "Other", None, None, None, None]


def test_facility_flag_uses_its_own_word_list(spark):
    raw = ["private hospital", "ngo", "dispensary", "maternity", "her home", "none"]
    assert one_col(spark, raw, T.facility_flag) == [1, 1, 0, 0, 0, None]


def test_skilled_flag_and_priority(spark):
    rows = [("yes", None, None, None, None), (None, " YES ", None, None, None),
            (None, None, "1", None, None), (None, None, None, "yes", None),
            (None, None, None, None, "yes"), (None, None, None, None, None),
            ("1", "yes", None, None, None)]
    df = spark.createDataFrame(rows, "m3a string, m3b string, m3c string, m3d string, m3e string")
    out = df.select(T.skilled_flag("m3a", "m3b", "m3c").alias("s"),
                    T.attendant_priority().alias("p")).collect()
    assert [r.s for r in out] == [1, 1, 1, 0, 0, 0, 1]
    assert [r.p for r in out] == ["Doctor", "Nurse or Midwife", "Auxiliary Midwife",
                                  "Traditional Birth Attendant", "Other", "None", "Doctor"]


def test_clean_visits(spark):
    raw = ["no antenatal visits", "0", "4", "4.9", "98", "don't know", None]
    assert one_col(spark, raw, T.clean_visits) == [0, 0, 4, 4, None, None, None]


def test_months_to_trimester(spark):
    raw = ["0", "3", "3.5", "6", "7", "98", "x", None]
    assert one_col(spark, raw, T.months_to_trimester) == [1, 1, 2, 2, 3, None, None, None]


def test_pregnancy_related_keeps_reference_negation_quirk(spark):
    raw = ["died while pregnant", "6 weeks after delivery", "death not related",
           "never pregnant", "violence", None]
    assert one_col(spark, raw, T.pregnancy_related) == [1, 1, 0, 1, None, None]


def test_recode_maps(spark):
    assert one_col(spark, ["Poorer", "5", "richer ", "x"],
                   lambda c: T.recode(c, T.WEALTH_MAP)) == ["Poor", "Richest", "Rich", None]
    assert one_col(spark, ["big problem", "not a problem", "dk"],
                   lambda c: T.recode(c, T.DISTANCE_MAP)) == [1, 0, None]
    assert one_col(spark, ["yes", "1", "no", "0", "dead", "x"],
                   lambda c: T.recode(c, T.CHILD_ALIVE_MAP)) == [1, 1, 0, 0, 0, None]


def test_title_case_matches_python(spark):
    raw = ["fct abuja-north", "  akwa ibom ", "o'brien", "2nd zone", "NORTH WEST"]
    assert one_col(spark, raw, T.normalise_label) == [s.strip().title() for s in raw]


def test_years_since_death_half_even_and_window(spark):
    df = spark.createDataFrame([(1489, 1489 - m) for m in (3, 9, 84, 85, -1)], "i int, d int")
    y = [r[0] for r in df.select(D.years_between(F.col("i"), F.col("d"))).collect()]
    assert y == [0.2, 0.8, 7.0, 7.1, None]
    keep = [r[0] for r in df.select(D.within_recency(D.years_between(F.col("i"), F.col("d"))))
            .collect()]
    assert keep == [True, True, True, False, False]


def test_cmc_year(spark):
    assert one_col(spark, [1, 12, 13, 1489, 0], lambda c: D.cmc_year(c), "int") == \
        [1900, 1900, 1901, 2024, None]


def test_age_at_death_window(spark):
    df = spark.createDataFrame([(1489, 3.0, 1093)], "i int, y double, b int")
    assert df.select(D.age_at_event(F.col("i"), F.col("y"), F.col("b"))).first()[0] == 30.0
    ages = spark.createDataFrame([(b,) for b in (1489 - 36 - 9 * 12, 1489 - 36 - 10 * 12,
                                                 1489 - 36 - 80 * 12, 1489 - 36 - 81 * 12)], "b int")
    out = [r[0] for r in ages.select(D.age_at_event(F.lit(1489), F.lit(3.0), F.col("b"))).collect()]
    assert out == [None, 10.0, 80.0, None]


def test_care_gap_tiers(spark):
    df = spark.createDataFrame([(19.9, 30.1), (20.0, 30.0), (39.9, 20.1), (40.0, 90.0)],
                               "f double, z double")
    assert [r[0] for r in df.select(S.care_gap_category(F.col("f"), F.col("z"))).collect()] == \
        ["Critical Care Gap", "Significant Care Gap", "Significant Care Gap", "Moderate"]


def test_trend_direction_and_label(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, 2.0), (3.0, 2.0), (2.0, 2.0)],
                               "v double, p double")
    assert [r[0] for r in df.select(S.trend_direction(F.col("v"), F.col("p"))).collect()] == \
        ["Baseline", "Improving", "Worsening", "No Change"]
    ch = spark.createDataFrame([(None,), (1.1,), (-0.4,), (0.0,)], "c double")
    assert [r[0] for r in ch.select(S.trend_label(F.col("c"))).collect()] == \
        ["Baseline", "Improving", "Declining", "Stable"]


def test_benchmark_verdict_bounds_inclusive(spark):
    df = spark.createDataFrame([(45.0,), (40.6,), (50.8,), (40.7,), (50.7,)], "v double")
    out = [r[0] for r in df.select(S.benchmark_verdict(F.col("v"), F.lit(45.7))).collect()]
    assert out == ["Consistent with WHO", "Below WHO estimate", "Above WHO estimate",
                   "Consistent with WHO", "Consistent with WHO"]


@pytest.mark.parametrize("dr,fac,zero,dbl,score", [
    (28.25, 12.8, 61.5, 7.3, 71.2), (8.94, 7.6, 72.3, 42.7, 58.0),
    (12.08, 24.1, 37.5, 37.8, 48.1), (4.93, 73.4, 2.1, 2.7, 13.3)])
def test_composite_score_published_samples(spark, dr, fac, zero, dbl, score):
    df = spark.createDataFrame([(dr, fac, zero, dbl)], "d double, f double, z double, b double")
    got = df.select(S.composite_score(F.col("d"), F.col("z"), F.col("f"), F.col("b"))).first()[0]
    assert got == score


def test_pregnancy_related_negation_guard(spark):
    raw = ["never pregnant", "died while pregnant", "death not related to pregnancy"]
    got = one_col(spark, raw, lambda c: T.pregnancy_related(c, negation_guard=True))
    assert got == [0, 1, 0]


def test_coercion_never_keeps_nan(spark):
    assert one_col(spark, ["nan", " 4 ", "x", None, "2.5"], T.to_double) == \
        [None, 4.0, None, None, 2.5]
    assert one_col(spark, ["nan", "4", "4.0", "4.5"], T.to_int) == [None, 4, 4, None]
    # the trimester rule keeps the original's float('nan') fall-through
    assert one_col(spark, ["nan"], T.months_to_trimester) == [3]


def test_title_case_property_random_ascii(spark):
    import random
    rnd = random.Random(1234)
    alphabet = "abcXYZ019 -'_/.,()&"
    samples = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 14)))
               for _ in range(400)]
    got = one_col(spark, samples, T.normalise_label)
    assert got == [s.strip().title() for s in samples]
