"""The four denominator conventions of ``rates.rate``."""

import pytest
from pyspark.sql import functions as F

from cohortlens.functions.rates import count_pct, rate, weight_pct


@pytest.fixture()
def rows(spark):
    # id, weight, facility (NULL = unknown), distance barrier
    data = [(1, 2.0, 1, 1), (1, 2.0, 1, 1), (2, 1.0, 0, 0), (3, 3.0, None, 1), (4, 4.0, 1, 0)]
    return spark.createDataFrame(data, "id int, w double, fac int, dist int")


def test_unweighted_conventions(rows):
    fac = F.col("fac") == 1
    r = rows.agg(
        rate(fac, denom="distinct", distinct="id", digits=None).alias("distinct"),
        rate(fac, denom="known", known=F.col("fac").isNotNull(), digits=None).alias("known"),
        rate(fac, denom="all", digits=None).alias("all"),
    ).first()
    assert r["distinct"] == 3 * 100.0 / 4        # 3 facility rows over 4 distinct ids
    assert r["known"] == 3 * 100.0 / 4           # 4 rows with a known value
    assert r["all"] == 3 * 100.0 / 5


def test_weighted_conventions_and_subpopulation(rows):
    fac, dist = F.col("fac") == 1, F.col("dist") == 1
    r = rows.agg(
        rate(fac, denom="all", weight="w", digits=None).alias("all"),
        rate(fac, denom="known", weight="w", known=F.col("fac").isNotNull(),
             digits=None).alias("known"),
        rate(fac, denom="all", weight="w", within=dist, digits=None).alias("within"),
    ).first()
    assert r["all"] == 8.0 / 12.0 * 100          # (2+2+4) / 12
    assert r["known"] == 8.0 / 9.0 * 100         # known-value weights 2+2+1+4
    assert r["within"] == 4.0 / 7.0 * 100        # among distance-barrier rows: 4 / (2+2+3)


def test_zero_denominator_is_null_not_an_error(spark):
    df = spark.createDataFrame([(0, 0.0)], "n long, w double")
    r = df.select(count_pct(F.col("n"), F.col("n")).alias("a"),
                  weight_pct(F.col("w"), F.col("w")).alias("b")).first()
    assert r.a is None and r.b is None


def test_rounding_half_up_vs_half_even(spark):
    df = spark.createDataFrame([(1, 8)], "a long, b long")      # 12.5 %
    r = df.select(count_pct(F.col("a"), F.col("b"), digits=0).alias("up"),
                  count_pct(F.col("a"), F.col("b"), digits=0, half_even=True).alias("even")).first()
    assert (r.up, r.even) == (13.0, 12.0)
