"""Published figures of the original analysis, re-derived with our operators.

The tables below are fixed values: published results (state scores, attendant
counts by zone, zone death counts) and the public indicator series they start
from.  Each test recomputes a published column from the published inputs.
"""

from pyspark.sql import functions as F

from cohortlens.functions.rates import per_thousand
from cohortlens.functions.scoring import composite_score
from cohortlens.operators.windows import rank_desc, share_within
from cohortlens.plans.analyses import trend_change
from cohortlens.schemas import WHO_MMR

# State, death rate per 1000, facility %, zero-ANC %, double barrier %, score
STATE_SCORES = [
    ("Zamfara", 28.25, 12.8, 61.5, 7.3, 71.2), ("Kebbi", 8.94, 7.6, 72.3, 42.7, 58.0),
    ("Sokoto", 11.02, 9.8, 61.1, 48.2, 57.9), ("Bayelsa", 12.08, 24.1, 37.5, 37.8, 48.1),
    ("Bauchi", 11.36, 12.9, 34.6, 25.6, 47.5), ("Yobe", 12.9, 11.9, 22.3, 27.1, 46.7),
    ("Gombe", 16.64, 17.7, 18.7, 12.4, 46.5), ("Jigawa", 12.37, 12.2, 19.1, 31.6, 45.9),
    ("Adamawa", 9.88, 10.2, 17.1, 48.3, 45.5), ("Kaduna", 10.94, 17.2, 28.9, 30.1, 45.2),
    ("Katsina", 7.65, 10.5, 39.1, 21.9, 44.4), ("Kano", 15.92, 22.7, 17.9, 13.0, 44.3),
    ("Borno", 11.06, 28.3, 14.8, 36.0, 39.9), ("Benue", 9.35, 36.9, 36.2, 25.8, 39.6),
    ("Enugu", 18.03, 49.8, 9.8, 23.5, 39.6), ("Plateau", 2.21, 25.6, 34.9, 59.7, 38.9),
    ("Niger", 0.76, 20.8, 53.8, 30.4, 38.7), ("Ebonyi", 7.3, 35.2, 12.3, 38.2, 33.5),
    ("Taraba", 1.05, 18.7, 32.1, 20.0, 32.6), ("Kwara", 0.99, 35.5, 45.7, 23.4, 32.2),
    ("Abia", 9.71, 49.7, 5.2, 38.9, 31.0), ("Akwa Ibom", 3.98, 24.1, 15.7, 21.8, 30.8),
    ("Kogi", 5.12, 53.1, 31.9, 21.1, 28.8), ("Nasarawa", 4.35, 31.9, 14.8, 18.0, 28.5),
    ("Rivers", 2.51, 34.8, 19.4, 21.2, 27.3), ("Ekiti", 3.51, 41.8, 6.8, 29.4, 24.8),
    ("Cross River", 3.41, 30.4, 4.9, 6.5, 23.6), ("Ondo", 0.0, 36.4, 24.5, 6.5, 23.0),
    ("Anambra", 2.89, 54.0, 8.3, 31.0, 21.6), ("Fct", 3.61, 47.4, 7.0, 8.7, 20.4),
    ("Oyo", 0.91, 50.9, 15.0, 15.1, 19.4), ("Delta", 1.04, 52.9, 11.6, 20.7, 19.0),
    ("Imo", 1.0, 45.6, 3.4, 20.8, 18.7), ("Ogun", 4.0, 65.6, 5.6, 25.9, 18.6),
    ("Osun", 5.93, 70.7, 4.3, 18.0, 18.0), ("Edo", 1.09, 59.5, 3.4, 14.5, 14.4),
    ("Lagos", 4.93, 73.4, 2.1, 2.7, 13.3),
]

# Zone, attendant, deliveries, published share within zone (%)
ATTENDANTS = [
    ("North Central", "None", 1076, 41.9), ("North Central", "Nurse or Midwife", 892, 34.8),
    ("North Central", "Doctor", 532, 20.7), ("North Central", "Auxiliary Midwife", 65, 2.5),
    ("North East", "None", 1805, 60.7), ("North East", "Nurse or Midwife", 745, 25.1),
    ("North East", "Auxiliary Midwife", 263, 8.8), ("North East", "Doctor", 159, 5.3),
    ("North West", "None", 3247, 74.7), ("North West", "Nurse or Midwife", 772, 17.8),
    ("North West", "Doctor", 195, 4.5), ("North West", "Auxiliary Midwife", 130, 3.0),
    ("South East", "Nurse or Midwife", 1003, 72.4), ("South East", "Doctor", 227, 16.4),
    ("South East", "None", 155, 11.2), ("South East", "Auxiliary Midwife", 1, 0.1),
    ("South South", "Nurse or Midwife", 658, 48.0), ("South South", "None", 362, 26.4),
    ("South South", "Doctor", 316, 23.0), ("South South", "Auxiliary Midwife", 35, 2.6),
    ("South West", "Nurse or Midwife", 578, 43.5), ("South West", "Doctor", 520, 39.1),
    ("South West", "None", 227, 17.1), ("South West", "Auxiliary Midwife", 5, 0.4),
]

# Zone, women, maternal deaths, published deaths per 1000
ZONE_DEATHS = [
    ("North West", 9404, 123, 13.08), ("North East", 6338, 68, 10.73),
    ("South East", 5068, 37, 7.3), ("South South", 5534, 21, 3.79),
    ("North Central", 7591, 27, 3.56), ("South West", 5115, 16, 3.13),
]

# Public maternal mortality ratio series (year, value, low, high)
MMR_SERIES = [
    (1985, 1344, 890.6, 1940), (1986, 1363, 921.3, 1940), (1987, 1351, 926, 1908),
    (1988, 1332, 920.1, 1853), (1989, 1304, 909.2, 1791), (1990, 1285, 905.2, 1749),
    (1991, 1282, 904.7, 1720), (1992, 1246, 883.3, 1677), (1993, 1200, 852.3, 1601),
    (1994, 1193, 850.9, 1585), (1995, 1186, 848, 1562), (1996, 1185, 850.1, 1564),
    (1997, 1184, 853.6, 1542), (1998, 1189, 862.8, 1534), (1999, 1165, 855.4, 1486),
    (2000, 1136, 845.9, 1438), (2001, 1130, 853.3, 1425), (2002, 1117, 857.5, 1398),
    (2003, 1090, 849.5, 1359), (2004, 1075, 845.9, 1334), (2005, 1060, 849.9, 1309),
    (2006, 1067, 864.5, 1305), (2007, 1063, 869.2, 1294), (2008, 1081, 885.8, 1308),
    (2009, 1088, 891.4, 1318), (2010, 1094, 900, 1333), (2011, 1108, 906.6, 1350),
    (2012, 1124, 919.9, 1383), (2013, 1146, 934.3, 1431), (2014, 1155, 931.1, 1465),
    (2015, 1168, 931.5, 1502), (2016, 1155, 914.2, 1512), (2017, 1142, 893.7, 1529),
    (2018, 1118, 865.9, 1528), (2019, 1091, 835.4, 1522), (2020, 1065, 795.9, 1553),
    (2021, 1046, 771.4, 1565), (2022, 1016, 735.2, 1546), (2023, 992.8, 718.3, 1540),
]


def test_composite_scores_and_tied_ranks(spark):
    df = spark.createDataFrame(STATE_SCORES, "state string, dr double, fac double, zero double, "
                                             "dbl double, published double")
    got = df.select("state", "published",
                    composite_score(F.col("dr"), F.col("zero"), F.col("fac"), F.col("dbl"))
                    .alias("score"))
    rows = got.select("*", rank_desc("score").alias("r")).collect()
    assert all(r.score == r.published for r in rows)                  # 37 / 37
    ranks = {r.state: r.r for r in rows}
    assert ranks["Zamfara"] == 1 and ranks["Lagos"] == 37
    assert ranks["Benue"] == ranks["Enugu"] == 14 and ranks["Plateau"] == 16


def test_share_within_zone(spark):
    df = spark.createDataFrame(ATTENDANTS, "zone string, who string, n long, published double")
    rows = share_within(df, "n", ["zone"], "pct").collect()
    assert all(r.pct == r.published for r in rows)                    # 24 / 24
    assert sum(r.n for r in rows) == 13968


def test_zone_death_rates(spark):
    df = spark.createDataFrame(ZONE_DEATHS, "zone string, women long, deaths long, "
                                            "published double")
    rows = df.select("published", per_thousand(F.col("deaths"), F.col("women")).alias("r")) \
        .collect()
    assert all(r.r == r.published for r in rows)                      # 6 / 6


def test_trend_on_the_public_series(spark):
    rows = [(y, float(v), float(lo), float(hi), "Nigeria", "MDG_0000000026")
            for y, v, lo, hi in MMR_SERIES]
    rows += [(y, 1.0, 1.0, 1.0, "Nigeria", "MORT_MATERNALNUM") for y, *_ in MMR_SERIES]
    out = trend_change(spark.createDataFrame(rows, WHO_MMR)).collect()
    assert len(out) == 39                                # the indicator filter halves it
    counts = {}
    for r in out:
        counts[r.trend_direction] = counts.get(r.trend_direction, 0) + 1
    assert counts == {"Baseline": 1, "Improving": 27, "Worsening": 11}
    best = min((r for r in out if r.absolute_change is not None),
               key=lambda r: r.absolute_change)
    assert (best.year, best.absolute_change) == (1993, -46.0)
    assert out[-1].mmr_value == 992.8 and out[-1].uncertainty_range == 822.0
