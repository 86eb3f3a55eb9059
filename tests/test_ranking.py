"""Distributed running totals / ranks / quantiles against pandas."""

import numpy as np
import pandas as pd

from cohortlens.operators.metrics import auc_exact, roc_points, youden_threshold
from cohortlens.operators.ranking import exact_quantiles, rank_within, running_totals


def test_running_totals_match_cumsum_with_ties(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"k": rng.integers(0, 50, 2000), "x": rng.integers(0, 5, 2000)})
    df = spark.createDataFrame(pdf).repartition(7)
    got = running_totals(df, "k", ["x"], ranges=5).toPandas()
    totals = pdf.groupby("k").x.sum().sort_index().cumsum()
    assert (got.cum_x.values == totals.loc[got.k].values).all()
    got_d = running_totals(df, "k", ["x"], descending=True, ranges=5).toPandas()
    tot_d = pdf.groupby("k").x.sum().sort_index(ascending=False).cumsum()
    assert (got_d.cum_x.values == tot_d.loc[got_d.k].values).all()


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    vals = rng.integers(0, 30, 999)
    df = spark.createDataFrame(pd.DataFrame({"v": vals}))
    got = {r.p: r.value for r in exact_quantiles(df, "v", [0.25, 0.5, 0.75, 0.9]).collect()}
    for p in (0.25, 0.5, 0.75, 0.9):
        assert abs(got[p] - np.quantile(vals, p)) < 1e-9


def test_rank_within_matches_row_number(spark):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 500), "h": rng.permutation(500)})
    got = rank_within(spark.createDataFrame(pdf), "g", "h", "h", "r").toPandas()
    exp = pdf.assign(r=pdf.groupby("g").h.rank(method="first").astype(int))
    m = got.merge(exp, on=["g", "h"])
    assert len(m) == 500 and (m.r_x == m.r_y).all()


def _auc_pairs(y, s):
    pos, neg = s[y == 1], s[y == 0]
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    return wins / (len(pos) * len(neg))


def test_auc_and_youden_with_ties(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 400)
    s = np.round(rng.random(400) + 0.3 * y, 1)       # heavy ties
    df = spark.createDataFrame(pd.DataFrame({"label": y, "score": s}))
    auc = auc_exact(df).first().auc
    assert abs(auc - _auc_pairs(y, s)) < 1e-12
    roc = roc_points(df).toPandas().sort_values("threshold", ascending=False)
    j = roc.tpr - roc.fpr
    best = roc.loc[j == j.max()].threshold.max()
    assert youden_threshold(roc_points(df)).first().threshold == best


def test_null_groups_and_null_keys_are_kept(spark):
    rows = [(None, 1, 10), (None, 1, 20), (None, 3, 5), ("a", None, 7), ("a", 2, 1), ("a", 2, 2)]
    df = spark.createDataFrame(rows, "g string, k int, x int").repartition(3)
    got = running_totals(df, "k", ["x"], group_cols=["g"], with_totals=True, ranges=3).collect()
    assert sorted(((r.g, r.k, r.x, r.cum_x, r.tot_x) for r in got), key=str) == sorted([
        (None, 1, 10, 30, 35), (None, 1, 20, 30, 35), (None, 3, 5, 35, 35), ("a", None, 7, 7, 10),
        ("a", 2, 1, 10, 10), ("a", 2, 2, 10, 10)], key=str)
    ranked = rank_within(df, "g", "k", "x", "r", size_name="n").collect()
    assert sorted(((r.g, r.x, r.r, r.n) for r in ranked), key=str) == sorted([
        (None, 10, 1, 3), (None, 20, 2, 3), (None, 5, 3, 3), ("a", 7, 1, 3), ("a", 1, 2, 3),
        ("a", 2, 3, 3)], key=str)


def test_places_of_large_and_small_groups_by_descending_key(spark):
    from cohortlens.operators.ranking import place_within
    rows = [(g, k, i) for i, (g, k) in enumerate(
        [("big", k % 40) for k in range(200)] + [("big", None)] * 3 + [("small", k) for k in range(9)]
        + [("small", None)] + [(None, k) for k in range(60)] + [("one", 7)])]
    df = spark.createDataFrame(rows, "g string, k long, x int").repartition(5)
    for heavy, ranges in ((50, 4), (50, 64), (1000, 4)):
        got = {}
        for r in place_within(df, "g", "k", heavy=heavy, ranges=ranges).collect():
            got.setdefault(r.g, []).append((r.place, r.k))
        assert sum(map(len, got.values())) == len(rows) and set(got) == {"big", "small", None, "one"}
        for g, placed in got.items():
            want = sorted((k for h, k, _ in rows if h == g), key=lambda k: (k is None, -(k or 0)))
            assert [k for _, k in sorted(placed, key=lambda p: p[0])] == want
            assert sorted(p for p, _ in placed) == list(range(len(want)))


def test_no_job_runs_while_a_running_total_is_planned(spark):
    df = spark.range(1000).selectExpr("id % 50 as k", "id as x")
    group = "planning-running-totals"
    spark.sparkContext.setJobGroup(group, "")
    try:
        running_totals(df, "k", ["x"])
        assert list(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_top_k_and_latest_row(spark):
    from cohortlens.operators.ranking import latest_row, top_k
    df = spark.createDataFrame([(y, float(y % 7)) for y in range(2000, 2030)], "year int, v double")
    assert [r.year for r in top_k(df, "year", 3).collect()] == [2029, 2028, 2027]
    assert tuple(latest_row(df, "year", ["year", "v"]).first()) == (2029, float(2029 % 7))


def test_null_profile_counts_every_column(spark):
    from cohortlens.operators.quality import null_profile
    df = spark.createDataFrame([(1, None, "a"), (None, None, "b")], "x int, y string, z string")
    got = {r.column_name: r.null_count for r in null_profile(df, "t").collect()}
    assert got == {"x": 1, "y": 2, "z": 0}
