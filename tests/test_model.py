"""Model pipeline on a planted-signal cohort, and exact metric identities."""

import numpy as np
import pytest

from cohortlens.operators.metrics import auc_exact, classification_report, roc_points, \
    youden_threshold
from cohortlens.plans import model as M
from cohortlens.schemas import (DIM_GEOGRAPHY, DIM_WOMAN, FACT_ANC, FACT_BIRTH, FACT_MORTALITY,
                                WHO_MMR, WHO_SBA, Star)


@pytest.fixture(scope="module")
def signal_star(spark):
    """1,200 women; facility delivery depends on wealth, education, visits."""
    rng = np.random.default_rng(42)
    zones = ["North West", "North East", "South West"]
    geo = [(i, i, f"S{i}", zones[i % 3], "Urban" if i % 2 else "Rural") for i in range(6)]
    edu = ["None", "Primary", "Secondary", "Higher"]
    wealth = ["Poorest", "Poor", "Middle", "Rich", "Richest"]
    women, anc = [], []
    for w in range(1200):
        e, q, v = int(rng.integers(0, 4)), int(rng.integers(0, 5)), int(rng.integers(0, 10))
        logit = -3.0 + 0.6 * e + 0.5 * q + 0.15 * v
        fac = int(rng.random() < 1 / (1 + np.exp(-logit)))
        women.append((w, f"c{w}", w % 6, 15 + w % 35, edu[e], wealth[q], int(w % 9 == 0),
                      int(w % 4 == 0), float(1 + w % 3)))
        anc.append((10_000 + w, w, v, 1 + w % 3, fac, "Doctor" if fac else "None", fac))
    return Star(geography=spark.createDataFrame(geo, DIM_GEOGRAPHY),
                woman=spark.createDataFrame(women, DIM_WOMAN),
                birth=spark.createDataFrame([], FACT_BIRTH),
                anc=spark.createDataFrame(anc, FACT_ANC),
                mortality=spark.createDataFrame([], FACT_MORTALITY),
                who_sba=spark.createDataFrame([], WHO_SBA),
                who_mmr=spark.createDataFrame([], WHO_MMR))


def test_split_keeps_class_shares(signal_star):
    zones = M.zone_values(signal_star)
    feats = M.feature_frame(M.model_rows(signal_star), zones)
    split = M.stratified_split(feats).toPandas()
    for _label, g in split.groupby("label"):
        assert g.is_test.sum() == int(np.floor(len(g) * 0.2 + 0.5))
    assert feats.columns[:10] == ["anc_id", "woman_id"] + M.BASE_FEATURES
    assert [c for c in feats.columns if c.startswith("zone_")] == [f"zone_{z}" for z in zones]


def test_split_is_spread_over_the_ids(spark):
    df = spark.range(20_000).selectExpr("id as anc_id", "int(id % 3 = 0) as label")
    split = M.stratified_split(df)
    rows = split.toPandas()
    assert len(rows) == 20_000
    for _label, g in rows.groupby("label"):
        assert g.is_test.sum() == int(np.floor(len(g) * 0.2 + 0.5))
        shares = g.groupby(g.anc_id // 2_000).is_test.mean()      # every tenth of the id range
        assert shares.between(0.1, 0.3).all()
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan


def test_logistic_and_forest_find_the_signal(spark, signal_star):
    train, test, feats = M.prepare(signal_star)
    w = train.select("label", "class_weight").distinct().collect()
    assert len(w) == 2 and abs(sum(1 / r.class_weight for r in w) - 2.0) < 1e-9
    lr = M.fit_logistic(train, feats)
    auc_lr = auc_exact(M.score(lr, test)).first().auc
    rf = M.fit_forest(train, feats, trees=30)
    auc_rf = auc_exact(M.score(rf, test)).first().auc
    assert auc_lr > 0.7 and auc_rf > 0.7
    best = youden_threshold(roc_points(M.score(lr, test))).first()
    assert 0.0 < best.threshold < 1.0 and best.youden_j > 0.3
    rep = {r["class"]: r for r in classification_report(M.score(lr, test)).collect()}
    assert rep["accuracy"].support == test.count()
    imp = M.feature_importance(spark, rf, feats).collect()
    assert abs(sum(r.importance for r in imp) - 1.0) < 1e-6
    assert sum(r.top for r in imp) == 5
    top = {r.feature for r in imp if r.top}
    assert {"wealth_num", "education_num"} & top


def test_rows_to_fit_are_dealt_over_the_session_and_not_by_class(spark, signal_star):
    train, _test, feats = M.prepare(signal_star)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = train.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(held) >= parts and max(held) < 2 * sum(held) / len(held)
    assert M.fit_forest(train, feats, trees=2).stages[-1].getCacheNodeIds()


def test_leaves_are_led_to_by_one_chain_of_joins(spark):
    from cohortlens.plans.model_checks import led_down, leaves
    nodes = spark.createDataFrame(
        [(0, 0, 0, 0.5, 1, 2, 0.1, [2.0, 2.0]), (0, 1, None, None, -1, -1, -1.0, [2.0, 0.0]),
         (0, 2, 0, 1.5, 3, 4, 0.1, [0.0, 2.0]), (0, 3, None, None, -1, -1, -1.0, [0.0, 1.0]),
         (0, 4, None, None, -1, -1, -1.0, [1.0, 1.0]), (1, 0, None, None, -1, -1, -1.0, [3.0, 1.0])],
        "tree int, node int, feature int, threshold double, left int, right int, gain double, "
        "stats array<double>")
    rows = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 2.0), (3, 2.0), (4, None)], "id int, a double")
    got = leaves(rows, nodes, ["a"], "id", 2)
    want = led_down(rows, nodes, ["a"], "id", 2).where("leaf").select("id", "tree", "stats")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") <= 4 and "Union" not in plan


def test_model_report(signal_star):
    rows = {r.metric: r.value for r in M.model_report(signal_star, trees=20).collect()}
    assert set(rows) == {"lr_auc", "rf_auc", "lr_threshold", "lr_sensitivity", "lr_specificity",
                         "lr_minority_recall", "train_rows", "test_rows"}
    assert rows["lr_auc"] > 0.7 and rows["train_rows"] + rows["test_rows"] == 1200


def test_standardise_population_std_for_ints_and_doubles(spark):
    import numpy as np
    vals = [1.5, 2.25, 4.0, 7.75]
    df = spark.createDataFrame([(i, int(v), v) for i, v in enumerate(vals)], "id int, a int, d double")
    got = M.standardise(df, ["a", "d"]).orderBy("id").collect()
    for col, xs in (("a", np.array([int(v) for v in vals], float)), ("d", np.array(vals))):
        exp = (xs - xs.mean()) / xs.std()
        assert np.allclose([r[f"{col}_z"] for r in got], exp)


# -- checks that use nothing of the fitting library ---------------------------

def test_forest_nodes_give_the_forests_own_scores(spark, signal_star):
    from pyspark.sql import functions as F
    from cohortlens.plans.model_checks import forest_nodes, importances, led_down, rescored
    train, test, feats = M.prepare(signal_star)
    rf = M.fit_forest(train, feats, trees=15, depth=5)
    nodes = forest_nodes(spark, rf).cache()
    own = {r.anc_id: r.score for r in M.score(rf, test, keep=["anc_id"]).collect()}
    got = {r.anc_id: r.score for r in rescored(test, nodes, feats, "anc_id", 5).collect()}
    assert own.keys() == got.keys() and all(abs(own[k] - got[k]) < 1e-9 for k in own)
    told = {r.feature: r.importance for r in M.feature_importance(spark, rf, feats).collect()}
    mine = {r.feature: r.importance for r in importances(nodes, feats).collect()}
    assert all(abs(told[f] - mine.get(f, 0.0)) < 1e-9 for f in feats)

    # without sampling, a node's weights and gain follow from the rows that reach it
    one = M.fit_forest(train, feats, trees=1, depth=4, subset="all", bootstrap=False)
    nodes = forest_nodes(spark, one).cache()
    reached = led_down(train, nodes, feats, "anc_id", 4, keep=("label", "fit_weight")) \
        .groupBy("node").agg(*[F.sum(F.when(F.col("label") == k, F.col("fit_weight")).otherwise(0.0))
                               .alias(f"w{k}") for k in (0, 1)], F.count(F.lit(1)).alias("n")).collect()
    held = {r.node: (r.w0, r.w1) for r in reached}
    table = {r.node: r for r in nodes.collect()}
    assert held.keys() == table.keys() and min(r.n for r in reached) >= 20
    for node, (w0, w1) in held.items():
        assert np.allclose(table[node].stats, (w0, w1))

    def gini(w):
        return 1 - sum((x / sum(w)) ** 2 for x in w)

    for node, r in table.items():
        if r.feature is not None:
            left, right, total = held[r.left], held[r.right], sum(held[node])
            gain = gini(held[node]) - sum(gini(w) * sum(w) / total for w in (left, right))
            assert abs(gain - r.gain) < 1e-9


def test_logistic_weights_are_the_minimum(signal_star):
    from cohortlens.plans.model_checks import logistic_slopes
    train, _test, feats = M.prepare(signal_star)
    fitted = M.fit_logistic(train, feats)
    assert all(abs(r.slope) < 1e-4 for r in logistic_slopes(train, fitted).collect())
    early = M.fit_logistic(train, feats, max_iter=1)  # the check can fail
    assert any(abs(r.slope) > 1e-3 for r in logistic_slopes(train, early).collect())
