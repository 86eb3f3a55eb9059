"""Entry C: facility-delivery prediction on MLlib.

pull (woman x geography x anc, known outcome) -> features -> stratified split
-> survey x balanced-class weights -> weighted logistic regression and random
forest -> exact ROC / AUC / Youden / report / importances.  Fitting runs as
distributed MLlib jobs (gradient / histogram aggregation); only model
parameters and curve-sized tables reach the driver.

Fixed values (the reference's encodings and hyper-parameters): education
None/Primary/Secondary/Higher -> 0..3; wealth Poorest/Poor/Middle/Rich/Richest
-> 0..4; missing visits and trimester -> 0; urban = 'Urban'; test share 0.2;
seed 42; LR max 1000 iterations with an L2 penalty (C = 1); RF 200 trees,
depth 8, at least 20 rows per leaf, sqrt features per split.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import spread_join
from ..schemas import Star
from ..session import checkpoint_dir

EDUCATION_ORDER = {"None": 0, "Primary": 1, "Secondary": 2, "Higher": 3}
WEALTH_ORDER = {"Poorest": 0, "Poor": 1, "Middle": 2, "Rich": 3, "Richest": 4}
BASE_FEATURES = ["age_at_survey", "education_num", "wealth_num", "has_insurance",
                 "distance_barrier", "anc_visits_clean", "trimester_clean", "urban"]
LABEL, WEIGHT = "facility_delivery", "survey_weight"
TEST_SHARE, SEED = 0.2, 42
FEATURE_LABELS = {"wealth_num": "Wealth Index", "education_num": "Education Level",
                  "anc_visits_clean": "ANC Visits", "age_at_survey": "Age at Survey",
                  "distance_barrier": "Distance Barrier", "trimester_clean": "First ANC Trimester",
                  "urban": "Urban Residence", "has_insurance": "Health Insurance"}

# The rows a model is fitted on, as SQL over the conformed tables: one row per care
# record with a known place of delivery.
MODEL_PULL_SQL = """
SELECT care.anc_id, woman_id, age_at_survey, education_level, wealth_index, has_insurance,
       distance_barrier, survey_weight, place.geopolitical_zone, place.urban_rural,
       care.anc_visits, care.first_anc_trimester, care.facility_delivery
FROM fact_anc_delivery AS care
JOIN dim_woman AS respondent USING (woman_id)
JOIN dim_geography AS place USING (state_id)
WHERE care.facility_delivery IS NOT NULL
"""


def model_rows(star: Star, spread: bool = False) -> DataFrame:
    """One row per care record with a known outcome, with its woman's attributes.

    ``spread`` deals out the records of women who hold a large share of them
    (``operators.skew``) at the price of a sketch over the records."""
    geo = star.geography.select("state_id", "geopolitical_zone", "urban_rural")
    anc = star.anc.where(F.col("facility_delivery").isNotNull()).select(
        "anc_id", "woman_id", "anc_visits", "first_anc_trimester", "facility_delivery")
    women = star.woman.join(geo, "state_id")
    return (spread_join(anc, women, "woman_id") if spread else anc.join(women, "woman_id")).select(
        "anc_id", "woman_id", "age_at_survey", "education_level", "wealth_index", "has_insurance",
        "distance_barrier", "survey_weight", "geopolitical_zone", "urban_rural", "anc_visits",
        "first_anc_trimester", "facility_delivery")


def _ordinal(col: str, order: dict[str, int]) -> Column:
    m = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    return F.try_element_at(m, F.col(col))


def zone_values(star: Star) -> list[str]:
    """Zone categories (sorted) from the geography dimension; one indicator column
    is made per value.  The dimension holds one row per state and settlement, so its
    zones are names on a map, not data that grows."""
    zones = star.geography.where(F.col("geopolitical_zone").isNotNull()).select(
        "geopolitical_zone").distinct().collect()
    return sorted(r[0] for r in zones)


def feature_frame(rows: DataFrame, zones: list[str]) -> DataFrame:
    """Encoded features + one indicator column per zone, label, weight; rows
    with any missing feature or label are dropped."""
    out = rows.select(
        "anc_id", "woman_id",
        F.col("age_at_survey").cast("double").alias("age_at_survey"),
        _ordinal("education_level", EDUCATION_ORDER).cast("double").alias("education_num"),
        _ordinal("wealth_index", WEALTH_ORDER).cast("double").alias("wealth_num"),
        F.col("has_insurance").cast("double").alias("has_insurance"),
        F.col("distance_barrier").cast("double").alias("distance_barrier"),
        F.coalesce(F.col("anc_visits"), F.lit(0)).cast("double").alias("anc_visits_clean"),
        F.coalesce(F.col("first_anc_trimester"), F.lit(0)).cast("double").alias("trimester_clean"),
        F.when(F.col("urban_rural") == "Urban", 1.0).otherwise(0.0).alias("urban"),
        *[F.when(F.col("geopolitical_zone") == z, 1.0).otherwise(0.0).alias(f"zone_{z}")
          for z in zones],
        F.col(LABEL).cast("int").alias("label"),
        F.col(WEIGHT).alias("weight"))
    return out.dropna(subset=BASE_FEATURES + ["label"])


def feature_names(zones: list[str]) -> list[str]:
    return BASE_FEATURES + [f"zone_{z}" for z in zones]


_MODULUS = 1 << 32
_BUCKETS = 1 << 16


def split_hash(id_col: str, seed: int = SEED) -> Column:
    """32-bit multiplicative hash of an integer id (Knuth's constant).  It wraps for
    every id above 1, so neighbouring ids land far apart; exact in 64 bits."""
    return (F.pmod(F.col(id_col), F.lit(1 << 31)) * F.lit(2654435761)
            + F.lit(seed * 7919)) % F.lit(_MODULUS)


def stratified_split(df: DataFrame, label: str = "label", id_col: str = "anc_id",
                     test_share: float = TEST_SHARE, seed: int = SEED) -> DataFrame:
    """Adds ``is_test``: per class, the ``round(test_share * n_class)`` rows with the
    smallest (seeded hash, id) go to test, so the class shares are exact.

    A histogram of 65,536 hash buckets per class names the bucket that holds the
    boundary; only that bucket's rows are ranked (one in 65,536), which gives the
    boundary (hash, id) of the class.  The split itself is a comparison with that
    row per class: no row-level shuffle, and the same at every size."""
    width = _MODULUS // _BUCKETS
    hashed = df.withColumn("_h", split_hash(id_col, seed))
    bucket = F.floor(F.col("_h") / width)
    hist = hashed.groupBy(label, bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(label).orderBy("_b")
    want = F.floor(F.sum("_n").over(Window.partitionBy(label)) * F.lit(test_share) + 0.5)
    edges = hist.select(F.col(label).alias("_label"), "_b", "_n", F.sum("_n").over(upto).alias("_to"),
                        want.alias("_want")) \
        .where((F.col("_to") >= F.col("_want")) & (F.col("_to") - F.col("_n") < F.col("_want"))) \
        .select("_label", "_b", (F.col("_want") - F.col("_to") + F.col("_n")).alias("_left"))
    same = F.col(label).eqNullSafe(F.col("_label"))
    rank = F.row_number().over(Window.partitionBy(label).orderBy("_h", id_col))
    # one row a class: broadcast, or a shuffle by class would leave as many tasks as classes
    last = (hashed.select(label, "_h", id_col).join(F.broadcast(edges), same & (bucket == F.col("_b")))
            .withColumn("_r", rank).where("_r = _left")
            .select("_label", F.struct("_h", id_col).alias("_edge")))
    test = F.coalesce(F.struct("_h", id_col) <= F.col("_edge"), F.lit(False))
    return hashed.join(F.broadcast(last), same, "left").withColumn("is_test", test.cast("int")).select(
        *df.columns, "is_test")


def balanced_weights(df: DataFrame, label: str = "label", weight: str = "weight",
                     out: str = "fit_weight") -> DataFrame:
    """Survey weight x ``n / (k * n_class)`` (balanced class weights); the
    per-class factors come from one aggregate (k rows, broadcast)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    tot = counts.agg(F.sum("_nc").alias("_n"), F.count(F.lit(1)).alias("_k"))
    factors = counts.crossJoin(tot).select(
        label, (F.col("_n").cast("double") / (F.col("_k") * F.col("_nc"))).alias("class_weight"))
    return df.join(F.broadcast(factors), label) \
        .withColumn(out, F.col(weight) * F.col("class_weight"))


def standardise(df: DataFrame, cols: list[str], suffix: str = "_z") -> DataFrame:
    """``(x - mean) / std_pop`` per column (the scaler the reference fits, which
    uses the population standard deviation; Spark's StandardScaler uses the
    sample one).  Integral columns use exact integer sums, so the result is
    reproducible bit for bit; other columns use ``avg`` / ``stddev_pop``."""
    types = dict(df.dtypes)
    aggs, sel = [], []
    for c in cols:
        if types[c] in ("int", "bigint", "smallint", "tinyint"):
            x = F.col(c).cast("decimal(38,0)")
            aggs += [F.count(c).alias(f"_n_{c}"), F.sum(x).alias(f"_s_{c}"),
                     F.sum(x * x).alias(f"_ss_{c}")]
            n, s_, ss = F.col(f"_n_{c}"), F.col(f"_s_{c}"), F.col(f"_ss_{c}")
            sel += [(s_.cast("double") / n).alias(f"_mean_{c}"),
                    F.sqrt((n * ss - s_ * s_).cast("double")
                           / (n.cast("double") * n.cast("double"))).alias(f"_std_{c}")]
        else:
            aggs += [F.avg(c).alias(f"_a_{c}"), F.stddev_pop(c).alias(f"_p_{c}")]
            sel += [F.col(f"_a_{c}").alias(f"_mean_{c}"), F.col(f"_p_{c}").alias(f"_std_{c}")]
    params = df.agg(*aggs).select(*sel)          # one row
    z = [((F.col(c) - F.col(f"_mean_{c}")) / F.nullif(F.col(f"_std_{c}"), F.lit(0.0)))
         .alias(c + suffix) for c in cols]
    return df.crossJoin(params).select(*df.columns, *z)


def _assembler(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="features")


def fit_scaler(train: DataFrame, features: list[str]) -> DataFrame:
    """One row of per-feature mean and population standard deviation
    (unweighted, as the reference's scaler; a zero deviation scales by 1)."""
    aggs = []
    for c in features:
        aggs += [F.avg(c).alias(f"_mu_{c}"), F.stddev_pop(c).alias(f"_sd_{c}")]
    row = train.agg(*aggs)
    return row.select(*[F.col(f"_mu_{c}") for c in features],
                      *[F.when(F.col(f"_sd_{c}") > 0, F.col(f"_sd_{c}")).otherwise(F.lit(1.0))
                        .alias(f"_sd_{c}") for c in features])


def apply_scaler(df: DataFrame, params: DataFrame, features: list[str]) -> DataFrame:
    """Standardised copies ``<c>_z`` of the features (one-row parameter table)."""
    out = df.crossJoin(F.broadcast(params))          # a single row
    z = [((F.col(c) - F.col(f"_mu_{c}")) / F.col(f"_sd_{c}")).alias(f"{c}_z") for c in features]
    return out.select(*df.columns, *z)


class ScaledModel:
    """A fitted pipeline behind its feature scaling (``transform`` scales first)."""

    def __init__(self, params: DataFrame, model, features: list[str]):
        self.params, self.model, self.features = params, model, features

    @property
    def stages(self):
        return self.model.stages

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(apply_scaler(df, self.params, self.features))


def fit_logistic(train: DataFrame, features: list[str], weight_col: str = "fit_weight",
                 max_iter: int = 1000, c: float = 1.0) -> ScaledModel:
    """Weighted L2 logistic regression on standardised features.

    Features are centred and scaled by the population standard deviation of
    the training rows (unweighted).  The reference's penalty ``||b||^2 / (2C)``
    on a weighted *sum* of losses equals Spark's ``regParam * ||b||^2 / 2`` on
    the weighted *mean* with ``regParam = 1 / (C * sum(w))``."""
    params = fit_scaler(train, features).cache()      # one row, reused for test
    sw = train.agg(F.sum(weight_col)).first()[0] or 1.0
    lr = LogisticRegression(featuresCol="features", labelCol="label", weightCol=weight_col,
                            maxIter=max_iter, regParam=1.0 / (c * sw), elasticNetParam=0.0,
                            standardization=False)
    scaled = [f"{f}_z" for f in features]
    model = Pipeline(stages=[_assembler(scaled), lr]).fit(apply_scaler(train, params, features))
    return ScaledModel(params, model, features)


def fit_forest(train: DataFrame, features: list[str], weight_col: str = "fit_weight",
               trees: int = 200, depth: int = 8, min_leaf: int = 20, seed: int = SEED,
               subset: str = "sqrt", bootstrap: bool = True):
    # cacheNodeIds: a row keeps the node it is at in every tree, so a level doesn't lead it
    # down from the roots again; the same forest, for four bytes a row and tree
    rf = RandomForestClassifier(featuresCol="features", labelCol="label", weightCol=weight_col,
                                numTrees=trees, maxDepth=depth, minInstancesPerNode=min_leaf,
                                featureSubsetStrategy=subset, bootstrap=bootstrap, seed=seed,
                                cacheNodeIds=True)
    return Pipeline(stages=[_assembler(features), rf]).fit(train)


def score(model, test: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Test rows with P(label = 1) and the 0.5-threshold prediction (and ``keep``)."""
    out = model.transform(test)
    return out.select("woman_id", "label", "weight", *(keep or []),
                      vector_to_array("probability")[1].alias("score"),
                      F.col("prediction").cast("int").alias("prediction"))


def feature_importance(spark, forest_model, features: list[str], top: int = 5) -> DataFrame:
    """RF importances with display labels (fallback to the raw name), sorted,
    top ``top`` flagged (the model holds one value per feature: tiny)."""
    imp = forest_model.stages[-1].featureImportances.toArray().tolist()
    rows = [(f, FEATURE_LABELS.get(f, f.replace("zone_", "Zone: ")
                                   if f.startswith("zone_") else f), float(v))
            for f, v in zip(features, imp)]
    df = spark.createDataFrame(rows, "feature string, label string, importance double")
    ranked = sorted(rows, key=lambda r: -r[2])
    top_names = {r[0] for r in ranked[:top]}
    return df.withColumn("top", F.col("feature").isin(*top_names)).orderBy(F.desc("importance"))


def best_single_split(train: DataFrame, features: list[str]):
    """A forest of one tree of depth one over all features: the best weighted split."""
    return fit_forest(train, features, trees=1, depth=1, subset="all", bootstrap=False)


def prepare(star: Star) -> tuple[DataFrame, DataFrame, list[str]]:
    """(weighted train rows, test rows, feature names); class weights are
    computed on the training rows only."""
    zones = zone_values(star)
    spark = star.anc.sparkSession
    checkpoint_dir(spark)
    # a fit passes over the rows once a tree level, whose cost lies in the trees and not in
    # bytes: dealt out evenly, however few partitions their bytes would take
    parts = max(spark.sparkContext.defaultParallelism,
                int(spark.conf.get("spark.sql.shuffle.partitions")))
    # written once: both fits, their scores and the report read it
    split = stratified_split(feature_frame(model_rows(star, spread=True), zones)) \
        .repartition(parts).checkpoint()
    train = balanced_weights(split.where(F.col("is_test") == 0))
    test = split.where(F.col("is_test") == 1)
    return train, test, feature_names(zones)


def model_report(star: Star, trees: int = 200, prepared=None) -> DataFrame:
    """The model step's summary as ``(metric, value)`` rows: test AUC of both
    models, the Youden threshold of the logistic model with its sensitivity
    and specificity, recall of the minority class at 0.5, and split sizes."""
    from ..operators.metrics import auc_exact, classification_report, roc_points, youden_threshold
    train, test, feats = prepared or prepare(star)
    lr_scores = score(fit_logistic(train, feats), test)
    rf_scores = score(fit_forest(train, feats, trees=trees), test)
    minority = test.groupBy("label").count().orderBy("count", "label").first()["label"]
    report = classification_report(lr_scores).where(F.col("class") == str(minority))
    parts = [
        auc_exact(lr_scores).select(F.lit("lr_auc").alias("metric"), F.col("auc").alias("value")),
        auc_exact(rf_scores).select(F.lit("rf_auc").alias("metric"), F.col("auc").alias("value")),
    ]
    best = youden_threshold(roc_points(lr_scores))
    for col in ("threshold", "sensitivity", "specificity"):
        parts.append(best.select(F.lit(f"lr_{col}").alias("metric"),
                                 F.col(col).cast("double").alias("value")))
    parts.append(report.select(F.lit("lr_minority_recall").alias("metric"),
                               F.col("recall").alias("value")))
    parts.append(train.agg(F.count(F.lit(1)).cast("double").alias("value"))
                 .select(F.lit("train_rows").alias("metric"), "value"))
    parts.append(test.agg(F.count(F.lit(1)).cast("double").alias("value"))
                 .select(F.lit("test_rows").alias("metric"), "value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
