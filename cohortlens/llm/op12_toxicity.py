"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the character n-grams of ``ORDERS`` (lower-cased text, white space as one space
character each, a space at either end), hashed into ``2 ** BITS`` buckets; a feature is
present or absent in a document, however often it occurs.  For each bucket j

    r_j = ln( (p_j + a s) / (P + a) ) - ln( (q_j + a (1 - s)) / (Q + a) )

with p_j and q_j the toxic and other labelled documents that hold it, P and Q the documents
of each class, s = P / (P + Q) and a = ``SMOOTH``, so a bucket nobody has seen scores 0.  A
present feature has the value r_j, an absent one 0, and a logistic regression with an L2
penalty is fitted over them (MLlib, one gradient sum over the partitions a step), a toxic
document counting ``TOXIC_WEIGHT`` times.  Buckets in fewer than ``MIN_DOCS`` labelled
documents, or with |r_j| below ``MIN_RATIO``, whose value would be next to nothing, are left
out of the model.

The labelled sample is bounded by ``MAX_LABELLED`` rows, picked by a hash of the id, and the
model by its buckets.  Scoring reads every whole text once.

Defined cases: null and empty texts have the n-grams of an empty text and get a score; labels
other than 0 and 1 are ignored, of several labels of one document the highest counts;
with labels of one class alone the score is that class's share for all, without labels
0.5; very long texts are read in pieces that overlap by the longest n-gram; repeated rows get
equal scores; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .op4_classifier import held_out
from .staging import by_bytes, stage

ORDERS = (3, 4, 5, 6)
BITS = 20
SMOOTH = 3.0
MIN_DOCS = 3
MIN_RATIO = 1.0
TOXIC_WEIGHT = 3.0
PENALTY = 0.01
STEPS = 100
#: Labelled documents that the model is fitted on, at most.
MAX_LABELLED = 8_000
PARTITIONS = 8
THRESHOLD = 0.3
#: Characters read at a time.
PIECE = 1 << 20


def _hashes(codes: np.ndarray) -> list[np.ndarray]:
    """Bucket of every n-gram of each order, over one run of code points."""
    out, rolling = [], codes
    for n in range(2, max(ORDERS) + 1):
        if len(codes) < n:
            break
        rolling = rolling[:-1] * np.uint32(0x01000193) + codes[n - 1:]
        if n in ORDERS:
            out.append((rolling * np.uint32(0x9E3779B1) + np.uint32(n)) >> np.uint32(32 - BITS))
    return out


def mark_buckets(text: str | None, seen: np.ndarray) -> None:
    """Set ``seen`` (one flag a bucket) for every n-gram of the whole text."""
    raw = f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass")
    codes = np.frombuffer(raw, np.uint32).copy()
    codes[(codes >= 9) & (codes <= 13)] = 32
    for at in range(0, len(codes), PIECE):
        for buckets in _hashes(codes[at:at + PIECE + max(ORDERS) - 1]):
            seen[buckets] = True


class Model:
    """Weights of the kept buckets, intercept and, where nothing could be learned, a fixed score."""

    def __init__(self, buckets: np.ndarray, weights: np.ndarray, intercept: float,
                 fixed: float | None = None):
        self.buckets, self.weights, self.intercept, self.fixed = buckets, weights, intercept, fixed

    def score(self, column: pa.Array) -> np.ndarray:
        if self.fixed is not None:
            return np.full(len(column), self.fixed)
        out, seen = np.empty(len(column)), np.zeros(1 << BITS, bool)
        for i, text in enumerate(column):
            mark_buckets(text.as_py(), seen)
            out[i] = self.weights[seen[self.buckets]].sum()
            seen[:] = False
        return 1 / (1 + np.exp(-np.clip(out + self.intercept, -30, 30)))


def _counted(batches):
    """Documents of each class that hold a bucket, over one partition."""
    counts, seen = np.zeros((2, 1 << BITS), np.int64), np.zeros(1 << BITS, bool)
    for batch in batches:
        for label, text in zip(batch.column("label").to_pylist(), batch.column("text"), strict=True):
            mark_buckets(text.as_py(), seen)
            counts[label, np.flatnonzero(seen)] += 1
            seen[:] = False
    held = np.flatnonzero(counts.sum(0))
    yield pa.record_batch([pa.array(held.astype(np.int32)), pa.array(counts[0, held]),
                           pa.array(counts[1, held])], names=["bucket", "other", "toxic"])


def log_count_ratio(toxic: np.ndarray, other: np.ndarray, n_toxic: int, n_other: int,
                    smooth: float = SMOOTH) -> np.ndarray:
    share = n_toxic / (n_toxic + n_other)
    return (np.log((toxic + smooth * share) / (n_toxic + smooth))
            - np.log((other + smooth * (1 - share)) / (n_other + smooth)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", max_labelled: int = MAX_LABELLED) -> Model:
    """Fit on the labelled documents outside ``held_out`` (at most ``max_labelled``)."""
    sample = (labels.where(F.col(label_col).isin(0, 1) & ~held_out(id_col))
              .groupBy(F.col(id_col).cast("long").alias("_labelled"))
              .agg(F.max(label_col).cast("int").alias("label"))
              .orderBy(F.xxhash64("_labelled"), "_labelled").limit(max_labelled))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"),
                       F.col(text_col).cast("string").alias("text")).join(
        F.broadcast(sample), F.col("_id") == F.col("_labelled"))  # max_labelled rows at most
    rows = stage(rows.select("_id", "label", "text").repartition(PARTITIONS, "_id"), "toxic-sample")
    sizes = dict(rows.groupBy("label").count().collect())
    n_toxic, n_other = sizes.get(1, 0), sizes.get(0, 0)
    none = np.zeros(0, np.int64)
    if not n_toxic or not n_other:
        return Model(none, none, 0.0, n_toxic / (n_toxic + n_other) if sizes else 0.5)

    found = (rows.select("label", "text").mapInArrow(_counted, "bucket int, other long, toxic long")
             .groupBy("bucket").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))
             .where(F.col("other") + F.col("toxic") >= MIN_DOCS).orderBy("bucket").toPandas())
    ratio = log_count_ratio(found.toxic.to_numpy(), found.other.to_numpy(), n_toxic, n_other)
    kept = np.abs(ratio) >= MIN_RATIO  # at most 2 ** BITS
    buckets, ratio = found.bucket.to_numpy()[kept], ratio[kept]
    if not len(buckets):
        return Model(none, none, 0.0, n_toxic / (n_toxic + n_other))

    def encode(batches):
        seen = np.zeros(1 << BITS, bool)
        for batch in batches:
            places = []
            for text in batch.column("text"):
                mark_buckets(text.as_py(), seen)
                places.append(np.flatnonzero(seen[buckets]).astype(np.int32))
                seen[:] = False
            yield pa.record_batch([batch.column("label"), pa.array(places, pa.list_(pa.int32()))],
                                  names=["label", "places"])

    width = len(buckets)
    vector = F.udf(lambda at: SparseVector(width, at, ratio[at]), VectorUDT())
    bags = stage(rows.select("label", "text").mapInArrow(encode, "label int, places array<int>"),
                 "toxic-bags")
    learner = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", maxIter=STEPS,
                                 regParam=PENALTY, elasticNetParam=0.0, standardization=False)
    fitted = learner.fit(bags.select(
        vector("places").alias("x"), F.col("label").cast("double").alias("y"),
        F.when(F.col("label") == 1, TOXIC_WEIGHT).otherwise(1.0).alias("w")))
    weights = fitted.coefficients.toArray() * ratio
    return Model(buckets.astype(np.int64), weights, float(fitted.intercept))


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id",
                    text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1: at least ``threshold``) of every document."""
    def run(batches):
        for part in by_bytes(batches, "text"):
            yield pa.record_batch([part.column("doc_id"), pa.array(model.score(part.column("text")))],
                                  names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, score double").withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))
