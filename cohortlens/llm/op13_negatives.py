"""Hard negatives by a BOND scan: columnar vectors, dimensions in the anchor's order.

Rows are dealt into chunks by a hash of their id and each chunk is stored once by dimension
(``vertical``): one contiguous run of values a dimension, with its smallest and largest
value.  A block of anchors and a chunk meet in one task, so a task holds
``CHUNK_ROWS`` vectors and ``BLOCK_ANCHORS`` anchors (about; both are dealt by hash),
whatever the table's size.

An anchor reads a chunk's dimensions by the magnitude of its own components, largest first,
``STRIDE`` at a time, and adds up partial products for the candidates left.  What
the unread dimensions can still add lies between the sums of their smallest and largest
contributions (``anchor component x`` the chunk's least or greatest value).  These bounds
shrink the candidates:

* positives (same label): one whose upper bound is below the k-th best lower bound goes;
* negatives (other labels): one whose bounds lie outside every window goes, and one that is
  below the k-th best lower bound among the candidates sure to be inside a window goes
  from that window.

When all dimensions are read the scores are exact and the windows are resolved.  First the
positives of each chunk are merged to the anchor's best ``positives``, which fix the windows
``[low, high]`` (in hundredths of the positive's score); a second scan finds the negatives.  An anchor
and a chunk give at most ``positives``, then ``positives x negatives`` rows.

Components are ``floor(scale x)`` as integers, clipped at ``limit(dimensions)``, below which
no score leaves 64 bits (for 64 dimensions: scaled values beyond 268 million).  Products
are added in 32-bit floats, 64-bit floats or 64-bit integers, the first in which the largest possible
sum is exact.

Defined cases: rows with a null id, label, vector or component, or a component that is not
finite, take no part; shorter vectors count as padded with zeros, an empty vector is all
zeros; equal scores go by the smaller id; wholly equal rows count once, and of rows with
one id and unequal contents the smallest (label, vector) counts; an anchor without positives, or a
window without negatives, gives no row; an empty table gives none; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage

CHUNK_ROWS = 8_192
BLOCK_ANCHORS = 1_024
STRIDE = 16
#: Partitions that pairs of a block and a chunk are dealt to, at most.
MAX_PARTITIONS = 20_000
_BEST = "anchor_id long, id long, score long"
_FOUND = "anchor_id long, positive_id long, positive_score long, id long, score long"


def limit(dimensions: int) -> int:
    """The largest component whose products over all dimensions fit 62 bits."""
    return int((2 ** 62 / max(dimensions, 1)) ** 0.5) - 1


def clean_vectors(rows: DataFrame, id_col: str, vector_col: str, label: Column,
                  scale: float) -> DataFrame:
    """(id, label, v) of the rows that take part, v as integers (array of longs)."""
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda e: F.coalesce(
        ~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False)))
    # a double beyond 2**60 is clipped later on all the same
    whole = F.transform(x, lambda e: F.floor(F.least(F.greatest(
        e * scale, F.lit(-2.0 ** 60)), F.lit(2.0 ** 60))).cast("long"))
    return rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"),
                       F.when(finite, whole).alias("v")).where(
        F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).groupBy("id") \
        .agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")


def _matrix(lists: pa.ListArray, dimensions: int) -> np.ndarray:
    """One row a vector, padded with zeros and clipped."""
    size = lists.value_lengths().to_numpy()
    out = np.zeros((len(lists), dimensions), np.int64)
    row = np.repeat(np.arange(len(lists)), size)
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    most = limit(dimensions)
    out[row, place] = np.clip(lists.flatten().to_numpy(), -most, most)
    return out


def vertical(vectors: DataFrame, chunks: int, dimensions: int) -> DataFrame:
    """(chunk, ids, labels, values): one row a chunk, values by dimension."""
    def pack(key, table):
        m = _matrix(table.column("v").combine_chunks(), dimensions)
        ids, labels = (table.column(c).to_numpy() for c in ("id", "label"))
        order = np.argsort(ids)
        m = m[order]
        small = np.int16 if not m.size or np.abs(m).max() < 2 ** 15 else np.int64
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int64()),
                         "ids": pa.array([ids[order].tobytes()], pa.binary()),
                         "labels": pa.array([labels[order].tobytes()], pa.binary()),
                         "wide": pa.array([small is np.int64]),
                         "values": pa.array([np.ascontiguousarray(m.T, small).tobytes()], pa.binary())})

    return vectors.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks))).groupBy("chunk") \
        .applyInArrow(pack, "chunk long, ids binary, labels binary, wide boolean, values binary")


class Chunk:
    """The vectors of a chunk by dimension, with each dimension's least and greatest value."""

    def __init__(self, ids: bytes, labels: bytes, wide: bool, values: bytes):
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.values = np.frombuffer(values, np.int64 if wide else np.int16).reshape(-1, len(self.ids))
        empty = not self.values.size
        self.least = np.zeros(0, np.int64) if empty else self.values.min(1).astype(np.int64)
        self.greatest = np.zeros(0, np.int64) if empty else self.values.max(1).astype(np.int64)
        self._as: dict[type, np.ndarray] = {}

    def of(self, kind: type) -> np.ndarray:
        if kind not in self._as:
            self._as[kind] = self.values.astype(kind)
        return self._as[kind]

    def scan(self, anchor: np.ndarray, candidates: np.ndarray, shrink, stride: int = STRIDE):
        """Exact scores of the candidates that ``shrink`` leaves: (places, scores).

        ``shrink(lower, upper)`` gets the bounds of the candidates left and returns a mask.
        """
        ends = np.stack([anchor * self.least, anchor * self.greatest])
        low, high = ends.min(0), ends.max(0)
        most = float((np.abs(anchor).astype(float)
                      * np.maximum(np.abs(self.least), np.abs(self.greatest))).sum())
        kind = np.float32 if most < 2 ** 24 else np.float64 if most < 2 ** 53 else np.int64
        values, mine = self.of(kind), anchor.astype(kind)
        order = np.argsort(-np.abs(anchor), kind="stable")
        part = np.zeros(len(candidates), kind)
        everyone = len(candidates) == len(self.ids)
        for at in range(0, len(order), stride):
            dims = order[at:at + stride]
            block = values[dims] if everyone else values[dims][:, candidates]
            part = part + mine[dims] @ block
            rest = order[at + stride:]
            exact = part.astype(np.int64)
            keep = shrink(exact + low[rest].sum(), exact + high[rest].sum())
            if not keep.all():
                candidates, part, everyone = candidates[keep], part[keep], False
            if not len(candidates):
                break
        return candidates, part.astype(np.int64)


def best_of(chunk: Chunk, anchor_id: int, label: int, anchor: np.ndarray, k: int):
    """The k best same-label rows of a chunk: (ids, scores), best first."""
    def shrink(lower, upper):
        if len(lower) <= k:
            return np.ones(len(lower), bool)
        return upper >= np.partition(lower, len(lower) - k)[len(lower) - k]

    own = np.flatnonzero((chunk.labels == label) & (chunk.ids != anchor_id))
    places, scores = chunk.scan(anchor, own, shrink)
    order = np.lexsort((chunk.ids[places], -scores))[:k]
    return chunk.ids[places][order], scores[order]


def in_windows(chunk: Chunk, label: int, anchor: np.ndarray, lows: np.ndarray, highs: np.ndarray,
               k: int):
    """The k best other-label rows of a chunk in each window: a list of (ids, scores)."""
    def shrink(lower, upper):
        keep = np.zeros(len(lower), bool)
        for low, high in zip(lows, highs, strict=True):
            possible = (upper >= low) & (lower <= high)
            sure = lower[(lower >= low) & (upper <= high)]
            if len(sure) > k:
                possible &= upper >= np.partition(sure, len(sure) - k)[len(sure) - k]
            keep |= possible
        return keep

    places, scores = chunk.scan(anchor, np.flatnonzero(chunk.labels != label), shrink)
    ids, out = chunk.ids[places], []
    for low, high in zip(lows, highs, strict=True):
        inside = np.flatnonzero((scores >= low) & (scores <= high))
        order = inside[np.lexsort((ids[inside], -scores[inside]))[:k]]
        out.append((ids[order], scores[order]))
    return out


def _met(anchors: DataFrame, chunks: DataFrame, n_blocks: int, n_chunks: int, scan, schema: str
         ) -> DataFrame:
    """``scan(anchor table, chunk row)`` for every block of anchors and every chunk."""
    blocked = anchors.withColumn("block", F.pmod(F.xxhash64("anchor_id"), F.lit(n_blocks)))
    left = blocked.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"),
                                                            F.lit(n_chunks - 1).cast("long"))))
    right = chunks.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"),
                                                            F.lit(n_blocks - 1).cast("long"))))

    def run(key, asked, held):
        if not asked.num_rows or not held.num_rows:
            return scan(None, None)
        return scan(asked, Chunk(*[held.column(c)[0].as_py() for c in
                                   ("ids", "labels", "wide", "values")]))

    # by number, as a pair is little to read and much to compute
    parts = min(n_blocks * n_chunks, MAX_PARTITIONS)
    keys = ["block", "chunk"]
    return left.repartition(parts, *keys).groupBy(*keys).cogroup(
        right.repartition(parts, *keys).groupBy(*keys)).applyInArrow(run, schema)


def _table(schema: str, parts: list[tuple]) -> pa.Table:
    """Columns of longs from pieces of equal columns."""
    names = [f.split()[0] for f in schema.split(", ")]
    return pa.table({n: pa.array(np.concatenate([np.zeros(0, np.int64), *[p[i] for p in parts]]),
                                 pa.int64()) for i, n in enumerate(names)})


def _first(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best rows of each key; partial top-k runs before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                   label: Column | str = "label", anchor: Column | str = "true",
                   positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
                   scale: float = 256.0, chunk_rows: int = CHUNK_ROWS,
                   block_anchors: int = BLOCK_ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchor`` says by ``id`` which rows are anchors.  A negative's score lies between ``low`` and ``high`` hundredths of
    the positive's.
    """
    label = F.col(label) if isinstance(label, str) else label
    anchor = F.expr(anchor) if isinstance(anchor, str) else anchor
    vectors = stage(clean_vectors(rows, id_col, vector_col, label, scale), "vectors")
    size = vectors.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("d"),
                       F.count(F.when(anchor, 1)).alias("a")).first()
    n_chunks, n_blocks = -(-size.n // chunk_rows) or 1, -(-size.a // block_anchors) or 1
    dimensions = max(size.d, 1)
    chunks = stage(vertical(vectors, n_chunks, dimensions), "vertical")
    asked = stage(vectors.where(anchor).withColumnRenamed("id", "anchor_id"), "anchors")

    def nearest(table, chunk):
        parts = []
        if table is not None:
            for i, l, a in zip(table.column("anchor_id").to_pylist(), table.column("label").to_pylist(),
                               _matrix(table.column("v").combine_chunks(), dimensions), strict=True):
                ids, scores = best_of(chunk, i, l, a, positives)
                parts.append((np.full(len(ids), i), ids, scores))
        return _table(_BEST, parts)

    best = stage(_first(_met(asked, chunks, n_blocks, n_chunks, nearest, _BEST), ["anchor_id"],
                        positives), "positives")
    windows = best.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct(
        "rank", "id", "score"))).alias("found"))  # at most ``positives`` a group

    def between(table, chunk):
        parts = []
        if table is not None:
            for i, l, a, found in zip(
                    table.column("anchor_id").to_pylist(), table.column("label").to_pylist(),
                    _matrix(table.column("v").combine_chunks(), dimensions),
                    table.column("found").to_pylist(), strict=True):
                scores = np.array([f["score"] for f in found], np.int64)
                lows = [-(-low * int(s) // 100) for s in scores]
                highs = [high * int(s) // 100 for s in scores]
                for f, (ids, got) in zip(found, in_windows(chunk, l, a, lows, highs, negatives),
                                         strict=True):
                    parts.append((np.full(len(ids), i), np.full(len(ids), f["id"]),
                                  np.full(len(ids), f["score"]), ids, got))
        return _table(_FOUND, parts)

    found = _met(asked.join(windows, "anchor_id"), chunks, n_blocks, n_chunks, between, _FOUND)
    return _first(found, ["anchor_id", "positive_id"], negatives).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"),
        F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
