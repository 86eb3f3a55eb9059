"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Level 1 counts rows per length, level 2 rows per (length, prefix hash) among the
lengths that more than one row has, and only rows whose (length, prefix hash)
more than one row has are hashed in full.  Every level is an aggregate with a
map-side part followed by a join against its small staged result, so a key that
holds a third of the rows is summed before it is shuffled and split by the join.
Texts themselves are never shuffled for the query.

Texts are equal when their bytes are, after lower-casing A-Z; equality is decided
by length, 64-bit prefix hash and SHA-256 together.

Defined cases: null counts as empty; of equal texts the largest doc_id stays, and
a null doc_id never stays unless all are null; repeated rows of one doc_id and
text are each returned, with the same decision; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import as_bytes, by_bytes, stage

PREFIX_BYTES = 256


def _keys(docs: DataFrame, prefix_bytes: int, full: bool, carry_text: bool = False) -> DataFrame:
    """Length and prefix hash of each row; with ``full`` the SHA-256 of the whole text."""
    schema = "doc_id long, n_bytes long, prefix long" + ", full binary" * full + \
        ", text string" * carry_text

    def run(batches):
        for part in by_bytes(batches, "text"):
            texts = [t.lower() for t in as_bytes(part.column("text"))]
            heads = [xxhash.xxh64_intdigest(t[:prefix_bytes], 0) for t in texts]
            columns = [part.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()),
                       pa.array(heads, pa.uint64()).view(pa.int64())]
            names = ["doc_id", "n_bytes", "prefix"]
            if full:
                columns.append(pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()))
                names.append("full")
            if carry_text:
                columns.append(part.column("text"))
                names.append("text")
            yield pa.record_batch(columns, names=names)

    return docs.mapInArrow(run, schema)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 prefix_bytes: int = PREFIX_BYTES, hash_all: bool = False) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, full (binary digest).

    ``full`` is null for rows that the earlier levels already proved unique, unless
    ``hash_all`` asks for the digest of every row; the groups are the same.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).cast("string").alias("text"))
    keys = stage(_keys(docs, prefix_bytes, hash_all), "exact-keys")
    lengths = stage(keys.groupBy("n_bytes").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
                    .select("n_bytes"), "exact-lengths")
    heads = stage(keys.join(lengths, "n_bytes", "left_semi").groupBy("n_bytes", "prefix")
                  .agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("n_bytes", "prefix"),
                  "exact-prefixes")
    level = ["n_bytes", "prefix"]
    if hash_all:
        hashed = keys
        left = keys.join(heads, level, "left_semi")
    else:
        left = stage(_keys(_keys(docs, prefix_bytes, False, carry_text=True)
                           .join(heads, level, "left_semi").select("doc_id", "text"),
                           prefix_bytes, True), "exact-full")
        hashed = left.unionByName(keys.join(heads, level, "left_anti")
                                  .withColumn("full", F.lit(None).cast("binary")))
    groups = stage(left.groupBy(*level, "full")
                   .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
                   .where("group_size > 1"), "exact-groups")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return hashed.join(groups, [*level, "full"], "left").select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), "full")
