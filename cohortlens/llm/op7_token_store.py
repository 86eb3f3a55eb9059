"""Token-id store: raw id payloads in shards, keyed by a minimal perfect hash index.

Layout of a store (a Parquet folder, one row per shard, shards in key order):

=============  ===============================================================
part, seq      place of the shard: shards sorted by (part, seq) are in key order
first, last    smallest and largest document key of the shard
n_docs, n_ids  documents and ids of the shard
width          bytes per id, 2 or 4 (unsigned, little endian)
payload        the ids of all its documents, end to end, with nothing between
offsets        int64[n_docs + 1]: where each document's ids begin in the payload
keys           the document keys in payload order
displace       int64[]: the minimal perfect hash (``perfect_hash``)
prints         uint32[n]: fingerprint stored in each slot
ordinals       int64[n]: the document (first of its key) that a slot points to
=============  ===============================================================

A lookup finds the shard by its key range (Parquet statistics prune the rest),
hashes the key to one slot, compares the fingerprint, and reads one payload slice.

Documents are range-partitioned by key once, before encoding, so ids are never
shuffled; a shard is closed at ``shard_bytes``, so a task holds one shard and one
document at most.

Defined cases: null text counts as empty and holds the end id alone; a null key is
stored first, in order, but not indexed; documents that repeat a key lie side by
side, the index points at the first of them in its shard and the store holds all;
other columns are ignored; no rows give no shard.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import perfect_hash
from .staging import by_bytes
from .tokenizing import encoder, with_end

SHARD_BYTES = 8 << 20
SHARD_DOCS = 1 << 16

SHARD_SCHEMA = ("part int, seq int, first long, last long, n_docs long, n_ids long, width int, "
                "payload binary, offsets binary, keys array<long>, displace binary, "
                "prints binary, ordinals binary")


def _shard(part: int, seq: int, keys: list, ids: list[np.ndarray], width: int) -> pa.RecordBatch:
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    nulls = sum(k is None for k in keys)  # they come first
    known, first = np.unique(np.array(keys[nulls:], np.int64), return_index=True)
    displace = perfect_hash.build(known)
    slot = perfect_hash.slots(known, displace, max(1, len(known)))
    prints, ordinals = np.zeros(len(known), np.uint32), np.zeros(len(known), np.int64)
    prints[slot], ordinals[slot] = perfect_hash.fingerprints(known.view(np.uint64)), first + nulls
    row = {
        "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()),
        "first": pa.array([int(known[0]) if len(known) else None], pa.int64()),
        "last": pa.array([int(known[-1]) if len(known) else None], pa.int64()),
        "n_docs": pa.array([len(ids)], pa.int64()), "n_ids": pa.array([int(offsets[-1])], pa.int64()),
        "width": pa.array([width], pa.int32()),
        "payload": pa.array([np.concatenate(ids).astype(f"<u{width}").tobytes()], pa.binary()),
        "offsets": pa.array([offsets.astype("<i8").tobytes()], pa.binary()),
        "keys": pa.array([keys], pa.list_(pa.int64())),
        "displace": pa.array([displace.astype("<i8").tobytes()], pa.binary()),
        "prints": pa.array([prints.astype("<u4").tobytes()], pa.binary()),
        "ordinals": pa.array([ordinals.astype("<i8").tobytes()], pa.binary()),
    }
    return pa.record_batch(list(row.values()), names=list(row))


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, width: int = 2,
                id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES,
                shard_docs: int = SHARD_DOCS, keeps_space: bool = True) -> None:
    """Encode ``docs`` and write the store; ``width`` 2 holds vocabularies up to 65,536 ids."""
    def run(batches):
        from pyspark import TaskContext
        code = encoder(tokenizer, keeps_space)
        part, seq = TaskContext.get().partitionId(), 0
        keys, held, size = [], [], 0
        for rows in by_bytes(batches, "text"):
            ids, at = with_end(*code.encode(rows.column("text")), end_id)
            if len(ids) and int(ids.max()) >= 1 << 8 * width:
                raise ValueError(f"ids need more than {width} bytes")
            for key, b, e in zip(rows.column("doc_id").to_pylist(), at[:-1].tolist(),
                                 at[1:].tolist(), strict=True):
                keys.append(key)
                held.append(ids[b:e].copy())
                size += width * (e - b)
                if size >= shard_bytes or len(keys) >= shard_docs:
                    yield _shard(part, seq, keys, held, width)
                    seq, keys, held, size = seq + 1, [], [], 0
        if keys:
            yield _shard(part, seq, keys, held, width)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).cast("string").alias("text"))
    (rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
     .mapInArrow(run, SHARD_SCHEMA).write.option("parquet.block.size", 64 << 20).parquet(path))


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARD_SCHEMA).parquet(path)


def _ids(row: dict, begin: int, end: int) -> np.ndarray:
    width = row["width"]
    return np.frombuffer(row["payload"], f"<u{width}", end - begin, begin * width)


def find(row: dict, keys: np.ndarray) -> np.ndarray:
    """Ordinal of each key in a shard, or -1: one hash, one slot, one fingerprint."""
    prints = np.frombuffer(row["prints"], "<u4")
    if not len(prints):
        return np.full(len(keys), -1, np.int64)
    slot = perfect_hash.slots(keys, np.frombuffer(row["displace"], "<i8"), len(prints))
    found = np.frombuffer(row["ordinals"], "<i8")[slot]
    return np.where(prints[slot] == perfect_hash.fingerprints(keys.view(np.uint64)), found, -1)


def store_documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Every document of a store: doc_id, start, n_tokens, ids_crc32 and, if asked, its ids.

    Each document is reached through the index.  ``start`` counts the ids of all
    documents before it: a prefix sum over the partitions' totals and one inside
    each partition, both over shard sizes only.
    """
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                offsets = np.frombuffer(row["offsets"], "<i8")
                keys = row["keys"]
                nulls = sum(k is None for k in keys)
                known = np.array(keys[nulls:], np.int64)
                ordinal = find(row, known)
                if (ordinal < 0).any():
                    raise ValueError("a stored key is not in the index")
                again = np.arange(len(known)) - np.searchsorted(known, known)
                ordinal = np.concatenate([np.arange(nulls), ordinal + again])
                blobs = [_ids(row, b, e).astype("<u4").tobytes() for b, e in zip(
                    offsets[ordinal].tolist(), offsets[ordinal + 1].tolist(), strict=True)]
                n = len(ordinal)
                columns = [pa.array([row["part"]] * n, pa.int32()),
                           pa.array([row["seq"]] * n, pa.int32()), pa.array(keys, pa.int64()),
                           pa.array(offsets[ordinal]), pa.array(np.diff(offsets)[ordinal]),
                           pa.array([zlib.crc32(b) for b in blobs], pa.int64())]
                names = ["part", "seq", "doc_id", "inner", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array(blobs, pa.binary())], [*names, "ids"]
                yield pa.record_batch(columns, names=names)

    shards = read_shards(spark, path)
    sizes = shards.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.join(parts, "part").select("part", "seq", (F.col("before") + F.coalesce(
        F.sum("n_ids").over(inside), F.lit(0))).alias("begin"))
    docs = (shards.select("part", "seq", "width", "payload", "offsets", "keys", "displace",
                          "prints", "ordinals")
            .mapInArrow(run, "part int, seq int, doc_id long, inner long, n_tokens long, "
                             "ids_crc32 long" + ", ids binary" * with_ids))
    return docs.join(begins, ["part", "seq"]).select(
        "doc_id", (F.col("begin") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32",
        *["ids"] * with_ids)


def lookup(spark: SparkSession, path: str, key: int) -> list[np.ndarray]:
    """Ids of the documents stored under ``key``: reads the shards whose range holds it."""
    out = []
    for r in read_shards(spark, path).where(
            (F.col("first") <= key) & (F.col("last") >= key)).orderBy("part", "seq").toLocalIterator():
        row = r.asDict()
        at = int(find(row, np.array([key], np.int64))[0])
        offsets = np.frombuffer(row["offsets"], "<i8")
        while 0 <= at < len(row["keys"]) and row["keys"][at] == key:
            out.append(_ids(row, int(offsets[at]), int(offsets[at + 1])).astype(np.uint32))
            at += 1
    return out
