"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight positional bytes.  Two fingerprints at most ``d``
bits apart differ in at most ``d`` bytes, so they share at least ``8 - d`` of the
eight: the guaranteed minimum.  The index keys a posting list by ``8 - d`` byte
positions and their values; a pair meets in a list exactly when its tally of
shared positional bytes reaches the minimum, so the count filter is met before a
pair exists.  Members of a list differ only in the ``d`` left-out bytes, hence a
list of distinct fingerprints has at most ``256 ** d`` members whatever the size
of the corpus, and its links are found by looking up each member with up to ``d``
of those bits flipped: the work is proportional to the members, never to their
pairs.  The tally and the bit distance are then checked on each link.

Equal fingerprints are one node from the start, so copies are never paired.

Defined cases: null or empty text has fingerprint zero and is linked like any
other; a row with a null id gets a fingerprint and the component of its equals,
but never names a component; repeated rows stay rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .components import components
from .staging import as_bytes, by_bytes, stage

SEED = 42
_BLOCK = 1 << 16


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """SimHash of lower-cased ``text`` over word shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    k = min(shingle, len(words))
    spans = zip(start[:len(words) - k + 1].tolist(), end[k - 1:].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[s:e], SEED) for s, e in spans), np.uint64, len(words) - k + 1)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        bits = np.unpackbits(hashes[at:at + _BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8),
                             axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = 3) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed 64-bit integer."""
    def run(batches):
        for part in by_bytes(batches, "text"):
            fps = np.array([fingerprint(t, shingle) for t in as_bytes(part.column("text"))],
                           np.uint64)
            yield pa.record_batch([part.column("doc_id"), pa.array(fps.view(np.int64))],
                                  names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, StructType([StructField("doc_id", LongType()),
                                            StructField("fp", LongType())]))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _first_list(touched: tuple[int, ...], size: int) -> tuple[int, ...]:
    """Of the left-out sets that hold ``touched``, the one that reports the link."""
    rest = [p for p in range(8) if p not in touched]
    return tuple(sorted((*touched, *rest[:size - len(touched)])))


def posting_lists(nodes: DataFrame, max_bits: int) -> DataFrame:
    """(left_out, fps, ids): posting lists with two members or more."""
    keys = []
    for number, out in enumerate(combinations(range(8), max_bits)):
        mask = (1 << 64) - 1 - sum(255 << 8 * p for p in out)
        keys.append(F.struct(F.lit(number).alias("left_out"),
                             F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("shared")))
    return (nodes.select("fp", "id", F.explode(F.array(*keys)).alias("k"))
            .groupBy("k.left_out", "k.shared")
            .agg(F.collect_list(F.struct("fp", "id")).alias("members"))
            .where(F.size("members") > 1)
            .select("left_out", F.col("members.fp").alias("fps"), F.col("members.id").alias("ids")))


def _links_in(batch: pa.RecordBatch, max_bits: int) -> pa.RecordBatch:
    out_sets = list(combinations(range(8), max_bits))
    fps_col = batch.column("fps")
    rows = np.repeat(np.arange(len(fps_col)), np.diff(fps_col.offsets.to_numpy()))
    fps = fps_col.flatten().to_numpy().view(np.uint64)
    ids = batch.column("ids").flatten().to_numpy()
    number = batch.column("left_out").to_numpy()[rows]
    positions = np.array(out_sets, np.uint64)[number]
    low = np.zeros(len(fps), np.uint64)
    for j in range(max_bits):
        low |= ((fps >> (positions[:, j] * np.uint64(8))) & np.uint64(255)) << np.uint64(8 * j)
    width = np.uint64(8 * max_bits)
    code = (rows.astype(np.uint64) << width) | low
    order = np.argsort(code)
    code, fps, ids, number = code[order], fps[order], ids[order], number[order]
    lefts, rights = [], []
    for bits in range(1, max_bits + 1):
        for flip in combinations(range(8 * max_bits), bits):
            cells = sorted({b // 8 for b in flip})
            reports = np.array([_first_list(tuple(s[c] for c in cells), max_bits) == s
                                for s in out_sets])
            if not reports.any():
                continue
            mask = np.uint64(sum(1 << b for b in flip))
            mine = np.flatnonzero(reports[number] & ((code ^ mask) > code))
            want = code[mine] ^ mask
            at = np.minimum(np.searchsorted(code, want), len(code) - 1)
            hit = code[at] == want
            lefts.append(mine[hit])
            rights.append(at[hit])
    left = np.concatenate(lefts) if lefts else np.zeros(0, np.int64)
    right = np.concatenate(rights) if rights else np.zeros(0, np.int64)
    return pa.record_batch([fps[left].view(np.int64), fps[right].view(np.int64),
                            ids[left], ids[right]], names=["fp_a", "fp_b", "a", "b"])


def links(nodes: DataFrame, max_bits: int = 2) -> DataFrame:
    """Links (fp_a, fp_b, a, b, shared_bytes, distance) between distinct fingerprints."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                yield _links_in(batch.slice(at, 2000), max_bits)

    schema = StructType([StructField(n, LongType()) for n in ("fp_a", "fp_b", "a", "b")])
    found = posting_lists(nodes, max_bits).mapInArrow(run, schema)
    tally = sum((F.shiftrightunsigned(F.col("fp_a").bitwiseXOR(F.col("fp_b")), 8 * p)
                 .bitwiseAND(F.lit(255)) == 0).cast(IntegerType()) for p in range(8))
    return (found.withColumn("shared_bytes", tally).where(F.col("shared_bytes") >= 8 - max_bits)
            .withColumn("distance", F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))))
            .where(F.col("distance") <= max_bits))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One row per document: doc_id, fp, component_id (smallest doc_id reachable)."""
    fps = stage(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("id")), "nodes")
    found = components(links(nodes.where("id is not null"), max_bits))
    classes = stage(nodes.join(found, nodes["id"] == found["node"], "left").select(
        "fp", F.coalesce("component", "id").alias("component_id")), "classes")
    return fps.join(classes, "fp", "left").select("doc_id", "fp", "component_id")
