"""Best-fit decreasing packing with a segment tree over remaining capacities.

Only lengths decide a packing, and a length is at most ``capacity``.  So Spark
counts the pieces of each length (at most ``capacity`` rows, whatever the corpus),
best-fit decreasing runs on those counts, and the plan it returns is applied to
the pieces where they are.  Bins of equal remaining capacity and equal history
are one entry with a count; the segment tree over the capacities finds the
tightest open entry for a length in logarithmic time.  Because equal lengths are
interchangeable this is exactly the packing that places one document at a time.

The place of a piece follows from its rank among the pieces of its length: ranks
are local counts inside a partition of the staged piece table, plus the counts of
the partitions before it.  No partition, length or bin is gathered in one task.

Size of the plan: a length opens at most two entries (full bins and one rest) and
splits at most one, so there are at most ``3 * capacity`` entries, and a bin holds
at most ``sqrt(2 * capacity)`` different lengths: at most ``3 * capacity *
sqrt(2 * capacity)`` runs (0.4 million for 2048, 20 MB), the proven bound of what
is broadcast.

Defined cases: null text counts as empty and gives its end id alone; longer
documents than the capacity are cut into full pieces and a rest; repeated rows are
packed each; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import by_bytes, stage
from .tokenizing import encoder, with_end

CAPACITY = 2048
END_ID = 0


class OpenCapacities:
    """Segment tree over remaining capacities: which capacities have open bins."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = np.zeros(2 * self.size, bool)

    def set(self, remaining: int, is_open: bool) -> None:
        at = self.size + remaining
        self.open[at] = is_open
        while at > 1:
            at //= 2
            self.open[at] = self.open[2 * at] or self.open[2 * at + 1]

    def tightest(self, length: int) -> int:
        """Smallest open remaining capacity of at least ``length``, or -1."""
        at = self.size + length
        if self.open[at]:
            return length
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at + (not self.open[2 * at])
                return at - self.size
            at //= 2
        return -1


def best_fit_plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Runs (length, first rank, pieces, per bin, first bin, offset), by length and rank.

    Pieces of a run with rank r lie in bin ``first bin + (r - first rank) // per bin``
    at ``offset + (r - first rank) % per bin * length``.
    """
    tree = OpenCapacities(capacity)
    entries: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # (first bin, bins)
    runs, bins = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0

        def place(first: int, count: int, room: int, left: int, rank: int) -> tuple[int, int]:
            """Fill bins first..first+count of ``room`` in order; returns what is left."""
            each = room // length
            full = min(count, left // each)
            if full:
                runs.append((length, rank, full * each, each, first, capacity - room))
                put(room - each * length, first, full)
                left, rank = left - full * each, rank + full * each
            if full < count and left:
                runs.append((length, rank, left, left, first + full, capacity - room))
                put(room - left * length, first + full, 1)
                full, rank, left = full + 1, rank + left, 0
            if full < count:
                put(room, first + full, count - full)
            return left, rank

        def put(room: int, first: int, count: int) -> None:
            entries[room].append((first, count))
            tree.set(room, True)

        while left:
            room = tree.tightest(length)
            if room < 0:
                need = -(-left // (capacity // length))
                left, rank = place(bins, need, capacity, left, rank)
                bins += need
                continue
            first, count = entries[room].pop()
            if not entries[room]:
                tree.set(room, False)
            left, rank = place(first, count, room, left, rank)
    return np.array(runs, np.int64).reshape(-1, 6)[
        np.lexsort((np.array([r[1] for r in runs], np.int64), np.array([r[0] for r in runs], np.int64)))]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
                 id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True,
                 keeps_space: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked, the ids."""
    def run(batches):
        code = encoder(tokenizer, keeps_space)
        for part in by_bytes(batches, "text"):
            ids, at = with_end(*code.encode(part.column("text")), end_id)
            sizes = np.diff(at)
            cuts = -(-sizes // capacity)
            row = np.repeat(np.arange(len(sizes)), cuts)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            start = piece * capacity
            length = np.minimum(sizes[row] - start, capacity)
            raw, begin = ids.astype("<u4").tobytes(), 4 * (at[:-1][row] + start)
            blobs = [raw[b:b + 4 * n] for b, n in zip(begin.tolist(), length.tolist(), strict=True)]
            columns = [part.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)),
                       pa.array(start), pa.array(length),
                       pa.array([zlib.crc32(b) for b in blobs], pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(blobs, pa.binary())], [*names, "ids"]
            yield pa.record_batch(columns, names=names)
        code.forget()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long"
                           + ", ids binary" * with_ids)


def _local_ranks(lengths: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Rank of each piece among those of its length so far; ``seen`` is carried on."""
    order = np.argsort(lengths, kind="stable")
    ordered = lengths[order]
    first = np.searchsorted(ordered, ordered)
    ranks = np.empty(len(lengths), np.int64)
    ranks[order] = np.arange(len(lengths)) - first + seen[ordered]
    seen += np.bincount(lengths, minlength=len(seen))
    return ranks


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to the rows of ``token_pieces`` (or any with ``length``)."""
    columns = pieces.columns
    schema = pieces.schema

    def number(batches):
        from pyspark import TaskContext
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            ranks = _local_ranks(batch.column("length").to_numpy(), seen)
            yield pa.record_batch([*batch.columns, pa.array(np.full(len(ranks), task, np.int32)),
                                   pa.array(ranks)], names=[*columns, "_part", "_rank"])

    from pyspark.sql.types import IntegerType, LongType, StructType
    numbered = stage(pieces.mapInArrow(number, StructType(list(schema.fields))
                                       .add("_part", IntegerType()).add("_rank", LongType())),
                     "pieces")
    per_part = numbered.groupBy("_part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1)
    bases = stage(per_part.select("_part", "length", "n", F.coalesce(F.sum("n").over(before),
                                                                     F.lit(0)).alias("_base")),
                  "piece-ranks")
    counts = {r[0]: r[1] for r in bases.groupBy("length").agg(F.sum("n")).collect()}
    runs = pieces.sparkSession.sparkContext.broadcast(best_fit_plan(counts, capacity))

    def place(batches):
        plan = runs.value
        key = plan[:, 0] << 44 | plan[:, 1]  # ranks stay below 2 ** 44
        for batch in batches:
            rank = batch.column("_rank").to_numpy() + batch.column("_base").to_numpy()
            length = batch.column("length").to_numpy()
            run = plan[np.searchsorted(key, length << 44 | rank, side="right") - 1]
            nth = rank - run[:, 1]
            yield pa.record_batch(
                [*(batch.column(c) for c in columns), pa.array(run[:, 4] + nth // run[:, 3]),
                 pa.array(run[:, 5] + nth % run[:, 3] * length)],
                names=[*columns, "sequence_id", "offset"])

    return (numbered.join(bases.drop("n"), ["_part", "length"])
            .select(*columns, "_rank", "_base")
            .mapInArrow(place, StructType(list(schema.fields)).add("sequence_id", LongType())
                        .add("offset", LongType())))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY,
                   end_id: int = END_ID, **columns) -> DataFrame:
    """Tokenise, cut and pack whole documents; see ``token_pieces`` for ``columns``."""
    return pack(token_pieces(docs, tokenizer, capacity, end_id, **columns), capacity)
