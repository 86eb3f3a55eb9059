"""Line dedup by pairwise alignment: rare shared lines find the pairs, patience diff aligns.

Every line with a word is an incidence (line hash, k-th occurrence in its document,
position).  So is every window, the shortest runs of adjacent lines that are a block worth
deleting: ``min_block`` lines, or fewer of ``min_words`` words together.  A document
meets another through what they share: each incidence is joined with the first document
(least doc_id) that holds the same line or window, so the rows are at most the incidences
however many documents share one, and a document is compared with every first holder of
one of its lines or windows.  A single line leads to its own first holder, often another
one for each line of a block; a window is rarer than its lines and leads to the first
document that holds the block itself, so a block that any earlier document
holds is met whole.

Per pair the shared lines are aligned as patience diff does: lines that occur once
in either document, and the lines of shared windows, are anchors, the longest increasing
run of anchors is kept, and kept anchors grow over neighbouring equal lines.  A block (consecutive lines in both
documents) is deleted from the later document when it holds a rare line (of
``RARE_WORDS`` words or more, in at most ``rare`` documents), at least ``min_block``
lines, or at least ``min_words`` words, however many documents hold it; a lone common
line of fewer words, or a short one, stays.  The first holder never loses a line to a
later one.

The groups are single documents: the lines of one document and its partners' places,
never the documents that share a line.

Defined cases: null or empty text has no line and stays as it is; a row with a null
id takes no part and is returned as it is; rows that repeat an id are one document
per distinct text, and equal rows get equal decisions; lines are compared after
stripping white space at their ends; other columns are kept.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import as_bytes, by_bytes, stage

RARE = 10
RARE_WORDS = 5
MIN_BLOCK = 3
MIN_WORDS = 30


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _kept_runs(gone: list[int]) -> list[dict]:
    """Runs of kept lines around the deleted ones; the last is open-ended."""
    begins = [0, *(g + 1 for g in gone)]
    return [{"from": b, "count": e - b} for b, e in zip(begins, [*gone, begins[-1] + (1 << 30)],
                                                        strict=True) if e > b]


def line_hashes(text: bytes) -> list[int]:
    """Signed hash of each line; 0 for lines without a word."""
    out = []
    for line in text.split(b"\n"):
        line = line.strip()
        out.append((xxhash.xxh64_intdigest(line) or 1) if line else 0)
    return [_signed(h) for h in out]


def windows(hashes: list[int], words: list[int], min_block: int, min_words: int
            ) -> list[tuple[int, int, list[int]]]:
    """(first position, hash, words of each line) of every window of a document's lines."""
    out = []
    for pos in range(len(hashes)):
        run = b""
        for size in range(1, min_block + 1):
            if pos + size > len(hashes) or not hashes[pos + size - 1]:
                break
            run += hashes[pos + size - 1].to_bytes(8, "little", signed=True)
            if size > 1 and (size == min_block or sum(words[pos:pos + size]) >= min_words):
                out.append((pos, _signed(xxhash.xxh64_intdigest(run, size)), words[pos:pos + size]))
    return out


def incidences(docs: DataFrame, id_col: str, text_col: str, min_block: int = MIN_BLOCK,
               min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, version, pos, line, occurrence, alone, words, before, after, parts), one row per
    line and one per window.

    ``alone``: once in its document; ``words``: the number of its words; ``parts``: the words
    of each line of a window, null for a line.
    """
    def run(batches):
        for part in by_bytes(batches, "text", 4 << 20):
            columns = [[] for _ in range(10)]
            for doc, text in zip(part.column("doc_id").to_pylist(), as_bytes(part.column("text")),
                                 strict=True):
                hashes = line_hashes(text)
                words = [len(x.split()) for x in text.split(b"\n")]
                total, seen = Counter(hashes), Counter()
                version = _signed(xxhash.xxh64_intdigest(text, 42))  # what xxhash64() gives
                for pos, h in enumerate(hashes):
                    if h:
                        seen[h] += 1
                        row = (doc, version, pos, h, seen[h], total[h] == 1, words[pos],
                               hashes[pos - 1] if pos else 0,
                               hashes[pos + 1] if pos + 1 < len(hashes) else 0, None)
                        for c, v in zip(columns, row, strict=True):
                            c.append(v)
                for pos, h, parts in windows(hashes, words, min_block, min_words):
                    seen[h] += 1
                    row = (doc, version, pos, h, seen[h], True, sum(parts), 0, 0, parts)
                    for c, v in zip(columns, row, strict=True):
                        c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(),
                     pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                  names=["doc_id", "version", "pos", "line", "occurrence", "alone",
                                         "words", "before", "after", "parts"])

    return docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, version long, pos int, line long, occurrence int, alone boolean, "
             "words int, before long, after long, parts array<int>")


def increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing run of ``values`` (patience sorting)."""
    tails, tops, back = [], [], []
    for i, v in enumerate(values):
        at = bisect_left(tails, v)
        if at == len(tails):
            tails.append(v)
            tops.append(i)
        else:
            tails[at], tops[at] = v, i
        back.append(tops[at - 1] if at else -1)
    out, i = [], tops[-1] if tops else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(shared: list[dict], rare: int = RARE, min_block: int = MIN_BLOCK,
          min_words: int = MIN_WORDS, words: dict[int, int] | None = None) -> set[int]:
    """Positions to delete from the later document of one pair.

    ``shared`` has the lines that both hold: pos, other (position in the earlier
    document), alone (once in both), line, words, holders, and the neighbouring line hashes
    of both sides (before, after, other_before, other_after), and the windows with their
    ``parts``.  ``words`` has the number of words by line, also for lines first held by
    another document.
    """
    words = words or {r["line"]: r["words"] for r in shared}
    lines = {(r["pos"], r["other"]): r for r in shared if not r.get("parts")}
    for r in shared:
        for i, n in enumerate(r.get("parts") or ()):
            key = r["pos"] + i, r["other"] + i
            known = lines.get(key) or dict.fromkeys(
                ("before", "after", "other_before", "other_after"), 0) | {
                "pos": key[0], "other": key[1], "line": None, "words": n, "holders": r["holders"]}
            lines[key] = known | {"alone": True}
    rows = sorted(lines.values(), key=lambda r: (r["pos"], -r["other"]))
    anchors = [r for r in rows if r["alone"]]
    taken = {anchors[i]["pos"]: anchors[i]["other"] for i in increasing([r["other"] for r in anchors])}
    at = {(r["pos"], r["other"]): r for r in rows}
    # grow: a neighbour of a kept line that is the same line on both sides
    edge = list(taken.items())
    size = {r["pos"]: r["words"] for r in rows}  # words of the lines in blocks
    while edge:
        pos, other = edge.pop()
        row = at.get((pos, other))
        if row is None:
            continue  # known to be equal from its neighbour's hashes only
        for step, mine, theirs in ((-1, "before", "other_before"), (1, "after", "other_after")):
            if row[mine] and row[mine] == row[theirs] and pos + step not in taken:
                taken[pos + step] = other + step
                size[pos + step] = words.get(row[mine], 0)
                edge.append((pos + step, other + step))
    gone: set[int] = set()
    block: list[int] = []
    for pos in [*sorted(taken), None]:
        if block and (pos is None or pos != block[-1] + 1 or taken[pos] != taken[block[-1]] + 1):
            held = [at.get((p, taken[p])) for p in block]
            held = [r for r in held if r and r["line"] is not None]
            if len(block) >= min_block or sum(size[p] for p in block) >= min_words or any(
                    r["words"] >= RARE_WORDS and r["holders"] <= rare for r in held):
                gone.update(block)
            block = []
        if pos is not None:
            block.append(pos)
    return gone


def deletions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rare: int = RARE,
              min_block: int = MIN_BLOCK, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, version, gone, partners, kept) for the documents that lose lines.

    ``gone`` lists line positions, ``partners`` the earlier documents they are kept in;
    ``version`` is a hash of the text and ``kept`` has the runs of lines that stay.
    """
    found = stage(incidences(docs, id_col, text_col, min_block, min_words), "lines")
    firsts = stage(found.groupBy("line", "occurrence").agg(
        F.min(F.struct("doc_id", "version", "pos", "alone", "before", "after")).alias("first"),
        F.count(F.lit(1)).alias("holders")).where("holders > 1"), "line-firsts")
    # both sides grow with the corpus: a merge join at every size
    shared = found.join(firsts.hint("merge"), ["line", "occurrence"]).where("first.doc_id < doc_id").select(
        "doc_id", "version", F.struct(
            "pos", F.col("first.doc_id").alias("partner"), F.col("first.version").alias("of"),
            F.col("first.pos").alias("other"),
            (F.col("alone") & F.col("first.alone")).alias("alone"), "line", "words", "holders",
            "before", "after",
            F.col("first.before").alias("other_before"),
            F.col("first.after").alias("other_after"), "parts").alias("row"))
    # a document that shares no window, and no line that is rare or long, keeps all its lines
    able = F.bool_or(F.col("row.parts").isNotNull() | (F.col("row.words") >= min_words)
                     | ((F.col("row.words") >= RARE_WORDS) & (F.col("row.holders") <= rare)))
    per_doc = shared.groupBy("doc_id", "version").agg(
        F.collect_set("row").alias("rows"), able.alias("able")).where("able").drop("able")

    runs = pa.list_(pa.struct([("from", pa.int32()), ("count", pa.int32())]))

    def run(batches):
        for batch in batches:
            gone, partners, keep = [], [], []
            for i in range(batch.num_rows):
                pairs: dict[tuple, list[dict]] = {}
                words = {}
                for r in batch.column("rows")[i].as_py():
                    if not r["parts"]:
                        words[r["line"]] = r["words"]
                    pairs.setdefault((r["partner"], r["of"]), []).append(r)
                cut: set[int] = set()
                kept_in = set()
                for (partner, _), rows in pairs.items():
                    if dead := align(rows, rare, min_block, min_words, words):
                        cut |= dead
                        kept_in.add(partner)
                if cut:
                    keep.append(i)
                    gone.append(sorted(cut))
                    partners.append(sorted(kept_in))
            yield pa.record_batch(
                [batch.column("doc_id").take(pa.array(keep, pa.int64())),
                 batch.column("version").take(pa.array(keep, pa.int64())),
                 pa.array(gone, pa.list_(pa.int32())), pa.array(partners, pa.list_(pa.int64())),
                 pa.array([_kept_runs(g) for g in gone], runs)],
                names=["doc_id", "version", "gone", "partners", "kept"])

    return stage(per_doc.select("doc_id", "version", "rows").mapInArrow(
        run, "doc_id long, version long, gone array<int>, partners array<long>, "
             "kept array<struct<from:int,count:int>>"), "line-deletions")


def delete_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 rare: int = RARE, min_block: int = MIN_BLOCK, min_words: int = MIN_WORDS,
                 report: bool = False) -> DataFrame:
    """``docs`` with the aligned common blocks deleted from later documents.

    With ``report`` the columns ``gone`` (deleted line positions) and ``partners``
    follow; they are empty for documents that lose nothing.
    """
    cuts = deletions(docs, id_col, text_col, rare, min_block, min_words).toDF(
        "_ld_doc", "_ld_version", "_ld_gone", "_ld_partners", "_ld_kept")
    joined = docs.withColumn("_ld_text", F.col(text_col).cast("string")).join(
        cuts.hint("merge"), (F.col(id_col).cast("long") == F.col("_ld_doc"))
        & (F.xxhash64("_ld_text") == F.col("_ld_version")), "left")
    lines = F.split("_ld_text", "\n")
    kept = F.flatten(F.transform("_ld_kept", lambda r: F.slice(lines, r["from"] + 1, r["count"])))
    out = joined.withColumn(text_col, F.when(F.col("_ld_kept").isNull(), F.col(text_col))
                            .otherwise(F.array_join(kept, "\n")))
    extra = [F.coalesce("_ld_gone", F.array().cast("array<int>")).alias("gone"),
             F.coalesce("_ld_partners", F.array().cast("array<bigint>")).alias("partners")]
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], *extra * report)
