"""Repeated passages: paragraph MinHash banding, exact Jaccard, removal by components.

1. Each line of ``min_words`` words or more is a paragraph.  One pass over the
   documents gives its place, a 128-bit key of its normalised words, and the band
   values of a MinHash over its 5-word shingles.
2. Equal paragraphs are one node.  Bands are tuned (``tune_bands``) so that a pair
   at the threshold collides with at least the asked probability.
3. Every member of a colliding bucket is verified against the bucket's least key
   (a star, so the rows grow with the members).  Buckets whose members then still
   lie in several components are compared fully, each in one piece while its text is
   at most ``BLOCK_CHARS``, so a member is sent once; larger ones in block pairs of that
   size.  No link between colliding paragraphs is lost and no pair list is emitted.
4. Of each component the occurrence with the least (doc_id, position) stays.

With ``passages`` the whole text, as one stream of words, is read in two more ways, so
that line ends don't matter:

5. It is cut at word boundaries chosen by content (``cut_places``): short lines in a row
   are merged and long lines split, and equal stretches get equal cuts whatever
   surrounds them.  These passages are units of their own in steps 1 to 4; they and the
   lines are never compared with each other, since both cover the same words.
6. Of every ``min_words + WINNOW - 1`` words in a row at least one window of
   ``min_words`` words is taken, chosen by content (``winnow``).  Equal windows repeat:
   a run of that length (50 words) held twice is found for certain, and removed from
   the first to the last taken window in it.  A removed word has an equal word at an
   earlier place, so a word of each copy always stays.

Jaccard is exact on the sets of 5-word shingles.  Defined cases: null or empty
text has no paragraph; a row with a null id is returned with nothing removed and
matches nothing; rows that repeat an id and text count as one document, so they
don't remove each other; rows of one id with different texts each keep their paragraphs; other columns are ignored; ties go to the least
(doc_id, position).
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .prefilter import may_hold
from .staging import as_bytes, by_bytes, stage

SHINGLE = 5
THRESHOLD = 0.8
MIN_WORDS = 30
BLOCK_CHARS = 1 << 21  # text of a block of a bucket
BATCH = 1 << 19  # text read at once: the arrays of its words stay in the cache
BAND_BYTES = 5  # of a band value: unequal ones agree for one pair in 2 ** 40, and pairs are verified
WINNOW = 21  # words between which a window is taken
REACH = 32  # words to either side of a cut
PASSAGE = 1 << 30  # idx of passages and windows: this and the place of the first word
_SPACE = r"[\x20\x09-\x0D]+"


def tune_bands(threshold: float = THRESHOLD, recall: float = 0.999,
               most_bands: int = 12) -> tuple[int, int]:
    """(bands, rows): the most selective bands that still reach ``recall`` at the threshold."""
    best = None
    for rows in range(1, 9):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - threshold ** rows)))
        if bands <= most_bands:
            best = (bands, rows)
    return best


def shingle_hashes(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Hash of every k consecutive word hashes; fewer words give one shingle of all."""
    k = max(1, min(k, len(words)))
    with np.errstate(over="ignore"):
        out = np.zeros(max(0, len(words) - k + 1), np.uint64)
        for i in range(k):
            out = out * np.uint64(0x9E3779B97F4A7C15) + words[i:len(words) - k + 1 + i]
            out ^= out >> np.uint64(29)
    return out


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def shingle_set(paragraph: bytes) -> np.ndarray:
    return np.unique(shingle_hashes(_word_hashes(paragraph.lower().split())))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Exact Jaccard of two sorted distinct arrays."""
    if not len(a) or not len(b):
        return 0.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return (rng.integers(0, 1 << 63, count, np.uint64) * np.uint64(2) + np.uint64(1),
            rng.integers(0, 1 << 63, count, np.uint64))


def _band_values(shingles: np.ndarray, units: list[tuple[np.ndarray, np.ndarray]], bands: int,
                 rows: int) -> list[np.ndarray]:
    """MinHash band values of each list of units, given as first and last word of each.

    ``shingles`` has the shingle that begins at each word; it is hashed once for all lists.
    """
    mult, add = _permutations(bands * rows)
    out = [np.zeros((len(first), bands), np.uint64) for first, _ in units]
    edges = []
    for first, last in units:  # from the first shingle to behind the last one, and the gap between
        edge = np.stack([first, last - SHINGLE + 2], axis=1).ravel()
        edges.append(edge[:-1] if len(edge) and edge[-1] == len(shingles) else edge)
    hashed = np.empty_like(shingles)
    for i in range(bands * rows):
        np.multiply(shingles, mult[i], out=hashed)
        np.add(hashed, add[i], out=hashed)
        np.right_shift(hashed, np.uint64(16), out=hashed)
        b = i // rows
        for values, edge in zip(out, edges, strict=True):
            if len(values):
                least = np.minimum.reduceat(hashed, edge)[::2]
                values[:, b] = (values[:, b] ^ least) * np.uint64(0xBF58476D1CE4E5B9)
                values[:, b] ^= values[:, b] >> np.uint64(31)
    return out


def _packed(values: np.ndarray) -> pa.Array:
    """One binary per unit: ``BAND_BYTES`` of each band value, one band after the other."""
    n, bands = values.shape
    cut = values.astype("<u8").view(np.uint8).reshape(n, bands, 8)[:, :, :BAND_BYTES]
    ends = np.arange(n + 1, dtype=np.int32) * (bands * BAND_BYTES)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(cut.tobytes())])


_IS_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])


class _Words:
    """The words of a slice of texts: hash, text, and place in code points and bytes."""

    def __init__(self, part: pa.RecordBatch) -> None:
        texts = as_bytes(part.column("text").filter(pc.is_valid(part.column("doc_id"))))
        self.docs = part.column("doc_id").drop_null()
        self.raw = b"\n".join([*texts, b""])
        codes = np.frombuffer(self.raw, np.uint8)
        space = _IS_SPACE[codes]
        edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
        self.first, self.past = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        self.begins = begins = np.cumsum(sizes) - sizes
        self.doc = np.searchsorted(begins, self.first, "right") - 1
        chars = np.zeros(len(codes) + 1, np.int64)
        np.cumsum((codes & 0xC0) != 0x80, out=chars[1:])
        shift = chars[begins][self.doc] if len(texts) else self.first
        self.start, self.end = chars[self.first] - shift, chars[self.past] - shift
        self.chars, self.shift = chars, shift
        self.breaks = np.flatnonzero(codes == 10)  # a line end after each text, too
        split = self.raw.lower().split()
        self.normal = b" ".join(split)
        self.past_normal = np.cumsum(self.past - self.first + 1) - 1  # end of each word there
        self.hashes = _word_hashes(split)
        n = np.bincount(self.doc, minlength=len(texts))
        self.place = np.arange(len(self.doc)) - (np.cumsum(n) - n)[self.doc]  # in its text
        self.left = n[self.doc] - self.place  # words from here to the end of the text
        self.order = shingle_hashes(self.hashes) if len(self.hashes) >= SHINGLE else np.zeros(0, np.uint64)

    def keys(self, at: np.ndarray, last: np.ndarray, passage: bool) -> pa.Array:
        """``_key`` of word runs from ``at`` to ``last``."""
        begin = self.past_normal[at] - (self.past[at] - self.first[at])
        head = b"\n" * passage
        return pa.array([hashlib.md5(head + self.normal[a:b], usedforsecurity=False).digest()
                         for a, b in zip(begin.tolist(), self.past_normal[last].tolist(), strict=True)], pa.binary())

    def spans(self, at: np.ndarray, last: np.ndarray) -> list[pa.Array]:
        """doc_id, idx, start and end of word runs from ``at`` to ``last``."""
        return [self.docs.take(pa.array(self.doc[at])),
                pa.array((PASSAGE + self.place[at]).astype(np.int32)),
                pa.array(self.start[at].astype(np.int64)), pa.array(self.end[last].astype(np.int64))]


def _least_ahead(values: np.ndarray, width: int) -> np.ndarray:
    """Least of ``width`` values from each place on; shorter at the end."""
    out, have = values.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[:-step] = np.minimum(out[:-step], out[step:])
        have += step
    return out


def cut_places(order: np.ndarray, place: np.ndarray, left: np.ndarray, reach: int = REACH) -> np.ndarray:
    """Places of the least values within ``reach`` places to both sides in the same text.

    ``place`` is the number of values before each one in its text, ``left`` from it on.
    """
    if len(order) < 2 * reach + 1:
        return np.zeros(0, np.int64)
    least = _least_ahead(order, 2 * reach + 1)[:len(order) - 2 * reach]
    at = np.flatnonzero(least == order[reach:len(order) - reach]) + reach
    return at[(place[at] >= reach) & (left[at] > reach)]


def winnow(order: np.ndarray, place: np.ndarray, left: np.ndarray, width: int = WINNOW) -> np.ndarray:
    """Places that are the last least value of some ``width`` places in a row of a text
    (or of all of a shorter one); values without any ``left`` are passed over.
    """
    if not len(order):
        return np.zeros(0, np.int64)
    least = _least_ahead(order, min(width, len(order)))
    least[left < width] = 0  # no window of one text begins here
    # the greatest least value of the windows that hold a place is its own: it is least in one
    best = ~_least_ahead(~least[::-1], min(width, len(order)))[::-1]
    at = np.flatnonzero((best == order) & (place + left >= width) & (left > 0))
    tied = np.flatnonzero((order[at[1:]] == order[at[:-1]]) & (np.diff(at) < width))
    p, q = at[tied], at[tied + 1]  # q is taken instead of p in the windows that hold both
    alone = np.zeros(len(p), np.uint64)
    for k in range(width - 1 if len(p) else 0):
        begin = p - width + 1 + k
        alone = np.maximum(alone, np.where((begin >= 0) & (begin <= q - width), least[begin], 0))
    at = np.delete(at, tied[alone != order[p]])
    short = np.flatnonzero((place + left < width) & (left > 0))
    if not len(short):
        return at
    heads = np.flatnonzero(place[short] == 0)
    sizes = np.diff(np.append(heads, len(short)))
    same = order[short] == np.repeat(np.minimum.reduceat(order[short], heads), sizes)
    return np.sort(np.append(at, np.maximum.reduceat(np.where(same, short, -1), heads)))


_NAMES = ["doc_id", "idx", "start", "end", "key", "bands"]


def _key(paragraph: bytes, passage: bool) -> bytes:
    """128-bit key of the normalised words; the line end keeps passages apart from lines."""
    return hashlib.md5(b"\n" * passage + b" ".join(paragraph.lower().split()), usedforsecurity=False).digest()


def _lines(w: _Words, min_words: int) -> tuple[np.ndarray, np.ndarray, list]:
    """First and last word of each line of ``min_words``, and its doc_id, idx, start and end."""
    line = np.searchsorted(w.breaks, w.first)
    n_words = np.bincount(line, minlength=len(w.breaks))
    chosen = n_words >= max(min_words, SHINGLE)
    at = np.flatnonzero(chosen)
    word = (np.cumsum(n_words) - n_words)[at]  # first word of each
    doc = w.doc[word]
    begin = np.concatenate([[0], w.breaks + 1])[at]
    past = w.breaks[at]
    index = at - np.searchsorted(w.breaks, w.begins[doc])
    where = [w.docs.take(pa.array(doc)), pa.array(index.astype(np.int32)),
             pa.array((w.chars[begin] - w.shift[word]).astype(np.int64)),
             pa.array((w.chars[past] - w.shift[word]).astype(np.int64))]
    return word, word + n_words[at] - 1, where


def _passages(w: _Words, min_words: int) -> tuple[np.ndarray, np.ndarray, list]:
    """As ``_lines``, of the stretches between cuts."""
    cut = w.place == 0
    n = len(w.order)
    cut[cut_places(w.order, w.place[:n], w.left[:n] - SHINGLE + 1)] = True
    at = np.flatnonzero(cut)
    n_words = np.diff(np.append(at, len(cut)))
    chosen = n_words >= max(min_words, SHINGLE)
    at, last = at[chosen], (at + n_words - 1)[chosen]
    return at, last, w.spans(at, last)


def _window_rows(w: _Words, size: int) -> pa.RecordBatch:
    """Rows of the taken windows; they have no bands."""
    n = len(w.order)
    at = winnow(w.order, w.place[:n], np.maximum(w.left[:n] - size + 1, 0))
    # shingles that cover the window stand for its words
    parts, steps = (w.order, sorted({*range(0, size - SHINGLE + 1, SHINGLE), size - SHINGLE})) if (
        size >= SHINGLE) else (w.hashes, range(size))
    keys = np.zeros((len(at), 2), np.uint64)
    with np.errstate(over="ignore"):
        for i in steps:
            part = parts[at + i]
            for k, seed in enumerate((np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))):
                key = (keys[:, k] ^ part) * seed
                keys[:, k] = key ^ (key >> np.uint64(29))
    ends = np.arange(len(at) + 1, dtype=np.int32) * 16
    key = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(keys.tobytes())])
    return pa.record_batch([*w.spans(at, at + size - 1), key, pa.nulls(len(at), pa.binary())],
                           names=_NAMES)


def paragraphs(docs: DataFrame, id_col: str, text_col: str, min_words: int, bands: int,
               rows: int, passages: bool = False) -> DataFrame:
    """One row per line of ``min_words``; with ``passages`` also per passage and taken window."""
    def run(batches):
        for part in by_bytes(batches, "text", BATCH):
            w = _Words(part)
            units = [_lines(w, min_words)] + [_passages(w, min_words)] * passages
            values = _band_values(w.order, [(at, last) for at, last, _ in units], bands, rows)
            for passage, ((at, last, where), value) in enumerate(zip(units, values, strict=True)):
                yield pa.record_batch([*where, w.keys(at, last, bool(passage)), _packed(value)], names=_NAMES)
            if passages:
                yield _window_rows(w, min_words)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, idx int, start long, end long, key binary, bands binary")


def repeated_windows(windows: DataFrame) -> DataFrame:
    """Removed rows of ``repeated_paragraphs`` for equal windows, and the first occurrence
    of each, with ``removed`` false.

    A count by 64-bit hash first: only windows that may repeat are grouped by their keys.
    """
    short = F.xxhash64("key")
    twice = stage(windows.groupBy(short.alias("k")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
                  .select("k"), "window-counts")
    again = stage(may_hold(windows, short, twice), "windows-again", "zstd")
    firsts = stage(again.groupBy("key").agg(
        F.min(F.struct("doc_id", "idx")).alias("first"), F.max(F.struct("doc_id", "idx")).alias("last"))
        .where("first <> last").select("key", "first"), "window-firsts")
    return again.join(firsts.hint("merge"), "key").select(
        "doc_id", "idx", "start", "end", F.col("first.doc_id").alias("first_doc"),
        F.col("first.idx").alias("first_idx"),
        ((F.col("doc_id") != F.col("first.doc_id")) | (F.col("idx") != F.col("first.idx"))).alias("removed"))


def _numbered(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle) of every distinct shingle of each text, in order; equal ones share a
    number.  The texts have ``SHINGLE`` words or more, as all paragraphs.
    """
    split = [t.lower().split() for t in texts]
    of = np.repeat(np.arange(len(split)), [len(s) for s in split])
    hashes = _word_hashes(list(chain.from_iterable(split)))
    inside = of[:1 - SHINGLE] == of[SHINGLE - 1:]
    distinct, number = np.unique(shingle_hashes(hashes)[inside], return_inverse=True)
    held = np.unique(of[:1 - SHINGLE][inside] * len(distinct) + number)
    return held // len(distinct), held % len(distinct)


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of nodes whose paragraphs reach the threshold."""
    def run(batches):
        for part in by_bytes(batches, "tb", BATCH):
            # a bucket's least paragraph comes again and again
            _, first, which = np.unique(part.column("a").to_numpy(), return_index=True, return_inverse=True)
            n = len(first)
            of, number = _numbered(as_bytes(part.column("ta").take(pa.array(first))) + as_bytes(part.column("tb")))
            size = np.bincount(of)
            split, most = np.searchsorted(of, n), number.max() + 1
            left = of[:split] * most + number[:split]
            right = which[of[split:] - n] * most + number[split:]
            both = left[np.minimum(np.searchsorted(left, right), len(left) - 1)] == right
            common = np.bincount(of[split:] - n, weights=both)
            good = common / (size[which] + size[n:] - common) >= threshold
            yield pa.record_batch([part.column("a"), part.column("b")],
                                  names=["a", "b"]).filter(pa.array(good))

    side = texts.select("node", "paragraph")
    return (pairs.join(side.toDF("a", "ta").hint("merge"), "a")
            .join(side.toDF("b", "tb").hint("merge"), "b")
            .select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long"))


def _links_in_blocks(group: np.ndarray, node: np.ndarray, component: np.ndarray, chunk: np.ndarray,
                     texts: list[bytes], threshold: float) -> list[tuple[int, int]]:
    """Spanning links of block pairs, one ``group`` of rows each; pairs already connected
    are passed over.  A pair of two blocks compares the one with the other.

    Overlaps are counted for all members at once from the lists of those that hold a
    shingle; members with too many shingles of their own have no partner in the group.
    """
    of, number = _numbered(texts)
    size = np.bincount(of, minlength=len(texts))
    _, token, held = np.unique(group[of] * (number.max() + 1) + number, return_inverse=True, return_counts=True)
    shared = np.bincount(of, weights=held[token] > 1, minlength=len(texts))
    able = shared >= threshold * size - 1e-6
    used = (held[token] > 1) & able[of]
    of, token = of[used], token[used]
    begin = np.searchsorted(of, np.arange(len(texts) + 1))
    holders = of[np.argsort(token, kind="stable")]
    ends = np.cumsum(np.bincount(token, minlength=len(held)))
    starts = np.concatenate([[0], ends[:-1]])
    links = []
    edges = np.flatnonzero(np.diff(group, prepend=-1, append=-1))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        label, blocks = component[a:b].copy(), chunk[a:b]
        two = (blocks != blocks[0]).any()
        for i in np.flatnonzero(able[a:b]):
            other = label != label[i]
            if two:
                other &= blocks != blocks[i]
            other &= able[a:b]
            if not other.any():
                continue
            held_by = [holders[starts[t]:ends[t]] for t in token[begin[a + i]:begin[a + i + 1]]]
            common = np.bincount(np.concatenate(held_by) - a, minlength=b - a)
            near = other & (common / (size[a + i] + size[a:b] - common) >= threshold)
            for j in np.flatnonzero(near):
                if label[i] != label[j]:
                    label[label == label[j]] = label[i]
                    links.append((int(node[a + i]), int(node[a + j])))
    return links


def _dealt(placed: DataFrame, block: int | None = None) -> DataFrame:
    """Members of buckets with several components, each with its chunk and block pair.

    A bucket is one block up to ``BLOCK_CHARS`` of text (or ``block`` members, where given), and
    a member of it is sent once.  Of a larger one a member goes to one block pair per block.
    """
    blocks = F.ceil(F.count(F.lit(1)) / block) if block else F.ceil(F.sum("chars") / BLOCK_CHARS)
    open_ = stage(placed.groupBy("bucket").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), blocks.cast("int").alias("blocks"))
        .where("lo <> hi").select("bucket", "blocks"), "paragraph-open")
    return (placed.join(open_, "bucket")
            .withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("bucket", "node", "component", "chunk",
                    F.least("chunk", "other").alias("lower"),
                    F.greatest("chunk", "other").alias("upper")))


def _rest(members: DataFrame, found: DataFrame, texts: DataFrame, threshold: float,
          block: int | None) -> DataFrame:
    """Links between components inside a bucket, by block pairs of bounded text."""
    found = found.withColumnRenamed("node", "of")
    sizes = texts.select(F.col("node").alias("_sized"), "chars")
    placed = members.join(found.hint("merge"), members["node"] == found["of"], "left").join(
        sizes.hint("merge"), F.col("node") == F.col("_sized")).select(
        "bucket", "node", "chars", F.coalesce("component", "node").alias("component"))
    placed = stage(placed, "paragraph-buckets")
    dealt = _dealt(placed, block)

    def run(batches):
        for batch in batches:
            m = batch.column("m")
            flat = m.flatten()
            node, component, chunk = (flat.field(i).to_numpy() for i in range(3))
            text = flat.field(3)
            group = np.repeat(np.arange(len(m)), pc.list_value_length(m).to_numpy())
            size = np.cumsum(pc.binary_length(text).to_numpy())
            ends = np.flatnonzero(np.diff(group, append=-1)) + 1  # of the block pairs
            at = 0
            while at < len(group):  # as many block pairs as hold BATCH, one at least
                fit = np.searchsorted(size[ends - 1], (size[at - 1] if at else 0) + BATCH, "right")
                past = ends[max(fit - 1, np.searchsorted(ends, at, "right"))]
                links = _links_in_blocks(group[at:past], node[at:past], component[at:past], chunk[at:past],
                                         as_bytes(text[at:past]), threshold)
                at = past
                if links:
                    a, b = zip(*links, strict=True)
                    yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())],
                                          names=["a", "b"])

    return (dealt.join(texts.select("node", "paragraph").hint("merge"), "node")
            .groupBy("bucket", "lower", "upper")
            .agg(F.collect_list(F.struct("node", "component", "chunk", "paragraph")).alias("m"))
            .select("m").mapInArrow(run, "a long, b long"))


def _candidates(nodes: DataFrame, bands: int) -> tuple[DataFrame, DataFrame]:
    """Stars (a, b) of the colliding buckets, and the members of buckets of three or more.

    A bucket of two is its least and its last node, so only the entries of larger
    buckets meet the bucket table again.
    """
    # passages have bands of their own: they overlap lines, so the two never meet
    entries = nodes.select("node", F.col("first.idx"), "bands",
                           F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band")).select(
        "node", F.xxhash64(F.substring("bands", F.col("band") * BAND_BYTES + 1, F.lit(BAND_BYTES)),
                           F.col("band") + F.when(F.col("idx") >= PASSAGE, bands).otherwise(0))
        .alias("bucket"))
    buckets = stage(entries.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("members"), F.min("node").alias("least"), F.max("node").alias("last"))
        .where("members > 1"), "buckets")
    crowded = buckets.where("members > 2").drop("last")
    members = stage(may_hold(entries, F.col("bucket"), crowded.select("bucket"))
                    .join(crowded.hint("merge"), "bucket"), "members")
    star = buckets.where("members = 2").select(F.col("least").alias("a"), F.col("last").alias("b")).unionByName(
        members.where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")))
    return stage(star.distinct(), "candidates"), members


def _candidate_texts(docs: DataFrame, found: DataFrame, nodes: DataFrame, star: DataFrame) -> DataFrame:
    """(node, chars, paragraph) of the nodes in ``star``, cut from the text of their first occurrence.

    Of rows that share an id, the one whose paragraph has the node's key gives it.
    """
    wanted = star.select(F.col("a").alias("node")).unionByName(star.select(F.col("b").alias("node"))).distinct()
    firsts = stage(nodes.select("node", "key", "first.doc_id", "first.idx")
                   .join(wanted.hint("merge"), "node", "left_semi"), "candidate-firsts")
    place = F.xxhash64("doc_id", "idx", "key")
    spans = (may_hold(found, place, firsts.select(place)).select("doc_id", "idx", "key", "start", "end").distinct()
             .join(firsts.hint("merge"), ["doc_id", "idx", "key"]).groupBy("doc_id")
             .agg(F.collect_list(F.struct("node", "key", "idx", "start", "end")).alias("spans")))
    spans = stage(spans, "candidate-spans")

    def run(batches):
        last, given = None, set()  # rows that repeat an id lie together
        for batch in batches:
            for part in by_bytes([batch], "text", 4 << 20):
                names, out = [], []
                for doc, text, cuts in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(),
                                           part.column("spans").to_pylist(), strict=True):
                    if doc != last:
                        last, given = doc, set()
                    for c in cuts:
                        if c["node"] in given:
                            continue
                        raw = text[c["start"]:c["end"]].encode()
                        if _key(raw, c["idx"] >= PASSAGE) == c["key"]:
                            given.add(c["node"])
                            names.append(c["node"])
                            out.append(raw)
                yield pa.record_batch([pa.array(names, pa.int64()), pa.array([len(t) for t in out], pa.int64()),
                                       pa.array(out, pa.binary()).cast(pa.string())],
                                      names=["node", "chars", "paragraph"])

    return stage(may_hold(docs, F.col("doc_id"), spans.select("doc_id")).join(spans.hint("merge"), "doc_id")
                 .mapInArrow(run, "node long, chars long, paragraph string"), "candidate-texts", "zstd")


def repeated_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        min_words: int = MIN_WORDS, threshold: float = THRESHOLD,
                        recall: float = 0.999, block: int | None = None,
                        passages: bool = False) -> DataFrame:
    """One row per repeated occurrence: doc_id, idx, start, end, first_doc, first_idx, removed.

    ``start`` and ``end`` are code points of the paragraph in its text; the first
    occurrence of a component has ``removed`` false.  With ``passages`` those cut from
    the whole text and the repeated windows are among the rows; rows may then overlap.
    """
    bands, rows = tune_bands(threshold, recall)
    rows_ = stage(paragraphs(docs, id_col, text_col, min_words, bands, rows, passages),
                  "paragraphs", "zstd")
    found = rows_.where("bands is not null")
    nodes = stage(found.groupBy("key").agg(
        F.min(F.struct("doc_id", "idx")).alias("first"), F.max(F.struct("doc_id", "idx")).alias("last"),
        F.min("bands").alias("bands")).select(
        F.monotonically_increasing_id().alias("node"), "key", "first",
        (F.col("first") != F.col("last")).alias("again"), "bands"), "paragraph-nodes")
    star, members = _candidates(nodes, bands)
    whole = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    texts = _candidate_texts(whole, found, nodes, star)
    links = stage(_verified(star, texts, threshold), "paragraph-links")
    starred = stage(components(links), "paragraph-stars")
    more = stage(_rest(members, starred, texts, threshold, block), "paragraph-links")
    groups = components(starred.toDF("a", "b").unionByName(more)).withColumnRenamed("node", "of")
    named = stage(nodes.select("node", "key", "first", "again").join(
        groups.hint("merge"), F.col("node") == F.col("of"), "left").where("again or of is not null").select(
        "key", "first", F.coalesce("component", "node").alias("component")), "paragraph-groups")
    firsts = stage(named.groupBy("component").agg(F.min("first").alias("of")), "paragraph-firsts")
    classes = stage(named.join(firsts.hint("merge"), "component").select("key", "of"), "paragraph-classes")
    # a class left here has two occurrences at least, so its first one is repeated
    out = may_hold(found.select("doc_id", "idx", "start", "end", "key"), F.col("key"), classes.select("key")).join(
        classes.hint("merge"), "key").select(
        "doc_id", "idx", "start", "end", F.col("of.doc_id").alias("first_doc"),
        F.col("of.idx").alias("first_idx"))
    out = out.withColumn("removed", (F.col("doc_id") != F.col("first_doc"))
                         | (F.col("idx") != F.col("first_idx")))
    windows = rows_.where("bands is null").select("doc_id", "idx", "start", "end", "key")
    return out.unionByName(repeated_windows(windows)) if passages else out


def _joined_spans(found: DataFrame) -> DataFrame:
    """``found`` (doc_id, removed, repeats_of) with overlapping spans made one."""
    def run(batches):
        for batch in batches:
            spans = batch.column("removed")
            flat, sizes = spans.flatten(), pc.list_value_length(spans).to_numpy()
            start, end = (flat.field(i).to_numpy() for i in (0, 1))
            lengths, begins, ends = [], [], []
            for past, size in zip(np.cumsum(sizes), sizes, strict=True):
                b, e = start[past - size:past], np.maximum.accumulate(end[past - size:past])
                head = np.ones(size, bool)
                head[1:] = b[1:] > e[:-1]
                tail = np.append(head[1:], True)[:size]
                begins.append(b[head])
                ends.append(e[tail])
                lengths.append(int(head.sum()))
            pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) if x
                                                else pa.array([], pa.int64()) for x in (begins, ends)],
                                               names=["start", "end"])
            offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
            yield pa.record_batch([batch.column("doc_id"), pa.ListArray.from_arrays(offsets, pairs),
                                   batch.column("repeats_of")],
                                  names=["doc_id", "removed", "repeats_of"])

    return found.select("doc_id", "removed", "repeats_of").mapInArrow(
        run, "doc_id long, removed array<struct<start:bigint,end:bigint>>, repeats_of array<bigint>")


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             **options) -> DataFrame:
    """One row per document: doc_id, n_removed, removed [(start, end)], repeats_of [doc_id].

    ``repeats_of`` names the first document of each repeated passage it holds, itself
    included where it is the first.  With ``passages`` overlapping spans are one span.
    """
    found = repeated_paragraphs(docs, id_col, text_col, **options)
    spans = found.groupBy("doc_id").agg(
        F.sort_array(F.collect_set(F.when(F.col("removed"), F.struct("start", "end")))).alias("removed"),
        F.sort_array(F.collect_set("first_doc")).alias("repeats_of"))
    if options.get("passages"):
        spans = _joined_spans(spans)
    spans = stage(spans, "paragraph-removals")
    return docs.select(F.col(id_col).cast("long").alias("doc_id")).join(spans, "doc_id", "left").select(
        "doc_id", F.coalesce(F.size("removed"), F.lit(0)).alias("n_removed"),
        F.coalesce("removed", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("removed"),
        F.coalesce("repeats_of", F.array().cast("array<bigint>")).alias("repeats_of"))


def _cut_spans(docs: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    cuts = removals(docs, id_col, text_col, **options).where("n_removed > 0").select(
        F.col("doc_id").alias("_of"), F.col("removed").alias("_cut")).dropDuplicates(["_of"])
    schema = docs.join(cuts.limit(0), F.lit(True), "left").schema

    def run(batches):
        for part in by_bytes(batches, text_col, 4 << 20):
            out = []
            for text, spans in zip(part.column(text_col).to_pylist(),
                                   part.column("_cut").to_pylist(), strict=True):
                at, kept = 0, []
                for s in spans or ():
                    kept.append(text[at:s["start"]])
                    at = s["end"]
                out.append(text if text is None else "".join([*kept, text[at:]]))
            at = part.schema.get_field_index(text_col)
            yield part.set_column(at, part.schema.field(at), pa.array(out, part.column(at).type))

    joined = docs.join(cuts.hint("merge"), F.col(id_col).cast("long") == F.col("_of"), "left")
    return joined.mapInArrow(run, schema).select(*[F.col(f"`{c}`") for c in docs.columns])


def remove_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      **options) -> DataFrame:
    """``docs`` with the repeated passages cut out of ``text_col``, other columns as they are."""
    if options.get("passages"):
        return _cut_spans(docs, id_col, text_col, **options)
    spans = stage(repeated_paragraphs(docs, id_col, text_col, **options).where("removed")
                  .groupBy("doc_id").agg(F.collect_set("idx").alias("_cut"))
                  .withColumnRenamed("doc_id", "_of"), "paragraph-cuts")
    kept = F.filter(F.split(F.col(text_col), "\n"), lambda x, i: ~F.array_contains("_cut", i))
    joined = docs.join(spans, F.col(id_col) == F.col("_of"), "left")
    return joined.withColumn(text_col, F.when(F.col("_cut").isNull(), F.col(text_col))
                             .otherwise(F.array_join(kept, "\n"))).select(docs.columns)
