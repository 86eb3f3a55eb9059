"""Quality classifier: gated-attention multiple-instance learning over passages.

A document is a bag of passages of ``PASSAGE`` words; every passage of the whole
text is encoded.  The model is

    h_k = tanh(W x_k + e)                         passage code
    a   = softmax_k( w . (tanh(V h_k) * sigmoid(U h_k)) )   gated attention
    score = sigmoid( c . sum_k a_k h_k + b )

with W, e, V, U, w, c and b learned together from document labels.  Fitting is
data-parallel on Spark: each round every partition of the labelled sample takes a
few passes of Adam from the common weights and sends back its weights, and the
driver averages them (a few thousand numbers per partition).

``x_k`` has word-shape shares, repetition (distinct words, equal neighbours, windows
of five words seen earlier in the document) and hashed words; nothing else of a row
is an input.

The labelled sample is bounded by ``MAX_LABELLED`` rows, picked by a hash of the id.

Defined cases: null or empty text is one passage without words and gets a score;
labels other than 0 and 1 are ignored, of several labels of one document the lowest
counts; without labels every score is 0.5; repeated rows get equal scores; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .op10_paragraphs import shingle_hashes
from .staging import as_bytes, by_bytes, stage

PASSAGE = 128
HASHED = 32
#: Labelled documents that the model is fitted on, at most.
MAX_LABELLED = 8_000
PARTITIONS, ROUNDS, PASSES, BATCH = 8, 8, 6, 64
CODE, GATE = 16, 8
THRESHOLD = 0.7
SPACE = r"[\x20\x09-\x0D]+"
_CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789",
            b".,;:'\"()?", b"!", b"#*$%&|<>~^_=+\\/{}[]@`")
SHAPES = len(_CLASSES) + 4
WIDTH = SHAPES + 4 + HASHED


def _word_shapes(words: list[bytes]) -> np.ndarray:
    """Per distinct word: counts of each character class, length, and three flags."""
    table = np.full(256, len(_CLASSES), np.int64)
    for i, chars in enumerate(_CLASSES):
        table[np.frombuffer(chars, np.uint8)] = i
    out = np.zeros((len(words), SHAPES), np.float32)
    if not words:
        return out
    size = np.fromiter(map(len, words), np.int64, len(words))
    kinds = table[np.frombuffer(b"".join(words), np.uint8)]
    row = np.repeat(np.arange(len(words)), size)
    counts = np.bincount(row * (len(_CLASSES) + 1) + kinds,
                         minlength=len(words) * (len(_CLASSES) + 1)).reshape(len(words), -1)
    out[:, :len(_CLASSES)] = counts[:, :-1]
    out[:, len(_CLASSES)] = size
    letters = counts[:, 0] + counts[:, -1]
    out[:, -3] = (counts[:, 1] > 1) & (letters == 0)
    out[:, -2] = counts[:, 5] > 0
    out[:, -1] = size > 14
    return out


def encode_passages(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(x, offsets): the passage vectors of each text, one row a passage."""
    cut = pc.split_pattern_regex(pc.fill_null(column, ""), SPACE)
    n = len(column)
    words = cut.flatten()
    doc = np.repeat(np.arange(n), np.diff(cut.offsets.to_numpy()))
    real = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    words, doc = words.filter(pa.array(real)).dictionary_encode(), doc[real]
    codes = words.indices.to_numpy().astype(np.int64)
    names = as_bytes(words.dictionary)
    n_words = np.bincount(doc, minlength=n)
    first = np.cumsum(n_words) - n_words
    place = np.arange(len(doc)) - first[doc]
    per_doc = np.maximum(1, -(-n_words // PASSAGE))
    offsets = np.concatenate([[0], np.cumsum(per_doc)])
    passage = offsets[doc] + place // PASSAGE
    total = int(offsets[-1])
    x = np.zeros((total, WIDTH), np.float32)
    held = np.bincount(passage, minlength=total)
    scale = 1 / np.maximum(held, 1)
    if len(doc):
        heads = np.flatnonzero(np.diff(passage, prepend=-1))
        shapes = _word_shapes(names)
        x[passage[heads], :SHAPES] = np.add.reduceat(shapes[codes], heads, axis=0)
        pairs = np.unique(passage * len(names) + codes)
        x[:, SHAPES] = np.bincount(pairs // len(names), minlength=total)
        same = (codes[1:] == codes[:-1]) & (passage[1:] == passage[:-1])
        x[:, SHAPES + 1] = np.bincount(passage[1:][same], minlength=total)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, names), np.uint64, len(names))
        windows = shingle_hashes(hashes[codes]) if len(codes) >= 5 else np.zeros(0, np.uint64)
        inside = np.flatnonzero(doc[:len(windows)] == doc[len(doc) - len(windows):])
        order = inside[np.lexsort((inside, windows[inside], doc[inside]))]
        again = (windows[order][1:] == windows[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        x[:, SHAPES + 2] = np.bincount(passage[order[1:][again]], minlength=total)
        bucket = (hashes[codes] % np.uint64(HASHED)).astype(np.int64)
        x[:, SHAPES + 4:] = np.bincount(passage * HASHED + bucket,
                                        minlength=total * HASHED).reshape(total, HASHED)
    x *= scale[:, None].astype(np.float32)
    x[:, SHAPES + 3] = np.minimum(held, PASSAGE) / PASSAGE
    return x, offsets


def _shapes(code: int = CODE, gate: int = GATE) -> list[tuple[str, tuple[int, ...]]]:
    return [("W", (WIDTH, code)), ("e", (code,)), ("V", (code, gate)), ("U", (code, gate)),
            ("w", (gate,)), ("c", (code,)), ("b", (1,))]


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in _shapes():
        size = int(np.prod(shape))
        out[name] = flat[at:at + size].reshape(shape)
        at += size
    return out


def start_weights(seed: int = 4) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.concatenate([(rng.normal(size=shape) / np.sqrt(shape[0] if len(shape) > 1 else 8)
                            * (len(shape) > 1 or name in "wc")).reshape(-1)
                           for name, shape in _shapes()])


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


def forward(p: dict[str, np.ndarray], x: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Scores and what the gradient needs; every bag has a passage."""
    heads, sizes = offsets[:-1], np.diff(offsets)
    h = np.tanh(x @ p["W"] + p["e"])
    t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
    logit = (t * s) @ p["w"]
    a = np.exp(logit - np.repeat(np.maximum.reduceat(logit, heads), sizes))
    a /= np.repeat(np.add.reduceat(a, heads), sizes)
    z = np.add.reduceat(a[:, None] * h, heads, axis=0)
    return {"h": h, "t": t, "s": s, "a": a, "z": z, "score": _sigmoid(z @ p["c"] + p["b"][0])}


def gradient(p: dict[str, np.ndarray], x: np.ndarray, offsets: np.ndarray, y: np.ndarray,
             decay: float = 1e-4) -> np.ndarray:
    f = forward(p, x, offsets)
    heads, sizes = offsets[:-1], np.diff(offsets)
    d = (f["score"] - y) / len(y)
    dz = np.repeat(d[:, None] * p["c"], sizes, axis=0)
    da = (dz * f["h"]).sum(1)
    dl = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, heads), sizes))
    dg = dl[:, None] * p["w"]
    dt, ds = dg * f["s"] * (1 - f["t"] ** 2), dg * f["t"] * f["s"] * (1 - f["s"])
    dh = f["a"][:, None] * dz + dt @ p["V"].T + ds @ p["U"].T
    du = dh * (1 - f["h"] ** 2)
    g = [x.T @ du, du.sum(0), f["h"].T @ dt, f["h"].T @ ds, (f["t"] * f["s"]).T @ dl, f["z"].T @ d,
         np.array([d.sum()])]
    return np.concatenate([v.reshape(-1) for v in g]) + decay * np.concatenate(
        [v.reshape(-1) for v in p.values()])


def _train_here(bags: list[tuple[np.ndarray, float]], flat: np.ndarray, passes: int, seed: int,
                rate: float = 0.01) -> np.ndarray:
    """Adam over this partition's bags from the common weights."""
    flat, m, v = flat.copy(), np.zeros_like(flat), np.zeros_like(flat)
    rng, step = np.random.default_rng(seed), 0
    for _ in range(passes):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            some = [bags[i] for i in order[at:at + BATCH]]
            offsets = np.concatenate([[0], np.cumsum([len(b) for b, _ in some])])
            g = gradient(unpack(flat), np.concatenate([b for b, _ in some]), offsets,
                         np.array([y for _, y in some]))
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            flat -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return flat


class Model:
    """Weights with the scaling of the inputs; ``score`` works on a string column."""

    def __init__(self, flat: np.ndarray | None, mean: np.ndarray, scale: np.ndarray):
        self.flat, self.mean, self.scale = flat, mean, scale

    def score(self, column: pa.Array) -> np.ndarray:
        if self.flat is None:
            return np.full(len(column), 0.5)
        out = [np.zeros(0)]
        for part in by_bytes([pa.record_batch([column], names=["text"])], "text", 4 << 20):
            x, offsets = encode_passages(part.column("text"))
            out.append(forward(unpack(self.flat), (x - self.mean) * self.scale, offsets)["score"])
        return np.concatenate(out)


def held_out(id_col: str = "doc_id") -> Column:
    """Documents no label is learned from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, float]]:
    for batch in batches:
        for x, y in zip(batch.column("x").to_pylist(), batch.column("label").to_pylist(),
                        strict=True):
            yield np.frombuffer(x, np.float32).reshape(-1, WIDTH), y


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS,
        passes: int = PASSES) -> Model:
    """Fit on the labelled documents outside ``held_out`` (at most ``max_labelled``)."""
    sample = (labels.where(F.col(label_col).isin(0, 1) & ~held_out(id_col))
              .groupBy(F.col(id_col).cast("long").alias("_labelled"))
              .agg(F.min(label_col).cast("double").alias("label"))
              .orderBy(F.xxhash64("_labelled"), "_labelled").limit(max_labelled))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"),
                       F.col(text_col).cast("string").alias("text")).join(
        F.broadcast(sample), F.col("_id") == F.col("_labelled"))

    def encode(batches):
        for part in by_bytes(batches, "text"):
            x, at = encode_passages(part.column("text"))
            blobs = [x[b:e].tobytes() for b, e in zip(at[:-1], at[1:], strict=True)]
            yield pa.record_batch([part.column("_id"), part.column("label"),
                                   pa.array(blobs, pa.binary())], names=["id", "label", "x"])

    bags = stage(rows.select("_id", "text", "label").mapInArrow(
        encode, "id long, label double, x binary").repartition(PARTITIONS, "id")
        .sortWithinPartitions("id"), "bags")

    def moments(batches):
        total = np.zeros((3, WIDTH))
        for x, _ in _bags(batches):
            total += np.stack([np.full(WIDTH, len(x)), x.sum(0), (x.astype(np.float64) ** 2).sum(0)])
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["v"])

    sums = sum((np.frombuffer(r.v).reshape(3, WIDTH) for r in
                bags.mapInArrow(moments, "v binary").collect()), np.zeros((3, WIDTH)))
    if not sums[0, 0]:
        return Model(None, np.zeros(WIDTH), np.ones(WIDTH))
    mean = sums[1] / sums[0]
    scale = 1 / np.sqrt(np.maximum(sums[2] / sums[0] - mean ** 2, 1e-6))
    flat = start_weights()
    for number in range(rounds):
        def train(batches, flat=flat, number=number):
            some = [((x - mean) * scale, y) for x, y in _bags(batches)]
            if some:
                yield pa.record_batch([pa.array([len(some)], pa.int64()), pa.array(
                    [_train_here(some, flat, passes, number).tobytes()], pa.binary())],
                    names=["n", "v"])

        got = bags.mapInArrow(train, "n long, v binary").collect()
        flat = sum(r.n * np.frombuffer(r.v) for r in got) / sum(r.n for r in got)
    return Model(flat, mean, scale)


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


def keep_good(docs: DataFrame, model: Model, text_col: str = "text",
              threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that the model scores below the threshold; all columns stay."""
    def run(batches):
        for part in by_bytes(batches, text_col, 4 << 20):
            yield part.filter(pa.array(model.score(part.column(text_col)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
