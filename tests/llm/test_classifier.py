import zlib

import numpy as np
import pyarrow as pa

from cohortlens.llm.op4_classifier import (PASSAGE, encode_passages, fit, forward, gradient,
                                           held_out, keep_good, score_documents, start_weights,
                                           unpack)
from tests.conftest import SF_ORACLE
from tests.llm.conftest import edge_rows

LABELS = "doc_id long, quality int, toxic int"


def test_gradient_is_the_derivative():
    rng = np.random.default_rng(1)
    texts = pa.array(["a b " * 300, "One!", "", "x " * 200 + "Y, z"], pa.string())
    x, at = encode_passages(texts)
    y, flat = np.array([1.0, 0, 1, 0]), start_weights()

    def loss(w):
        p = unpack(w)
        s = np.clip(forward(p, x, at)["score"], 1e-12, 1 - 1e-12)
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean() + 0.5e-4 * (w ** 2).sum()

    g = gradient(unpack(flat), x, at, y)
    for i in rng.choice(len(flat), 40, replace=False):
        step = np.zeros_like(flat)
        step[i] = 1e-5
        assert abs((loss(flat + step) - loss(flat - step)) / 2e-5 - g[i]) < 1e-6


def test_every_passage_is_encoded_and_weights_sum_to_one(words):
    texts = [words(1, n) for n in (0, 1, PASSAGE, PASSAGE + 1, 10 * PASSAGE)]
    x, at = encode_passages(pa.array([*texts, None], pa.string()))
    assert np.diff(at).tolist() == [1, 1, 1, 2, 10, 1]
    a = forward(unpack(start_weights()), x, at)["a"]
    assert np.allclose(np.add.reduceat(a, at[:-1]), 1)
    alone = [encode_passages(pa.array([t], pa.string()))[0] for t in texts]  # rows don't mix
    assert np.allclose(np.concatenate(alone), x[:at[-2]], atol=1e-6)


def test_held_out_accuracy(shipped):
    docs = shipped.read.parquet(f"{SF_ORACLE}/documents.parquet")
    labels = shipped.read.parquet(f"{SF_ORACLE}/labels.parquet")
    scored = score_documents(docs, fit(docs, labels))
    rows = scored.join(labels, "doc_id").where(held_out()).collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert scored.count() == docs.count()


def test_labels_of_held_out_rows_teach_nothing(shipped, make_docs, words):
    rows = [(i, words(i, 20)) for i in range(200)]
    docs = make_docs(rows)
    labels = shipped.createDataFrame([(i, i % 2, 0) for i in range(200)], LABELS)
    turned = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, "
                               "1 - quality, quality) as quality", "toxic")
    a, b = fit(docs, labels, rounds=1), fit(docs, turned, rounds=1)
    assert np.allclose(a.flat, b.flat)


def test_edges(shipped, make_docs, words):
    rows = edge_rows(words)
    docs = make_docs(rows, extra=["x", "label", "score", "quality"])
    labels = shipped.createDataFrame([(i, i % 2, 0) for i in range(13)] + [(3, None, 0), (None, 1, 0),
                                     (4, 7, 0), (5, 1, 1), (999, 1, 0)], LABELS)
    model = fit(docs, labels, rounds=1)
    got = score_documents(docs, model).collect()
    assert sorted((str(r.doc_id) for r in got)) == sorted(str(i) for i, _ in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    kept = keep_good(docs, model)
    assert kept.columns == docs.columns
    good = sorted((str(r.doc_id) for r in got if r.score >= 0.7))
    assert sorted(str(r.doc_id) for r in kept.collect()) == good


def test_nothing_to_learn_from(shipped, make_docs):
    none = shipped.createDataFrame([], LABELS)
    assert score_documents(make_docs([]), fit(make_docs([]), none)).collect() == []
    got = score_documents(make_docs([(1, "a")]), fit(make_docs([(1, "a")]), none)).collect()
    assert [(r.score, r.predicted) for r in got] == [(0.5, 0)]
