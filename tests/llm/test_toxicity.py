import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from cohortlens.llm import op12_toxicity as op
from cohortlens.llm.op12_toxicity import BITS, ORDERS, fit, mark_buckets, score_documents
from tests.conftest import SF_ORACLE
from tests.llm.conftest import edge_rows

LABELS = "doc_id long, quality int, toxic int"


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def plain_buckets(text):
    """The buckets of a text, n-gram by n-gram in Python integers."""
    chars = [32 if 9 <= ord(c) <= 13 else ord(c) for c in f" {(text or '').lower()} "]
    out = set()
    for n in ORDERS:
        for at in range(len(chars) - n + 1):
            h = chars[at]
            for c in chars[at + 1:at + n]:
                h = (h * 0x01000193 + c) % 2 ** 32
            out.add((h * 0x9E3779B1 + n) % 2 ** 32 >> (32 - BITS))
    return out


def marked(text):
    seen = np.zeros(1 << BITS, bool)
    mark_buckets(text, seen)
    return set(np.flatnonzero(seen).tolist())


def planted(n, seed=3):
    """Prose of 20 invented words; a quarter of the documents hold one of two insults."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice("alum bero cita dorn elka fuma gres holt inca jura".split())
                 + rng.choice(["", "n", "ta"]) for _ in range(rng.randrange(5, 60))]
        toxic = i % 4 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["grobik", "Zwopfel"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


@pytest.mark.parametrize("text", [None, "", "a", "ab c", "Éa\tß\n\n漢字 x", "x" * 50])
def test_buckets_equal_plain_python(text):
    assert marked(text) == plain_buckets(text)


def test_pieces_of_a_long_text_lose_no_ngram(monkeypatch):
    text = "".join(random.Random(1).choice("abcdefg é") for _ in range(3_000))
    whole = marked(text)
    monkeypatch.setattr(op, "PIECE", 64)
    assert marked(text) == whole == plain_buckets(text)


def test_scores_equal_a_plain_model(shipped, make_docs):
    """Counts, ratios and scores again with dictionaries, from the fitted weights."""
    rows, labels = planted(120)
    model = fit(make_docs(rows), shipped.createDataFrame(labels, LABELS))
    learned = [(set(plain_buckets(t)), y) for (i, t), (_, _, y) in zip(rows, labels, strict=True)
               if not held(i)]
    n_toxic = sum(y for _, y in learned)
    n_other, share = len(learned) - n_toxic, n_toxic / len(learned)
    ratio = {}
    for b in set().union(*[s for s, _ in learned]):
        p, q = (sum(b in s for s, y in learned if y == k) for k in (1, 0))
        r = (math.log((p + op.SMOOTH * share) / (n_toxic + op.SMOOTH))
             - math.log((q + op.SMOOTH * (1 - share)) / (n_other + op.SMOOTH)))
        if p + q >= op.MIN_DOCS and abs(r) >= op.MIN_RATIO:
            ratio[b] = r
    assert set(model.buckets.tolist()) == set(ratio)
    weight = dict(zip(model.buckets.tolist(), model.weights.tolist(), strict=True))
    got = {r.doc_id: r.score for r in score_documents(make_docs(rows), model).collect()}
    for i, text in rows:
        z = sum(weight[b] for b in plain_buckets(text) if b in weight) + model.intercept
        assert abs(got[i] - 1 / (1 + math.exp(-z))) < 1e-9
    # the fit is a minimum: along every coordinate tried, the loss rises
    x = {b: [float(b in s) * ratio[b] for s, _ in learned] for b in list(ratio)[:20]}
    z = np.array([sum(weight[b] for b in s if b in weight) + model.intercept for s, _ in learned])
    y = np.array([y for _, y in learned])
    w = np.where(y == 1, op.TOXIC_WEIGHT, 1.0)
    slope = w * (1 / (1 + np.exp(-z)) - y) / w.sum()
    assert abs(slope.sum()) < 1e-3
    for b, column in x.items():
        assert abs(slope @ np.array(column) + op.PENALTY * weight[b] / ratio[b]) < 1e-3


def test_planted_insults_are_found_and_clean_texts_left_alone(shipped, make_docs):
    rows, labels = planted(400)
    docs = make_docs(rows)
    got = {r.doc_id: r for r in
           score_documents(docs, fit(docs, shipped.createDataFrame(labels, LABELS))).collect()}
    unseen = [(got[i].predicted, y) for i, _, y in labels if held(i)]
    assert len(unseen) > 60 and all(p == y for p, y in unseen)


def test_held_out_documents(shipped):
    docs = shipped.read.parquet(f"{SF_ORACLE}/documents.parquet")
    labels = shipped.read.parquet(f"{SF_ORACLE}/labels.parquet")
    got = {r.doc_id: r.predicted for r in score_documents(docs, fit(docs, labels)).collect()}
    rows = [(got[r.doc_id], r.toxic) for r in labels.collect() if held(r.doc_id)]
    assert len(got) == docs.count()
    assert np.mean([p == 0 for p, y in rows if y == 0]) > 0.97  # 37 toxic texts to learn from
    assert np.mean([p for p, y in rows if y == 1]) > 0.5


def test_labels_of_held_out_rows_teach_nothing(shipped, make_docs):
    rows, labels = planted(120)
    turned = [(i, q, 1 - y if held(i) else y) for i, q, y in labels]
    a, b = (fit(make_docs(rows), shipped.createDataFrame(x, LABELS)) for x in (labels, turned))
    assert a.buckets.tolist() == b.buckets.tolist() and np.allclose(a.weights, b.weights, atol=1e-6)


def test_edges(shipped, make_docs, words):
    rows = edge_rows(words)
    docs = make_docs(rows, extra=["x", "y", "w", "label", "score", "toxic", "bucket"])
    labels = [(i, 1, i % 2) for i in range(13)] + [(3, 1, None), (None, 1, 0), (4, 1, 7), (999, 1, 1)]
    model = fit(docs, shipped.createDataFrame(labels, LABELS))
    got = score_documents(docs, model).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert len({r.score for r in got if r.doc_id == 9}) == 1


@pytest.mark.parametrize("labels, score", [([], 0.5), ([(1, 1, 1)], 1.0), ([(1, 1, 0)], 0.0)])
def test_nothing_to_tell_apart(shipped, make_docs, labels, score):
    given = shipped.createDataFrame(labels, LABELS)
    assert not held(1)
    assert score_documents(make_docs([]), fit(make_docs([]), given)).collect() == []
    docs = make_docs([(1, "a b c"), (2, None)])
    assert {r.score for r in score_documents(docs, fit(docs, given)).collect()} == {score}


def test_score_of_null_and_empty_column():
    model = op.Model(np.array([3]), np.array([1.0]), 0.0)
    assert len(model.score(pa.array([None, ""], pa.string()))) == 2
