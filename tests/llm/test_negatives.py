import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm.op13_negatives import Chunk, best_of, hard_negatives, in_windows, limit

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=5, positives=5, negatives=3):
    """All scores in Python integers, no pruning."""
    kept = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        v = [math.floor(256 * float(np.float32(x))) for x in v]
        kept[i] = min(kept.get(i, (label, v)), (label, v))
    most = limit(max([1, *[len(v) for _, v in kept.values()]]))
    kept = {i: (label, [max(-most, min(most, x)) for x in v]) for i, (label, v) in kept.items()}
    out = []
    for a, (label, q) in kept.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v, strict=False)), i, l)
                        for i, (l, v) in kept.items() if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            good = [x for x in scored if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s]
            out += [(a, p, r, x[1], -s, -x[0]) for r, x in enumerate(good[:negatives], 1)]
    return sorted(out)


def mined(spark, rows, every=5, extra=(), **kw):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for name in extra:
        df = df.withColumn(name, F.lit("clash"))
    return sorted(tuple(r) for r in hard_negatives(df, anchor=f"id % {every} = 0", **kw).collect())


def some(n, d, labels=3, seed=1, scale=0.3):
    rng = random.Random(seed)
    centre = [[rng.gauss(0, scale) for _ in range(d)] for _ in range(labels)]
    return [(i, [rng.gauss(c, scale) for c in centre[i % labels]], rng.randrange(labels))
            for i in rng.sample(range(4 * n), n)]


@pytest.mark.parametrize("chunk_rows, block_anchors", [(8192, 1024), (16, 4)])
def test_equal_to_all_scores(shipped, chunk_rows, block_anchors):
    rows = some(160, 12)
    got = mined(shipped, rows, chunk_rows=chunk_rows, block_anchors=block_anchors)
    assert got == brute(rows) and len(got) > 100


def test_options(shipped):
    rows = some(90, 5, seed=4)
    assert mined(shipped, rows, positives=2, negatives=4) == brute(rows, positives=2, negatives=4)


def test_edges(shipped):
    rows = some(60, 6, seed=2)
    rows += [(1000, None, 1), (1005, [0.1] * 6, None), (None, [0.1] * 6, 1),
             (1010, [0.1, None, 0.1, 0.1, 0.1, 0.1], 1), (1015, [float("nan")] * 6, 1),
             (1020, [float("inf")] + [0.1] * 5, 1), (1025, [], 1), (1030, [0.2, 0.3], 2),
             (1035, [0.2] * 9, 1), (-5, [0.25] * 6, 0), (-10, [0.0] * 6, 0)]
    rows += [(2000 + i, [0.3, 0.2, 0.1, 0.3, 0.2, 0.1], i % 2) for i in range(25)]  # ties
    rows += [(3000, [0.3] * 6, 1)] * 3 + [(3001, [0.3] * 6, 1), (3001, [0.2] * 6, 1), (3001, [0.2] * 6, 0)]
    extra = ["id", "v", "chunk", "block", "score", "rank", "anchor_id", "found"]
    assert mined(shipped, rows, extra=extra, chunk_rows=20, block_anchors=6) == brute(rows)


def test_huge_components(shipped):
    rows = [(i, [x * 10.0 ** (i % 9 * 4) for x in v], label) for i, v, label in some(40, 4, seed=7)]
    assert mined(shipped, rows) == brute(rows)


def test_empty_and_lonely(shipped):
    assert mined(shipped, []) == []
    assert mined(shipped, [(0, [0.5, 0.5], 1)]) == []
    assert mined(shipped, [(0, [0.5], 1), (1, [0.5], 2)]) == []  # no positive
    assert mined(shipped, [(0, [0.5], 1), (1, [0.5], 1), (2, [0.4], 2)]) == \
        brute([(0, [0.5], 1), (1, [0.5], 1), (2, [0.4], 2)])


@pytest.mark.parametrize("bits", [7, 11, 20, 30])
def test_bounds_never_lose_a_row(bits):
    """Pruned scans equal full scores in each of the three number types."""
    rng = np.random.default_rng(bits)
    m = rng.integers(-2 ** bits, 2 ** bits, (300, 10))
    m[::3] //= 4
    labels = rng.integers(0, 3, 300)
    c = Chunk(np.arange(300).tobytes(), labels.tobytes(), True, np.ascontiguousarray(m.T).tobytes())
    for a in range(0, 300, 17):
        scores = [sum(int(x) * int(y) for x, y in zip(m[a], r, strict=True)) for r in m]
        same = sorted((-scores[i], i) for i in range(300) if labels[i] == labels[a] and i != a)[:5]
        ids, got = best_of(c, a, labels[a], m[a], 5)
        assert [(-s, i) for i, s in zip(ids.tolist(), got.tolist(), strict=True)] == same
        lows, highs = [-s // 2 for s, _ in same], [-s * 95 // 100 for s, _ in same]
        for low, high, (ids, got) in zip(lows, highs, in_windows(c, labels[a], m[a], lows, highs, 3),
                                         strict=True):
            good = sorted((-scores[i], i) for i in range(300)
                          if labels[i] != labels[a] and low <= scores[i] <= high)[:3]
            assert [(-s, i) for i, s in zip(ids.tolist(), got.tolist(), strict=True)] == good


def test_candidates_shrink_before_the_last_dimension():
    rng = np.random.default_rng(1)
    m = rng.integers(-8, 8, (500, 64))
    m[:5, :4] = 1000
    seen = []
    c = Chunk(np.arange(500).tobytes(), np.zeros(500, np.int64).tobytes(), True,
              np.ascontiguousarray(m.T).tobytes())

    def shrink(lower, upper):
        seen.append(len(lower))
        return upper >= np.partition(lower, -3)[-3]

    c.scan(m[0], np.arange(500), shrink, 4)
    assert seen[0] == 500 and seen[1] == 5  # the anchor's largest components come first
