import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from cohortlens.llm.op9_packing import OpenCapacities, best_fit_plan, pack, pack_documents
from tests.llm.conftest import edge_rows


def brute_best_fit(lengths, capacity):
    """Best-fit decreasing one by one; returns the remaining capacities, sorted."""
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= n]
        if fits:
            best = min(fits, key=lambda i: room[i])
            room[best] -= n
        else:
            room.append(capacity - n)
    return sorted(room)


def rooms(plan, capacity):
    used, spans = defaultdict(int), defaultdict(list)
    for length, _, pieces, per_bin, first, offset in plan.tolist():
        for k in range(pieces):
            b, o = first + k // per_bin, offset + k % per_bin * length
            used[b] += length
            spans[b].append((o, o + length))
    for s in spans.values():  # gapless from 0
        s.sort()
        assert s[0][0] == 0 and all(a[1] == b[0] for a, b in zip(s, s[1:], strict=False))
    return sorted(capacity - u for u in used.values())


def test_plan_equals_one_by_one_placement():
    rng = random.Random(1)
    for trial in range(60):
        capacity = rng.choice([7, 16, 50, 128])
        top = rng.choice([capacity, max(1, capacity // 3), max(1, capacity // 9)])
        lengths = [rng.randint(1, top) for _ in range(rng.randint(0, 400))]
        counts = defaultdict(int)
        for n in lengths:
            counts[n] += 1
        plan = best_fit_plan(counts, capacity)
        assert rooms(plan, capacity) == brute_best_fit(lengths, capacity), trial
        assert len(plan) <= 3 * capacity * (2 * capacity) ** 0.5


def test_tree_finds_the_tightest():
    rng = random.Random(2)
    tree, open_ = OpenCapacities(100), set()
    for _ in range(500):
        c = rng.randint(0, 100)
        (open_.add if rng.random() < .5 else open_.discard)(c)
        tree.set(c, c in open_)
        n = rng.randint(1, 100)
        assert tree.tightest(n) == min((x for x in open_ if x >= n), default=-1)


def test_documents(make_docs, words, vocabulary):
    rows = [(3000, "a <|endoftext|> b"), (3001, "<|startoftext|>")] + edge_rows(words) + [(50 + i, words(i, i % 90)) for i in range(300)]
    path = f"{vocabulary}/word_bpe_49k.json"
    got = pack_documents(make_docs(rows, extra=["length", "sequence_id", "_rank", "ids"]), path).collect()
    code = Tokenizer.from_file(path)
    want = []
    for i, t in rows:
        ids = np.array([*code.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for p, at in enumerate(range(0, len(ids), 2048)):
            piece = ids[at:at + 2048].tobytes()
            want.append((i, p, at, len(piece) // 4, zlib.crc32(piece), piece))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in got),
                  key=str) == sorted(want, key=str)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for s in bins.values():
        s.sort()
        assert s[0][0] == 0 and sum(n for _, n in s) <= 2048
        assert all(a + n == b for (a, n), (b, _) in zip(s, s[1:], strict=False))
    assert len(bins) == len(brute_best_fit([w[3] for w in want], 2048))


def test_hot_length_over_many_partitions(shipped):
    df = shipped.range(0, 5000, 1, 40).selectExpr(
        "id as doc_id", "cast(if(id % 3 = 0, 700, 1 + id % 11) as long) as length")
    got = pack(df, 2048).collect()
    places = {(r.sequence_id, r.offset) for r in got}
    assert len(places) == len(got) == 5000
    assert len({r.sequence_id for r in got}) == len(brute_best_fit([r.length for r in got], 2048))


def test_empty_table(make_docs, vocabulary):
    assert pack_documents(make_docs([]), f"{vocabulary}/word_bpe_49k.json").collect() == []
