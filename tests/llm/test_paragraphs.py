import random

from cohortlens.llm.op10_paragraphs import (jaccard, remove_paragraphs, removals, shingle_set,
                                            tune_bands)
from tests.llm.conftest import edge_rows


def eligible(text, least):
    out, at = [], 0
    for i, line in enumerate((text or "").split("\n")):
        if len(line.encode().lower().split()) >= least:
            out.append((i, at, at + len(line), line))
        at += len(line) + 1
    return out


def shingles(line):
    w = line.encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}


def brute(rows, least=30, threshold=0.8):
    """{doc_id: (removed spans, first documents)} by comparing all pairs of paragraphs."""
    occ = sorted({(d, i, s, e, line) for d, t in rows if d is not None
                  for i, s, e, line in eligible(t, least)})
    sets = [shingles(o[4]) for o in occ]
    group = list(range(len(occ)))
    for i in range(len(occ)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if inter and inter / (len(sets[i]) + len(sets[j]) - inter) >= threshold \
                    and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    out = {}
    for i, (d, _, s, e, _) in enumerate(occ):
        members = [j for j in range(len(occ)) if group[j] == group[i]]
        if len(members) > 1:
            spans, firsts = out.setdefault(d, (set(), set()))
            first = occ[min(members)]
            firsts.add(first[0])
            if occ[i][:2] != first[:2]:
                spans.add((s, e))
    return {d: (sorted(s), sorted(f)) for d, (s, f) in out.items()}


def got(df):
    return {r.doc_id: ([(x.start, x.end) for x in r.removed], list(r.repeats_of))
            for r in df.collect() if r.repeats_of}


def corpus(words):
    rng = random.Random(4)
    rows = []
    for d in range(120):
        lines = [words(d * 10 + k, rng.randint(5, 60)) for k in range(rng.randint(1, 5))]
        for _ in range(rng.randint(0, 2)):  # a passage of a small pool, often edited a little
            w = words(90_000 + rng.randrange(6), 60).split()
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = f"é{rng.randrange(50)}"
            lines.insert(rng.randint(0, len(lines)), " ".join(w).title() if d % 2 else " ".join(w))
        rows.append((d * 13 % 127, "\n".join(lines)))
    return rows


def test_against_all_pairs(make_docs, words):
    rows = corpus(words)
    want = brute(rows)
    assert len(want) > 40
    assert got(removals(make_docs(rows), block=8)) == want  # small blocks: many block pairs


def test_edges_and_clashing_columns(make_docs, words):
    rows = edge_rows(words) + [(300, words(2, 40) + "\n" + words(2, 40))]
    df = removals(make_docs(rows, extra=["key", "bands", "removed", "idx"]))
    assert df.count() == len(rows)
    assert got(df) == brute(rows)


def test_cut_texts(make_docs, words):
    rows = [(1, "head\n" + words(1, 50) + "\ntail"), (2, words(1, 50) + "\nother"), (3, None)]
    cut = {r.doc_id: (r.text, r.source) for r in
           remove_paragraphs(make_docs(rows, extra=["_x"])).collect()}
    assert cut == {1: (rows[0][1], "s"), 2: ("other", "s"), 3: (None, "s")}


def test_one_hot_bucket_in_several_components(make_docs, words):
    """Many distinct copies of one passage and outsiders that collide with it."""
    rng = random.Random(8)
    base, rows = words(5, 60).split(), []
    for d in range(150):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 6, 8])):
            w[rng.randrange(60)] = f"q{rng.randrange(10_000)}"
        rows.append((d, " ".join(w)))
    assert got(removals(make_docs(rows), block=16)) == brute(rows)


def test_members_of_an_open_bucket_are_sent_once(shipped):
    """A group four times as large takes four times the rows; in blocks every pair still meets."""
    from cohortlens.llm.op10_paragraphs import _dealt
    for n in (300, 1200):
        rows = [(7, i, 400, i) for i in range(n)] + [(8, i, 400, 1) for i in range(9)]
        placed = shipped.createDataFrame(rows, "bucket long, node long, chars long, component long")
        assert _dealt(placed).count() == n  # bucket 8 is one component already
    placed = placed.where("node < 60").withColumn("chars", placed["chars"] * 1000)  # more than one block
    for dealt in (_dealt(placed), _dealt(placed, 8)):
        met = {}
        for r in dealt.collect():
            met.setdefault((r.lower, r.upper), []).append((r.node, r.chunk))
        assert len(met) > 1
        assert {(a, b) for (low, up), m in met.items() for a, x in m for b, y in m
                if a < b and (low == up or x != y)} == {(a, b) for b in range(60) for a in range(b)}


def test_links_of_several_blocks_at_once():
    """Linked members of each block are joined by links that reach the threshold, and no others."""
    import numpy as np
    from cohortlens.llm.op10_paragraphs import _links_in_blocks
    rng, texts, group, chunk = random.Random(2), [], [], []
    for g in range(6):
        base = [f"b{rng.randrange(999)}" for _ in range(60)]
        for _ in range([1, 2, 40, 3, 90, 30][g]):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 9])):
                w[rng.randrange(60)] = f"q{rng.randrange(50)}"
            texts.append(" ".join(w).encode())
            group.append(g)
            chunk.append(rng.randrange(2) if g == 5 else 0)  # the last compares two blocks
    n = len(texts)
    sets = [shingle_set(t) for t in texts]

    def classes(pairs):
        label = list(range(n))
        for a, b in pairs:
            if label[a] != label[b]:
                label = [label[b] if x == label[a] else x for x in label]
        return {frozenset(i for i in range(n) if label[i] == x) for x in label}

    want = [(i, j) for j in range(n) for i in range(j) if group[i] == group[j] and jaccard(sets[i], sets[j]) >= 0.8
            and (group[i] != 5 or chunk[i] != chunk[j])]
    links = _links_in_blocks(np.array(group), np.arange(n), np.arange(n), np.array(chunk), texts, 0.8)
    assert {tuple(sorted(x)) for x in links} <= set(want)
    assert classes(links) == classes(want) and any(len(c) > 5 for c in classes(want))


def test_bands_reach_the_recall():
    for threshold in (0.7, 0.8, 0.9):
        bands, rows = tune_bands(threshold, 0.999)
        assert 1 - (1 - threshold ** rows) ** bands >= 0.999
    assert jaccard(shingle_set(b"a b c d e f"), shingle_set(b"A B C D E F")) == 1


def test_empty_table(make_docs):
    assert removals(make_docs([])).collect() == []


def test_rows_that_share_an_id_keep_their_own_texts(make_docs, words):
    """Two texts under one id: near copies of both are found, each by its own paragraph."""
    one, two = words(71, 100), words(72, 100)
    near = [" ".join("x" if i == 50 else w for i, w in enumerate(t.split())) for t in (one, two)]
    rows = [(1, one), (1, two), (1, two), (2, near[0]), (3, near[1]), (4, words(73, 100))]
    got = {r.doc_id: r.n_removed for r in removals(make_docs(rows)).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 0}
