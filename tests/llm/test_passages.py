"""Passages that are no lines of their own: inside long lines, or over several short ones."""
import random

import numpy as np

from cohortlens.llm.op10_paragraphs import cut_places, remove_paragraphs, removals, winnow


def split_lines(text, at):
    w = text.split()
    return "\n".join(" ".join(w[i:i + at]) for i in range(0, len(w), at))


def removed_words(rows, found):
    """{doc_id: places of the words that lie in removed spans}."""
    out = {}
    for d, text in rows:
        at, places = 0, set()
        for i, w in enumerate(text.split()):
            at = text.index(w, at)
            if any(s <= at and at + len(w) <= e for s, e in found.get(d, ())):
                places.add(i)
            at += len(w)
        out[d] = places
    return out


def spans(df):
    return {r.doc_id: [(x.start, x.end) for x in r.removed] for r in df.collect()}


def test_inside_long_lines_and_over_short_lines(make_docs, words):
    run = words(1, 200, 5000)
    rows = [(1, f"{words(2, 300, 5000)} {run} {words(3, 200, 5000)}"),
            (2, f"é {words(4, 150, 5000)} {run.upper()} {words(5, 90, 5000)}"),  # inside one line
            (3, f"{words(6, 20, 5000)}\n{split_lines(run, 9)}\n{words(7, 8, 5000)}"),  # short lines
            (4, f"{words(8, 20, 5000)} {split_lines(run, 70)} {words(9, 90, 5000)}"),  # mixed
            (5, words(10, 300, 5000)), (None, run), (6, None), (7, "")]
    docs = make_docs(rows, extra=["_x"])
    got = spans(removals(docs, passages=True))
    assert not got[1] and not got[5] and not got[6] and not got[7]
    cut = removed_words([r for r in rows if r[0] and r[1]], got)
    for d, begin in ((2, 151), (3, 20), (4, 20)):
        inside = cut[d] & set(range(begin, begin + 200))
        assert cut[d] == inside and len(inside) >= 200 - 40
    old = spans(removals(docs))
    assert not old[2] and not old[3]  # what lines alone miss
    texts = {r.doc_id: r.text for r in remove_paragraphs(docs, passages=True).collect()}
    for d, text in rows:
        want, at = "", 0
        for s, e in got.get(d, ()) if d is not None else ():
            want, at = want + text[at:s], e
        assert texts[d] == (text if text is None else want + text[at:])


def test_every_50_word_run_is_found(make_docs, words):
    """Recall against a brute-force count of 50-word windows is 1."""
    rng = random.Random(3)
    pool = [words(900 + i, 50, 9000) for i in range(40)]
    rows = []
    for d in range(150):
        parts = [words(d, rng.randint(0, 120), 9000), rng.choice(pool), words(500 + d, 40, 9000)]
        rows.append((d, split_lines(" ".join(parts), rng.choice([7, 25, 40, 1000]))))
    seen, holding = {}, set()
    for d, text in rows:
        w = text.split()
        for i in range(len(w) - 49):
            if seen.setdefault(tuple(w[i:i + 50]), d) != d:
                holding.add(d)
    got = spans(removals(make_docs(rows), passages=True))
    assert len(holding) > 80 and all(got[d] for d in holding)


def test_near_copy_inside_long_lines(make_docs, words):
    """One word in 58 is changed: copies that no line shows."""
    run = words(1, 600, 5000).split()
    near = [f"x{i}" if i % 58 == 7 else w for i, w in enumerate(run)]
    rows = [(1, f"{words(2, 100, 5000)} {' '.join(run)} {words(3, 100, 5000)}"),
            (2, f"{words(4, 77, 5000)} {' '.join(near)} {words(5, 50, 5000)}")]
    assert spans(removals(make_docs(rows), passages=True))[2]


def test_places_of_several_texts_at_once():
    """Windows and cuts of a batch are those of each text alone, ties and short texts too."""
    rng = np.random.default_rng(5)
    for values in (3, 40, 1 << 60):
        sizes = rng.integers(0, 150, 60)
        texts = [rng.integers(1, values, n).astype(np.uint64) for n in sizes]
        order, begins = np.concatenate(texts), np.cumsum(sizes) - sizes
        place = np.concatenate([np.arange(n) for n in sizes])
        left = np.concatenate([np.arange(n, 0, -1) for n in sizes])
        windows, cuts = set(), set()
        for t, b in zip(texts, begins, strict=True):
            width = min(21, len(t))
            for i in range(len(t) - width + 1 if len(t) else 0):
                windows.add(b + max(range(i, i + width), key=lambda p, t=t: (-int(t[p]), p)))
            cuts |= {b + p for p in range(32, len(t) - 32) if t[p] == t[p - 32:p + 33].min()}
        assert winnow(order, place, left).tolist() == sorted(windows)
        assert cut_places(order, place, left).tolist() == sorted(cuts)
