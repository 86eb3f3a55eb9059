import random

import xxhash

from cohortlens.llm.op1_simhash import fingerprint, links, simhash_groups
from tests.llm.conftest import edge_rows


def brute_fingerprint(text, k=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    w = [x for x in text.split(" ") if x]
    if not w:
        return 0
    shingles = [" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, bits):
    """prints: [(id, fingerprint)]; ids may be null, a null names nothing."""
    group = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= bits and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    return [min((prints[j][0] for j in range(len(prints))
                 if group[j] == group[i] and prints[j][0] is not None), default=None)
            for i in range(len(prints))]


def check(df, rows, bits=2):
    got = sorted(((r.doc_id, r.fp & (2 ** 64 - 1), r.component_id) for r in df.collect()), key=str)
    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    want = [(i, f, c) for (i, f), c in zip(prints, brute_components(prints, bits), strict=True)]
    assert got == sorted(want, key=str)


def test_edges_and_clashing_columns(make_docs, words):
    rows = edge_rows(words)
    check(simhash_groups(make_docs(rows, extra=["fp", "component_id", "id"])), rows)


def test_near_copies_with_chains(make_docs, words):
    rng = random.Random(5)
    rows, number = [], 0
    for family in range(12):
        base = words(family, 150).split()
        for _ in range(15):
            w = list(base)
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(1000)}"
            rows.append((number * 7 % 1009, " ".join(w)))
            number += 1
    check(simhash_groups(make_docs(rows)), rows)


def test_every_link_is_found(shipped):
    """Dense balls of fingerprints, all distances, against all pairs."""
    rng = random.Random(3)
    prints = set()
    for _ in range(4):
        centre = rng.getrandbits(64)
        prints |= {centre} | {centre ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64)
                              for _ in range(120)}
    prints = sorted(prints)
    signed = [(p - 2 ** 64 if p >> 63 else p, i) for i, p in enumerate(prints)]
    got = links(shipped.createDataFrame(signed, "fp long, id long").repartition(4)).collect()
    found = sorted((min(r.a, r.b), max(r.a, r.b)) for r in got)
    want = [(j, i) for i in range(len(prints)) for j in range(i)
            if (prints[i] ^ prints[j]).bit_count() <= 2]
    assert found == sorted(want)  # every link once, and no other
    assert all(r.shared_bytes >= 6 for r in got)


def test_empty_table(make_docs):
    assert simhash_groups(make_docs([])).collect() == []


def test_long_text_is_read_whole(words):
    text = words(9, 70_000)
    assert fingerprint(text.encode()) == brute_fingerprint(text)
