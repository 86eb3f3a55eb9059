import hashlib
from collections import defaultdict

import pytest

from cohortlens.llm.op5_exact import exact_groups
from tests.llm.conftest import edge_rows


def norm(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    out = []
    for i, t in rows:
        g = groups[norm(t)]
        keep = max((x for x in g if x is not None), default=None)
        out.append((i, keep, len(g), i == keep))
    return sorted(out, key=str)


@pytest.mark.parametrize("everything", [True, False])
def test_edges(make_docs, words, everything):
    rows = edge_rows(words) + [(100 + i, "Same " + "text " * 100 + str(i % 3)) for i in range(40)]
    rows += [(200, "p" * 300 + "x"), (201, "p" * 300 + "y"), (202, "P" * 300 + "Y")]
    got = exact_groups(make_docs(rows, extra=["prefix", "full", "n_bytes"]),
                       hash_all=everything).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got), key=str) == brute(rows)
    digests = {hashlib.sha256(norm(t).encode()).digest() for _, t in rows}
    assert {bytes(r.full) for r in got if r.full is not None} <= digests
    if everything:
        assert {bytes(r.full) for r in got} == digests
    else:  # unique lengths and prefixes were never read in full
        assert any(r.full is None for r in got)


def test_empty_table(make_docs):
    assert exact_groups(make_docs([])).collect() == []
