import hashlib
import math
import re
from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortlens.llm.op3_pii import (CONTEXT, GENERALISE, REMOVE, SUPPORT, find_spans, sanitise,
                                    spans_text)
from tests.llm.conftest import edge_rows

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute_base(text):
    out = []
    for number, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": lambda: True, "ip": lambda m=m: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda d=digits: 14 <= len(d) <= 19 and luhn(d),
                    "phone": lambda d=digits: 10 <= len(d) <= 15}[kind]():
                out.append((m.start(), number, m.end(), kind, m[0]))
    return sorted(out)


ODD = [
    "mail a.b+c@x-y.example.org, then a@b.c_d@e.f and .@-.-", "a@b a@b. a@b.c. x@y.z@w.v.u",
    "1.2.3.4 256.1.1.1 0001.002.03.4 1.2.3 1.2.3.4.5.6.7.8 999.1.2.3.4 00000255.0.0.1",
    "4111 1111 1111 1111, 4111-1111-1111-1112 4111111111111111 1 2 3 5500005555555559",
    "+1 (499) 555-6503 +44 20 7946 0958. +12 +1--------------2 ++1 555 123 4567 +1 555 123 45 67 890 12",
    "49927398716 4992739871600 79927398713 378282246310005 6304 0000 0000 0000 000",
    "ü+1 (415) 555-2671é 日本 x@例.com ab@例.jp.com q@r.s", "a" * 300 + "@" + "b" * 300 + ".c",
    "1" * 4000, "1 " * 3000, ("1" * 40 + ".") * 50, "+1" + " " * 500 + "2", "@" * 200, "%" * 500,
    "9.9.9.9-1234567890123456 +1.2.3.4.5.6.7.8.9.10", "a@b.c" * 50,
]


def test_base_spans(make_docs, words):
    rows = edge_rows(words) + [(100 + i, t) for i, t in enumerate(ODD)] + [(200, " ".join(ODD) * 3)]
    found = find_spans(make_docs(rows, extra=["base", "spans", "version", "kind"]))
    got = found.select("doc_id", "base", spans_text(F.col("base")).alias("s"),
                       F.sha2(spans_text(F.col("base")), 256).alias("h")).collect()
    want = [(i, brute_base(t)) for i, t in rows]
    assert sorted(((r.doc_id, [tuple(x) for x in r.base]) for r in got), key=str) == sorted(
        want, key=str)
    for r in got:
        joined = ",".join(f"{k}:{s}:{e}" for s, _, e, k, _ in r.base)
        assert r.s == joined and r.h == hashlib.sha256(joined.encode()).hexdigest()


@pytest.mark.parametrize("alphabet", ["a.@_-", "19.", "1 -4", "+1 ().-2", "a1@.+- é"])
def test_base_on_random_texts(shipped, make_docs, alphabet):
    @settings(max_examples=1, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(st.text(alphabet=alphabet, max_size=60), min_size=300, max_size=300))
    def run(texts):
        rows = list(enumerate(texts))
        got = find_spans(make_docs(rows)).select("doc_id", "base").collect()
        assert {r.doc_id: [tuple(x) for x in r.base] for r in got} == {
            i: brute_base(t) for i, t in rows}
    run()


def brute_spans(rows):
    """Base and added spans of every distinct (id, text), by counting over all documents."""
    docs = {(i, t or "") for i, t in rows}
    total = len(rows)
    base = {d: brute_base(d[1]) for d in docs}
    near = defaultdict(set)
    holds = defaultdict(set)
    for d, spans in base.items():
        text = d[1]
        for start, _, end, kind, value in spans:
            entity = f"{kind}:{value.lower()}"
            holds[entity].add(d)
            same = [m.span() for m in re.finditer(PLAIN[kind], text)]
            left = max([e for s, e in same if e <= start], default=0)
            right = min([s for s, e in same if s >= end], default=len(text))
            before, after = text[left:start], text[end:right]
            if len(before) > CONTEXT:
                before = re.sub(r"^[^\x20\x09-\x0D]*", "", before[-CONTEXT - 1:])
            if len(after) > CONTEXT:
                after = re.sub(r"[^\x20\x09-\x0D]*$", "", after[:CONTEXT + 1])
            for part, shift in ((before, start - len(before)), (after, end)):
                for m in re.finditer(r"[^\W_]{3,}", part):
                    near[entity, m[0].lower()].add((d, m.start() + shift, m.end() + shift, m[0]))
    has = defaultdict(int)
    for _, t in rows:
        for w in {m.lower() for m in re.findall(r"[^\W_]{3,}", t or "")}:
            has[w] += 1
    out = {d: list(spans) for d, spans in base.items()}
    added = defaultdict(set)
    for (entity, term), places in near.items():
        n_te, n_e = len({p[0] for p in places}), len(holds[entity])
        if n_te < SUPPORT or n_e == total:
            continue
        level = math.log2(n_te * total / (has[term] * n_e)) / math.log2(total / n_e)
        if level >= GENERALISE - 1e-12:
            kind = (5, "remove") if level >= REMOVE - 1e-12 else (4, "general")
            for d, s, e, w in places:
                if not any(s < b[2] and b[0] < e for b in base[d]):
                    added[d].add((s, kind[0], e, kind[1], w))
    return {d: sorted([*spans, *added[d]]) for d, spans in out.items()}


def disclosing_corpus(words):
    rows = [(i, words(i, 30)) for i in range(60)]
    for i in range(8):  # "clinic Marlowe" gives the address away, "today" is everywhere
        rows.append((100 + i, f"{words(i, 6)} clinic Marlowe today ann.lee@example.org visit {i} "
                              f"{words(i + 50, 5)}"))
    rows += [(200 + i, f"today {words(i, 9)} clinic opens") for i in range(3)]
    rows += [(300 + i, f"today call +1 (415) 555-26{i:02d} {words(i, 4)}") for i in range(20)]
    return rows


def test_disclosing_terms(make_docs, words):
    rows = disclosing_corpus(words) + edge_rows(words)
    want = brute_spans(rows)
    got = find_spans(make_docs(rows)).collect()
    texts = defaultdict(list)
    for d, spans in want.items():
        texts[d[0]].append(spans)
    for r in got:
        assert [tuple(x) for x in r.spans] in texts[r.doc_id]
    kinds = {(x.kind, x.value) for r in got for x in r.spans}
    assert ("remove", "Marlowe") in kinds and not any(v == "today" for _, v in kinds)
    assert any(v == "clinic" and k == "general" for k, v in kinds)


def brute_clean(text, spans):
    merged = []
    for start, _, end, kind, value in spans:
        label = {"remove": "", "general": "[NUMBER]" if value.isnumeric() else "[NAME]"
                 if value[0].isupper() else "[WORD]"}.get(kind, f"[{kind.upper()}]")
        if merged and merged[-1][1] > start:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end, label])
    out, at = "", 0
    for s, e, label in merged:
        out, at = out + text[at:s] + label, e
    return out + text[at:]


def test_sanitised_texts(make_docs, words):
    rows = disclosing_corpus(words) + edge_rows(words) + [(500 + i, t) for i, t in enumerate(ODD)]
    rows.append((600, ("é" * 250 + " x@y.zz ") * 9))
    want = brute_spans(rows)
    got = sanitise(make_docs(rows, extra=["base", "_pii"])).collect()
    expected = [(i, t if not want[i, t or ""] else brute_clean(t, want[i, t or ""])) for i, t in rows]
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(expected, key=str)
    assert got[0].source == "s" and got[0]["_pii"] == "clash"


def test_empty_table(make_docs):
    assert find_spans(make_docs([])).collect() == []
    assert sanitise(make_docs([])).collect() == []
