"""Disclosing terms of rare entities."""
import math
import random
import re
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import Row

from cohortlens.llm.op3_pii import (CERTAIN, CONFIDENCE_Z, CONTEXT, FULL, GENERALISE, REMOVE,
                                    find_spans, sanitise)
from tests.llm.conftest import edge_rows
from tests.llm.test_pii import PLAIN, brute_base, brute_clean


def bound(hits, n, z=CONFIDENCE_Z):
    p = hits / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def added(df):
    return {r.doc_id: [(x.kind, x.value, x.start) for x in r.spans if x.kind in ("general", "remove")]
            for r in df.collect()}


def corpus(words):
    rows = [(i, words(i, 30)) for i in range(400)]
    rows.append((500, f"{words(1, 5)} Marlowe writes from ann.lee@example.org about {words(2, 5)}. "
                      f"{words(3, 40)} So says marlowe again"))
    rows.append((501, f"{words(4, 40)} and Marlowe was here"))
    rows += [(510 + i, f"about writes from {words(600 + i, 9)}") for i in range(80)]
    return rows


def test_entity_of_one_document_is_scored(make_docs, words):
    rows = corpus(words)
    n = len(rows)
    # marlowe: one mention nearby, two documents; "writes": one nearby, 81 documents
    assert math.log2(bound(1, 2) * n) / math.log2(n) < 0.7 < math.log2(bound(1, 1) * n) / math.log2(n)
    alone = [(i, t) for i, t in rows if i != 501]
    got = added(find_spans(make_docs(alone), bounded=True))
    assert ("general", "Marlowe") in {x[:2] for x in got[500]}
    assert not {"writes", "from", "about"} & {x[1] for x in got[500]}
    assert not added(find_spans(make_docs(alone)))[500]  # three documents asked for: none


def test_every_place_of_a_disclosing_term_is_marked(make_docs, words):
    rows = corpus(words) + [(502, "Ann writes to ann.lee@example.org, Marlowe"), (None, "MARLOWE")]
    docs = make_docs(rows, extra=["held", "gone", "term", "added"])
    near = added(find_spans(docs, bounded=True, generalise=0.3))
    assert [x[1] for x in near[500]].count("Marlowe") == 1 and not near[501]
    got = added(find_spans(docs, bounded=True, everywhere=True, generalise=0.3))
    for d, text in rows:
        low, places, at = (text or "").lower(), [], -1
        while (at := low.find("marlowe", at + 1)) >= 0:
            places.append(at)
        assert [x[2] for x in got[d] if x[1].lower() == "marlowe"] == places
    clean = {r.doc_id: r.text for r in sanitise(docs, bounded=True, everywhere=True,
                                               generalise=0.3).collect()}
    assert not any("marlowe" in (t or "").lower() for t in clean.values())


# -- the form that the query and the pipeline use, against counting by hand ------

def brute_full(rows, generalise=GENERALISE, remove=REMOVE, certain=CERTAIN):
    """All spans of every distinct (id, text): FULL, from the definitions."""
    docs, total = {(i, t or "") for i, t in rows}, len(rows)
    base = {d: brute_base(d[1]) for d in docs}
    near, holds, has = defaultdict(set), defaultdict(set), Counter()
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
            for w in re.findall(r"[^\W_]{3,}", before) + re.findall(r"[^\W_]{3,}", after):
                near[entity, w.lower()].add(d)
    for _, t in rows:
        has.update({m.lower() for m in re.findall(r"[^\W_]{3,}", t or "")})
    gone = {}
    for (entity, term), where in near.items():
        if not has[term]:  # a piece of a word, cut by a mention, that is no word anywhere
            continue
        n_e, sure = len(holds[entity]), bound(min(len(where), has[term]), has[term])
        if n_e == total or sure < certain[0]:
            continue
        score = math.log2(sure * total / n_e) / math.log2(total / n_e)
        if score >= generalise:
            gone[term] = gone.get(term, False) or (score >= remove and sure >= certain[1])
    out = {}
    for d, spans in base.items():
        more = {(m.start(), 5 if gone[m[0].lower()] else 4, m.end(),
                 "remove" if gone[m[0].lower()] else "general", m[0])
                for m in re.finditer(r"[^\W_]{3,}", d[1]) if m[0].lower() in gone}
        out[d] = sorted([*spans, *[a for a in more if not any(
            a[0] < b[2] and b[0] < a[2] for b in spans)]])
    return out


def random_corpus(seed, n=150):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("kor", "Lim", "été", "mus", "tab2") for b in ("an", "el", "is", "ot", "ux")]
    people = [("ann.lee@example.org", "Marlowe", "harbour"), ("10.20.30.40", "gateway", "Rack7"),
              ("+1 (415) 555-2671", "reception", "desk"), ("4111 1111 1111 1111", "visa", "jane")]
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 25))]
        if rng.random() < 0.25:
            value, *terms = rng.choice(people)
            words[rng.randrange(len(words) + 1):0] = [rng.choice(terms), value, rng.choice(terms + vocabulary)]
        if rng.random() < 0.1:
            words.append(rng.choice(people)[rng.randrange(1, 3)])
        if rng.random() < 0.1:  # an entity of one document with words of its own
            words += [f"sole{i}", f"user{i}@host{i}.net", f"only{i}"]
        rows.append((i, " ".join(words)))
    return rows


def checked(make_docs, rows, **more):
    want = brute_full(rows, **more)
    got = find_spans(make_docs(rows, extra=["term", "slot", "gone", "w", "added", "sure"]),
                     **{**FULL, **more}).collect()
    texts = defaultdict(list)
    for (i, _), spans in want.items():
        texts[i].append(spans)
    assert len(got) == len(rows)
    for r in got:
        assert [tuple(x) for x in r.spans] in texts[r.doc_id]
    return Counter(x.kind for r in got for x in r.spans)


@pytest.mark.parametrize("seed", range(4))
def test_random_corpora(make_docs, seed):
    rows = random_corpus(seed)
    kinds = checked(make_docs, rows)
    assert kinds["general"] and kinds["email"]
    assert checked(make_docs, rows, generalise=0.3, remove=0.4, certain=(0.1, 0.2))["remove"]


def test_edges_in_full(make_docs, words):
    rows = random_corpus(9, 40) + [(1000 + (i or 0), t) for i, t in edge_rows(words)]
    rows += [(2000, "Marlowe " * 400 + "ann.lee@example.org " * 300), (2000, "Marlowe"), (2000, "Marlowe"),
             (None, "harbour Marlowe"), (2001, "x" * 30_000 + " Marlowe")]
    checked(make_docs, rows)
    checked(make_docs, rows, generalise=0.2, remove=0.5, certain=(0.05, 0.3))
    assert find_spans(make_docs([]), **FULL).collect() == []
    clean = {(r.doc_id, r.text) for r in sanitise(make_docs(rows), **FULL).collect()}
    want = brute_full(rows)
    assert clean == {(i, t if not want[i, t or ""] else brute_clean(t, want[i, t or ""])) for i, t in rows}


def test_more_documents_do_not_change_what_is_removed(make_docs, words):
    """The same counts in a corpus four times the size: the same terms, the same kinds."""
    rows = random_corpus(2, 120)
    more = rows + [(10_000 + i, words(i, 5)) for i in range(3 * len(rows))]
    got = [{(x.kind, x.value.lower()) for spans in brute_full(r).values()
            for x in [Row(kind=s[3], value=s[4]) for s in spans]} for r in (rows, more)]
    assert {v for k, v in got[0] if k == "remove"} <= {v for k, v in got[1] if k == "remove"}
    assert not any(k == "remove" and v.startswith(("sole", "only")) for k, v in got[1])
    checked(make_docs, more)


def test_many_matches_in_one_text(make_docs):
    """16,000 addresses in one text: places and replacements in linear time."""
    text = " ".join(f"user{i}@example.org" for i in range(16_000))
    began = time.time()
    clean = sanitise(make_docs([(1, text)]), **FULL).collect()
    took = time.time() - began
    assert clean[0].text == " ".join(["[EMAIL]"] * 16_000) and took < 30, took
