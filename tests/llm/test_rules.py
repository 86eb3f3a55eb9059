import random
import re
from collections import Counter

from cohortlens.llm.op6_rules import (FEATURES, DecisionList, judge, learn, quality_rules,
                                      text_stats, with_features)
from tests.conftest import SF_ORACLE
from tests.llm.conftest import edge_rows


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if windows[tuple(w[i:i + 5])] > 1 for k in range(5)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text),
            len(lines) - len(set(lines)), len(covered))


def rows_of(words):
    rng = random.Random(3)
    rows = edge_rows(words)
    rows += [(100 + i, " ".join(rng.choice("abc") for _ in range(rng.randrange(40)))) for i in range(80)]
    rows += [(300, "a b c d e " * 5), (301, "x\ny\nx\n \n\nx"), (302, "# * $ %% &|<> é日本👍 #"),
             (303, "a b c d e f a b c d e"), (304, "a a a a a a"), (305, "a a a a a"),
             (306, "p\x0bq\x0cr s"), (307, " x \nx\n x ")]
    return rows


def test_statistics(make_docs, words):
    rows = rows_of(words)
    got = text_stats(make_docs(rows, extra=["n_words", "_words", "bad"])).collect()
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
                   for r in got), key=str) == sorted(((i, *brute(t)) for i, t in rows), key=str)


def test_learned_list_on_the_tables(shipped):
    docs = shipped.read.parquet(f"{SF_ORACLE}/documents.parquet")
    labels = shipped.read.parquet(f"{SF_ORACLE}/labels.parquet")
    rules = quality_rules(docs, labels)
    assert rules.rules and all(c.feature in FEATURES for r in rules.rules for c in r)
    rows = judge(docs, rules).join(labels, "doc_id").collect()
    verdict = [(r.quality, r.kept) for r in rows if not r.base_failed]
    good = [k for q, k in verdict if q == 1]
    assert sum(good) / len(good) > 0.97
    caught = [r for r in rows if r.quality == 0]
    assert sum(not r.kept for r in caught) / len(caught) > 0.9
    # the list is an ordered condition: replay it by hand
    for r in rows:
        first = next((i for i, rule in enumerate(rules.rules, 1) if all(
            (r[c.feature] >= c.threshold) == c.at_least for c in rule)), 0)
        assert r["rule"] == first and r.kept == (not r.base_failed and first == 0)


def test_covering_finds_a_planted_conjunction(shipped):
    rng = random.Random(2)
    rows = []
    for i in range(1500):
        f = {n: rng.random() for n in FEATURES}
        bad = int((f["marks_per_word"] >= .6 and f["repeat_share"] < .4) or f["chars_per_word"] >= .9)
        rows.append((i, bad, *f.values()))
    names = ", ".join(f"{n} double" for n in FEATURES)
    train = shipped.createDataFrame(rows, f"doc_id long, bad int, {names}")
    rules = learn(train)
    wrong = train.withColumn("v", rules.verdict()).where("(v > 0) <> (bad = 1)").count()
    assert len(rules.rules) >= 2 and wrong < 75


def test_edges(shipped, make_docs, words):
    rows = edge_rows(words)
    docs = make_docs(rows, extra=["bad", "rule", "kept", "quality"])
    labels = shipped.createDataFrame([(1, 0, 0), (3, 1, 0), (4, None, 0), (5, 9, 0), (None, 0, 0),
                                      (3, 0, 0), (777, 0, 0)], "doc_id long, quality int, toxic int")
    got = judge(docs, quality_rules(docs, labels)).collect()
    assert len(got) == len(rows)
    none = shipped.createDataFrame([], "doc_id long, quality int, toxic int")
    rules = quality_rules(make_docs([]), none)
    assert rules.rules == [] and judge(make_docs([]), rules).collect() == []
    for r in judge(docs, DecisionList()).collect():
        b = r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words
        assert r.base_failed == b and r.kept == (not b)


def test_features_of_nothing(make_docs):
    r = with_features(text_stats(make_docs([(1, None)]))).first()
    assert all(r[f] == 0 for f in FEATURES)
