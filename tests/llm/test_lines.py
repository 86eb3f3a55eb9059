import random
from collections import Counter, defaultdict

from cohortlens.llm.op2_lines import (MIN_BLOCK, MIN_WORDS, RARE, RARE_WORDS, delete_lines,
                                      increasing)
from tests.llm.conftest import edge_rows


def longest_increasing(values):
    """All positions of one longest strictly increasing run, by dynamic programming."""
    best = []
    for i, v in enumerate(values):
        best.append(1 + max((best[j] for j in range(i) if values[j] < v), default=0))
    return max(best, default=0)


def test_increasing_is_longest():
    rng = random.Random(1)
    for _ in range(200):
        values = [rng.randrange(30) for _ in range(rng.randrange(25))]
        run = increasing(values)
        picked = [values[i] for i in run]
        assert run == sorted(run) and all(a < b for a, b in zip(picked, picked[1:], strict=False))
        assert len(run) == longest_increasing(values)


def runs_of(lines, min_block):
    """(position, lines) of every run of 2 to ``min_block`` adjacent lines that is worth deleting."""
    for pos in range(len(lines)):
        for size in range(2, min_block + 1):
            run = lines[pos:pos + size]
            if len(run) == size and all(run) and (size == min_block or sum(
                    len(x.split()) for x in run) >= MIN_WORDS):
                yield pos, tuple(run)


def brute(rows, rare=RARE, min_block=MIN_BLOCK):
    """Deleted positions per (id, text): every later document against the first holders of its
    lines and of its runs."""
    docs = sorted({(d, t) for d, t in rows if d is not None and t is not None}, key=lambda r: r[0])
    lines = {k: [x.encode().strip() for x in k[1].split("\n")] for k in docs}
    holders = defaultdict(list)
    for k in docs:
        seen = Counter()
        for pos, x in enumerate(lines[k]):
            if x:
                seen[x] += 1
                holders[x, seen[x]].append((k, pos))
        for pos, run in runs_of(lines[k], min_block):
            seen[run] += 1
            holders[run, seen[run]].append((k, pos))
    counted = Counter()  # rows, as the operator counts them
    for d, t in rows:
        if d is not None and t is not None:
            seen = Counter()
            for x in lines[d, t]:
                if x:
                    seen[x] += 1
                    counted[x, seen[x]] += 1
    out = {}
    for k in docs:
        pairs = defaultdict(dict)
        seen = Counter()
        for pos, x in enumerate(lines[k]):
            if x:
                seen[x] += 1
                first, other = holders[x, seen[x]][0]
                if first[0] < k[0]:
                    pairs[first][pos] = (other, counted[x, seen[x]], x)
        placed = defaultdict(set)
        for pos, run in runs_of(lines[k], min_block):
            seen[run] += 1
            first, other = holders[run, seen[run]][0]
            if first[0] < k[0]:
                pairs[first]
                placed[first] |= {(pos + i, other + i) for i in range(len(run))}
        gone = set()
        for first, shared in pairs.items():
            total, theirs = Counter(lines[k]), Counter(lines[first])
            anchors = {(p, o) for p, (o, _, x) in shared.items() if total[x] == theirs[x] == 1}
            anchors = sorted(anchors | placed[first], key=lambda a: (a[0], -a[1]))
            taken = dict(anchors[i] for i in increasing([o for _, o in anchors]))
            edge = list(taken.items())
            while edge:
                p, o = edge.pop()
                if p not in shared or shared[p][0] != o:
                    continue
                for s in (-1, 1):
                    if 0 <= p + s < len(lines[k]) and 0 <= o + s < len(lines[first]) \
                            and lines[k][p + s] and lines[k][p + s] == lines[first][o + s] \
                            and p + s not in taken:
                        taken[p + s] = o + s
                        edge.append((p + s, o + s))
            todo = sorted(taken)
            while todo:
                block = [todo.pop(0)]
                while todo and todo[0] == block[-1] + 1 and taken[todo[0]] == taken[block[-1]] + 1:
                    block.append(todo.pop(0))
                if len(block) >= min_block or sum(len(lines[k][p].split()) for p in block) >= MIN_WORDS or any(
                        p in shared and shared[p][0] == taken[p] and shared[p][1] <= rare
                        and len(shared[p][2].split()) >= RARE_WORDS for p in block):
                    gone |= set(block)
        if gone:
            out[k] = sorted(gone)
    return out


def check(make_docs, rows, **options):
    df = delete_lines(make_docs(rows, extra=["gone_", "version", "line", "first"]), report=True,
                      **options)
    want = brute(rows, **options)
    expected = []
    for d, t in rows:
        gone = want.get((d, t), [])
        text = t if not gone else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
        expected.append((d, text, gone))
    assert sorted(((r.doc_id, r.text, list(r.gone)) for r in df.collect()), key=str) == sorted(
        expected, key=str)
    return want


def test_random_overlaps(make_docs, words):
    rng = random.Random(6)
    pool = [words(i, 8) for i in range(60)]
    common = ["Licensed.", "", "  ", "The end", "Licensed."]
    rows = []
    for d in range(150):
        at = rng.randrange(50)
        body = pool[at:at + rng.randint(0, 9)] + [words(1000 + d, 6) for _ in range(rng.randint(0, 4))]
        if rng.random() < .4:
            body += rng.sample(pool, 3)
        for _ in range(rng.randint(0, 3)):
            body.insert(rng.randint(0, len(body)), rng.choice(common))
        rows.append((d * 37 % 151, "\n".join(body)))
    assert len(check(make_docs, rows)) > 30
    check(make_docs, rows, rare=2, min_block=2)


def test_short_rare_lines_stay(make_docs, words):
    rows = [(d, f"Of.\n{words(d, 9)}\nThe end.") for d in range(4)]
    assert check(make_docs, rows) == {}


def test_common_line_stays_and_copies_go(make_docs, words):
    rows = [(d, f"{words(d, 9)}\nLicensed under X.\n{words(d + 500, 9)}") for d in range(40)]
    assert check(make_docs, rows) == {}
    rows += [(100 + d, "\n".join(words(k, 7) for k in range(900, 906))) for d in range(30)]
    assert len(check(make_docs, rows)) == 29  # a large group of copies: only the first keeps its text


def test_edges(make_docs, words):
    check(make_docs, edge_rows(words) + [(40, "a\r\nb\r\na"), (41, "a\nb\na"), (42, "a\nb\na\na")])


def test_empty_table(make_docs):
    assert delete_lines(make_docs([])).collect() == []


def test_a_block_whose_lines_have_other_first_holders(make_docs, words):
    """Five adjacent lines of 8 words in two documents, each line alone in 17 earlier ones."""
    block = [words(700 + i, 8) for i in range(5)]
    rows = [(i * 17 + j, f"{words(2000 + i * 17 + j, 9)}\n{block[i]}\n{words(3000 + i * 17 + j, 9)}")
            for i in range(5) for j in range(17)]
    rows += [(d, "\n".join([words(d, 9), *block, words(d + 1, 9)])) for d in (1000, 1001)]
    assert check(make_docs, rows) == {(1001, rows[-1][1]): [1, 2, 3, 4, 5]}


def test_every_block_that_an_earlier_document_holds_goes(make_docs):
    """Against all earlier documents, not first holders: no run of three lines is left in order."""
    rng = random.Random(8)
    pool = [f"line {i} of the pool" for i in range(25)]
    rows = [(d, "\n".join(pool[at:at + rng.randint(2, 7)] + [f"own {d}"]))
            for d, at in enumerate(rng.randrange(20) for _ in range(120))]
    check(make_docs, rows)
    left = {r.doc_id: list(r.gone) for r in delete_lines(make_docs(rows), report=True).collect()}
    held = set()
    for d, text in rows:
        lines = text.split("\n")
        runs = {tuple(lines[i:i + 3]): i for i in range(len(lines) - 2)}
        for run, i in runs.items():
            assert run not in held or {i, i + 1, i + 2} <= set(left[d])
        held |= set(runs)
