import hashlib
import random

import pytest
from pyspark.sql import functions as F

from cohortlens.llm.op11_merkle import (FIELDS, as_hex, build_manifest, fold, leaf_digest,
                                        proof_digest, proofs)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    doc_id, text, lang, source, n = row
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}"
                     for v in (doc_id, source, lang, n, text)))


def tree(leaves):
    """Root and, for each leaf, (left, right) of every level; level by level, in plain lists."""
    paths, place = [[] for _ in leaves], list(range(len(leaves)))
    while len(leaves) > 1:
        for path, p in zip(paths, place, strict=True):
            run = p - p % 8
            path.append(("".join(leaves[run:p]), "".join(leaves[p + 1:run + 8])))
        leaves = [H("".join(leaves[a:a + 8])) for a in range(0, len(leaves), 8)]
        place = [p // 8 for p in place]
    return leaves[0], paths


def brute(rows):
    """(id, leaf, subroot, root, proof digest) of every row."""
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = []
    for name in names:
        held = sorted(groups[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        made.append((held, *tree([leaf(r) for r in held])))
    root, upper = tree([m[1] for m in made])
    return sorted((str(r[0]), leaf(r), sub, root, H("".join(a + b for a, b in path + up)))
                  for (held, sub, paths), up in zip(made, upper, strict=True)
                  for r, path in zip(held, paths, strict=True))


def run(spark, rows, parts=3, extra=()):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    for name in extra:
        docs = docs.withColumn(name, F.lit("clash"))
    return proofs(build_manifest(docs))


def found(made):
    return sorted((str(r.id), r.leaf, r.subroot, r.root, r.p) for r in made.select(
        "id", *[as_hex(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")],
        as_hex(proof_digest(F.col("proof"))).alias("p")).collect())


def some(n, langs, seed=1):
    rng = random.Random(seed)
    ids = rng.sample(range(10 * n), n)
    return [(i, f"text {i} é" * rng.randrange(3), rng.choice(langs), f"s{i % 5}", i % 7) for i in ids]


@pytest.mark.parametrize("n, langs", [(1, ["en"]), (8, ["en"]), (9, ["en"]), (65, ["en"]),
                                      (700, ["en", "en", "en", "de", "fr"])])
def test_equal_to_plain_lists(shipped, n, langs):
    rows = some(n, langs)
    made = run(shipped, rows)
    assert found(made) == brute(rows)
    assert made.where(as_hex(fold(F.col("leaf"), F.col("proof"))) != as_hex(F.col("root"))).count() == 0


def test_many_groups_of_unequal_depth(shipped):
    rows = some(600, ["a"] * 9 + [f"l{i}" for i in range(70)], seed=5)
    assert found(run(shipped, rows)) == brute(rows)


def test_edges(shipped):
    rows = some(30, ["en", "é", None])
    rows += [(5000, None, "en", None, None), (5001, "", "en", "", 0), (5002, "x" * 400_000, "", "s", 1),
             (5003, "same", "en", "s", 4), (5003, "same", "en", "s", 4), (5003, "other", "en", "s", 5),
             (None, "a", "en", "s", 1), (None, "a", "en", "s", 1), (None, "b", None, "s", 1)]
    extra = ["tree", "pos", "n", "row", "leaf", "id", "root", "members", "digest"]
    assert found(run(shipped, rows, extra=extra)) == brute(rows)


def test_one_row_repeated_many_times(shipped):
    rows = [(7, "copy", "en", "s", 4)] * 400 + some(100, ["en"])
    assert found(run(shipped, rows, parts=7)) == brute(rows)


def test_empty_table(shipped):
    made = build_manifest(shipped.createDataFrame([], SCHEMA))
    assert proofs(made).collect() == [] and made.root.collect() == []


def test_tampering_shows(shipped):
    rows = some(200, ["en", "de"])
    docs = shipped.createDataFrame(rows, SCHEMA)
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.col("text"), F.lit("!"))).otherwise(F.col("text"))
    forged = leaf_digest([text if f == "text" else F.col(f) for f in FIELDS])
    made = proofs(build_manifest(docs.withColumn("forged", forged), carry=("forged",)))
    holds = made.withColumn("ok", fold(F.col("forged"), F.col("proof")) == F.col("root")).collect()
    assert all(r.ok == (r.id % 3 != 0) for r in holds) and len(holds) == 200
