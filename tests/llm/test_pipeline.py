import inspect

import corpus_pipeline as P
from pyspark.sql import functions as F

from cohortlens.llm.op1_simhash import simhash_groups
from cohortlens.llm.op2_lines import delete_lines
from cohortlens.llm.op3_pii import FULL, sanitise
from cohortlens.llm.op4_classifier import fit, score_documents
from tests.conftest import SF_ORACLE, SF_SMALL
from tests.llm.conftest import edge_rows


def test_stages_follow_one_another(shipped):
    """Each stage's rows are what its operator decides on all that the stage before kept."""
    docs = shipped.read.parquet(f"{SF_ORACLE}/documents.parquet")
    labels = shipped.read.parquet(f"{SF_ORACLE}/labels.parquet")
    steps = [s for _, s in P.STAGES]
    assert [list(inspect.signature(s).parameters) for s in steps] == [["spark", "docs", "sf_dir"]] * 5

    good = steps[0](shipped, docs, SF_ORACLE).persist()
    scored = score_documents(docs, fit(docs, labels)).where("predicted = 1")
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in scored.collect()}

    lines = steps[1](shipped, good, SF_ORACLE).persist()
    assert lines.columns == docs.columns
    want = {r.doc_id: r.text for r in delete_lines(good).collect()}
    assert {r.doc_id: r.text for r in lines.collect()} == want
    assert lines.where(F.length("text") != F.col("n_chars")).count() == 0

    single = steps[2](shipped, lines, SF_ORACLE).persist()
    groups = {r.component_id for r in simhash_groups(lines).collect()}
    assert sorted(r.doc_id for r in single.collect()) == sorted(groups)

    clean = steps[3](shipped, single, SF_ORACLE).persist()
    want = {r.doc_id: r.text for r in sanitise(single, **FULL).collect()}
    assert {r.doc_id: r.text for r in clean.collect()} == want

    packed = steps[4](shipped, clean, SF_ORACLE)
    assert {r.doc_id for r in packed.collect()} == set(want)


def test_run_is_the_stages(shipped):
    rows = P.run(shipped, SF_SMALL).collect()
    room = {}
    for r in rows:
        room.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in room.values():
        spans.sort()
        assert spans[0][0] == 0 and sum(n for _, n in spans) <= 2048
    docs = {r.doc_id for r in shipped.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    assert {r.doc_id for r in rows} <= docs and len(rows) > len(docs) // 3


def test_edges_go_through_every_stage(shipped, make_docs, words):
    for rows in (edge_rows(words), []):
        docs = make_docs(rows, extra=["_text", "fp", "spans"])
        for name, step in P.STAGES:
            out = step(shipped, docs, SF_SMALL)
            if name != P.STAGES[-1][0]:
                assert out.columns == docs.columns
                docs = out.persist()
        assert out.count() >= 0
