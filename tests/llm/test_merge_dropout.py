import random

import numpy as np
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortlens.llm.op8_merge_dropout import MergeDropout, decode_documents, encode_documents
from tests.llm.conftest import edge_rows

PATH = "/opt/tokenizers/piece_bpe_32k.model"
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
PLAIN, DROPPED = MergeDropout(PATH, rate=0.0), MergeDropout(PATH, seed=3, rate=0.3)
TEXTS = ["", " ", "  ", "Hello world", " lead", "trail ", "a  b   c", "tab\tnew\nline", "日本語 ёж 👍🏽",
         "x" * 3000, "don't STOP!!! 3.14", "a\n\n  b", "\x00\x01"]


def test_without_dropout_it_is_the_library(words):
    for text in [*TEXTS, words(1, 300)]:
        assert PLAIN.encode(text) == LIBRARY.encode(text), repr(text)


def test_dropout_decodes_losslessly_and_varies(words):
    text = words(2, 200)
    several = {tuple(DROPPED.encode(text, v)) for v in range(5)}
    assert len(several) == 5
    for ids in several:
        assert DROPPED.decode(list(ids)) == LIBRARY.decode(list(ids)) == text
    assert DROPPED.encode(text, 1) == MergeDropout(PATH, seed=3, rate=0.3).encode(text, 1)
    assert MergeDropout(PATH, seed=4, rate=0.3).encode(text, 1) != DROPPED.encode(text, 1)
    assert len(MergeDropout(PATH, rate=1.0).encode("abc def")) == 8  # no merge at all


def test_long_runs_are_merged_alike(words):
    rng = random.Random(4)
    for rate in (0.0, 0.3):
        code = MergeDropout(PATH, seed=5, rate=rate)
        for n in (1, 2, 7, 60, 199):
            symbols = [code.rank_of.get(rng.choice("▁theandиong\n!日"), len(code.id_of))
                       for _ in range(n)]
            assert code._merged(list(symbols), 77) == code._merged_long(list(symbols), 77)


def test_runs_encoded_together_equal_single_runs(words):
    rng = random.Random(6)
    runs = [r for i in range(40) for r in PLAIN.runs(words(i, 30) + " Ünïcode, don't; 日本 x" + "y" * i)]
    runs += ["".join(rng.choice("▁theandиong!日") for _ in range(rng.randint(1, 40))) for _ in range(300)]
    variants = [rng.randrange(4) for _ in runs]
    for code in (PLAIN, DROPPED, MergeDropout(PATH, rate=1.0)):
        together = code.encode_runs(runs, variants)
        assert [np.frombuffer(b, np.uint32).tolist() for b in together] == [
            code._run_ids(r, v) for r, v in zip(runs, variants, strict=True)]


@given(st.text(max_size=60))
@settings(max_examples=150, deadline=None)
def test_any_text_comes_back(text):
    assert DROPPED.decode(DROPPED.encode(text, 2)) == text


@given(st.text(alphabet="ab ▁\nlteral-mk", max_size=30))
@settings(max_examples=100, deadline=None)
def test_marks_and_spaces_come_back(text):
    assert DROPPED.decode(DROPPED.encode(text)) == text


def test_documents(make_docs, words):
    rows = edge_rows(words) + [(50 + i, t) for i, t in enumerate(TEXTS)] + [(90, "a▁b ▁ c")]
    encoded = encode_documents(make_docs(rows, extra=["ids", "variant"]), PATH, seed=3, rate=0.3)
    got = decode_documents(encoded, PATH).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(
        ((i, t or "") for i, t in rows), key=str)
    texts = dict(rows)
    for r in encoded.where("doc_id is not null").collect():
        ids = np.frombuffer(r.ids, "<u2").tolist()
        assert len(ids) == r.n_ids
        assert ids == DROPPED.encode(texts[r.doc_id] or "", r.variant)


def test_empty_table(make_docs):
    assert decode_documents(encode_documents(make_docs([]), PATH), PATH).collect() == []
