import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cohortlens.llm import perfect_hash
from cohortlens.llm.op7_token_store import (find, lookup, read_shards, store_documents, write_store)
from cohortlens.llm.tokenizing import ColumnEncoder
from tests.llm.conftest import edge_rows


@given(st.sets(st.integers(-2 ** 63, 2 ** 63 - 1), min_size=1, max_size=300))
@settings(max_examples=40, deadline=None)
def test_perfect_hash_is_minimal(keys):
    keys = np.array(sorted(keys), np.int64)
    slots = perfect_hash.slots(keys, perfect_hash.build(keys), len(keys))
    assert sorted(slots.tolist()) == list(range(len(keys)))


ODD = ["", " ", "  a", "a  b", "a \n b", "a  b", "a  b", "x\ty z", "don't  stop", "it's a",
       "trailing ", "a b c", "\n\n a", "é ü ß", "日本 語 x", "a \x85b", "1 22 3.5", "<|endoftext|> a",
       "a <|endoftext|>", "é ́x", "Σ ς ΑΣ Σ", "tab\t", "a\x1c b", "👍🏽 ok", "a\r\n b"]


@pytest.mark.parametrize("name,spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_column_encoder_equals_the_library(vocabulary, words, name, spaced):
    code = ColumnEncoder(f"{vocabulary}/{name}", spaced)
    texts = ODD + [words(i, 50) for i in range(20)] + [None]
    ids, at = code.encode(pa.array(texts, pa.string()))
    plain = Tokenizer.from_file(f"{vocabulary}/{name}")
    for i, t in enumerate(texts):
        assert ids[at[i]:at[i + 1]].tolist() == plain.encode(t or "", add_special_tokens=False).ids, t


@given(st.lists(st.text(alphabet="ab' \n\t é.1", max_size=12), min_size=1, max_size=6))
@settings(max_examples=60, deadline=None)
def test_column_encoder_on_any_white_space(texts):
    code = ColumnEncoder("/opt/tokenizers/byte_bpe_50k.json", True)
    ids, at = code.encode(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert ids[at[i]:at[i + 1]].tolist() == code.tokenizer.encode(t, add_special_tokens=False).ids


def test_round_trip(make_docs, shipped, words, vocabulary, tmp_out):
    rows = edge_rows(words) + [(1000 - i, words(i, i % 60)) for i in range(200)]
    rows += [(2000, "end <|endoftext|> of"), (2001, "<|endoftext|>")]
    path, name = f"{tmp_out}/store", f"{vocabulary}/byte_bpe_50k.json"
    write_store(make_docs(rows, extra=["keys", "part"]), path, name, shard_bytes=4000)
    got = store_documents(shipped, path, with_ids=True).collect()
    code = Tokenizer.from_file(name)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start, want = 0, []
    for i, t in order:
        ids = np.array([*code.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        want.append((i, start, len(ids) // 4, zlib.crc32(ids), ids))
        start += len(ids) // 4
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in got),
                  key=lambda r: r[1]) == want
    assert read_shards(shipped, path).count() > 3
    for key in (0, 3, 9, 950):
        assert [x.astype("<u4").tobytes() for x in lookup(shipped, path, key)] == [
            w[4] for w in want if w[0] == key]
    assert lookup(shipped, path, 123_456) == [] and lookup(shipped, path, 20) == []
    row = read_shards(shipped, path).where("n_docs > 1 and first is not null").first().asDict()
    unknown = np.arange(10 ** 9, 10 ** 9 + 5000)
    assert (find(row, unknown) >= 0).sum() <= 1  # fingerprints turn strangers away


def test_empty_table(make_docs, shipped, vocabulary, tmp_out):
    write_store(make_docs([]), f"{tmp_out}/store", f"{vocabulary}/byte_bpe_50k.json")
    assert store_documents(shipped, f"{tmp_out}/store").collect() == []
