"""Whole-column encoding with the tokenizers library, each distinct piece encoded once.

A text is cut before every space that the tokenizer always starts a new token at;
the pieces of a batch are dictionary-encoded, the library encodes each distinct
piece, and the ids are gathered back.  A piece that is a plain word with plain
punctuation behind it holds two pre-tokens, which go to the library's BPE model
directly; any other piece goes through the library's whole pipeline.  A piece cache
of bounded size lives in the Python worker.

The result is the library's own for the whole text: texts with a cut that is not
certain (a space next to other white space or a control character), and texts that hold
the string of an added token, which the library takes out before it splits, go to the
library whole.
"""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHED_PIECES = 600_000
_CALL = 2_000
#: Punctuation that never starts a contraction, so it is one pre-token behind a word.
_BEHIND = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_SPACE_MARK = "\u0120"  # how byte-level vocabularies write the space

_encoders: dict[tuple[str, bool], ColumnEncoder] = {}


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes follow 255."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) if b in own else chr(256 + others.index(b)) for b in range(256)}


class ColumnEncoder:
    """Encodes string columns; ``keeps_space`` tells whether spaces reach the ids.

    A vocabulary that keeps spaces also keeps the case; one that drops them is
    lower-cased, as its normaliser says.
    """

    def __init__(self, path: str, keeps_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.keeps_space = keeps_space
        self.letters = _byte_letters()
        self.words: dict[str, dict[str, bytes | None]] = {"": {}, " ": {}}
        self.tails: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        """Through the library's whole pipeline."""
        out = []
        for at in range(0, len(texts), _CALL):
            out += [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(
                texts[at:at + _CALL], add_special_tokens=False)]
        return out

    def _pretoken(self, text: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(text)]).tobytes()

    def _word(self, word: str, mark: str) -> bytes | None:
        """Ids of a word of Latin-1 letters, or None for any other text."""
        if not word.isalpha():
            return None
        if not self.keeps_space:
            word = word.lower()
        if not word.isascii():
            if max(word) > "\xff":
                return None
            word = word.encode().decode("latin-1").translate(self.letters)
        return self._pretoken(mark + word)

    def _pieces(self, texts: list[str], lead: str) -> list[bytes]:
        """Ids (native unsigned 32-bit) of distinct pieces with ``lead`` before each."""
        words, tails = self.words[lead], self.tails
        mark = _SPACE_MARK if lead else ""
        out, rest = [], []
        for t in texts:
            word = t.rstrip(_BEHIND)
            ids = words.get(word)
            if ids is None:
                ids = words[word] = self._word(word, mark)
            if ids is not None and len(word) < len(t):
                tail = t[len(word):]
                ends = tails.get(tail)
                if ends is None:
                    ends = tails[tail] = self._pretoken(tail)
                ids += ends
            if ids is None:
                rest.append(len(out))
            out.append(ids)
        for i, ids in zip(rest, self._whole([lead + texts[i] for i in rest]), strict=True):
            out[i] = ids
        for known in (words, tails):
            if len(known) > CACHED_PIECES:
                known.clear()
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): row i has ids[offsets[i]:offsets[i + 1]]; null is empty."""
        column = pc.fill_null(column, "")
        split = pc.split_pattern(column, " ")
        begin = split.offsets.to_numpy().astype(np.int64)
        begin -= begin[0]
        words = split.flatten().dictionary_encode()
        codes = words.indices.to_numpy().astype(np.int64)
        names = words.dictionary
        n = len(column)
        row = np.repeat(np.arange(n), np.diff(begin))
        first = np.zeros(len(codes), bool)
        first[begin[:-1]] = True
        whole = np.zeros(n, bool)
        for content in self.added:  # in any case, as a normaliser may lower it first
            whole |= pc.match_substring(column, content, ignore_case=True).to_numpy(
                zero_copy_only=False)
        if self.keeps_space:
            unsure = pc.match_substring_regex(names, r"^($|[\s\pZ\pC])").to_numpy(
                zero_copy_only=False)[codes] & ~first
            whole[row[unsure]] = True
        texts = names.to_numpy(zero_copy_only=False).tolist()
        # piece table: every distinct later piece, then each row's first piece or whole text
        lead = " " if self.keeps_space else ""
        used = np.zeros(len(texts), bool)
        used[codes[~first & ~whole[row]]] = True
        slot = np.cumsum(used) - 1
        pieces = self._pieces([texts[i] for i in np.flatnonzero(used)], lead)
        base = len(pieces)
        heads = [texts[c] for c in codes[begin[:-1]][~whole]]
        place = {t: base + i for i, t in enumerate(dict.fromkeys(heads))}
        pieces += self._pieces(list(place), "")
        whole_at = len(pieces)
        pieces += self._whole([column[int(i)].as_py() for i in np.flatnonzero(whole)])
        piece = slot[codes]
        piece[begin[:-1][~whole]] = [place[t] for t in heads]
        piece[begin[:-1][whole]] = whole_at + np.arange(int(whole.sum()))
        keep = first | ~whole[row]
        piece, row = piece[keep], row[keep]
        size = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
        flat = np.frombuffer(b"".join(pieces), np.uint32)
        ids = gather(flat, np.cumsum(size) - size, size, piece)
        counts = np.bincount(row, weights=size[piece], minlength=n).astype(np.int64)
        return ids, np.concatenate([[0], np.cumsum(counts)])

    def forget(self) -> None:
        """Give the cached pieces back; the worker may go on with other work."""
        for known in (*self.words.values(), self.tails):
            known.clear()


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The slices flat[start[w]:start[w] + size[w]] for each w of ``which``, end to end."""
    sizes = size[which]
    shift = start[which] - (np.cumsum(sizes) - sizes)
    return flat[np.repeat(shift, sizes) + np.arange(int(sizes.sum()))]


def encoder(path: str, keeps_space: bool) -> ColumnEncoder:
    """The worker's encoder for a vocabulary file, loaded once."""
    key = (path, keeps_space)
    if key not in _encoders:
        _encoders[key] = ColumnEncoder(path, keeps_space)
    return _encoders[key]


def with_end(ids: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Append the id ``end`` to every row."""
    return (np.insert(ids, offsets[1:], end).astype(np.uint32),
            offsets + np.arange(len(offsets)))
