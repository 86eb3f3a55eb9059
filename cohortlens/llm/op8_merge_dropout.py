"""SentencePiece (BPE) encoding with seeded merge-dropout, and its lossless decoding.

Encoding follows the agenda of BPE: candidate merges wait in a priority queue by
score, then place; the best is taken while its two symbols still stand.  With
merge-dropout a taken candidate is skipped when a keyed hash of (seed, variant,
piece of text, place, merged id) falls below the dropout rate, so the same seed
gives the same ids on every run and every executor, and another seed or variant
gives another segmentation.  A document's variant is a keyed hash of its id modulo
``variants``.  At rate 0 the ids are the library's own.

A merge never spans two neighbouring characters that stand side by side in no piece of
the vocabulary, so a text is cut at such places (before space marks, between words and
punctuation) and encoded run by run, each distinct (run, variant) once per batch, with a
bounded cache in the Python worker.

Decoding joins the pieces' bytes.  A space mark that the text itself holds is
written as byte pieces, so every text comes back as it was.

Defined cases: null counts as empty; an empty text has no ids; a null id has
variant 0; repeated rows are encoded alike; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import by_bytes
from .tokenizing import gather

RATE = 0.1
VARIANTS = 4
CACHED_RUNS = 200_000
SHORT_RUN, LONG_RUN = 32, 200
_ROWS, _AT_ONCE = 10_000, 400_000
MARK = "▁"
_LITERAL = ""  # the run that stands for a space mark of the text itself
_ODD, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_SEGMENT = re.compile(r"\w+|\W+")

_models: dict[tuple, MergeDropout] = {}


class PairTable:
    """Open-addressed table of non-negative 64-bit keys, searched for whole arrays."""

    def __init__(self, pairs: dict[int, int]):
        bits = max(4, (4 * len(pairs)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.zeros(1 << bits, np.int64)
        keys = np.fromiter(pairs, np.int64, len(pairs))
        for slot, key, value in zip(self._slots(keys).tolist(), pairs, pairs.values(), strict=True):
            while self.keys[slot] >= 0:
                slot = slot + 1 & self.mask
            self.keys[slot], self.values[slot] = key, value

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(_ODD) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray, missing: int) -> np.ndarray:
        flat = keys.reshape(-1)
        out = np.full(len(flat), missing, np.int64)
        todo, slots = np.arange(len(flat)), self._slots(flat)
        while len(todo):
            there = self.keys[slots]
            hit = there == flat[todo]
            out[todo[hit]] = self.values[slots[hit]]
            on = ~hit & (there >= 0)
            todo, slots = todo[on], slots[on] + 1 & self.mask
        return out.reshape(keys.shape)


class Vocabulary:
    """The pieces of a model file, as bytes; enough to decode."""

    def __init__(self, path: str):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
                   for i in range(n)]
        names = [model.id_to_piece(i) for i in range(n)]
        self.byte_ids = [0] * 256
        self.bytes_of = [b""] * n
        self.scored = []
        for i, name in enumerate(names):
            if model.is_byte(i):
                value = int(name[3:5], 16)
                self.byte_ids[value] = i
                self.bytes_of[i] = bytes([value])
            elif not special[i]:
                self.scored.append((-model.get_score(i), i, name))
                self.bytes_of[i] = name.replace(MARK, " ").encode()

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``: pieces joined, without the leading space the model added."""
        of = self.bytes_of
        return b"".join([of[i] for i in ids])[1:].decode("utf-8", "surrogatepass")


class MergeDropout(Vocabulary):
    """Encoder and decoder for one model file, seed and rate."""

    def __init__(self, path: str, seed: int = 0, rate: float = RATE):
        super().__init__(path)
        # symbols are ranks: the better a piece scores, the lower its rank
        scored = sorted(self.scored)
        self.id_of = [i for _, i, _ in scored]
        self.rank_of = {name: r for r, (_, _, name) in enumerate(scored)}
        self.side_by_side = {name[i:i + 2] for name in self.rank_of for i in range(len(name) - 1)}
        #: (left rank, right rank) -> rank of the merged piece, for every cut of every piece
        self.merge: dict[int, int] = {}
        for r, (_, _, name) in enumerate(scored):
            for cut in range(1, len(name)):
                a, b = self.rank_of.get(name[:cut]), self.rank_of.get(name[cut:])
                if a is not None and b is not None:
                    self.merge[a << 20 | b] = r
        self.ids = np.array([*self.id_of, 0], np.uint32)
        self.pairs = PairTable(self.merge)
        self.seed, self.limit = seed, int(rate * (1 << 64))
        self.known: dict[str, bytes] = {}  # by variant and run

    def _skips(self, key: int, place: int, rank: int) -> bool:
        """Keyed hash: is the candidate at this place passed over?"""
        return (key ^ place << 20 ^ rank) * _ODD & _MASK < self.limit

    def _merged(self, symbols: list[int], key: int) -> list[tuple[int, int]]:
        """(symbol, place of its first character) after the agenda of a run is done.

        The agenda is a list with the candidate of each neighbouring pair, best first by
        rank, then place.  A skipped candidate is gone until a neighbour's merge makes a
        new one.
        """
        merge, never, limit = self.merge.get, len(self.id_of), self.limit
        places = list(range(len(symbols)))
        agenda = [merge(a << 20 | b, never) for a, b in zip(symbols, symbols[1:], strict=False)]
        while agenda:
            best = min(agenda)
            if best == never:
                break
            i = agenda.index(best)
            if limit and (key ^ places[i] << 20 ^ best) * _ODD & _MASK < limit:  # as _skips
                agenda[i] = never
                continue
            symbols[i] = best
            del symbols[i + 1], places[i + 1], agenda[i]
            if i:
                agenda[i - 1] = merge(symbols[i - 1] << 20 | best, never)
            if i < len(agenda):
                agenda[i] = merge(best << 20 | symbols[i + 1], never)
        return list(zip(symbols, places, strict=True))

    def _merged_long(self, symbols: list[int], key: int) -> list[tuple[int, int]]:
        """The same for long runs: the agenda is a heap over linked symbols."""
        merge, n = self.merge.get, len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        agenda = []

        def push(left: int, right: int) -> None:
            rank = merge(symbols[left] << 20 | symbols[right])
            if rank is not None:
                heapq.heappush(agenda, (rank, left, right, symbols[left], symbols[right]))

        for i in range(n - 1):
            push(i, i + 1)
        while agenda:
            rank, left, right, a, b = heapq.heappop(agenda)
            if not (alive[left] and alive[right] and symbols[left] == a and symbols[right] == b):
                continue
            if self.limit and self._skips(key, left, rank):
                continue
            symbols[left], alive[right] = rank, False
            nxt = after[left] = after[right]
            if nxt < n:
                before[nxt] = left
                push(left, nxt)
            if before[left] >= 0:
                push(before[left], left)
        return [(s, i) for i, s in enumerate(symbols) if alive[i]]

    def _merged_all(self, runs: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The agenda of many short runs at once: (symbols, lengths), one row a run.

        Each round takes the best candidate of every run that has one.  A column is a
        character's place; a merged symbol keeps its first place and -1 marks the rest.
        """
        never, n = len(self.id_of), len(runs)
        sizes = np.fromiter(map(len, runs), np.int64, n)
        width = int(sizes.max()) + 1
        every = np.arange(n)
        symbols = np.full((n, width), never, np.int64)
        rank_of = self.rank_of
        letters = np.fromiter((rank_of.get(c, never) for c in "".join(runs)), np.int64,
                              int(sizes.sum()))
        symbols[np.repeat(every, sizes), np.arange(len(letters)) - np.repeat(
            np.cumsum(sizes) - sizes, sizes)] = letters
        after = np.tile(np.arange(1, width + 1), (n, 1))
        before = np.tile(np.arange(-1, width - 1), (n, 1))
        agenda = np.full((n, width), never, np.int64)
        agenda[:, :-1] = self.pairs.find(symbols[:, :-1] << 20 | symbols[:, 1:], never)
        rows = every
        while True:
            at = agenda[rows].argmin(axis=1)
            best = agenda[rows, at]
            open_ = best < never
            rows, at, best = rows[open_], at[open_], best[open_]
            if not len(rows):
                break
            if self.limit:
                mixed = (keys[rows] ^ (at.astype(np.uint64) << np.uint64(20)) ^ best.astype(
                    np.uint64)) * np.uint64(_ODD)
                skips = mixed < np.uint64(min(self.limit, _MASK))
                agenda[rows[skips], at[skips]] = never
                r, i, b = rows[~skips], at[~skips], best[~skips]
            else:
                r, i, b = rows, at, best
            j = after[r, i]
            k = after[r, j]
            symbols[r, i], symbols[r, j] = b, -1
            after[r, i], before[r, k] = k, i
            agenda[r, j] = never
            agenda[r, i] = self.pairs.find(b << 20 | symbols[r, k], never)
            h = before[r, i]
            left = h >= 0
            r, h, b = r[left], h[left], b[left]
            agenda[r, h] = self.pairs.find(symbols[r, h] << 20 | b, never)
        return symbols, sizes

    def encode_runs(self, runs: list[str], variants: list[int]) -> list[bytes]:
        """Ids (native unsigned 32-bit) of each run under its variant."""
        out: list[bytes | None] = [None] * len(runs)
        short = [i for i, r in enumerate(runs) if 0 < len(r) <= SHORT_RUN]
        for at in range(0, len(short), _AT_ONCE):
            some = sorted(short[at:at + _AT_ONCE], key=lambda i: len(runs[i]))
            for begin in range(0, len(some), _ROWS):
                which = some[begin:begin + _ROWS]
                texts = [runs[i] for i in which]
                keys = np.fromiter((self._key(t, variants[i]) for t, i in zip(
                    texts, which, strict=True)), np.uint64, len(which))
                symbols, sizes = self._merged_all(texts, keys)
                strange = len(self.id_of)
                inside = np.arange(symbols.shape[1]) < sizes[:, None]
                real = inside & (symbols >= 0)
                odd = (real & (symbols == strange)).any(axis=1)
                ids = self.ids[symbols[real]]
                ends = np.cumsum(real.sum(axis=1))
                raw, begins = ids.tobytes(), 4 * np.concatenate([[0], ends])
                for row, i in enumerate(which):
                    out[i] = self._bytes(runs[i], variants[i]) if odd[row] else \
                        raw[begins[row]:begins[row + 1]]
        for i, r in enumerate(runs):
            if out[i] is None:
                out[i] = self._bytes(r, variants[i])
        return out

    def _key(self, run: str, variant: int) -> int:
        return xxhash.xxh64_intdigest(run.encode(), self.seed * 1_000_003 + variant)

    def _bytes(self, run: str, variant: int) -> bytes:
        return array("I", self._ids(run, variant)).tobytes()

    def _run_ids(self, run: str, variant: int) -> list[int]:
        """Ids of one run; a character without a piece of its own becomes byte pieces."""
        rank_of, strange = self.rank_of, len(self.id_of)
        key = self._key(run, variant)
        symbols = [rank_of.get(c, strange) for c in run]
        merged = (self._merged if len(run) <= LONG_RUN else self._merged_long)(symbols, key)
        id_of, out = self.id_of, []
        for symbol, place in merged:
            if symbol != strange:
                out.append(id_of[symbol])
            else:
                out += [self.byte_ids[v] for v in run[place].encode()]
        return out

    def cut(self, part: str) -> list[str]:
        """Runs of a text part: cut where no piece can reach across."""
        out: list[str] = []
        for segment in _SEGMENT.findall(part):
            if out and out[-1][-1] + segment[0] in self.side_by_side:
                out[-1] += segment
            else:
                out.append(segment)
        return out

    def runs(self, text: str) -> list[str]:
        """Runs of a whole text, with the leading mark that the model puts before it."""
        if not text:
            return []
        out = []
        for i, part in enumerate(text.split(MARK)):
            if i:
                out.append(_LITERAL)
            part = (MARK if i == 0 else "") + part.replace(" ", MARK)
            out += [run for word in _WORD.findall(part) for run in self.cut(word)]
        return out

    def _ids(self, run: str, variant: int) -> list[int]:
        if run == _LITERAL:
            return [self.byte_ids[v] for v in MARK.encode()]
        return self._run_ids(run, variant)

    def encode(self, text: str, variant: int = 0) -> list[int]:
        return [i for run in self.runs(text) for i in self._ids(run, variant)]

    def encode_column(self, column: pa.Array, variants: np.ndarray, count: int
                      ) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of a string column; each distinct (run, variant) is encoded once."""
        texts = pc.fill_null(column, "")
        plain = pc.invert(pc.match_substring_regex(texts, f"{MARK}|  |^ | $|^$")).to_numpy(
            zero_copy_only=False)
        at = np.flatnonzero(plain)
        split = pc.split_pattern(texts.take(pa.array(at)), " ")
        words = split.flatten().dictionary_encode()
        place: dict[str, int] = {}
        codes_of = [[place.setdefault(r, len(place)) for r in (
            [MARK + w] if w.isascii() and w.isalpha() else self.cut(MARK + w))]
            for w in words.dictionary.to_numpy(zero_copy_only=False)]
        sizes = np.fromiter(map(len, codes_of), np.int64, len(codes_of))
        flat = np.fromiter(chain.from_iterable(codes_of), np.int64, int(sizes.sum()))
        which = words.indices.to_numpy().astype(np.int64)
        row_parts = [np.repeat(np.repeat(at, np.diff(split.offsets.to_numpy())), sizes[which])]
        name_parts = [gather(flat, np.cumsum(sizes) - sizes, sizes, which)]
        for i in np.flatnonzero(~plain):
            runs = self.runs(texts[int(i)].as_py())
            row_parts.append(np.full(len(runs), i))
            name_parts.append(np.array([place.setdefault(r, len(place)) for r in runs], np.int64))
        names = list(place)
        rows, codes = np.concatenate(row_parts), np.concatenate(name_parts)
        order = np.argsort(rows, kind="stable")
        rows, codes = rows[order], codes[order]
        wanted, which = np.unique(codes * count + variants[rows], return_inverse=True)
        if len(self.known) + len(wanted) > CACHED_RUNS:
            self.known = {}
        known, variant_of = self.known, (wanted % count).tolist()
        runs = [names[c] for c in (wanted // count).tolist()]
        keys = [f"{v} {r}" for v, r in zip(variant_of, runs, strict=True)]
        new = [i for i, key in enumerate(keys) if key not in known]
        known.update(zip([keys[i] for i in new], self.encode_runs(
            [runs[i] for i in new], [variant_of[i] for i in new]), strict=True))
        pieces = [known[key] for key in keys]
        size = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
        flat = np.frombuffer(b"".join(pieces), np.uint32)
        ids = gather(flat, np.cumsum(size) - size, size, which)
        per_row = np.bincount(rows, weights=size[which], minlength=len(texts)).astype(np.int64)
        return ids, np.concatenate([[0], np.cumsum(per_row)])


def model(path: str, seed: int, rate: float) -> MergeDropout:
    """The worker's encoder for a model file, seed and rate, loaded once."""
    key = (path, seed, rate)
    if key not in _models:
        _models[key] = MergeDropout(path, seed, rate)
    return _models[key]


def _variants(ids: list, seed: int, count: int) -> np.ndarray:
    return np.array([0 if i is None else xxhash.xxh64_intdigest(str(i), seed) % count for i in ids],
                    np.int64)


def encode_documents(docs: DataFrame, path: str, seed: int = 0, rate: float = RATE,
                     variants: int = VARIANTS, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """(doc_id, variant, n_ids, ids) with ids as little-endian unsigned 16-bit integers."""
    def run(batches):
        code = model(path, seed, rate)
        for part in by_bytes(batches, "text", 4 << 20):
            chosen = _variants(part.column("doc_id").to_pylist(), seed, variants)
            ids, at = code.encode_column(part.column("text"), chosen, variants)
            raw = ids.astype("<u2").tobytes()
            blobs = [raw[2 * b:2 * e] for b, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.record_batch([part.column("doc_id"), pa.array(chosen, pa.int32()),
                                   pa.array(np.diff(at)), pa.array(blobs, pa.binary())],
                                  names=["doc_id", "variant", "n_ids", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, variant int, n_ids long, ids binary")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """Replace ``ids`` by ``text`` and add ids_crc32."""
    def run(batches):
        code = Vocabulary(path)
        for part in by_bytes(batches, "ids", 2 << 20):
            blobs = part.column("ids").to_pylist()
            texts = [code.decode(np.frombuffer(b, "<u2").tolist()) for b in blobs]
            rest = [n for n in part.schema.names if n != "ids"]
            yield pa.record_batch([*(part.column(n) for n in rest), pa.array(texts, pa.string()),
                                   pa.array([zlib.crc32(b) for b in blobs], pa.int64())],
                                  names=[*rest, "text", "ids_crc32"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in encoded.schema.fields
                       if f.name != "ids")
    return encoded.mapInArrow(run, schema + ", text string, ids_crc32 long")
