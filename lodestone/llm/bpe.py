"""Operator 4: BPE encoding and decoding, by speculation and verification.

Distinct words are first cut greedily into longest tokens (one automaton pass over all of them).
A cut is the BPE result if every adjacent pair of tokens is: no merge across their border may come
before the merges that made its two sides. That test is vectorised over the distinct pairs of a
batch and remembered. Only words that fail it are merged exactly, in rank order.

The vocabulary's path is a parameter. Special strings inside a text become their ids, as is the
tokenizers library's default. Null texts are empty and give no ids. Long texts and long words are
handled whole: exact merging of a long word takes n log n steps. Of pairs of equal rank the leftmost
merges first. Repeated rows are answered row by row; an empty table gives no rows. Other columns pass
:func:`encode` and :func:`decode`, but those named like a new column are replaced; :func:`round_trip` does
not read them.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as k
from .common import ship_code
from .pretokens import WORDS, PieceMemory

NEVER = np.int64(1) << 40
_SEPARATOR = "Ā"
_SHORT, _NO_RANK = 40, 1 << 60


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        alphabet = byte_alphabet()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*model["vocab"].values(), *special.values()]) + 1
        self.token_bytes = [b""] * size
        for token, i in model["vocab"].items():
            if token not in special:
                self.token_bytes[i] = bytes(alphabet[c] for c in token)
        for token, i in special.items():
            self.token_bytes[i] = token.encode()
        self.special = special
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        vocab = model["vocab"]
        self.byte_ids = [0] * 256
        for c, b in alphabet.items():
            self.byte_ids[b] = vocab[c]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self._lay_out(size)

    def _lay_out(self, size: int) -> None:
        self.size = size
        pairs = np.array([a * size + b for a, b in self.merges], np.int64)
        self.rank_of = {code: rank for code, (rank, _) in zip(pairs.tolist(), self.merges.values(), strict=True)}
        self.born_of = {rank: c for rank, c in self.merges.values()}
        order = np.argsort(pairs)
        self.pair_codes = pairs[order]
        self.pair_ranks = np.array([r for r, _ in self.merges.values()], np.int64)[order]
        born, left, right = np.full(size, -1, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        for (a, b), (rank, c) in self.merges.items():
            if born[c] < 0:
                born[c], left[c], right[c] = rank, a, b
        self.born = born
        self.right_spine, self.left_spine = self._spine(right), self._spine(left)
        self.flat = np.frombuffer(b"".join(self.token_bytes), np.uint8)
        self.lengths = np.array([len(t) for t in self.token_bytes], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        automaton = ahocorasick.Automaton()
        for i, t in enumerate(self.token_bytes):
            if t and i not in self.special.values():
                automaton.add_word(t.decode("latin-1"), i)
        automaton.make_automaton()
        self.automaton = automaton
        self.known_codes, self.known_fit = np.zeros(0, np.int64), np.zeros(0, bool)
        self.words: dict[str, bytes] = {}

    def _spine(self, child: np.ndarray) -> list[np.ndarray]:
        """Outermost parts of each token on one side: itself, its child, that one's child, ... (-1: none)."""
        out = [np.arange(self.size)]
        while (out[-1] >= 0).any():
            out.append(np.where(out[-1] >= 0, child[out[-1]], -1))
        return out[:-1]

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE leaves each pair of adjacent tokens as it is."""
        fit = np.ones(len(a), bool)
        for i, spine in enumerate(self.right_spine):
            x = spine[a]
            x_ends = self.born[self.right_spine[i - 1][a]] if i else np.full(len(a), NEVER)
            rows = np.flatnonzero(fit & (x >= 0))
            if not len(rows):
                break
            for j, other in enumerate(self.left_spine):
                at = rows[other[b[rows]] >= 0]
                if not len(at):
                    break
                y = other[b[at]]
                y_ends = self.born[self.left_spine[j - 1][b[at]]] if j else np.full(len(at), NEVER)
                code = x[at] * self.size + y
                place = np.minimum(np.searchsorted(self.pair_codes, code), len(self.pair_codes) - 1)
                rank = np.where(self.pair_codes[place] == code, self.pair_ranks[place], NEVER)
                exists = (rank > self.born[x[at]]) & (rank > self.born[y])
                fit[at[exists & (rank < x_ends[at]) & (rank <= y_ends) & (rank < NEVER)]] = False
        return fit

    def _pairs_fit(self, codes: np.ndarray) -> np.ndarray:
        distinct, inverse = np.unique(codes, return_inverse=True)
        at = np.searchsorted(self.known_codes, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.known_codes)
        known[inside] = self.known_codes[at[inside]] == distinct[inside]
        fit = np.empty(len(distinct), bool)
        fit[known] = self.known_fit[at[known]]
        new = distinct[~known]
        fit[~known] = self.compatible(new // self.size, new % self.size)
        if len(new):
            if len(self.known_codes) > 4_000_000:
                self.known_codes, self.known_fit = np.zeros(0, np.int64), np.zeros(0, bool)
            codes = np.concatenate([self.known_codes, new])
            order = np.argsort(codes, kind="stable")
            self.known_codes, self.known_fit = codes[order], np.concatenate([self.known_fit, fit[~known]])[order]
        return fit[inverse]

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word."""
        if not words:
            return []
        lengths = np.array([len(w) for w in words], np.int64)
        found = list(self.automaton.iter_long(_SEPARATOR.join(w.decode("latin-1") for w in words)))
        ends, ids = (np.array(x, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        stops = np.cumsum(lengths + 1)
        owner = np.searchsorted(stops, ends, "right")
        covered = np.bincount(owner, self.lengths[ids], len(words)).astype(np.int64) == lengths
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        fits = self._pairs_fit(ids[inner] * self.size + ids[inner + 1])
        covered[owner[inner[~fits]]] = False
        bounds = np.searchsorted(owner, np.arange(len(words) + 1))
        return [ids[a:b].astype(np.int32) if ok else np.array(self.merge(w), np.int32) for w, ok, a, b in zip(words, covered.tolist(), bounds[:-1], bounds[1:], strict=True)]

    def merge(self, word: bytes) -> list[int]:
        """Exact BPE: the merge of least rank first, the leftmost among equals."""
        ids = [self.byte_ids[b] for b in word]
        if len(ids) > _SHORT:
            return self._merge_long(ids)
        size, rank = self.size, self.rank_of.get
        ranks = [rank(a * size + b, _NO_RANK) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks and (least := min(ranks)) < _NO_RANK:
            i = ranks.index(least)
            ids[i : i + 2] = [self.born_of[least]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank(ids[i - 1] * size + ids[i], _NO_RANK)
            if i < len(ranks):
                ranks[i] = rank(ids[i] * size + ids[i + 1], _NO_RANK)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """:meth:`merge` with a queue, for words whose pairs are too many to look through each time."""
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(self.merges[p][0], i, p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.merges]
        heapq.heapify(queue)
        while queue:
            _, i, pair = heapq.heappop(queue)
            j = after[i]
            if j >= n or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j] = self.merges[pair][1], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (p := (ids[a], ids[b])) in self.merges:
                    heapq.heappush(queue, (self.merges[p][0], a, p))
        return [i for i in ids if i >= 0]

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece as the bytes of 32-bit numbers."""
        parts = [self._words_of(p) for p in pieces]
        new = list({w for p in parts for w in p if isinstance(w, str)} - self.words.keys())
        if len(self.words) + len(new) > 200_000:
            self.words = {}
            new = list({w for p in parts for w in p if isinstance(w, str)})
        self.words.update(zip(new, (x.tobytes() for x in self.encode_words([w.encode() for w in new])), strict=True))
        return [b"".join([self.words[w] if isinstance(w, str) else np.int32(w).tobytes() for w in p]) for p in parts]

    def _words_of(self, piece: str) -> list:
        if self.special_pattern is None or not self.special_pattern.search(piece):
            return WORDS.findall(piece)
        out: list = []
        for part in self.special_pattern.split(piece):
            out += [self.special[part]] if part in self.special else WORDS.findall(part)
        return out

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[k.ranges(self.begins[ids], self.lengths[ids])]


_models: dict[str, tuple[Bpe, PieceMemory]] = {}


def load(path: str, most_pieces: int = 300_000) -> tuple[Bpe, PieceMemory]:
    """The model of this worker; read once."""
    if path not in _models:
        bpe = Bpe(path)
        _models[path] = bpe, PieceMemory(bpe.encode_pieces, most_pieces)
    return _models[path]


def encode_texts(texts: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts joined, offsets)."""
    _, memory = load(path)
    rows = [b"".join(v) for v in memory.values(texts)]
    return np.frombuffer(b"".join(rows), np.int32), np.cumsum([0, *(len(r) // 4 for r in rows)])


def decode_ids(ids: np.ndarray, offsets: np.ndarray, path: str) -> list[str]:
    """The text of each run of ids; bytes that aren't UTF-8 become U+FFFD."""
    bpe, _ = load(path)
    raw = bpe.decode_bytes(ids).tobytes()
    ends = np.concatenate([[0], np.cumsum(bpe.lengths[ids])])[offsets]
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _id_lists(texts: pa.Array, path: str) -> pa.Array:
    ids, offsets = encode_texts([t or "" for t in texts.to_pylist()], path)
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))


def _texts(runs: pa.Array, path: str) -> pa.Array:
    runs = runs.fill_null(pa.scalar([], runs.type))
    offsets = runs.offsets.to_numpy()
    return pa.array(decode_ids(runs.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0], path), pa.string())


def encode(docs: DataFrame, path: str, column: str = "ids", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with the ids of their text in ``column``."""
    return _append(docs, path, text, [(column, "array<int>", _id_lists)])


def decode(encoded: DataFrame, path: str, column: str = "decoded", ids: str = "ids") -> DataFrame:
    """The rows of ``encoded`` with the text of their ids in ``column``; null ids give no text."""
    return _append(encoded, path, ids, [(column, "string", _texts)])


def encode_and_decode(docs: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded", text: str = "text") -> DataFrame:
    """:func:`encode`, then :func:`decode`, in one pass: a task needs one worker with one model."""
    return _append(docs, path, text, [(ids, "array<int>", _id_lists), (decoded, "string", _texts)])


def _append(frame: DataFrame, path: str, source: str, steps: list[tuple[str, str, Callable[[pa.Array, str], pa.Array]]]) -> DataFrame:
    """The rows with a column for each step, which gets the source or what the step before it gave."""
    ship_code(frame.sparkSession)
    names = [name for name, _, _ in steps]
    frame = frame.drop(*names)
    at = frame.columns.index(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in k.row_slices(whole, at):
                new, value = [], batch.column(at)
                for _, _, step in steps:
                    value = step(value, path)
                    new.append(value)
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)
    return frame.mapInArrow(run, fields + "".join(f", `{name}` {sql}" for name, sql, _ in steps))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and decoded of every row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return encode_and_decode(rows, path).drop("text")
