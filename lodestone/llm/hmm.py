"""Operator 7: language-model scores from a hidden Markov model over words.

Counts of every word of every training text are gathered first. Words frequent enough to fit a table
of at most ``most_words`` rows are symbols of their own; each other word is emitted through the class
of its shape and then drawn within the class by its smoothed count, so the model is a distribution
over whole texts and every word's count matters. States are trained by Baum-Welch from a seeded random
start: ``warm_rounds`` rounds over a share of the training texts (whole texts, drawn by a hash of id and
text, so by no order of rows), then rounds over all of them until the gain for each token falls under
``least_gain``, ``most_rounds`` at most. The share is ``warm_share``, or what gives about ``warm_tokens`` tokens if
that is more, so a small corpus is its own share. Each round sums expected counts over all partitions in
doubles; a round without any leaves the model as it is. A text's score is the exact likelihood of the whole text by the scaled forward recursion. Long texts are
worked off in runs side by side; forward and backward values are carried over the runs' borders, so
counts and likelihoods are those of the whole text, and only a text's first word counts as a start.

Null and empty texts hold the end token alone. Very long texts are whole, as said. Repeated rows count as
often as they occur. A row without an id is a training row. Without training texts all counts are 0 and
the model is uniform over its few symbols; an empty table gives no rows. Words of equal count enter the
table together or not at all. Extra columns, of whatever name, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as k
from .common import is_held_out, materialize, ship_code

SHAPES = 31 * 4
_DRAWS = 1 << 30
_LAST = np.full(256, 30, np.int64)
_LAST[97:123] = np.arange(26)
_LAST[65:91] = np.arange(26)
_LAST[ord(".")], _LAST[ord(",")] = 26, 27
_LAST[48:58] = 28
_LAST[128:] = 29


def shapes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Class of each word: its last byte's kind and a band of its length."""
    return _LAST[raw[ends - 1]] * 4 + np.searchsorted([4, 7, 11], ends - starts, "left")


@dataclass(frozen=True)
class Vocabulary:
    hashes: np.ndarray  # sorted hashes of the frequent words
    counts: np.ndarray  # their counts
    rare_total: np.ndarray  # tokens of the other words, by shape
    rare_types: np.ndarray  # distinct other words, by shape
    texts: int  # training texts, so the count of the end token
    tokens: int
    types: int

    @property
    def end(self) -> int:
        return len(self.hashes) + SHAPES

    def unigram(self) -> np.ndarray:
        c = np.concatenate([self.counts, self.rare_total, [self.texts]]).astype(np.float64) + 1
        return c / c.sum()


@dataclass(frozen=True)
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # symbols x states


class Packed:
    """Sequences laid out step by step, longest first: step t's tokens are neighbours."""

    def __init__(self, symbols: np.ndarray, offsets: np.ndarray):
        lengths = np.diff(offsets)
        self.order = np.argsort(-lengths, kind="stable")
        ordered = lengths[self.order]
        steps = int(ordered[0]) if len(ordered) else 0
        self.alive = np.searchsorted(-ordered, -np.arange(steps), "left")
        self.at = np.concatenate([[0], np.cumsum(self.alive)])
        step = k.ranges(np.zeros(len(ordered), np.int64), ordered)
        self.rank = np.empty(int(self.at[-1]), np.int64)
        place = self.at[step] + np.repeat(np.arange(len(ordered)), ordered)
        self.rank[place] = np.repeat(np.arange(len(ordered)), ordered)
        self.symbols = np.empty(int(self.at[-1]), np.int64)
        self.symbols[place] = symbols[k.ranges(offsets[:-1][self.order], ordered)]

    def forward(self, model: Model, keep: bool = False, begin: np.ndarray | None = None):
        """(scale of every token, scaled forward values or None, emissions).

        ``begin`` has each sequence's chances of the first state, where they aren't the model's.
        """
        emit = model.emit[self.symbols]
        scale = np.empty(len(emit))
        ahead = np.empty_like(emit) if keep else None
        first = model.start if begin is None else begin[self.order]
        a = None
        for t, n in enumerate(self.alive):
            lo = self.at[t]
            a = first * emit[lo : lo + n] if a is None else (a[:n] @ model.move) * emit[lo : lo + n]
            s = a.sum(axis=1)
            a /= s[:, None]
            scale[lo : lo + n] = s
            if keep:
                ahead[lo : lo + n] = a
        return scale, ahead, emit

    def log10_likelihood(self, model: Model, begin: np.ndarray | None = None) -> np.ndarray:
        scale, _, _ = self.forward(model, begin=begin)
        out = np.empty(len(self.order))
        out[self.order] = np.bincount(self.rank, np.log10(scale), len(self.order))
        return out

    def products(self, model: Model) -> np.ndarray:
        """For each sequence the matrix (up to a factor) from the chances of its first token's state to
        the forward values of its last token."""
        states = len(model.start)
        emit = model.emit[self.symbols]
        out = np.empty((len(self.order), states, states))
        a = None
        for t, n in enumerate(self.alive):
            e = emit[self.at[t] : self.at[t] + n, None, :]
            if a is None:
                a = np.eye(states)[None] * e
            else:
                if n < len(a):
                    out[self.order[n : len(a)]] = a[n:]
                a = (a[:n].reshape(-1, states) @ model.move).reshape(n, states, states) * e
            if t % 16 == 15:
                a /= a.sum(axis=(1, 2), keepdims=True)
        if a is not None:
            out[self.order[: len(a)]] = a
        return out

    def expected(self, model: Model, totals: Counts, carried: Carried | None = None) -> None:
        """Add the expected counts of these sequences (Baum-Welch) to ``totals``."""
        if not len(self.alive):
            return
        scale, ahead, emit = self.forward(model, True, None if carried is None else carried.begin)
        final = None if carried is None else carried.final[self.order]
        back = np.ones((0, len(model.start)))
        both = np.empty_like(ahead)
        for t in range(len(self.alive) - 1, -1, -1):
            lo, n = self.at[t], self.alive[t]
            if len(back) < n:  # sequences that end here
                m = len(back)
                new = np.ones((n - m, back.shape[1]))
                if final is not None:
                    new = final[m:n] / (ahead[lo + m : lo + n] * final[m:n]).sum(axis=1, keepdims=True)
                back = np.concatenate([back, new])
            both[lo : lo + n] = ahead[lo : lo + n] * back
            out = emit[lo : lo + n] * back / scale[lo : lo + n, None]
            if t:
                totals.move += (ahead[self.at[t - 1] : self.at[t - 1] + n].T @ out) * model.move
                back = out @ model.move.T
        starts = np.ones(int(self.alive[0]), bool)
        if carried is not None:
            starts = carried.is_first[self.order]
            totals.move += (carried.before[self.order][~starts].T @ out[~starts]) * model.move
        totals.start += both[: self.alive[0]][starts].sum(axis=0)
        for s in range(both.shape[1]):
            totals.emit[:, s] += np.bincount(self.symbols, both[:, s], len(totals.emit))
        totals.log10 += float(np.log10(scale).sum())


@dataclass(frozen=True)
class Carried:
    """What runs of texts get from the runs before and after them."""

    is_first: np.ndarray
    before: np.ndarray  # forward values of the token before the run
    begin: np.ndarray  # chances of the first token's state, given all before
    final: np.ndarray  # backward values of the last token (up to a factor)


def carry(runs: Packed, pieces: np.ndarray, model: Model) -> Carried:
    """Forward and backward values at the borders of runs; ``pieces`` has each text's number of runs."""
    products = runs.products(model)
    n, states = len(products), len(model.start)
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    ends = np.cumsum(pieces)
    first[ends - pieces], last[ends - 1] = True, True
    before, begin, final = np.zeros((n, states)), np.empty((n, states)), np.ones((n, states))
    for r in range(n):
        begin[r] = model.start if first[r] else before[r] @ model.move
        if not last[r]:
            a = begin[r] @ products[r]
            before[r + 1] = a / a.sum()
    for r in range(n - 1, -1, -1):
        if not first[r]:
            b = model.move @ (products[r] @ final[r])
            final[r - 1] = b / b.sum()
    return Carried(first, before, begin, final)


class Counts:
    def __init__(self, symbols: int, states: int):
        self.start, self.move, self.emit, self.log10 = np.zeros(states), np.zeros((states, states)), np.zeros((symbols, states)), 0.0

    def model(self, unigram: np.ndarray, strength: float) -> Model:
        """Most likely parameters, each drawn a little towards what the corpus has on the whole."""
        states = len(self.start)
        emit = self.emit + strength * unigram[:, None]
        move = self.move + strength / states
        start = self.start + strength / states
        return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def cut_runs(offsets: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of runs of at most ``run`` tokens within the sequences, and each one's number of runs."""
    lengths = np.diff(offsets)
    pieces = -(-lengths // run)
    begins = np.repeat(offsets[:-1], pieces) + run * k.ranges(np.zeros(len(pieces), np.int64), pieces)
    return np.concatenate([begins, offsets[-1:]]), pieces


def text_groups(ids: np.ndarray, offsets: np.ndarray, model: Model, run: int) -> Iterator[tuple[np.ndarray, Packed, Carried | None, np.ndarray]]:
    """Texts in groups of similar length: their rows, sequences, what these are carried, and the place of
    each sequence's text among the rows. Texts beyond eight runs are worked off in runs."""
    for rows in token_chunks(offsets):
        symbols, bounds = gather(ids, offsets, rows)
        if bounds[1] - bounds[0] <= 8 * run:  # the longest comes first
            yield rows, Packed(symbols, bounds), None, np.arange(len(rows))
        else:
            cut, pieces = cut_runs(bounds, run)
            packed = Packed(symbols, cut)
            yield rows, packed, carry(packed, pieces, model), np.repeat(np.arange(len(rows)), pieces)


def token_chunks(offsets: np.ndarray, most: int = 400_000) -> Iterator[np.ndarray]:
    """Rows in groups of similar length, of about ``most`` tokens each."""
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    group = np.cumsum(lengths[order]) // most
    yield from (x for x in np.split(order, np.flatnonzero(np.diff(group)) + 1) if len(x))


def gather(symbols: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(offsets)[rows]
    return symbols[k.ranges(offsets[:-1][rows], n)], np.concatenate([[0], np.cumsum(n)])


def count_words(texts: DataFrame) -> DataFrame:
    """(h, shape, c) of every distinct word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = k.text_buffer(batch.column(0))
            parts = []
            for lo, hi in k.row_chunks(offsets):
                part = raw[offsets[lo] : offsets[hi]]
                starts, ends, _ = k.word_spans(part, offsets[lo : hi + 1] - offsets[lo], k.NON_SPACE)
                h, first, c = np.unique(k.word_hashes(part, starts, ends), return_index=True, return_counts=True)
                parts.append((h, shapes(part, starts[first], ends[first]), c))
            if not parts:
                continue
            h, first, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
            c = np.bincount(inverse, np.concatenate([p[2] for p in parts]), len(h)).astype(np.int64)
            shape = np.concatenate([p[1] for p in parts])[first]
            yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(shape.astype(np.int32)), pa.array(c)], names=["h", "shape", "c"])

    counted = texts.mapInArrow(run, "h long, shape int, c long")
    return counted.groupBy("h").agg(F.min("shape").alias("shape"), F.sum("c").alias("c"))


def vocabulary(counts: DataFrame, texts: int, most_words: int) -> Vocabulary:
    """The frequent words: all with a count of at least the least one that lets them fit the table."""
    band = F.floor(F.log2(F.col("c").cast("double")) * 8)
    bands = counts.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c")).orderBy(F.desc("band")).collect()
    taken, least = 0, None
    for b in bands:
        if taken + b["n"] > most_words:
            break
        taken, least = taken + b["n"], b["band"]
    frequent = counts.where(band >= least) if least is not None else counts.limit(0)
    rare = counts.where(band < least) if least is not None else counts
    table = frequent.select("h", "c").toPandas()
    hashes = table.h.to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    total, types = np.zeros(SHAPES, np.int64), np.zeros(SHAPES, np.int64)
    for r in rare.groupBy("shape").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect():
        total[r["shape"]], types[r["shape"]] = r["c"], r["n"]
    return Vocabulary(hashes[order], table.c.to_numpy(np.int64)[order], total, types, texts, sum(b["c"] for b in bands) + texts, sum(b["n"] for b in bands) + (texts > 0))


def encode(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """row, doc_id, held_out, drawn (a number from id and text, for samples), symbols (with the end), known (frequent tokens), base (their part of the
    base score), within (what shapes take off the score), rare and rare_n (other words, distinct)."""
    logs = np.log10(v.counts.astype(np.float64) + 1)
    shape_log = np.log10(v.rare_total + v.rare_types + 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = k.text_buffer(batch.column(4))
            for lo, hi in k.row_chunks(offsets):
                rows = hi - lo
                part = raw[offsets[lo] : offsets[hi]]
                starts, ends, bounds = k.word_spans(part, offsets[lo : hi + 1] - offsets[lo], k.NON_SPACE)
                h = k.word_hashes(part, starts, ends)
                row = np.repeat(np.arange(rows), np.diff(bounds))
                at = np.minimum(np.searchsorted(v.hashes, h), max(0, len(v.hashes) - 1))
                frequent = v.hashes[at] == h if len(v.hashes) else np.zeros(len(h), bool)
                shape = shapes(part, starts, ends)
                ids = np.full(len(h) + rows, v.end, np.int32)
                ids[np.arange(len(h)) + row] = np.where(frequent, at, len(v.hashes) + shape)
                base = np.bincount(row[frequent], logs[at[frequent]], rows)
                within = np.bincount(row[~frequent], shape_log[shape[~frequent]], rows)
                other, other_row = h[~frequent], row[~frequent]
                order = np.lexsort((other, other_row))
                other, other_row = other[order], other_row[order]
                first = np.flatnonzero(np.r_[True, (other[1:] != other[:-1]) | (other_row[1:] != other_row[:-1])]) if len(other) else np.zeros(0, np.int64)
                rare_at = pa.array(np.searchsorted(other_row[first], np.arange(rows + 1)).astype(np.int32))
                yield pa.record_batch(
                    [
                        *(batch.column(c).slice(lo, rows) for c in range(4)),
                        pa.ListArray.from_arrays(pa.array((bounds + np.arange(rows + 1)).astype(np.int32)), pa.array(ids)),
                        pa.array(np.bincount(row[frequent], minlength=rows).astype(np.int64)),
                        pa.array(base.astype(np.float64)),  # without words numpy counts in integers
                        pa.array(within.astype(np.float64)),
                        pa.ListArray.from_arrays(rare_at, pa.array(other[first].view(np.int64))),
                        pa.ListArray.from_arrays(rare_at, pa.array(np.diff(np.r_[first, len(other)]).astype(np.int32))),
                    ],
                    names=["row", "doc_id", "held_out", "drawn", "symbols", "known", "base", "within", "rare", "rare_n"],
                )

    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(_DRAWS)).alias("drawn")
    return docs.select("row", "doc_id", "held_out", drawn, "text").mapInArrow(
        run, "row long, doc_id long, held_out boolean, drawn long, symbols array<int>, known long, base double, within double, rare array<long>, rare_n array<int>"
    )


def _sequences(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    lists = batch.column(column)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0]


def expected_counts(training: DataFrame, model: Model, symbols: int, run: int) -> Counts:
    """One Baum-Welch round over all of ``training``'s partitions."""
    states = len(model.start)
    names = [f"e{s}" for s in range(states)]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = Counts(symbols, states)
        for batch in batches:
            for _, packed, carried, _ in text_groups(*_sequences(batch, 0), model, run):
                packed.expected(model, totals, carried)
        used = np.flatnonzero(totals.emit.any(axis=1))
        if len(used):
            keys = np.concatenate([used, -1 - np.arange(states), [-1 - states, -2 - states]])
            extra = np.zeros((1, states))
            extra[0, 0] = totals.log10
            values = np.concatenate([totals.emit[used], totals.move, totals.start[None], extra])
            columns = [pa.array(np.ascontiguousarray(values[:, s])) for s in range(states)]
            yield pa.record_batch([pa.array(keys.astype(np.int32)), *columns], names=["symbol", *names])

    # a task's counts are a table of all its words, so fewer and larger tasks send less
    tasks = training.coalesce(max(1, training.rdd.getNumPartitions() // 2))
    parts = tasks.select("symbols").mapInArrow(step, "symbol int, " + ", ".join(f"{n} double" for n in names))
    table = parts.groupBy("symbol").agg(*(F.sum(n).alias(n) for n in names)).toPandas()
    totals = Counts(symbols, states)
    key, value = table.symbol.to_numpy(np.int64), table[names].to_numpy(np.float64)
    totals.emit[key[key >= 0]] = value[key >= 0]
    for i in np.flatnonzero(key < 0):
        n = int(-1 - key[i])
        if n < states:
            totals.move[n] = value[i]
        elif n == states:
            totals.start = value[i]
        else:
            totals.log10 = float(value[i, 0])
    return totals


def first_model(v: Vocabulary, states: int, seed: int = 11) -> Model:
    """A random emission table about the words' own shares, and states that tend to stay."""
    unigram = v.unigram()
    emit = unigram[:, None] * np.exp(np.random.default_rng(seed).normal(size=(len(unigram), states)))
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


def train(fit: DataFrame, v: Vocabulary, states: int, warm_rounds: int, warm_share: float, warm_tokens: int, most_rounds: int, least_gain: float, strength: float, run: int) -> tuple[Model, list[float]]:
    """The trained model, and the mean log10 likelihood of a token before each full round."""
    model, seen = first_model(v, states), []
    if not v.texts:
        return model, seen
    share = min(1.0, max(warm_share, warm_tokens / v.tokens))
    warm = materialize(fit.where(F.col("drawn") < int(share * _DRAWS)).select("symbols"), "op7-warm")
    for _ in range(warm_rounds):
        totals = expected_counts(warm, model, v.end + 1, run)
        model = totals.model(v.unigram(), strength) if totals.start.any() else model
    for _ in range(most_rounds):
        totals = expected_counts(fit, model, v.end + 1, run)
        model = totals.model(v.unigram(), strength)
        seen.append(totals.log10 / v.tokens)
        if len(seen) > 1 and seen[-1] - seen[-2] < least_gain:
            break
    return model, seen


def score_texts(
    docs: DataFrame, states: int = 8, most_words: int = 65_536, warm_rounds: int = 4, warm_share: float = 1 / 16, warm_tokens: int = 1 << 20, most_rounds: int = 6, least_gain: float = 5e-3, strength: float = 5.0, run: int = 512, mod: int = 7
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).

    Bound: ``most_words`` rows of the emission table; other words go through their shapes and a join on
    the full counts.
    """
    spark = docs.sparkSession
    ship_code(spark)
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), is_held_out(F.col("doc_id"), mod).alias("held_out"), F.col("text").cast("string").alias("text")
    )
    training = rows.where("not held_out")
    texts = training.count()
    counts = materialize(count_words(training.select("text")), "op7-counts")
    v = vocabulary(counts, texts, most_words)
    encoded = materialize(encode(rows, v), "op7-encoded")
    model, _ = train(encoded.where("not held_out").select("drawn", "symbols"), v, states, warm_rounds, warm_share, warm_tokens, most_rounds, least_gain, strength, run)

    def likelihood(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, offsets = _sequences(batch, 3)
            out = np.zeros(batch.num_rows)
            for chunk, packed, carried, of in text_groups(ids, offsets, model, run):
                own = packed.log10_likelihood(model, None if carried is None else carried.begin)
                out[chunk] = np.bincount(of, own, len(chunk))
            n = pa.array(np.diff(offsets))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(3)), n, *(batch.column(c) for c in range(4, 7)), pa.array(out)], names=["row", "doc_id", "held_out", "n_tokens", "known", "base", "within", "path"])

    scored = encoded.select("row", "doc_id", "held_out", "symbols", "known", "base", "within").mapInArrow(
        likelihood, "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, within double, path double"
    )
    words = encoded.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("x")).select("row", F.col("x.rare").alias("h"), F.col("x.rare_n").alias("n"))
    rare = words.join(counts.select("h", "c"), "h").groupBy("row").agg(F.sum("n").alias("rare_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("rare_log"))
    joined = scored.join(rare, "row", "left")
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    total = F.lit(float(np.log10(v.tokens + v.types + 1)))
    end_log = F.lit(float(np.log10(texts + 1)))
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0)) + F.lit(int(texts > 0))).alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + rare_log + end_log - F.col("n_tokens") * total).alias("base_score"),
        (F.col("path") + rare_log - F.col("within")).alias("score"),
    )
