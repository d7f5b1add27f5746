"""Operator 9: benchmark decontamination with a distributed positional inverted index.

The index is partitioned by document and built once, whatever is searched. A segment holds, for some
documents, every term (a 64-bit hash) with the sorted positions where it stands. Segments are rows of
a table in the shared folder, so an executor that is lost costs only the rebuilding of its rows. A
search reads segments and, for each test phrase whose terms a segment holds, intersects the
offset-adjusted position lists, from the phrase's rarest term there to its most frequent. No posting
is shuffled.

A proximity match of a phrase is a document with a place ``b`` so that every term ``i`` of the phrase
stands at most ``slop`` words from ``b + i``, all within the document. An item with an exact match is
not counted again as near.

Null or empty texts have no words and match nothing. Very long texts are one segment each. Repeated
rows are answered row by row. Test items without words are ignored; an item id that repeats counts
once; a null item id is ignored. Empty tables give no rows, an empty test set no hits. Extra columns,
of whatever name, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as k
from .common import materialize, ship_code

SEGMENT_SCHEMA = (
    "rows array<long>, doc_ids array<long>, doc_nulls array<boolean>, doc_starts array<int>,"
    " terms array<long>, term_starts array<int>, positions array<int>"
)
MATCH_SCHEMA = "row long, doc_id long, n_words long, starts array<int>, ends array<int>, item_ids array<long>, near_ids array<long>"
_SEGMENT_BYTES = 1 << 21
_GROUP_BYTES = 1 << 23
_MOST_PLACES = 1 << 21
_NEVER = 1 << 40


@dataclass(frozen=True)
class Phrases:
    """The test phrases of one block of items."""

    vocabulary: np.ndarray  # sorted term hashes
    terms: np.ndarray  # phrases x window: term numbers, -1 beyond a phrase's end
    lengths: np.ndarray
    owner_starts: np.ndarray  # where each phrase's items begin in ``owners``
    owners: np.ndarray


_TO_SPACE = bytes(int(k.LOWER[i]) if k.ALNUM[i] else 32 for i in range(256))


def item_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TO_SPACE).split()


def phrases_of(items: list[tuple[int | None, str | None]], window: int) -> Phrases:
    """Windows of ``window`` consecutive words; a shorter item is one window."""
    owners: dict[tuple[bytes, ...], set[int]] = {}
    for item, text in items:
        words = item_words(text)
        if item is not None and words:
            for i in range(max(1, len(words) - window + 1)):
                owners.setdefault(tuple(words[i : i + window]), set()).add(item)
    words = sorted({w for p in owners for w in p})
    hashes = np.array([k.hash_of(w) for w in words], k.U)
    order = np.argsort(hashes)
    number = {words[j]: i for i, j in enumerate(order)}
    terms = np.full((len(owners), window), -1, np.int32)
    for row, phrase in enumerate(owners):
        terms[row, : len(phrase)] = [number[w] for w in phrase]
    held = [sorted(x) for x in owners.values()]
    flat = np.array([i for x in held for i in x], np.int64)
    return Phrases(hashes[order], terms, (terms >= 0).sum(axis=1), np.cumsum([0, *map(len, held)]), flat)


def build_index(docs: DataFrame) -> DataFrame:
    """One row for each segment; see the module's text. Columns: SEGMENT_SCHEMA."""
    ship_code(docs.sparkSession)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = k.text_buffer(batch.column(2))
            for lo, hi in k.row_chunks(offsets, _SEGMENT_BYTES):
                own = [batch.column(c).slice(lo, hi - lo) for c in (0, 1)]
                yield _segment(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], *own)

    row = F.monotonically_increasing_id().alias("row")
    return docs.select(row, F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(segments, SEGMENT_SCHEMA)


def _segment(raw: np.ndarray, offsets: np.ndarray, rows: pa.Array, ids: pa.Array) -> pa.RecordBatch:
    starts, ends, row_words = k.word_spans(raw, offsets, k.ALNUM)
    hashes = k.word_hashes(raw, starts, ends)
    positions = np.argsort(hashes, kind="stable")
    hashes = hashes[positions]
    first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]]) if len(hashes) else np.zeros(0, np.int64)
    one = lambda a, kind: pa.array([a], pa.list_(kind))
    return pa.record_batch(
        [
            one(rows.to_numpy(), pa.int64()),
            one(ids.fill_null(0).to_numpy(zero_copy_only=False), pa.int64()),
            one(ids.is_null().to_numpy(zero_copy_only=False), pa.bool_()),
            one(row_words.astype(np.int32), pa.int32()),
            one(hashes[first].view(np.int64), pa.int64()),
            one(np.r_[first, len(hashes)].astype(np.int32), pa.int32()),
            one(positions.astype(np.int32), pa.int32()),
        ],
        names=["rows", "doc_ids", "doc_nulls", "doc_starts", "terms", "term_starts", "positions"],
    )


class Segment:
    """A segment's lists, ready for intersection."""

    def __init__(self, row: pa.RecordBatch):
        get = lambda name: row.column(name).flatten().to_numpy(zero_copy_only=False)
        self.rows, self.ids, self.nulls = get("rows"), get("doc_ids"), get("doc_nulls").astype(bool)
        self.bounds = get("doc_starts").astype(np.int64)
        self.terms, self.positions = get("terms").view(np.uint64), get("positions").astype(np.int64)
        self.starts = get("term_starts").astype(np.int64)
        self.width = int(self.bounds[-1]) + 1
        # (term, position) as one sorted number, so that a list is searched without being cut out
        self.places = np.repeat(np.arange(len(self.terms)), np.diff(self.starts)) * self.width + self.positions

    def has(self, place: np.ndarray) -> np.ndarray:
        return self.places[np.minimum(np.searchsorted(self.places, place), len(self.places) - 1)] == place

    def between(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether any place lies in ``low`` to ``high``, both included."""
        at = np.searchsorted(self.places, low)
        return (low <= high) & (self.places[np.minimum(at, len(self.places) - 1)] <= high) & (at < len(self.places))


def search_segment(s: Segment, test: Phrases, slop: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Exact matches (phrase, begin) and near ones (phrase, document) of one segment; none near without slop."""
    none = np.zeros(0, np.int64)
    if not len(test.terms) or not len(s.terms):
        return none, none, none, none
    at = np.minimum(np.searchsorted(s.terms, test.vocabulary), len(s.terms) - 1)
    held = np.where(s.terms[at] == test.vocabulary, np.diff(s.starts)[at], 0)
    counts = np.where(test.terms >= 0, held[test.terms], _NEVER)
    phrase = np.flatnonzero(counts.min(axis=1) > 0)
    counts = counts[phrase]
    order = np.argsort(counts, axis=1, kind="stable")  # rarest first
    found = [(none, none, none, none)]
    least = counts[np.arange(len(phrase)), order[:, 0]]
    for lo, hi in k.row_chunks(np.r_[0, np.cumsum(least)], _MOST_PLACES):
        found.append(_intersect(s, test, slop, at, phrase[lo:hi], order[lo:hi], least[lo:hi]))
    exact, begin, near, doc = (np.concatenate(x) for x in zip(*found, strict=True))
    return exact, begin, near, doc


def _intersect(s: Segment, test: Phrases, slop: int | None, at: np.ndarray, phrase: np.ndarray, order: np.ndarray, least: np.ndarray):
    """Postings of each phrase's rarest term, narrowed by the other terms' lists in order of rarity."""
    rarest = order[:, 0]
    list_of = at[test.terms[phrase, rarest]]
    place = s.positions[k.ranges(s.starts[list_of], least)]
    mine = np.repeat(np.arange(len(phrase)), least)
    doc = np.searchsorted(s.bounds, place, "right") - 1
    begin = place - rarest[mine]
    low, high = s.bounds[doc], s.bounds[doc + 1]

    def steps(rows: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Offset and list of each row's j-th rarest term, and the rows whose phrase has so many."""
        offset = order[mine[rows], j]
        term = test.terms[phrase[mine[rows]], offset]
        return offset, at[term] * s.width, term >= 0

    alive = np.flatnonzero((begin >= low) & (begin + test.lengths[phrase[mine]] <= high))
    for j in range(1, order.shape[1]):
        offset, base, real = steps(alive, j)
        alive = alive[~real | s.has(base + begin[alive] + offset)]
    if slop is None:
        return phrase[mine[alive]], begin[alive], alive[:0], alive[:0]
    close = np.arange(len(place))
    shift = np.zeros(len(place), np.int64)
    for reach in (2 * slop, slop):  # all places that could be near, then each of their beginnings
        for j in range(order.shape[1]):
            offset, base, real = steps(close, j)
            middle = begin[close] + shift + offset
            inside = s.between(base + np.maximum(middle - reach, low[close]), base + np.minimum(middle + reach, high[close] - 1))
            close, shift = close[~real | inside], shift[~real | inside]
        if reach != slop:
            close, shift = np.repeat(close, 2 * slop + 1), np.tile(np.arange(-slop, slop + 1), len(close))
    near = np.unique(np.stack([phrase[mine[close]], doc[close]]), axis=1)
    return phrase[mine[alive]], begin[alive], near[0], near[1]


def search_index(index: DataFrame, test: Phrases, slop: int = 2) -> DataFrame:
    """Exact and proximity matches of every indexed document.

    Columns: row (of the index), doc_id, n_words, starts and ends (word positions of the joined hit
    intervals within the document, end exclusive), item_ids (exact matches), near_ids (others).
    """
    ship_code(index.sparkSession)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                s = Segment(batch.slice(row, 1))
                yield _answer(s, test, *search_segment(s, test, slop))

    return index.mapInArrow(search, MATCH_SCHEMA)


def _answer(s: Segment, test: Phrases, exact: np.ndarray, begin: np.ndarray, near: np.ndarray, near_doc: np.ndarray) -> pa.RecordBatch:
    n = len(s.ids)
    edge = np.zeros(s.width, np.int32)
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + test.lengths[exact], -1)
    hit = np.cumsum(edge[:-1]) > 0
    before, after = np.zeros_like(hit), np.zeros_like(hit)
    before[1:], after[:-1] = hit[:-1], hit[1:]
    before[s.bounds[:-1][s.bounds[:-1] < len(hit)]] = False
    after[s.bounds[1:][s.bounds[1:] > 0] - 1] = False
    first, stop = np.flatnonzero(hit & ~before), np.flatnonzero(hit & ~after) + 1
    cut = np.searchsorted(first, s.bounds)
    of_doc = np.repeat(s.bounds[:-1], np.diff(cut))
    offsets = pa.array(cut.astype(np.int32))
    items = _pairs(test, exact, np.searchsorted(s.bounds, begin, "right") - 1)
    close = _pairs(test, near, near_doc)
    return pa.record_batch(
        [
            pa.array(s.rows),
            pa.array(s.ids, pa.int64(), mask=s.nulls),
            pa.array(np.diff(s.bounds)),
            pa.ListArray.from_arrays(offsets, pa.array((first - of_doc).astype(np.int32))),
            pa.ListArray.from_arrays(offsets, pa.array((stop - of_doc).astype(np.int32))),
            _lists(n, items),
            _lists(n, close - items),
        ],
        names=["row", "doc_id", "n_words", "starts", "ends", "item_ids", "near_ids"],
    )


def _pairs(test: Phrases, phrase: np.ndarray, doc: np.ndarray) -> set[tuple[int, int]]:
    """(document, item) of matched phrases."""
    n = np.diff(test.owner_starts)[phrase]
    item = test.owners[k.ranges(test.owner_starts[phrase], n)]
    return set(zip(np.repeat(doc, n).tolist(), item.tolist(), strict=True))


def _lists(n: int, pairs: set[tuple[int, int]]) -> pa.Array:
    ordered = np.array(sorted(pairs), np.int64).reshape(-1, 2)
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(ordered[:, 0], np.arange(n + 1)).astype(np.int32)), pa.array(ordered[:, 1]))


def item_blocks(benchmark: DataFrame, window: int, block_bytes: int) -> Iterator[Phrases]:
    """The test set in blocks of about ``block_bytes`` of text, dealt by a hash of id and text.

    One block at a time is on the driver, so its size does not follow that of the test set, however often
    an id repeats.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    if blocks == 1:
        yield phrases_of([tuple(r) for r in items.collect()], window)
        return
    items = materialize(items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))).repartition("block"), "op9-items")
    for b in range(blocks):
        yield phrases_of([tuple(r) for r in items.where(F.col("block") == b).drop("block").collect()], window)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, slop: int = 2, block_bytes: int = 1 << 20) -> DataFrame:
    """Words of every document that lie in an occurrence of a test window.

    Columns: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (a word is hit and ``share``
    times the hit words reach the words), item_ids, n_near and near_ids (items with a proximity match
    only). The corpus is read and indexed once; test items are searched block by block.
    """
    index = materialize(build_index(docs), "op9-index", _GROUP_BYTES)
    blocks = item_blocks(benchmark, window, block_bytes)
    first = next(blocks)
    found = search_index(index, first, slop)
    others = [materialize(search_index(index, test, slop).where("size(item_ids) > 0 or size(near_ids) > 0"), "op9-block") for test in blocks]
    if not others:
        lengths = F.zip_with("starts", "ends", lambda a, b: (b - a).cast("long"))
        return found.select("doc_id", "n_words", *_summary(share, F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x), F.col("near_ids")))
    every = found.select("row", "doc_id", "n_words", "starts", "ends", "item_ids", "near_ids")
    for other in others:
        every = every.unionByName(other)
    gathered = every.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list(F.arrays_zip("starts", "ends")))).alias("spans"),
        *(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("item_ids", "near_ids")),
    )
    hit = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda a, s: F.struct((a["n"] + F.greatest(s["ends"] - F.greatest(s["starts"], a["end"]), F.lit(0))).alias("n"), F.greatest(a["end"], s["ends"]).alias("end")),
    )["n"]
    return gathered.select("doc_id", "n_words", *_summary(share, hit, F.array_except("near_ids", "item_ids")))


def mark_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, block_bytes: int = 1 << 20) -> DataFrame:
    """All columns of ``docs`` and ``contaminated``, by the rule of :func:`decontaminate`.

    The verdict is found in the pass that holds the text: a batch is indexed, its index searched and
    forgotten. So rows need no number and no join, and nothing is shuffled. Each block of items is one more
    such pass over the rows. A column ``contaminated`` of ``docs`` is replaced.
    """
    ship_code(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() != "contaminated"]
    named = docs.select(F.col("text").cast("string").alias("body"), F.lit(None).cast("array<int>").alias("spans"), F.lit(0).cast("long").alias("n_words"), *(F.col(f"`{c}`").alias(f"user{i}") for i, c in enumerate(kept)))

    def marked(rows: DataFrame, test: Phrases) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raw, offsets = k.text_buffer(batch.column(0))
                for lo, hi in k.row_chunks(offsets, _SEGMENT_BYTES):
                    part = batch.slice(lo, hi - lo)
                    ids = pa.array(np.zeros(hi - lo, np.int64))
                    s = Segment(_segment(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], ids, ids))
                    exact, begin, _, _ = search_segment(s, test, None)
                    spans = part.column(1).to_pylist()
                    end = begin + test.lengths[exact]
                    doc = np.searchsorted(s.bounds, begin, "right") - 1
                    for d, a, b in zip(doc.tolist(), (begin - s.bounds[doc]).tolist(), (end - s.bounds[doc]).tolist(), strict=True):
                        spans[d] = [*(spans[d] or []), a, b]
                    found = pa.array([None if x is None else joined(x) for x in spans], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([part.column(0), found, pa.array(np.diff(s.bounds)), *part.columns[3:]], names=part.schema.names)

        return rows.mapInArrow(run, rows.schema)

    for test in item_blocks(benchmark, window, block_bytes):
        named = marked(named, test)
    steps = F.transform(F.coalesce("spans", F.array().cast("array<int>")), lambda x, i: F.when(i % 2 == 0, -x).otherwise(x))
    hit = F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)
    verdict = (hit > 0) & (hit * share >= F.col("n_words"))
    return named.select(*(F.col(f"user{i}").alias(c) for i, c in enumerate(kept)), verdict.alias("contaminated"))


def joined(spans: list[int]) -> list[int]:
    """Begins and ends in turn, in order, of spans that overlap no more."""
    out: list[int] = []
    for a, b in sorted(zip(spans[::2], spans[1::2], strict=True)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _summary(share: int, hit: Column, near: Column) -> list[Column]:
    names = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    return [
        hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"),
        ((hit > 0) & (hit * share >= F.col("n_words"))).alias("contaminated"),
        F.col("item_ids"),
        F.size(near).cast("long").alias("n_near"),
        near.alias("near_ids"),
    ]


def items_digest(items: list[int]) -> str:
    """The digest of ``items_sha256``, for tests."""
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
