"""Operator 12: substring dedup by recompression.

A text is compressed in rounds. The first gives every maximal run of one token a name; each further one
parts the names in left and right ones and gives every pair of a left and a right neighbour a name. A name
is a digest of what it stands for, so all partitions agree on the names of a round without asking each
other, and whether a pair is joined depends on nothing but the pair. So within a window of tokens all
symbols but those at its edges (whose partner may lie outside) are the same wherever the window stands.
The longest of these interior symbols (all of three words or more alike), of equally long ones that of
greatest digest, is the window's symbol; a window without any is its own. More rounds of pairs give longer
symbols but fewer interior ones, so more rows; two leave 0.19 rows for each window.

1. Neighbouring windows of one symbol are one row: the symbol, the document and a mark of 40 bits for each
   window. A whole document is a symbol too, with all its words as its window; a document whose whole
   symbol stands in a smaller id of the same batch sends nothing else.
2. The rows of a symbol meet. Where only one document has it, no window of it repeats. Else the windows of
   equal marks are compared: a window also found under a smaller id is a repeat. So symbols reveal repeats,
   and symbol and mark (98 bits) verify them.
3. Symbols that a sample shows to fill a fourth of a task are dealt by document. Their rows have few
   shapes (the marks that stand side by side), as they come from copies: the least id of each shape is
   combined before the shuffle, windows are compared among shapes, and each row gets its shape's answer.
4. Repeats are brought back to the texts by row number, and the words that they cover are taken out.

Null and empty texts have no words. A text of fewer words than a window loses none. Rows without an id
lose no word and take none from others; rows that share an id take none from each other, each loses what a
smaller id has. A very long text is worked off in segments that overlap by a window. An empty table gives
no rows. Extra columns, of whatever name, are not read.

Bound: all tasks know the frequent symbols, four for each shuffle partition at most. Any other has less than
a fourth of a partition's rows (or some hundreds), which a task holds at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as k
from .common import materialize, numbered, ship_code

PAIR_ROUNDS = 2
LONG = 3
SEGMENT = 1 << 16
_MARK = 5  # bytes
_A, _B = k.U(0xD6E8FEB86659FD93), k.U(0xA0761D6478BD642F)
_LOG2 = np.array([0, 0, 1, 1, 2, 2, 2, 2, *[3] * 8, *[4] * 16])


class Symbols:
    """The symbols of a round over a stretch of tokens: names, words that each stands for, rows."""

    def __init__(self, tokens: np.ndarray, row: np.ndarray):
        """Round of runs: every maximal run of one token is a symbol."""
        new = np.ones(len(tokens), bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(new)
        self.words = np.diff(np.r_[first, len(tokens)])
        self.names = np.where(self.words > 1, k.mix(tokens[first] * _A + self.words.astype(k.U)), tokens[first])
        self.row = row[first]
        self.place = np.cumsum(new) - 1  # of each token's symbol

    def join_pairs(self, turn: int) -> np.ndarray:
        """Round of pairs: every left name and the right name behind it become one symbol. Gives which of
        the former symbols were left ones; ``place`` then has each one's new symbol."""
        salt = k.mix(np.array([turn + 1], k.U))
        left = k.mix(self.names ^ salt) >> k.U(63) == 1
        pair = np.zeros(len(left), bool)
        pair[:-1] = left[:-1] & ~left[1:] & (self.row[:-1] == self.row[1:])
        head = np.ones(len(left), bool)
        head[1:] = ~pair[:-1]
        first, partner = np.flatnonzero(head), np.append(self.names[1:], self.names[:1])
        joined = pair[first]
        names = np.where(joined, k.mix(self.names[first] * _A + partner[first] * _B + salt), self.names[first])
        self.words = self.words[first] + np.where(joined, np.append(self.words[1:], 0)[first], 0)
        self.names, self.row, self.place = names, self.row[first], np.cumsum(head) - 1
        return left

    def ranks(self) -> np.ndarray:
        """Longer symbols before shorter ones, then by digest: 64 bits that stand for the symbol."""
        return (np.minimum(self.words, LONG).astype(k.U) << k.U(58)) | (k.mix(self.names ^ _B) >> k.U(6))


def greatest(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The greatest value of each range a..b (both included, of less than 32 values)."""
    tables = [values]
    for step in (1, 2, 4, 8)[: int(_LOG2[int((b - a).max()) + 1])]:
        last = tables[-1]
        tables.append(np.append(np.maximum(last[:-step], last[step:]), last[len(last) - step :]) if len(last) > step else last)
    power = _LOG2[b - a + 1]
    out = np.zeros(len(a), k.U)
    for p, table in enumerate(tables):
        at = np.flatnonzero(power == p)
        out[at] = np.maximum(table[a[at]], table[b[at] - (1 << p) + 1])
    return out


def window_symbols(tokens: np.ndarray, row: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, symbol, digest) of every window that lies in one row."""
    n = len(tokens) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, k.U), np.zeros(0, k.U)
    at = np.flatnonzero(row[:n] == row[window - 1 :])
    digest = tokens[:n].copy()
    for i in range(1, window):
        digest = digest * _A + tokens[i : i + n]
    digest = k.mix(digest[at])
    found = np.zeros(len(at), k.U)
    symbols = Symbols(tokens, row)
    # the run at either edge may go on outside
    live, a, b = np.arange(len(at)), symbols.place[at] + 1, symbols.place[at + window - 1] - 1
    for turn in range(PAIR_ROUNDS + 1):
        inside = a <= b
        live, a, b = live[inside], a[inside], b[inside]
        if not len(live):
            break
        found[live] = np.maximum(found[live], greatest(symbols.ranks(), a, b))
        if turn < PAIR_ROUNDS:
            left = symbols.join_pairs(turn)
            # a right symbol at the front edge and a left one at the back may have their partners outside
            a, b = a + ~left[a], b - left[b]
            inside = a <= b
            live, a, b = live[inside], symbols.place[a[inside]], symbols.place[b[inside]]
    return at, np.where(found > 0, found, digest >> k.U(6)), digest


def _marks(digests: np.ndarray) -> np.ndarray:
    return digests.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_MARK]


_ROWS = "name long, row long, doc long, at int, span int, hot boolean, marks binary"


def symbol_rows(texts: DataFrame, window: int, hot: np.ndarray) -> DataFrame:
    """A row for neighbouring windows of one symbol: ``at`` is the first one's place, ``span`` the words of
    each, ``marks`` has 40 bits for each. ``hot`` symbols are told apart."""

    def whole(tokens: np.ndarray, bounds: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows of enough words, their digests, which rows are copies of a smaller id)."""
        long = np.flatnonzero(np.diff(bounds) >= window)
        digests = np.array([np.frombuffer(hashlib.blake2b(tokens[bounds[i] : bounds[i + 1]].tobytes(), digest_size=16).digest(), k.U) for i in long], k.U).reshape(-1, 2)
        copies = np.zeros(len(docs), bool)
        if len(long):
            _, same = np.unique(digests, axis=0, return_inverse=True)
            least = np.full(same.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, same.ravel(), docs[long])
            copies[long] = docs[long] > least[same.ravel()]
        return long, digests, copies

    def batch_of(name: np.ndarray, row: np.ndarray, doc: np.ndarray, at: np.ndarray, span: np.ndarray, counts: np.ndarray, marks: np.ndarray) -> pa.RecordBatch:
        offsets = np.concatenate([[0], np.cumsum(counts) * _MARK]).astype(np.int32)
        packed = pa.BinaryArray.from_buffers(pa.binary(), len(name), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(marks).tobytes())])
        place = np.minimum(np.searchsorted(hot, name), max(0, len(hot) - 1))
        is_hot = hot[place] == name if len(hot) else np.zeros(len(name), bool)
        columns = [pa.array(name.view(np.int64)), pa.array(row), pa.array(doc), pa.array(at.astype(np.int32)), pa.array(span.astype(np.int32)), pa.array(is_hot), packed]
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _ROWS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, docs = (batch.column(c).to_numpy() for c in (0, 1))
            raw, offsets = k.text_buffer(batch.column(2))
            for lo, hi in k.row_chunks(offsets):
                part = raw[offsets[lo] : offsets[hi]]
                starts, ends, bounds = k.word_spans(part, offsets[lo : hi + 1] - offsets[lo], k.NON_SPACE)
                tokens = k.word_hashes(part, starts, ends, k.UNCHANGED)
                own, doc = ids[lo:hi], docs[lo:hi]
                long, digests, copies = whole(tokens, bounds, doc)
                if len(long):
                    ones, words = np.ones(len(long), np.int64), np.diff(bounds)[long]
                    yield batch_of(digests[:, 0].copy(), own[long], doc[long], 0 * ones, words, ones, _marks(digests[:, 1]))
                row = np.repeat(np.arange(hi - lo), np.diff(bounds))
                place = np.arange(len(tokens)) - bounds[row]
                kept = ~copies[row]
                tokens, row, place = tokens[kept], row[kept], place[kept]
                for begin in range(0, len(tokens), SEGMENT):
                    piece = slice(begin, begin + SEGMENT + window - 1)
                    at, name, digest = window_symbols(tokens[piece], row[piece], window)
                    if not len(at):
                        continue
                    first = np.flatnonzero(np.r_[True, (name[1:] != name[:-1]) | (at[1:] != at[:-1] + 1)])
                    of = row[piece][at[first]]
                    yield batch_of(name[first], own[of], doc[of], place[piece][at[first]], np.full(len(first), window), np.diff(np.r_[first, len(at)]), _marks(digest))

    return texts.select("row", "doc", "text").mapInArrow(run, _ROWS)


def hot_symbols(texts: DataFrame, window: int, share: int, parts: int) -> np.ndarray:
    """Symbols that would fill a fourth of one of ``parts`` tasks, by a sample of documents; so ``4 * parts``
    at most."""
    sampled = texts.where(F.pmod(F.xxhash64(F.lit("hot"), "row"), F.lit(share)) == 0)
    counts = materialize(symbol_rows(sampled, window, np.zeros(0, k.U)).groupBy("name").agg(F.count(F.lit(1)).alias("n")), "op12-sample")
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = max(16, -(-total // (4 * parts)))
    return np.sort(counts.where(F.col("n") >= least).select("name").toPandas().name.to_numpy(np.int64).view(k.U))


def unpacked(marks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(number of marks of each row, all marks)."""
    offsets = np.frombuffer(marks.buffers()[1], np.int32)[marks.offset : marks.offset + len(marks) + 1].astype(np.int64)
    body = np.frombuffer(marks.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    wide = np.zeros((len(body) // _MARK, 8), np.uint8)
    wide[:, :_MARK] = body.reshape(-1, _MARK)
    return np.diff(offsets) // _MARK, wide.view("<u8").ravel().astype(k.U)


_FOUND = "row long, start int, end int, name long, doc long, span int, marks binary"
_FOUND_NAMES = [x.split()[0] for x in _FOUND.split(", ")]


def _spans(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    n = len(row)
    columns = [pa.array(row), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=_FOUND_NAMES)


def _repeats(table: pa.Table) -> pa.RecordBatch | None:
    """Spans of the windows that also stand under a smaller id; whole groups of rows of one symbol."""
    name = table["name"].to_numpy()
    doc, row, at, span = (table[c].to_numpy() for c in ("doc", "row", "at", "span"))
    first = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
    shared = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
    sizes = np.diff(np.r_[first, len(name)])
    taken = np.repeat(shared, sizes)
    if not taken.any():
        return None
    group = np.repeat(np.cumsum(shared), sizes)[taken].astype(k.U)
    marks = table["marks"].filter(pa.array(taken)).combine_chunks()
    counts, mark = unpacked(marks if isinstance(marks, pa.Array) else pa.concat_arrays(marks.chunks))
    doc, row, at, span = doc[taken], row[taken], at[taken], span[taken]
    of = np.repeat(np.arange(len(doc)), counts)
    within = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    order = np.lexsort((mark, group[of]))
    g, m, d = group[of][order], mark[order], doc[of][order]
    begin = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (m[1:] != m[:-1])])
    least = np.repeat(np.minimum.reduceat(d, begin), np.diff(np.r_[begin, len(d)]))
    repeat = np.zeros(len(of), bool)
    repeat[order] = d > least
    hit = np.flatnonzero(repeat)
    if not len(hit):
        return None
    head = np.r_[True, (of[hit][1:] != of[hit][:-1]) | (within[hit][1:] != within[hit][:-1] + 1)]
    tail = np.r_[head[1:], True]
    a, b = hit[head], hit[tail]
    return _spans(row[of[a]], at[of[a]] + within[a], at[of[b]] + within[b] + span[of[b]])


def compare(rows: DataFrame, parts: int) -> DataFrame:
    """Spans (row, start, end) of repeats; rows of hot symbols are passed on with their marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def answer() -> Iterator[pa.RecordBatch]:
            if held:
                found = _repeats(pa.Table.from_batches(held))
                if found is not None:
                    yield found

        for whole in batches:
            is_hot = whole["hot"]
            hot = whole.filter(is_hot)
            if len(hot):
                yield pa.RecordBatch.from_arrays([hot["row"], hot["at"], pa.nulls(len(hot), pa.int32()), hot["name"], hot["doc"], hot["span"], hot["marks"]], names=_FOUND_NAMES)
            batch = whole.filter(pa.array(~is_hot.to_numpy(zero_copy_only=False)))
            if not len(batch):
                continue
            name = batch["name"].to_numpy()
            last = int(np.searchsorted(name != name[-1], False)) if name[0] != name[-1] else 0  # rows are sorted: where the last name begins
            if last:
                held.append(batch.slice(0, last))
                yield from answer()
                held = []
            elif held and held[-1]["name"][-1].as_py() != name[0]:
                yield from answer()
                held = []
            held.append(batch.slice(last))
        yield from answer()

    deal = F.when(F.col("hot"), F.xxhash64("name", "row")).otherwise(F.col("name"))
    return rows.repartition(parts, deal).sortWithinPartitions("name").mapInArrow(run, _FOUND)


def hot_repeats(hot: DataFrame) -> DataFrame:
    """(row, spans) of repeats among the rows of hot symbols: each window against the least id that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, mark = unpacked(batch["marks"])
            of = np.repeat(np.arange(len(batch)), counts)
            within = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
            held = batch.select(["shape", "name", "least", "most"]).take(pa.array(of))
            yield pa.RecordBatch.from_arrays([*held.columns, pa.array(mark.view(np.int64)), pa.array(within.astype(np.int32))], names=["shape", "name", "least", "most", "mark", "within"])

    shapes = hot.groupBy("name", "marks").agg(F.min("doc").alias("least"), F.max("doc").alias("most"))
    shapes = materialize(shapes.withColumn("shape", F.monotonically_increasing_id()), "op12-shapes")
    windows = shapes.mapInArrow(run, "shape long, name long, least long, most long, mark long, within int")
    shared = windows.groupBy("name", "mark").agg(F.min("least").alias("first"), F.max("most").alias("last")).where("first < last")
    answers = windows.select("shape", "name", "mark", "within").join(shared.select("name", "mark", "first"), ["name", "mark"])
    answers = answers.groupBy("shape").agg(F.collect_list(F.struct("within", "first")).alias("firsts"))
    answers = materialize(shapes.select("shape", "name", "marks").join(answers, "shape").drop("shape"), "op12-answers")
    found = hot.select("row", "start", "doc", "span", "name", "marks").join(answers, ["name", "marks"])
    mine = F.filter("firsts", lambda x: x["first"] < F.col("doc"))
    spans = F.transform(mine, lambda x: F.struct((F.col("start") + x["within"]).alias("start"), (F.col("start") + x["within"] + F.col("span")).alias("end")))
    return found.select("row", spans.alias("spans")).where(F.size("spans") > 0)


def remove_repeats(docs: DataFrame, window: int = 13, share: int = 32) -> DataFrame:
    """doc_id, text (the words that stay, one space between), n_words, n_removed of every row.

    ``share``: one of so many documents is looked at to find frequent symbols, which decides where windows
    are compared and not whether.
    """
    if not 3 <= window < 32:
        raise ValueError("a window has 3 to 31 words")
    spark = docs.sparkSession
    ship_code(spark)
    rows = numbered(docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text")), "op12-rows")
    texts = rows.where("doc is not null")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot = hot_symbols(texts, window, share, parts)
    found = materialize(compare(symbol_rows(texts, window, hot), parts), "op12-found")
    cold = found.where("marks is null").select("row", F.array(F.struct("start", "end")).alias("spans"))
    covered = cold.unionAll(hot_repeats(found.where("marks is not null"))).groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in k.row_slices(whole, 1):
                lists = batch["spans"]
                kept, sizes, removed = [], [], []
                for text, spans in zip(batch["text"].to_pylist(), lists, strict=True):
                    words = (text or "").encode().split()  # at space and the control characters 9 to 13
                    sizes.append(len(words))
                    if spans.is_valid:
                        out = np.zeros(len(words) + 1, np.int64)
                        np.add.at(out, spans.values.field("start").to_numpy(), 1)
                        np.add.at(out, spans.values.field("end").to_numpy(), -1)
                        words = [w for w, c in zip(words, np.cumsum(out[:-1]).tolist(), strict=True) if not c]
                    kept.append(b" ".join(words).decode())
                    removed.append(sizes[-1] - len(words))
                yield pa.RecordBatch.from_arrays([batch["doc"], pa.array(kept, pa.string()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64())], names=["doc_id", "text", "n_words", "n_removed"])

    # texts of all sizes are shuffled once, as the spans follow the corpus
    joined = rows.join(covered.hint("shuffle_hash"), "row", "left")
    return joined.select("doc", "text", "spans").mapInArrow(run, "doc_id long, text string, n_words long, n_removed long")


ORACLE = r"""
with t as materialized (select row_number() over () n, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
win as materialized (select n, doc_id, i, array_to_string(w[i:i + 12], ' ') k from (select n, doc_id, w, unnest(range(1, len(w) - 11)) i from t where len(w) >= 13)),
least as (select k, min(doc_id) d from win group by k),
gone as (select distinct n, unnest(range(i, i + 13)) p from win join least using (k) where d < doc_id),
kept as (select x.n, string_agg(x.word, ' ' order by x.p) words, count(*) c
  from (select n, unnest(w) word, unnest(range(1, len(w) + 1)) p from t) x left join gone g on x.n = g.n and x.p = g.p where g.p is null group by x.n)
select doc_id, len(w)::bigint n_words, (len(w) - coalesce(c, 0))::bigint n_removed, sha256(coalesce(words, '')) kept_sha256 from t left join kept using (n)"""
