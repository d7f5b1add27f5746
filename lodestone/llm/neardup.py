"""Operator 6: near-duplicate groups with circulant MinHash.

1. A pass over the texts gives each document its set of word shingles (64-bit hashes), a 128-bit
   digest of the set and a MinHash signature from two permutations of a ring: sigma shuffles the
   places that shingles fall on, pi ranks them, and coordinate k is the least rank over the set with pi
   shifted by k places. The coordinates of one place are neighbours in memory, so they cost one copy.
   Shingles that fall on one place (the ring has 2**20) only add candidates; links are decided on sets.
2. Documents with equal sets (by all 128 bits) are one set. Rows of each signature band are keys; a set
   is linked to the least one that shares a key. Components of these links hold every linked pair (but
   for the banding's miss rate, 2e-7 at the threshold with the defaults).
3. A component of at most ``block_docs`` sets and ``block_shingles`` shingles is compared in one task by
   a product of sparse 0/1 matrices. In a larger one every set is first compared with the least set of
   its buckets, in slices; then only buckets that still hold sets of different groups are compared, each
   group against the others, cut into blocks, each pair of blocks a unit of work. So no task holds a
   whole large group, no pair that shares a key is skipped, and copies of one text edited in places
   need no pairs among themselves. A unit returns a spanning forest of its confirmed links.
4. Components of the confirmed links, again by contraction; the buckets' links connect whole groups.

No caps: every pair that shares a band key is decided on its full sets or already in one group.

Null or empty texts and texts without words have the empty set: no links, their own component. A
text of fewer than ``shingle`` words is one shingle. Rows are told apart by a row number, so ids may be
null or repeat: rows without an id take part as texts but are never the smallest id; their component is
null unless another member has an id. Repeated rows are answered row by row; of equal ids each row is
kept if the id is its component's. A very long text is one set, whatever its size. An empty table gives
no rows. Extra columns, of whatever name, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as k
from .common import join_small_ids, materialize, numbered, ship_code

RING = 1 << 20
#: Edges that a round of contraction leaves and one task takes (16 bytes each).
LAST_EDGES = 2000
_SEED = 20231
_tables: list[np.ndarray] = []


def _permutations() -> list[np.ndarray]:
    """sigma and pi, the two permutations of the ring."""
    if not _tables:
        r = np.random.default_rng(_SEED)
        _tables.extend(r.permutation(RING).astype(np.uint32) for _ in range(2))
    return _tables


def ring_place(shingles: np.ndarray) -> np.ndarray:
    """sigma of the place that each shingle falls on."""
    return _permutations()[0][(shingles & k.U(RING - 1)).astype(np.int64)].astype(np.int64)


def _pi_windows(coordinates: int) -> np.ndarray:
    """Row p holds pi at the places p - 1, p - 2, ... p - coordinates (in memory order)."""
    pi = _permutations()[1]
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([pi[RING - coordinates :], pi]), coordinates)


def signature(shingles: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """All coordinates: the least of the rows that the set's places select."""
    places = ring_place(shingles)
    out = windows[places[:1024]].min(axis=0)
    for i in range(1024, len(places), 1024):
        np.minimum(out, windows[places[i : i + 1024]].min(axis=0), out=out)
    return out


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    starts, ends, row_words = k.word_spans(raw, offsets, k.NON_SPACE)
    words = k.word_hashes(raw, starts, ends)
    joined = words[: max(0, len(words) - size + 1)].copy()
    for i in range(1, size):
        joined = joined * k.U(0xD6E8FEB86659FD93) + words[i : i + len(joined)]
    joined = k.mix(joined)
    out = []
    for a, b in zip(row_words[:-1], row_words[1:], strict=True):
        if b - a >= size:
            s = np.sort(joined[a : b - size + 1])
            out.append(s[np.r_[True, s[1:] != s[:-1]]])
        elif b > a:
            whole = hashlib.blake2b(words[a:b].tobytes(), digest_size=8).digest()
            out.append(np.frombuffer(whole, np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _set_digest(s: np.ndarray) -> tuple[int, int]:
    a, b = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
    return int(a), int(b)


def sketch(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """row, doc_id, n_shingles, digest (node and check; null for the empty set), keys (of the bands).

    A text that repeats within a batch has no keys again: its set has them already.
    """
    ship_code(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _pi_windows(bands * rows)
        powers = k.mix(np.arange(1, rows + 1, dtype=k.U)) | k.U(1)
        salt = k.mix(np.arange(bands, dtype=k.U) + k.U(77))
        for batch in batches:
            raw, offsets = k.text_buffer(batch.column(2))
            for lo, hi in k.row_chunks(offsets):
                sets = shingle_sets(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], shingle)
                digests = [_set_digest(s) if len(s) else (None, None) for s in sets]
                first = {d: i for i, d in reversed(list(enumerate(digests))) if d[0] is not None}
                own = sorted(first.values())
                keys: list[np.ndarray | None] = [None] * len(sets)
                if own:
                    sig = np.stack([signature(sets[i], windows) for i in own]).astype(k.U).reshape(len(own), bands, rows)
                    key = k.mix((k.mix(sig + k.U(1)) * powers).sum(axis=2, dtype=k.U) ^ salt).view(np.int64)
                    for i, x in zip(own, key, strict=True):
                        keys[i] = x
                yield pa.record_batch(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        batch.column(1).slice(lo, hi - lo),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([d[0] for d in digests], pa.int64()),
                        pa.array([d[1] for d in digests], pa.int64()),
                        pa.array(keys, pa.list_(pa.int64())),
                    ],
                    names=["row", "doc_id", "n_shingles", "node", "check", "keys"],
                )

    return docs.select("row", "doc_id", "text").mapInArrow(run, "row long, doc_id long, n_shingles long, node long, check long, keys array<long>")


def least_reachable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, into): every node of the edges (a, b) of all batches, and the least node that it reaches."""
    into: dict[int, int] = {}

    def find(x: int) -> int:
        while into.setdefault(x, x) != x:
            into[x] = into[into[x]]
            x = into[x]
        return x

    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(x), find(y)
            into[max(x, y)] = min(x, y)
    nodes = list(into)
    yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["node", "into"])


def components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "cc", stored: bool = False, last: int = LAST_EDGES) -> DataFrame:
    """Connected components of ``edges``: (node, root) for every node of an edge. ``stored`` edges are of
    different ends and in a table already.

    Each round contracts every node into its neighbour of least rank; rounds end when no edge is left.
    A node's rank is its number, so nodes around a least one, as links are made here, meet in one round.
    After a round that leaves more than half of the edges the next one ranks by a hash, which removes a
    constant share of the nodes, whatever the graph's shape.
    Neighbours are only ever reduced by ``min``, so a node with many of them is pre-aggregated.
    Of what a round leaves, ``last`` edges at most are followed to their ends in one small task.
    """
    spark = edges.sparkSession
    ship_code(spark)
    rest = edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
    if not stored:
        rest = materialize(rest.where("a != b").distinct(), f"{name}-edges")
    steps = []
    seed = 0
    left, hashed = rest.count(), False
    while left > last or left and not steps:
        rank = lambda c: F.struct((F.xxhash64(F.lit(seed), c) if hashed else c).alias("rank"), c.alias("node"))  # noqa: E731, B023
        both = rest.select("a", "b").unionAll(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(rank(F.col("b"))).alias("m"))
        own = rank(F.col("a"))
        step = materialize(least.select(F.col("a").alias("node"), F.least(F.col("m"), own)["node"].alias("into")), f"{name}-step{seed}")
        steps.append(step)
        to_a = step.select(F.col("node").alias("a"), F.col("into").alias("x"))
        to_b = step.select(F.col("node").alias("b"), F.col("into").alias("y"))
        moved = rest.join(to_a, "a").join(to_b, "b").where("x != y")
        rest = materialize(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"{name}-rest{seed}")
        before, left = left, rest.count()
        hashed = not hashed and 2 * left > before
        seed += 1
    if not steps:
        return spark.createDataFrame([], "node long, root long")
    if left:
        steps.append(materialize(rest.coalesce(1).mapInArrow(least_reachable, "node long, into long"), f"{name}-last"))
    out = steps[0].withColumnRenamed("into", "root")
    for step in steps[1:]:
        nxt = step.select(F.col("node").alias("root"), F.col("into"))
        out = out.join(nxt, "root", "left").select("node", F.coalesce("into", "root").alias("root"))
    return materialize(out, f"{name}-out")


def candidate_links(sketches: DataFrame) -> DataFrame:
    """(a, b): a node and the least node that shares a band key with it."""
    rows = sketches.where("keys is not null").select("node", F.explode("keys").alias("key"))
    hubs = rows.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("most")).where("hub != most").select("key", "hub")
    return rows.join(hubs, "key").where("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))


def linked_forest(nodes: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between ``left`` and ``right`` (masks over the nodes, which ascend):
    each node with the least of its tree."""
    n = len(nodes)
    sizes = np.array([len(s) for s in sets], np.int64)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), sizes)
    shared = count[column] > 1
    column, row = column[shared], row[shared]
    used, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    common = np.zeros((n, n), np.float32)
    width = max(64, (4 << 20) // n)
    for c in range(0, len(used), width):
        lo, hi = np.searchsorted(column, (c, c + width))
        part = np.zeros((n, min(width, len(used) - c)), np.float32)
        part[row[lo:hi], column[lo:hi] - c] = 1
        common += part @ part.T
    common = common.astype(np.int64)
    either = sizes[:, None] + sizes[None, :] - common
    link = (100 * common >= percent * either) & ((left[:, None] & right[None, :]) | (right[:, None] & left[None, :]))
    np.fill_diagonal(link, True)
    root = np.arange(n)
    while True:
        least = np.where(link, root[None, :], n).min(axis=1)
        least = least[least]
        if (least == root).all():
            break
        root = np.minimum(root, least)
    return [(int(nodes[i]), int(nodes[root[i]])) for i in range(n) if root[i] != i]


UNIT = "struct<u:long,lo:int,hi:int,block:int>"


def solved(rows: DataFrame, units: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(a, b): a spanning forest of the links between blocks ``lo`` and ``hi`` of every unit ``u``.

    ``units`` has set (the number of a row whose text has it), u, lo, hi and block. A text is read and
    cut into shingles once, whatever the units that take its set, and its set is shuffled to those alone.
    """
    unit = F.struct(F.col("u"), F.col("lo").cast("int").alias("lo"), F.col("hi").cast("int").alias("hi"), F.col("block").cast("int").alias("block"))
    wanted = materialize(units.groupBy(F.col("set").alias("row")).agg(F.collect_set(unit).alias("units")), "op6-units")
    carried = join_small_ids(rows.select("row", "text"), wanted, wanted.count(), ["row"])

    def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = k.text_buffer(batch.column(2))
            for lo, hi in k.row_chunks(offsets):
                sets = shingle_sets(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], shingle)
                yield pa.record_batch([*(batch.column(c).slice(lo, hi - lo) for c in (0, 1)), pa.array([x.tobytes() for x in sets], pa.binary())], names=["set", "units", "items"])

    held = carried.select("row", "units", "text").mapInArrow(full_sets, f"set long, units array<{UNIT}>, items binary")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = held.select("set", "items", F.explode("units").alias("x")).select("x.u", "x.lo", "x.hi", "set", "x.block", "items")
    dealt = dealt.repartition(parts, "u", "lo", "hi").sortWithinPartitions("u", "lo", "hi")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}

        def answer() -> pa.RecordBatch:
            nodes = sorted(held)
            sets = [np.frombuffer(held[x][1], np.uint64) for x in nodes]
            block = np.array([held[x][0] for x in nodes])
            forest = linked_forest(np.array(nodes, np.int64), sets, block == key[1], block == key[2], percent)
            return pa.record_batch([pa.array([x[0] for x in forest], pa.int64()), pa.array([x[1] for x in forest], pa.int64())], names=["a", "b"])

        for batch in batches:
            for *new, one, block, items in zip(*(batch.column(c).to_pylist() for c in ("u", "lo", "hi", "set", "block", "items")), strict=True):
                if new != key:
                    if len(held) > 1:
                        yield answer()
                    key, held = new, {}
                held[one] = (block, items)
        if len(held) > 1:
            yield answer()

    return dealt.mapInArrow(solve, "a long, b long")


def _blocks(count: str, shingles: str, block_docs: int, block_shingles: int) -> Column:
    return F.greatest(F.ceil(F.col(count) / block_docs), F.ceil(F.col(shingles) / block_shingles), F.lit(1)).cast("int")


def _dealt(column: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(5), column), blocks).cast("int")


def star_units(members: DataFrame, links: DataFrame, block_docs: int, block_shingles: int) -> DataFrame:
    """Every set with the least set that shares a key with it, in slices of the sets of one hub."""
    hubs = links.groupBy("a").agg(F.min("b").alias("hub"))
    around = members.join(hubs.withColumnRenamed("a", "node"), "node").select("set", "hub", "n")
    totals = around.groupBy("hub").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("shingles"))
    slices = totals.select("hub", _blocks("docs", "shingles", block_docs, block_shingles).alias("slices"))
    rays = around.join(slices, "hub").select(F.col("hub").alias("u"), _dealt(F.col("set"), F.col("slices")).alias("lo"), "set", F.lit(1).alias("side"))
    middles = members.join(slices.withColumnRenamed("hub", "node"), "node").select(F.col("node").alias("u"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("lo"), "set", F.lit(0).alias("side"))
    # a slice's number is twice its place: the hub stands in the even block, its sets in the odd one
    both = rays.unionAll(middles)
    return both.select("u", (2 * F.col("lo")).alias("lo"), (2 * F.col("lo") + 1).alias("hi"), "set", (2 * F.col("lo") + F.col("side")).alias("block"))


def bucket_units(members: DataFrame, keys: DataFrame, parts: DataFrame, block_docs: int, block_shingles: int) -> DataFrame:
    """Buckets that hold sets of different parts, cut into blocks; the largest part of a bucket is not
    compared with itself. Buckets with the same sets are compared once."""
    known = members.join(parts.select(F.col("node").alias("set"), F.col("root").alias("part")), "set", "left")
    known = known.select("node", "set", "n", F.coalesce("part", "set").alias("part"))
    rows = keys.join(known, "node").select(F.explode("keys").alias("key"), "set", "n", "part")
    rows = materialize(rows.distinct(), "op6-buckets")
    by_part = rows.groupBy("key", "part").agg(
        F.count(F.lit(1)).alias("docs"), F.sum("n").alias("shingles"), F.sum(F.xxhash64(F.lit(1), "set").cast("decimal(38,0)")).alias("one"), F.sum(F.xxhash64(F.lit(2), "set").cast("decimal(38,0)")).alias("two")
    )
    size = F.struct("docs", "shingles", "part")
    buckets = by_part.groupBy("key").agg(
        F.max(size).alias("main"), F.sum("docs").alias("docs"), F.sum("shingles").alias("shingles"), F.sum("one").alias("one"), F.sum("two").alias("two"), F.count(F.lit(1)).alias("parts")
    )
    buckets = buckets.where("parts > 1").groupBy("docs", "one", "two").agg(F.min(F.struct("key", "main", "shingles")).alias("b"))
    rest = {"rest_docs": F.col("docs") - F.col("b.main.docs"), "rest_shingles": F.col("b.shingles") - F.col("b.main.shingles")}
    cut = buckets.select(F.col("b.key").alias("key"), F.col("b.main").alias("main"), *(c.alias(n) for n, c in rest.items()))
    cut = cut.select(
        "key",
        F.col("main.part").alias("main"),
        _blocks("main.docs", "main.shingles", block_docs, block_shingles).alias("m"),
        _blocks("rest_docs", "rest_shingles", block_docs, block_shingles).alias("o"),
    )
    placed = rows.join(materialize(cut, "op6-cut"), "key").withColumn("is_main", F.col("part") == F.col("main"))
    block = F.when(F.col("is_main"), _dealt(F.col("set"), F.col("m"))).otherwise(F.col("m") + _dealt(F.col("set"), F.col("o")))
    first = F.when(F.col("is_main"), F.col("m")).otherwise(F.lit(0))
    placed = placed.select("key", "set", block.alias("block"), F.explode(F.sequence(first, F.col("m") + F.col("o") - 1)).alias("other"))
    return placed.select(F.col("key").alias("u"), F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "set", "block")


def confirmed_groups(rows: DataFrame, sketches: DataFrame, sets: DataFrame, shingle: int, percent: int, block_docs: int, block_shingles: int) -> list[DataFrame]:
    """Groups of sets, and groups of these: (node, root) of the sets linked through pairs with a common key,
    and then of the roots that links in buckets of large components connect. Others are their own root."""
    links = materialize(candidate_links(sketches).distinct(), "op6-candidates")
    clusters = components(links, name="op6-candidates", stored=True)
    members = sets.join(clusters, "node").select("node", "root", "set", "n")
    totals = members.groupBy("root").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("shingles"))
    small = (F.col("docs") <= block_docs) & (F.col("shingles") <= block_shingles)
    members = materialize(members.join(totals.select("root", small.alias("small")), "root"), "op6-members")
    whole = members.where("small").select(F.col("root").alias("u"), F.lit(0).alias("lo"), F.lit(0).alias("hi"), "set", F.lit(0).alias("block"))
    large = members.where("not small").select("node", "set", "n")
    stars = star_units(large, links, block_docs, block_shingles)
    found = materialize(solved(rows, whole.unionByName(stars), shingle, percent), "op6-links")
    parts = components(found, name="op6-parts", stored=True)
    if large.isEmpty():
        return [parts]
    buckets = bucket_units(large, sketches.where("keys is not null").select("node", "keys"), parts, block_docs, block_shingles)
    more = solved(rows, buckets, shingle, percent)
    for end in ("a", "b"):
        root = parts.select(F.col("node").alias(end), F.col("root").alias("part"))
        more = more.join(root, end, "left").withColumn(end, F.coalesce("part", end)).drop("part")
    return [parts, components(more, name="op6-rest")]


def near_duplicates(
    docs: DataFrame, shingle: int = 5, percent: int = 85, bands: int = 48, rows: int = 8, block_docs: int = 512, block_shingles: int = 2_000_000, row: str | None = None
) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable), kept (doc_id = component_id).

    Rows need a number that stays the same when they are read again: a column ``row`` of unique longs
    of a stored table, or else :func:`numbered` gives one.
    """
    if row is None:
        texts = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "op6-rows")
    else:
        texts = docs.select(F.col(row).cast("long").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches = materialize(sketch(texts, shingle, bands, rows), "op6-sketches")
    full = sketches.where("node is not null")
    sets = full.groupBy("node", "check").agg(F.min("row").alias("set"), F.min("doc_id").alias("least"), F.max("n_shingles").alias("n"))
    sets = materialize(sets, "op6-sets")
    of_set = sets.select("node", "check", "least", F.col("set").alias("root"))
    for groups in confirmed_groups(texts, sketches, sets, shingle, percent, block_docs, block_shingles):
        of_set = of_set.join(groups.select(F.col("node").alias("root"), F.col("root").alias("into")), "root", "left")
        of_set = of_set.select("node", "check", "least", F.coalesce("into", "root").alias("root"))
    smallest = of_set.groupBy("root").agg(F.min("least").alias("component_id"))
    of_set = materialize(of_set.join(smallest, "root").select("node", "check", "component_id"), "op6-components")
    linked = full.select("doc_id", "n_shingles", "node", "check").join(of_set, ["node", "check"]).select("doc_id", "n_shingles", "component_id")
    alone = sketches.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
