"""The nearest names by alignment cost, exactly, without aligning all pairs.

Symbol counts bound a cost from below, and a name's k-th best distance so far is a ceiling for what can still
matter. Names with the same symbols are put into one block. A name first looks through its own block, which
gives its ceiling; then it visits the blocks whose symbols allow a cost under it, and there only the names
whose own counts do. What is left is aligned in a band, and given up as soon as it is above the ceiling.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import phones as p
from lodestone.sources.tables import stored

_FOUND = "item string, neighbour string, distance double"
_AT_ONCE = 20_000


def _scale(lengths: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(lengths, p.LEAST_LENGTH) / p.PIVOT_LENGTH)


@dataclass(frozen=True)
class Tally:
    """Pairs that entered an alignment, and those that reached its end under their ceiling."""

    begun: Accumulator
    ended: Accumulator


class Pool:
    """Names that others are compared with."""

    def __init__(self, names: list[str], refs: list[str]):
        self.names = np.array(names, object)
        self.codes = [p.parse(x) for x in refs]
        self.counts = p.symbol_counts(self.codes)


def search(pool: Pool, names: list[str], refs: list[str], ceilings: np.ndarray, k: int, tally: Tally | None = None) -> list[tuple[str, str, float]]:
    """(name, neighbour, distance) of the ``k`` nearest in the pool to each name, none above its ceiling (a
    distance)."""
    codes = [p.parse(x) for x in refs]
    counts = p.symbol_counts(codes)
    scale = _scale(counts.sum(axis=1))
    found = []
    step = max(1, 1_000_000 // max(1, len(pool.codes)))
    for lo in range(0, len(codes), step):
        part = slice(lo, lo + step)
        least = p.least_costs(counts[part], pool.counts) / scale[part, None]
        least[np.array(names[part], object)[:, None] == pool.names[None, :]] = np.inf
        order = np.argsort(least, axis=1, kind="stable")
        best: list[list[tuple[float, str]]] = [[] for _ in range(len(least))]
        limit = ceilings[part].copy()
        at, width = 0, max(2 * k, 4)
        while at < least.shape[1]:  # the likeliest first: their distances lower the ceilings for the rest
            ahead = np.take_along_axis(least, order[:, at : at + width], axis=1)
            rows, columns = np.nonzero((ahead <= limit[:, None] + 1e-12) & (ahead < np.inf))
            if not len(rows):
                break
            chosen = order[rows, at + columns]
            for i in range(0, len(rows), _AT_ONCE):
                a, b = rows[i : i + _AT_ONCE], chosen[i : i + _AT_ONCE]
                cost = p.bounded_costs([codes[lo + x] for x in a], [pool.codes[x] for x in b], limit[a] * scale[part][a])
                for x, y, c in zip(a.tolist(), b.tolist(), cost.tolist(), strict=True):
                    if c < np.inf:
                        best[x].append((c / scale[lo + x], pool.names[y]))
                if tally is not None:
                    tally.begun.add(len(a))
                    tally.ended.add(int((cost < np.inf).sum()))
            for x in np.unique(rows).tolist():
                best[x] = sorted(best[x])[:k]
                if len(best[x]) == k:
                    limit[x] = min(limit[x], best[x][-1][0])
            at, width = at + width, 2 * width
        found += [(names[lo + x], other, d) for x, own in enumerate(best) for d, other in own]
    return found


def _answers(found: list[tuple[str, str, float]]) -> pa.RecordBatch:
    kinds = (("item", pa.string()), ("neighbour", pa.string()), ("distance", pa.float64()))
    return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])


def nearest_names(names: DataFrame, item: str, ref: str, k: int, block: int = 256, most_blocks: int = 4096, slice_rows: int = 20_000, tally: Tally | None = None) -> DataFrame:
    """item, neighbour, distance, place: the ``k`` nearest other items by scaled alignment cost, exactly.

    Ties go by the neighbour's name. ``ref`` holds symbols with one space between. A block has ``block`` names, or
    more where there would be more than ``most_blocks``, whose symbols all tasks know (some 3 MB). Visitors of one
    block are dealt in slices of about ``slice_rows``.
    """
    spark = names.sparkSession
    rows = names.select(F.col(item).alias("item"), F.col(ref).alias("ref")).distinct()
    tokens = F.transform(F.split("ref", " "), lambda s: F.regexp_replace(s, "[012]$", ""))
    rows = stored(rows.withColumn("tokens", F.array_distinct(tokens)), "names")
    n = rows.count()
    block = max(block, -(-n // most_blocks))
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // block)))
    # rare symbols first, so that the names of a block have few of them
    common = [r["s"] for r in rows.select(F.explode("tokens").alias("s")).groupBy("s").count().orderBy("count", "s").collect()]
    shape = F.concat_ws("", *(F.array_contains("tokens", s).cast("int").cast("string") for s in common)) if common else F.lit("")
    ranged = rows.select("item", "ref", shape.alias("shape")).repartitionByRange(parts, F.desc("shape"), "item").sortWithinPartitions(F.desc("shape"), "item").drop("shape")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            place = np.arange(seen, seen + batch.num_rows) // block
            seen += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], names=["item", "ref", "place"])

    placed = ranged.mapInArrow(number, "item string, ref string, place long").withColumn("block", F.spark_partition_id().cast("long") * (1 << 32) + F.col("place")).drop("place")
    placed = stored(placed, "placed")

    def visits(met: DataFrame) -> DataFrame:
        """Every visitor (block, slice, item, ref, ceiling; ``member`` rows first) against the members of its slice."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, members, pool = None, [], None
            for batch in batches:
                columns = [batch.column(c).to_pylist() for c in ("block", "slice", "member", "item", "ref", "ceiling")]
                waiting: list[tuple] = []

                def answer() -> Iterator[pa.RecordBatch]:
                    nonlocal pool
                    if waiting and members:  # noqa: B023
                        pool = pool or Pool(*map(list, zip(*members, strict=True)))  # noqa: B023
                        found = search(pool, [w[0] for w in waiting], [w[1] for w in waiting], np.array([w[2] for w in waiting]), k, tally)  # noqa: B023
                        if found:
                            yield _answers(found)

                for b, s, member, name, symbols, ceiling in zip(*columns, strict=True):
                    if (b, s) != key:
                        yield from answer()
                        key, members, pool, waiting = (b, s), [], None, []
                    if member:
                        members.append((name, symbols))
                    else:
                        waiting.append((name, symbols, ceiling))
                yield from answer()

        dealt = met.repartition(parts, "block", "slice").sortWithinPartitions("block", "slice", F.desc("member"))
        return dealt.mapInArrow(run, _FOUND)

    whole = placed.select("block", F.lit(0).alias("slice"), "item", "ref", F.lit(float("inf")).alias("ceiling"))
    own = stored(visits(whole.withColumn("member", F.lit(True)).unionByName(whole.withColumn("member", F.lit(False)))), "own")
    best = Window.partitionBy("item").orderBy("distance", "neighbour")
    ceilings = own.withColumn("at", F.row_number().over(best)).where(F.col("at") == k).select("item", F.col("distance").alias("ceiling"))
    limited = stored(placed.join(ceilings, "item", "left").withColumn("ceiling", F.coalesce("ceiling", F.lit(float("inf")))), "limited")

    bare = F.array_distinct(F.flatten(F.collect_set(F.array_distinct(F.transform(F.split("ref", " "), lambda s: F.regexp_replace(s, "[012]$", ""))))))
    size = F.when(F.col("ref") == "", 0).otherwise(F.size(F.split("ref", " ")))
    summary = placed.groupBy("block").agg(bare.alias("symbols"), F.min(size).alias("low"), F.max(size).alias("high")).orderBy("block").collect()  # most_blocks + parts at most
    blocks = np.array([r["block"] for r in summary], np.int64)
    present = np.array([np.isin(p.BARE, r["symbols"]) for r in summary], float).reshape(len(summary), len(p.BARE))
    low, high = (np.array([r[c] for r in summary], float) for c in ("low", "high"))
    lost = p.least_lost(present) if len(summary) else present

    def travel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = p.symbol_counts([p.parse(x) for x in batch.column(1).to_pylist()])
            size = counts.sum(axis=1)
            apart = np.maximum(np.maximum(size[:, None] - high, low - size[:, None]), 0) * p.LEAST_STEP
            least = np.maximum(apart, counts @ lost.T) / _scale(size)[:, None]
            go = (least <= batch.column(3).to_numpy()[:, None] + 1e-12) & (blocks[None, :] != batch.column(2).to_numpy()[:, None])
            who, where = np.nonzero(go)
            taken = batch.take(pa.array(who))
            yield pa.RecordBatch.from_arrays([pa.array(blocks[where]), taken.column(0), taken.column(1), taken.column(3)], names=["block", "item", "ref", "ceiling"])

    visitors = stored(limited.select("item", "ref", "block", "ceiling").mapInArrow(travel, "block long, item string, ref string, ceiling double"), "visitors")
    slices = F.broadcast(visitors.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / slice_rows).cast("int").alias("slices")))  # a row for each block
    coming = visitors.join(slices, "block").select("block", F.pmod(F.xxhash64("item"), F.col("slices")).cast("int").alias("slice"), "item", "ref", "ceiling", F.lit(False).alias("member"))
    there = placed.join(slices, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "item", "ref", F.lit(0.0).alias("ceiling"), F.lit(True).alias("member"))
    every = own.unionAll(stored(visits(coming.unionByName(there)), "met"))
    return every.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
