"""Order-dependent operators. Every order takes columns that break ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.tables import stored


def last_per_key(rows: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """The last record of each key: one aggregation, reduced before the shuffle."""
    last = F.max(F.struct(*order, F.struct(*keep).alias("kept")))
    return rows.groupBy(*keys).agg(last.alias("x")).select(*keys, "x.kept.*")


def first_by_priority(rows: DataFrame, keys: list[str], source: Column, priority: list[str], order: list[str], keep: list[str], usable: Column | None = None) -> DataFrame:
    """The record of the best source of each key; unlisted sources come last; ``usable`` skips some."""
    rank = F.array_position(F.array(*map(F.lit, priority)), source)
    rank = F.when(rank == 0, len(priority) + 1).otherwise(rank)
    rows = rows if usable is None else rows.where(usable)
    best = F.min(F.struct(rank.alias("rank"), *order, F.struct(*keep).alias("kept")))
    return rows.groupBy(*keys).agg(best.alias("x")).select(*keys, "x.kept.*")


def runs(rows: DataFrame, keys: list[str], order: list[str], label: str, at: str) -> DataFrame:
    """Runs of equal labels: keys, run, label, n, first and last ``at``. Null labels are dropped."""
    ordered = Window.partitionBy(*keys).orderBy(*order)
    changed = (F.lag(label).over(ordered).eqNullSafe(F.col(label))).cast("int")
    numbered = rows.where(F.col(label).isNotNull()).withColumn("new", 1 - changed).withColumn("run", F.sum("new").over(ordered))
    return numbered.groupBy(*keys, "run").agg(F.first(label).alias(label), F.count(F.lit(1)).alias("n"), F.min(at).alias(f"first_{at}"), F.max(at).alias(f"last_{at}"))


def widen(rows: DataFrame, keys: list[str], tie: str, start: str, end: str, most: float) -> DataFrame:
    """wide_from and wide_to: half the gap to each neighbour is added, ``most`` at most and at edges."""
    ordered = Window.partitionBy(*keys).orderBy(start, tie)
    before = F.col(start) - F.lag(end).over(ordered)
    after = F.lead(start).over(ordered) - F.col(end)
    half = lambda gap: F.when(gap.isNull(), F.lit(most)).otherwise(F.greatest(F.lit(0.0), F.least(gap / 2, F.lit(most))))
    return rows.withColumn("wide_from", F.col(start) - half(before)).withColumn("wide_to", F.col(end) + half(after))


def running_best(rows: DataFrame, keys: list[str], order: list[str], score: str, margin: float) -> DataFrame:
    """keys, n, first, best: a candidate replaces the best so far only if it beats it by ``margin``.

    Only a score above all before it can replace the best, so of a key's scores those that exceed
    all earlier ones of their input partition meet in one array. Scores that rise all the time are
    all such; others leave few.
    """
    x = F.struct(*order, F.col("score"))
    g = rising(rows, keys, order, score, margin).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(x)["score"].alias("first"), F.array_sort(F.collect_list(F.when(F.col("rises"), x))).alias("xs")
    )
    best = F.aggregate("xs", F.col("first"), lambda a, x: F.when(x["score"] > a + margin, x["score"]).otherwise(a))
    return g.select(*keys, F.col("n").cast("int").alias("n"), best.alias("best"), "first")


def rising(rows: DataFrame, keys: list[str], order: list[str], score: str, margin: float) -> DataFrame:
    """keys, order, score and rises: whether a score exceeds all earlier ones of its key in its
    input partition. With a negative margin lower scores count too, so all are marked."""
    part = rows.select(*keys, *order, F.col(score).alias("score"), F.spark_partition_id().alias("_part"))
    earlier = F.max("score").over(Window.partitionBy("_part", *keys).orderBy(*order, "score").rowsBetween(Window.unboundedPreceding, -1))
    seen = part.withColumn("_most", earlier)
    rises = F.col("score").isNotNull() & (F.col("_most").isNull() | (F.col("score") > F.col("_most")) | F.lit(margin < 0))
    return seen.select(*keys, *order, "score", rises.alias("rises"))


def best_then_margin(base: DataFrame, candidates: DataFrame, keys: list[str], score: str, name: str, margin: float) -> DataFrame:
    """The best candidate of each key, kept if it reaches the base score plus ``margin``."""
    best = candidates.groupBy(*keys).agg(F.max(F.struct(F.col(score), F.col(name))).alias("x"))
    joined = base.join(best, keys)
    return joined.select(*base.columns, F.col(f"x.{score}").alias("best"), F.col(f"x.{name}").alias("by"), (F.col(f"x.{score}") >= F.col(score) + margin).alias("kept"))


def rank_fraction(rows: DataFrame, value: str, tie: str, into: str) -> DataFrame:
    """Position from 0 to 1 over all rows, ties by ``tie``.

    A global rank is made of two parts: rows are range-partitioned and sorted, then numbered within
    their partition, and each partition adds how many rows stand before it.
    """
    ranked, total = global_rank(rows, [value, tie], into)
    return ranked.withColumn(into, F.col(into) / F.greatest(F.lit(total - 1), F.lit(1)))


def global_rank(rows: DataFrame, order: list[str], into: str) -> tuple[DataFrame, int]:
    """Row numbers from 0 in a total order without one task seeing all rows, and the row count.

    The range-partitioned rows are stored with their partition's number before they are counted: two
    runs of a range partitioning need not cut alike.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tagged = stored(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranked")
    sizes = {r["_part"]: r["n"] for r in tagged.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = {}, 0
    for p in sorted(sizes):
        before[p], total = total, total + sizes[p]
    offsets = F.create_map(*[F.lit(x) for kv in before.items() for x in kv]) if before else F.create_map(F.lit(0), F.lit(0))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return tagged.withColumn(into, F.element_at(offsets, F.col("_part")) + within).drop("_part"), total


def cumulative(counts: DataFrame, keys: list[str], value: str, amounts: list[str], most: int = 1 << 18) -> DataFrame:
    """The rows with before_<amount>: what the amounts sum up to over smaller values of the same keys.

    ``counts`` has one row for each keys and value. ``most`` of them at most are ordered by key as they are. Of more
    no task sees all values of a key: rows are range-partitioned and stored, sums of earlier partitions are added
    to those within the own one.
    """
    before = lambda w: {f"before_{a}": F.coalesce(F.sum(a).over(w), F.lit(0)) for a in amounts}
    counts = stored(counts, "counts")
    if counts.count() <= most:
        return counts.withColumns(before(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)))
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tagged = stored(counts.repartitionByRange(parts, *keys, value).withColumn("_part", F.spark_partition_id()), "cumulative")
    sums = tagged.groupBy("_part", *keys).agg(*(F.sum(a).alias(a) for a in amounts))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("_part").alias("_p"), *(F.col(k).alias(f"_k_{k}") for k in keys), *(F.coalesce(F.sum(a).over(earlier), F.lit(0)).alias(f"_o_{a}") for a in amounts))
    same = F.col("_part") == F.col("_p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    within = before(Window.partitionBy("_part", *keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    joined = tagged.join(offsets, same)
    return joined.select(*counts.columns, *((F.col(f"_o_{a}") + within[f"before_{a}"]).alias(f"before_{a}") for a in amounts))


def tertiles(rows: DataFrame, value: str, tie: str, into: str) -> DataFrame:
    """Thirds by rank: 0, 1, 2."""
    ranked, total = global_rank(rows, [value, tie], "_rank")
    return ranked.withColumn(into, F.least(F.floor(F.col("_rank") / (max(total, 1) / 3)), F.lit(2)).cast("int")).drop("_rank")


def difficulty_bands(rows: DataFrame, key: str, length: str, nearest: str, penalty: Column) -> DataFrame:
    """The rows with length_rank, crowding_rank, composite and band (0 easy to 2 hard).

    Long names are hard to say, and those near to another name are easily taken for it: the composite is
    0.4 of the length's rank, 0.4 of one minus the rank of the distance to the nearest name, and 0.2 of a
    penalty from 0 to 1 for doubtful references. Bands are thirds by rank of the composite.
    """
    ranked = rank_fraction(rank_fraction(rows, length, key, "length_rank"), nearest, key, "_near")
    ranked = ranked.withColumn("crowding_rank", 1 - F.col("_near")).drop("_near")
    ranked = ranked.withColumn("composite", 0.4 * F.col("length_rank") + 0.4 * F.col("crowding_rank") + 0.2 * penalty)
    return tertiles(ranked, "composite", key, "band")


def checkpoints(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """First, middle and last row of each key, by name."""
    ordered = Window.partitionBy(*keys).orderBy(order)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    r = F.row_number().over(ordered)
    numbered = rows.withColumns({"_r": r, "_n": n})
    return numbered.where((F.col("_r") == 1) | (F.col("_r") == F.floor(F.col("_n") / 2) + 1) | (F.col("_r") == F.col("_n"))).drop("_r", "_n")


def epochs(rows: DataFrame, epoch: str, every: int) -> DataFrame:
    """Epoch 0, each ``every``-th, and the last one."""
    last = rows.agg(F.max(epoch).alias("_last"))
    return rows.join(F.broadcast(last)).where((F.col(epoch) == 0) | (F.col(epoch) % every == 0) | (F.col(epoch) == F.col("_last"))).drop("_last")
