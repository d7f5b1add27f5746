"""Deterministic orders, stratified samples, era and difficulty strata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(key: Column, seed: str) -> Column:
    """An order that looks random and never changes: SHA-256 of the seed and the key."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def with_ids(rows: DataFrame, key: str, order: list[str], ids: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Rows whose ``key`` is among ``ids`` (all without), the first ``limit`` of them by ``order``: a user's own cut."""
    kept = rows if ids is None else rows.join(ids.select(key).distinct(), key, "left_semi")
    return kept if limit is None else kept.orderBy(*order).limit(limit)


def hash_number(key: Column, seed: str) -> Column:
    """An unsigned 32-bit number of a key: the first half of SHA-256's first 64 bits."""
    return F.conv(F.left(hash_order(key, seed), F.lit(8)), 16, 10).cast("long")


def mock_score(key: Column, seed: str, best: int = 5) -> Column:
    """A judge that isn't one: a whole score from 0 to ``best`` by the key's number, the same each time."""
    return (hash_number(key, seed) % (best + 1)).cast("int")


def jittered(score: Column, key: Column, seed: str, best: int = 5) -> Column:
    """A judge that differs from another: by one, up or down as the key's number says, for keys whose number's bit
    10 is set; within 0 to ``best``."""
    n = hash_number(key, seed)
    step = F.when(n % 2 == 0, 1).otherwise(-1)
    return F.when(F.shiftright(n, 10).bitwiseAND(F.lit(1)) == 1, F.greatest(F.lit(0), F.least(F.lit(best), score + step))).otherwise(score)


def stratified_sample(rows: DataFrame, stratum: str, key: str, size: int, seed: str, floor: int = 1, forced: Column | None = None, least_forced: int = 0) -> DataFrame:
    """``size`` rows: ``floor`` of each stratum (or all it has), the others in proportion to what the
    strata have beyond the floor, remainders to the largest fractions. In a stratum hash order decides.

    If fewer than ``least_forced`` of them are ``forced``, the first forced rows in hash order that were not
    taken come in and the last taken ones that are not forced go. Floors beyond ``size`` are an error.
    Strata are few; their counts are a small frame. A stratum keeps its first ``size`` rows at most before
    the allocation is known (group limit).
    """
    counts = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy()  # one row for each stratum
    counts = counts.withColumn("base", F.least(F.col("n"), F.lit(floor)))
    left = F.lit(size) - F.sum("base").over(whole)
    checked = F.when(left < 0, F.raise_error(F.lit("the floors need more rows than the sample has")).cast("long")).otherwise(left)
    counts = counts.withColumns({"spare": F.col("n") - F.col("base"), "left": checked})
    exact = F.when(F.sum("spare").over(whole) > 0, F.col("spare") * F.col("left") / F.sum("spare").over(whole)).otherwise(0.0)
    counts = counts.withColumn("exact", F.least(exact, F.col("spare")))
    counts = counts.withColumns({"extra": F.floor("exact"), "fraction": F.col("exact") - F.floor("exact")})
    counts = counts.withColumn("over", F.col("left") - F.sum("extra").over(whole))
    turn = F.row_number().over(Window.orderBy(F.desc("fraction"), stratum))
    quota = counts.select(stratum, F.least(F.col("n"), F.col("base") + F.col("extra") + (turn <= F.col("over")).cast("int")).alias("quota"))
    keyed = rows.withColumn("_order", hash_order(F.col(key), seed))
    numbered = keyed.withColumn("place", F.row_number().over(Window.partitionBy(stratum).orderBy("_order", key))).where(F.col("place") <= size)
    chosen = numbered.join(quota, stratum).where(F.col("place") <= F.col("quota")).drop("quota")
    if forced is None or not least_forced:
        return chosen.drop("_order")
    short = chosen.agg(F.greatest(F.lit(least_forced) - F.count_if(forced), F.lit(0)).alias("_short"))
    pool = keyed.where(forced).join(chosen.select(key), key, "left_anti").orderBy("_order", key).limit(least_forced)
    pool = pool.withColumn("place", F.row_number().over(Window.orderBy("_order", key)))
    come = pool.join(F.broadcast(short)).where(F.col("place") <= F.col("_short")).drop("_short")
    last = F.row_number().over(Window.orderBy(forced, F.desc(stratum), F.desc("_order"), F.desc(key)))  # at most ``size`` rows
    gone = chosen.withColumn("_last", last).join(F.broadcast(come.agg(F.count(F.lit(1)).alias("_n"))))
    stay = gone.where(forced | (F.col("_last") > F.col("_n"))).drop("_last", "_n")
    return stay.unionByName(come).drop("_order")


def era(rows: DataFrame, key: str, date: Column, cutoff: str, hit: Column) -> DataFrame:
    """key, latest, unresolved, era, era_confidence: the latest member's date decides.

    Without any date the era is ``new`` with low confidence; a member without a date caps it.
    """
    g = rows.groupBy(key).agg(F.max(date).alias("latest"), F.count_if(date.isNull()).alias("unresolved"), F.max(hit.cast("int")).alias("hit"))
    e = F.when(F.col("latest").isNull(), "new").when(F.col("latest") < F.lit(cutoff).cast("timestamp_ntz"), "established").otherwise("new")
    c = F.when(F.col("latest").isNull(), "low").when((F.col("hit") == 1) & (F.col("unresolved") == 0), "high").otherwise("medium")
    return g.select(key, "latest", "unresolved", e.alias("era"), c.alias("era_confidence"))


def cutoff_sweep(rows: DataFrame, date: Column, cutoffs: list[str]) -> DataFrame:
    """cutoff, established, new: conditional counts of all cutoffs in one pass; no date is new."""
    before = {c: F.count_if(F.coalesce(date < F.lit(c).cast("timestamp_ntz"), F.lit(False))) for c in cutoffs}
    g = rows.agg(F.count(F.lit(1)).alias("n"), *(x.alias(c) for c, x in before.items()))
    long = F.explode(F.create_map(*[x for c in cutoffs for x in (F.lit(c), F.col(f"`{c}`"))])).alias("cutoff", "established")
    return g.select("n", long).select("cutoff", "established", (F.col("n") - F.col("established")).alias("new"))


def difficulty(units: Column, length: Column, hard: Column, per_char: float = 0.02, bonus: float = 2.0) -> Column:
    return units + per_char * length + bonus * hard.cast("int")


def difficulty_tier(score: Column, easy: float = 6.16, medium: float = 10.18) -> Column:
    return F.when(score <= easy, "easy").when(score <= medium, "medium").otherwise("hard")


def difficulty_grid(rows: DataFrame, units: Column, length: Column, hard: Column, per_char: list[float], bonus: list[float]) -> DataFrame:
    """Tier counts for every pair of parameters, in one pass."""
    grid = F.array(*(F.struct(F.lit(a).alias("per_char"), F.lit(b).alias("bonus")) for a in per_char for b in bonus))
    swept = rows.select(units.alias("u"), length.alias("n"), hard.cast("int").alias("h"), F.explode(grid).alias("g"))
    tier = difficulty_tier(F.col("u") + F.col("g.per_char") * F.col("n") + F.col("g.bonus") * F.col("h"))
    return swept.groupBy("g.per_char", "g.bonus").agg(*(F.count_if(tier == x).alias(x) for x in ("easy", "medium", "hard")))
