"""Fuzzy titles: pairs of texts by matching blocks, found without comparing all pairs.

The ratio of two texts is twice their matched characters over both lengths. Texts of ratio t leave at most a
share 1 - t of their characters unmatched, and between two matched blocks at least one is unmatched; so blocks
are few and most neighbouring characters stay neighbours. That bounds the common pairs of characters from
below, and texts with so many in common share one of the rarest pairs of each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.fuzzy import matching_ratio
from lodestone.sources.tables import stored


def form(title: Column) -> Column:
    """Lower case, blanks and dashes and underscores as one blank."""
    return F.regexp_replace(F.lower(F.trim(title)), r"[\s_-]+", " ")


def common_pairs(length: Column, least: float) -> Column:
    """A text of ``length`` has at least so many pairs of neighbours in common with any text of ratio ``least``.

    With S the sum of both lengths, at least t S / 2 characters match, in at most (1 - t) S + 1 blocks, and a
    block of b characters has b - 1 pairs; S is least for the shortest text whose length allows the ratio.
    """
    shortest = F.ceil(length * least / (2 - least) - 1e-9)
    both = length + shortest
    return F.ceil(both * (least / 2 - (1 - least)) - 1 - 1e-9)


def _pairs_of(text: Column) -> Column:
    """Neighbours of a text, each with its number among equal ones, so that common ones can be counted as sets."""
    grams = F.when(F.length(text) > 1, F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(text, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    return F.transform(grams, lambda g, i: F.concat(g, F.size(F.filter(F.slice(grams, 1, i), lambda x: x == g)).cast("string")))


def similar_texts(left: DataFrame, right: DataFrame, least: float = 0.85) -> DataFrame:
    """l, r, ratio: pairs of texts (columns l and r) of at least ``least``, none lost; empty texts match nothing.

    Pairs of characters are ordered by how many texts have them; of each text the first ones are looked up,
    as many as any partner must share one of. Equal texts meet by the whole text as well. Above 0.8 texts that
    are too short for the bound to say anything are too short to differ.
    """
    if not 0.8 < least <= 1:
        raise ValueError("the bound holds for ratios above 0.8")
    sides = [side.select(F.col(c).alias("text")).where(f"{c} <> ''").distinct().withColumn("side", F.lit(c)) for side, c in ((left, "l"), (right, "r"))]
    rows = stored(sides[0].unionAll(sides[1]).withColumn("grams", _pairs_of(F.col("text"))), "texts")
    each = rows.select("side", "text", F.explode("grams").alias("gram"))
    counts = stored(each.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "grams")
    ordered = each.join(counts, "gram").groupBy("side", "text").agg(F.array_sort(F.collect_list(F.struct("n", "gram"))).alias("grams"))
    size = F.size("grams")
    kept = F.greatest(F.lit(0), F.least(size, size - common_pairs(F.length("text"), least) + 1))
    prefix = F.transform(F.slice("grams", 1, kept), lambda x: x["gram"])
    keyed = ordered.select("side", "text", F.explode(F.concat(prefix, F.array(F.concat(F.lit("="), "text")))).alias("key"))
    alone = rows.where(F.size("grams") == 0).select("side", "text", F.concat(F.lit("="), "text").alias("key"))
    keyed = stored(keyed.unionAll(alone).withColumn("n", F.length("text")), "keys")
    a = keyed.where("side = 'l'").select(F.col("text").alias("l"), "key", F.col("n").alias("ln"))
    b = keyed.where("side = 'r'").select(F.col("text").alias("r"), "key", F.col("n").alias("rn"))
    near = 2 * F.least("ln", "rn") >= least * (F.col("ln") + F.col("rn")) - 1e-9
    met = stored(a.join(b, "key").where(near).select("l", "r").distinct(), "met")
    return met.withColumn("ratio", matching_ratio("l", "r")).where(F.col("ratio") >= least)


def best_matches(targets: DataFrame, target: str, candidates: DataFrame, titles: list[str], least: float = 0.85) -> DataFrame:
    """target, the best candidate's titles and its ratio, for targets that have one of at least ``least``.

    A candidate's ratio is the largest over its titles; ties go by the titles' order. Targets and candidates are
    looked up in each other by :func:`similar_texts`.
    """
    names = targets.select(F.col(target).alias("target")).distinct().withColumn("l", form(F.col("target")))
    pool = candidates.select(*titles).distinct()
    forms = pool.select(F.explode(F.array(*(form(F.col(c)) for c in titles))).alias("r"))
    found = similar_texts(names, forms, least)
    each = None
    for c in titles:
        own = found.join(pool.withColumn("r", form(F.col(c))), "r").select("l", *titles, "ratio")
        each = own if each is None else each.unionAll(own)
    best = each.groupBy("l", *titles).agg(F.max("ratio").alias("ratio")).groupBy("l").agg(F.min_by(F.struct(*titles, "ratio"), F.struct(-F.col("ratio"), *titles)).alias("x"))
    return names.join(best, "l").select(F.col("target").alias(target), "x.*")


def first_source(targets: DataFrame, target: str, sources: list[tuple[str, DataFrame]], titles: list[str], least: float = 0.85) -> tuple[DataFrame, DataFrame]:
    """(target, source, titles, ratio of the first source that has a match; target and the sources that it missed).

    The sources are searched in turn, each for the targets that none before it had.
    """
    rest = stored(targets.select(target).distinct(), "targets")
    hits, misses = None, None
    for name, pool in sources:
        found = stored(best_matches(rest, target, pool, titles, least).withColumn("source", F.lit(name)), "matches")
        hits = found if hits is None else hits.unionAll(found)
        rest = stored(rest.join(found.select(target), target, "left_anti"), "targets")
        missed = rest.withColumn("missed", F.lit(name))
        misses = missed if misses is None else misses.unionAll(missed)
    return hits, misses.groupBy(target).agg(F.collect_list("missed").alias("missed"))
