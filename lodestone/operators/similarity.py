"""Vector, token and name similarity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import phones
from lodestone.functions.notation import as_letters
from lodestone.sources.tables import dealt, stored


def unit(vector: Column) -> Column:
    """The vector over its norm (plus a hair, so a null vector is no division by zero)."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))) + F.lit(1e-8)
    return F.transform(vector, lambda x: x.cast("double") / norm)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


FRAMES = 8192
_TILE = 1024

BEST = "struct<rows: array<double>, columns: array<double>>"


def _best_matches(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """For every pair of frame blocks the best match of each row and of each column."""
    rows, columns = [], []
    for x, y in zip(a, b, strict=True):
        left, right = np.stack(x), np.stack(y).T
        best = np.full(right.shape[1], -np.inf)
        of_rows = []
        for lo in range(0, len(left), _TILE):
            product = left[lo : lo + _TILE] @ right
            of_rows.append(product.max(axis=1))
            np.maximum(best, product.max(axis=0), out=best)
        rows.append(np.concatenate(of_rows))
        columns.append(best)
    return pd.DataFrame({"rows": rows, "columns": columns})


def max_similarity(frames_a: DataFrame, frames_b: DataFrame, pairs: DataFrame, digits: int = 6) -> DataFrame:
    """a, b, precision, recall, f1 of each pair of clips in ``pairs`` (a, b).

    Frames are (clip, frame, v) with unit vectors. A clip's frames are packed in blocks of ``FRAMES`` at
    most; the blocks of a pair meet by their numbers and are compared once, tile by tile, so neither a whole
    clip nor the pairwise products are ever rows of one task. All products are made: the time follows their number.
    """
    place = F.row_number().over(Window.partitionBy("clip").orderBy("frame")) - 1
    packed = lambda f: f.withColumn("part", F.floor(place / FRAMES)).groupBy("clip", "part").agg(F.array_sort(F.collect_list(F.struct("frame", "v"))).alias("fs"))
    left = packed(frames_a).select(F.col("clip").alias("a"), F.col("part").alias("pa"), F.transform("fs", lambda f: f["v"]).alias("va"))
    right = packed(frames_b).select(F.col("clip").alias("b"), F.col("part").alias("pb"), F.transform("fs", lambda f: f["v"]).alias("vb"))
    parts = lambda f, clip, part: f.groupBy(F.col("clip").alias(clip)).count().select(clip, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("count") - 1) / FRAMES))).alias(part))
    blocks = pairs.join(parts(frames_a, "a", "pa"), "a").join(parts(frames_b, "b", "pb"), "b")
    compare = F.pandas_udf(_best_matches, BEST)
    met = dealt(blocks.join(left, ["a", "pa"]), "b", "pb").join(right, ["b", "pb"]).select("a", "b", "pa", "pb", compare("va", "vb").alias("m"))
    sides = F.array(F.struct(F.lit("p").alias("side"), F.col("pa").alias("part"), F.col("m.rows").alias("best")), F.struct(F.lit("r").alias("side"), F.col("pb").alias("part"), F.col("m.columns").alias("best")))
    each = met.select("a", "b", F.inline(sides)).select("a", "b", "side", "part", F.posexplode("best").alias("i", "s")).groupBy("a", "b", "side", "part", "i").agg(F.max("s").alias("s"))
    both = each.groupBy("a", "b").agg(*(F.avg(F.when(F.col("side") == x, F.col("s"))).alias(x) for x in ("p", "r")))
    f1 = F.when(F.col("p") + F.col("r") <= 0, 0.0).otherwise(2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r")))
    return both.select("a", "b", F.round("p", digits).alias("precision"), F.round("r", digits).alias("recall"), F.round(f1, digits).alias("f1"))


def token_error_rate(a: Column, b: Column) -> Column:
    """:func:`error_rate` of two arrays of tokens."""
    return F.transform(F.array(as_letters(a, b)), lambda p: error_rate(p["a"], p["b"]))[0]


def error_rate(a: Column, b: Column) -> Column:
    """Edit distance over the longer length; both empty 0, one empty 1. Lengths count characters."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 0.0).when((F.length(a) == 0) | (F.length(b) == 0), 1.0).otherwise(F.levenshtein(a, b) / longest)


def nearest(queries: DataFrame, pool: DataFrame, name: str, k: int, reach: int) -> DataFrame:
    """query, neighbour, distance, place: the ``k`` nearest other names within ``reach`` edits.

    A name is within ``reach`` only if its length is: names meet in an equality join on length, each
    pool name being listed under the lengths it can serve. Both sides are distinct first.
    """
    q = queries.select(F.col(name).alias("query")).distinct().withColumn("len", F.length("query"))
    p = pool.select(F.col(name).alias("neighbour")).distinct()
    p = p.withColumn("len", F.explode(F.sequence(F.greatest(F.lit(1), F.length("neighbour") - reach), F.length("neighbour") + reach)))
    met = q.join(p, "len").where(F.col("query") != F.col("neighbour")).withColumn("distance", F.levenshtein("query", "neighbour", reach)).where(F.col("distance") >= 0)
    best = Window.partitionBy("query").orderBy("distance", "neighbour")
    return met.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).select("query", "neighbour", "distance", "place")


def margins(nearest_rows: DataFrame, own: Column, narrow: float = 0.25) -> DataFrame:
    """query, margin to the nearest neighbour, confusable (margin <= 0), narrow."""
    first = nearest_rows.where("place = 1").withColumn("margin", F.col("distance") - own)
    m = F.col("margin")
    return first.select("query", "neighbour", "margin", (m <= 0).alias("confusable"), ((m > 0) & (m < narrow)).alias("narrow"))
