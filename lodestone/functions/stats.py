"""Inferential statistics as columns."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lodestone.operators.windows import cumulative
from lodestone.sources.tables import stored

Z95 = 1.959963984540054  # fixed value: two-sided 95 %
Z80 = 0.8416212335729143  # fixed value: 80 % power


def wilson_low(k: Column, n: Column, z: float = Z95) -> Column:
    return _wilson(k, n, z, -1)


def wilson_high(k: Column, n: Column, z: float = Z95) -> Column:
    return _wilson(k, n, z, 1)


def _wilson(k: Column, n: Column, z: float, sign: int) -> Column:
    """One end of the Wilson interval; without trials it is (0, 1)."""
    p = k / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    end = F.least(F.lit(1.0), centre + half) if sign > 0 else F.greatest(F.lit(0.0), centre - half)
    return F.when(n > 0, end).otherwise(F.lit(1.0 if sign > 0 else 0.0))


def two_proportion_z(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """Pooled z; 0 if a side is empty or nothing varies."""
    pool = (k1 + k2) / (n1 + n2)
    se = F.sqrt(pool * (1 - pool) * (1 / n1 + 1 / n2))
    return F.when((n1 > 0) & (n2 > 0) & (se > 0), (k1 / n1 - k2 / n2) / se).otherwise(0.0)


@F.pandas_udf(DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    """Once for each distinct value of a batch: rates and counts repeat."""
    known = {x: 0.5 * (1 + math.erf(x / math.sqrt(2))) for x in z.dropna().unique()}
    return z.map(known)


# Acklam's rational approximation of the inverse normal distribution: the middle and the tails, each
# as numerator and denominator from the highest power down, and where the lower tail ends.
MIDDLE = (
    (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00),
    (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0),
)
TAIL = (
    (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00),
    (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0),
)
TAIL_ENDS = 0.02425


def _polynomial(x: Column, powers: tuple[float, ...]) -> Column:
    out = F.lit(powers[0])
    for c in powers[1:]:
        out = out * x + c
    return out


def normal_quantile(p: Column | str) -> Column:
    """Inverse of the normal distribution (relative error below 1.2e-9); an error outside (0, 1), null stays null."""
    p = F.col(p) if isinstance(p, str) else p
    checked = F.when((p > 0) & (p < 1), p).when(p.isNotNull(), F.raise_error(F.lit("a probability is not between 0 and 1")).cast("double"))

    def tail(q: Column) -> Column:
        x = F.sqrt(-2 * F.log(q))
        return _polynomial(x, TAIL[0]) / _polynomial(x, TAIL[1])

    x = checked - 0.5
    middle = _polynomial(x * x, MIDDLE[0]) * x / _polynomial(x * x, MIDDLE[1])
    return F.when(checked < TAIL_ENDS, tail(checked)).when(checked <= 1 - TAIL_ENDS, middle).otherwise(-tail(1 - checked))


def two_sided_p(z: Column) -> Column:
    return 2 * (1 - normal_cdf(F.abs(z)))


def z_for_confidence(confidence: float) -> float:
    return NormalDist().inv_cdf(1 - (1 - confidence) / 2)


def detectable_gap(p: Column, n: Column, z_alpha: float = Z95, z_power: float = Z80) -> Column:
    """Least difference of two rates of ``n`` trials each that a test would find."""
    return (z_alpha + z_power) * F.sqrt(2 * p * (1 - p) / n)


def kappa(both: Column, first: Column, second: Column, neither: Column) -> Column:
    """Cohen's kappa of two yes/no judges from the four counts; 1 if chance agreement is total."""
    n = both + first + second + neither
    seen = (both + neither) / n
    chance = ((both + first) / n) * ((both + second) / n) + ((second + neither) / n) * ((first + neither) / n)
    return F.when(chance >= 1, 1.0).otherwise((seen - chance) / (1 - chance))


def average_ranks(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value, rank: the rank of each distinct value, ties sharing the mean of their positions."""
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    ranked = cumulative(counts, keys, value, ["n"])
    return ranked.select(*keys, value, (F.col("before_n") + (F.col("n") + 1) / 2).alias("rank"))


def spearman(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """keys, n, rho: null under four pairs, 0 if a side doesn't vary. Pairs with a null are left out.

    Ranks are those of distinct values, from counts of both sides at once, so no task orders all rows of a key.
    """
    both = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, F.col(a).alias("a"), F.col(b).alias("b"))
    sides = F.explode(F.array(*(F.struct(F.lit(x).alias("side"), F.col(x).alias("v")) for x in ("a", "b"))))
    ranks = average_ranks(both.select(*keys, sides.alias("x")).select(*keys, "x.side", "x.v"), [*keys, "side"], "v")
    ranks = stored(ranks, "ranks")
    ranked = both
    for side in ("a", "b"):
        own = ranks.where(F.col("side") == side).select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("v").alias("_v"), F.col("rank").alias(f"r{side}"))
        same = F.col(side) == F.col("_v")
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        ranked = ranked.join(own, same).drop("_v", *(f"_{k}" for k in keys))
    found = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.covar_pop("ra", "rb").alias("c"), F.stddev_pop("ra").alias("sa"), F.stddev_pop("rb").alias("sb"))
    rho = F.when(F.col("n") < 4, None).when((F.col("sa") == 0) | (F.col("sb") == 0), 0.0).otherwise(F.col("c") / (F.col("sa") * F.col("sb")))
    return found.select(*keys, "n", rho.alias("rho"))


def auc(rows: DataFrame, positive: Column, score: Column) -> DataFrame:
    """n_pos, n_neg, auc: chance that a positive scores above a negative, ties half.

    Counts by distinct score are summed first and then cumulated over range partitions.
    """
    steps = rows.where(score.isNotNull()).groupBy(score.alias("s")).agg(F.sum(positive.cast("long")).alias("p"), F.sum((~positive).cast("long")).alias("q"))
    won = cumulative(steps, [], "s", ["q"]).select("p", "q", (F.col("p") * (F.col("before_q") + F.col("q") / 2)).alias("w"))
    return won.agg(F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"), F.sum("w").alias("w")).select("n_pos", "n_neg", (F.col("w") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def cut_score(error: Column) -> Column:
    """0 to 5 from a normalised error; each bound belongs to the better score."""
    # The bounds of the scores 5 to 1.
    cut = F.when(error <= 0.20, 5).when(error <= 0.45, 4).when(error <= 0.95, 3).when(error <= 1.70, 2).when(error <= 2.80, 1)
    return F.when(error.isNotNull(), cut.otherwise(0))


def rate_score(per: Column) -> Column:
    """Score of an error rate: 5 (1 - rate) ^ 1.6, within 0 to 5."""
    return clamp(5 * F.pow(F.greatest(1 - per, F.lit(0.0)), F.lit(1.6)), 0.0, 5.0)


def f1_score(f1: Column) -> Column:
    """1 to 5 from a max-similarity F1, 0.747 (people against people) giving the top."""
    return clamp(1 + 4 * F.greatest(f1, F.lit(0.0)) / 0.747, 1.0, 5.0)


def backoff(attempt: Column, initial: float = 0.5, factor: float = 2.0, most: float = 30.0) -> Column:
    return F.least(initial * F.pow(F.lit(factor), attempt - 1), F.lit(most))
