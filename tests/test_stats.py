"""Known values and planted effects."""

import math

import pytest
from pyspark.sql import functions as F

from lodestone.functions import stats as s
from lodestone.operators import aggregates as a


def one(spark, column, **values):
    names = list(values)
    frame = spark.createDataFrame([tuple(values.values())], names) if names else spark.range(1)
    return frame.select(column.alias("x")).first()["x"]


def test_normal_quantiles(spark):
    for p, z in ((0.5, 0.0), (0.975, 1.959964), (0.9, 1.281552), (0.8, 0.841621)):
        assert one(spark, s.normal_quantile(F.lit(p))) == pytest.approx(z, abs=1e-6)
    assert s.z_for_confidence(0.95) == pytest.approx(s.Z95)


def test_wilson(spark):
    k, n = F.col("k"), F.col("n")
    assert one(spark, s.wilson_low(k, n), k=70, n=100) == pytest.approx(0.6042, abs=1e-4)
    assert one(spark, s.wilson_high(k, n), k=70, n=100) == pytest.approx(0.7811, abs=1e-4)
    assert (one(spark, s.wilson_low(k, n), k=0, n=0), one(spark, s.wilson_high(k, n), k=0, n=0)) == (0.0, 1.0)


def test_two_proportions(spark):
    z = lambda *v: one(spark, s.two_proportion_z(*map(F.lit, v)))
    assert z(70, 100, 70, 100) == 0 and z(90, 100, 40, 100) == pytest.approx(7.41, abs=0.01) and z(0, 0, 1, 2) == 0
    assert one(spark, s.two_sided_p(F.lit(0.0))) == pytest.approx(1.0)


def test_detectable_gap(spark):
    assert one(spark, s.detectable_gap(F.lit(0.7), F.lit(274))) == pytest.approx(0.1097, abs=1e-4)


@pytest.mark.parametrize("error,score", [(0.2, 5), (0.21, 4), (0.45, 4), (0.95, 3), (1.7, 2), (2.8, 1), (2.81, 0)])
def test_cut_score(spark, error, score):
    assert one(spark, s.cut_score(F.lit(error))) == score


def test_rate_scores(spark):
    for per, score in ((0.1, 4.224), (0.2, 3.499), (0.4, 2.208), (0.6, 1.154)):
        assert one(spark, s.rate_score(F.lit(per))) == pytest.approx(score, abs=1e-3)
    assert one(spark, s.f1_score(F.lit(0.747))) == pytest.approx(5.0) and one(spark, s.f1_score(F.lit(-1.0))) == 1.0


def test_spearman_needs_four(spark):
    rows = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 3.0), ("a", 3.0, 9.0), *[("b", float(i), float(-i)) for i in range(5)], *[("c", 1.0, float(i)) for i in range(5)]], "k string, x double, y double")
    got = {r.k: r.rho for r in s.spearman(rows, ["k"], "x", "y").collect()}
    assert got["a"] is None and got["b"] == pytest.approx(-1) and got["c"] == 0


def test_auc_equals_pairs(spark):
    values = [(i * 7 % 11, i % 3 == 0) for i in range(60)]
    pos, neg = [v for v, p in values if p], [v for v, p in values if not p]
    want = sum((x > y) + 0.5 * (x == y) for x in pos for y in neg) / len(pos) / len(neg)
    frame = spark.createDataFrame(values, "v long, p boolean").repartition(5)
    assert s.auc(frame, F.col("p"), F.col("v")).first()["auc"] == pytest.approx(want)


def test_kappa(spark):
    assert one(spark, s.kappa(F.lit(5), F.lit(0), F.lit(0), F.lit(0))) == 1.0
    assert one(spark, s.kappa(F.lit(20), F.lit(5), F.lit(10), F.lit(15))) == pytest.approx(0.4)


def test_planted_effect_is_recovered(spark):
    """Pass chance depends on the tier alone: rates come back, the tier matters and a null split doesn't."""
    rows = spark.range(8000).select(
        F.col("id"), F.when(F.col("id") % 2 == 0, "easy").otherwise("hard").alias("tier"), (F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(1000)) / 1000).alias("u"), (F.pmod(F.xxhash64(F.lit(9), "id"), F.lit(2)) == 0).alias("coin")
    )
    rows = rows.withColumn("passed", F.col("u") < F.when(F.col("tier") == "easy", 0.9).otherwise(0.6))
    got = {r.stratum: r.rate for r in a.pass_rates(rows, F.col("passed"), "tier").collect()}
    assert got["easy"] == pytest.approx(0.9, abs=0.03) and got["hard"] == pytest.approx(0.6, abs=0.03)
    assert a.attribution(rows, F.col("tier") == "easy", F.col("passed")).first()["significant"]
    assert abs(a.attribution(rows, F.col("coin"), F.col("passed")).first()["z"]) < 3


def test_nearest_rank_is_half_even(spark):
    rows = spark.createDataFrame([("a", float(i)) for i in (1, 2, 3, 4)] + [("b", 7.0)], "k string, v double")
    got = {r.k: (r.n, r.p50, r.p90, r.most) for r in a.latency(rows, ["k"], "v").collect()}
    assert got == {"a": (4, 3.0, 4.0, 4.0), "b": (1, 7.0, 7.0, 7.0)}
    assert math.isclose(a.latency(rows.where("k = 'a'"), ["k"], "v").first()["mean"], 2.5)


def test_quantiles_over_the_whole_range(spark):
    from statistics import NormalDist

    ps = [1e-9, 1e-4, 0.0242, 0.0243, 0.3, 0.5, 0.7, 0.9757, 0.9758, 1 - 1e-6]
    rows = spark.createDataFrame([(p,) for p in ps] + [(None,)], "p double")
    got = {r.p: r.z for r in rows.select("p", s.normal_quantile(F.col("p")).alias("z")).collect()}
    assert got[None] is None and all(got[p] == pytest.approx(NormalDist().inv_cdf(p), rel=2e-9, abs=1e-9) for p in ps)
    for bad in (0.0, 1.0, -0.5, 2.0):
        with pytest.raises(Exception, match="between 0 and 1"):
            spark.createDataFrame([(bad,)], "p double").select(s.normal_quantile(F.col("p"))).collect()
