"""Grouped summaries. Every function takes rows and gives a new frame; none collects."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import stats as s
from lodestone.operators.windows import cumulative

PASS = 4  # fixed value: the least passing score


def pass_rates(rows: DataFrame, passed: Column, stratum: str, digits: int = 9) -> DataFrame:
    """stratum, n, k, rate and its Wilson interval. Rows with a null verdict count as not passed."""
    g = rows.groupBy(F.col(stratum).alias("stratum")).agg(F.count(F.lit(1)).alias("n"), F.count_if(passed).alias("k"))
    k, n = F.col("k"), F.col("n")
    cut = lambda c: F.round(c, digits)
    return g.select("stratum", "n", "k", cut(k / n).alias("rate"), cut(s.wilson_low(k, n)).alias("ci_low"), cut(s.wilson_high(k, n)).alias("ci_high"))


def pass_rate_of_ids(rows: DataFrame, ids: DataFrame, key: str, passed: Column) -> DataFrame:
    """n, k and rate over a subset of ids; ids without a row don't count."""
    g = rows.join(ids.select(key).distinct(), key, "left_semi").agg(F.count(F.lit(1)).alias("n"), F.count_if(passed).alias("k"))
    return g.select("n", "k", F.when(F.col("n") > 0, F.col("k") / F.col("n")).alias("rate"))


def agreement(rows: DataFrame, stratum: str, digits: int = 9) -> DataFrame:
    """Two judges' scores ``a`` and ``b`` compared by stratum and overall (stratum ``*``)."""
    pa, pb = F.col("a") >= PASS, F.col("b") >= PASS
    mean = lambda c: F.avg(c.cast("int"))
    g = rows.rollup(stratum).agg(
        F.count(F.lit(1)).alias("n"),
        mean(F.col("a") == F.col("b")).alias("exact"),
        mean(F.abs(F.col("a") - F.col("b")) <= 1).alias("within_one"),
        mean(pa == pb).alias("pass_agreement"),
        F.avg(F.col("a") - F.col("b")).alias("mean_gap"),
        mean(pa).alias("pass_a"),
        mean(pb).alias("pass_b"),
        F.count_if(flagged(F.col("a"), F.col("b"))).alias("flagged"),
        F.count_if(pa & pb).alias("x"),
        F.count_if(pa & ~pb).alias("y"),
        F.count_if(pb & ~pa).alias("z"),
        F.count_if(~pa & ~pb).alias("o"),
    )
    g = g.withColumn("kappa", s.kappa(F.col("x"), F.col("y"), F.col("z"), F.col("o")))
    shown = ["exact", "within_one", "pass_agreement", "mean_gap", "pass_a", "pass_b"]
    return g.select(F.coalesce(stratum, F.lit("*")).alias(stratum), "n", *(F.round(c, digits).alias(c) for c in shown), "flagged", F.round("kappa", digits).alias("kappa"))


def flagged(a: Column, b: Column) -> Column:
    """Two points apart, or one passes and the other fails."""
    return (F.abs(a - b) >= 2) | ((a >= PASS) != (b >= PASS))


def divergences(rows: DataFrame, key: str) -> DataFrame:
    """Flagged rows with the reason, worst first: verdicts that differ, then the widest gap."""
    a, b = F.col("a"), F.col("b")
    differ = (a >= PASS) != (b >= PASS)
    found = rows.where(flagged(a, b)).select(key, "a", "b", (a - b).alias("gap"), F.when(differ, "pass/fail").otherwise("gap").alias("reason"))
    return found.orderBy(~((F.col("a") >= PASS) != (F.col("b") >= PASS)), -F.abs("gap"), key)


def row_scores(members: DataFrame, keys: list[str], score: str, position: str) -> DataFrame:
    """worst, mean (halves to even), best, spread, limiting member (first at the worst score)."""
    x = F.col(score)
    return members.groupBy(*keys).agg(
        F.min(x).alias("worst"),
        F.rint(F.avg(x)).cast("int").alias("mean"),
        F.max(x).alias("best"),
        (F.max(x) - F.min(x)).alias("spread"),
        F.min(F.struct(x.alias("s"), F.col(position).alias("p")))["p"].alias("limiting"),
    )


#: Aggregators by name, each a column of :func:`row_scores`.
AGGREGATORS = ("worst", "mean", "best")


def sensitivity(rows: DataFrame, digits: int = 9) -> DataFrame:
    """Pass rate and mean score under each aggregator, and how far the pass rates lie apart at most."""
    long = rows.select(F.explode(F.create_map(*[c for a in AGGREGATORS for c in (F.lit(a), F.col(a))])).alias("aggregator", "score"))
    g = long.groupBy("aggregator").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("score") >= PASS).cast("int")).alias("p"), F.round(F.avg("score"), digits).alias("mean_score"))
    every = Window.partitionBy()  # one row for each aggregator
    return g.select("aggregator", "n", F.round("p", digits).alias("pass_rate"), "mean_score", F.round(F.max("p").over(every) - F.min("p").over(every), digits).alias("max_delta"))


def panel_median(scores: DataFrame, keys: list[str], score: str, least: int = 3, judge: str | None = None) -> DataFrame:
    """Median, spread and unanimity of odd panels of at least ``least`` judges (a panel is small).

    A judge that scores an item twice, or a score outside 0 to 5, is an error.
    """
    if judge is not None:
        twice = scores.groupBy(*keys, judge).agg(F.count(F.lit(1)).alias("_n"), F.first(score).alias(score))
        scores = twice.where(F.when(F.col("_n") == 1, True).otherwise(F.raise_error(F.lit("a judge scored an item twice")).cast("boolean")))
    legal = F.coalesce(F.col(score).between(0, 5), F.lit(False))
    scores = scores.where(F.when(legal, True).otherwise(F.raise_error(F.lit("a score is not between 0 and 5")).cast("boolean")))
    g = scores.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(score)).alias("xs")).where((F.col("n") >= least) & (F.col("n") % 2 == 1))
    low, high = F.get("xs", F.lit(0)), F.get("xs", F.size("xs") - 1)
    return g.select(*keys, "n", F.get("xs", F.floor(F.size("xs") / 2).cast("int")).alias("median"), (high - low).alias("spread"), (high == low).alias("unanimous"))


def panel_with_failures(scores: DataFrame, keys: list[str], score: str, failed: str, digits: int = 9) -> DataFrame:
    """Median of the judges that answered; unscoreable (null) if more than one didn't."""
    g = scores.groupBy(*keys).agg(F.count(F.lit(1)).alias("judges"), F.count(F.when(~F.col(failed), F.col(score))).alias("ok"), F.median(F.when(~F.col(failed), F.col(score))).alias("m"))
    scoreable = F.col("ok") >= F.greatest(F.lit(1), F.col("judges") - 1)
    return g.select(*keys, "judges", "ok", scoreable.alias("scoreable"), F.when(scoreable, F.round("m", digits)).alias("score"))


def latency(rows: DataFrame, keys: list[str], value: str, digits: int = 9) -> DataFrame:
    """Count, mean, maximum and nearest-rank percentiles (halves to even).

    Ranks come from counts by distinct value, summed before they are ordered, so a key with most of
    the rows orders its distinct values and not its rows.
    """
    steps = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    up = Window.partitionBy(*keys).orderBy(value)
    placed = steps.select(*keys, value, "c", F.sum("c").over(up).alias("to"), F.sum("c").over(Window.partitionBy(*keys)).alias("n"))

    def at(p: float) -> Column:
        rank = F.least(F.rint(F.lit(p) * (F.col("n") - 1)), F.col("n") - 1)
        return F.max(F.when((F.col("to") > rank) & (F.col("to") - F.col("c") <= rank), F.col(value)))

    return placed.groupBy(*keys).agg(
        F.sum("c").alias("n"), F.round(F.sum(F.col(value) * F.col("c")) / F.sum("c"), digits).alias("mean"), F.max(value).alias("most"), at(0.5).alias("p50"), at(0.9).alias("p90"), at(0.99).alias("p99")
    )


def middle_and_low(rows: DataFrame, keys: list[str], value: str, low: float) -> DataFrame:
    """keys, n, median (the upper one) and low (at the rank rounded down), null values left out.

    Ranks come from counts by distinct value, as in ``latency``.
    """
    steps = rows.groupBy(*keys, value).agg(F.count(value).alias("c"))
    up = Window.partitionBy(*keys).orderBy(value)
    placed = steps.select(*keys, value, "c", F.sum("c").over(up).alias("to"), F.sum("c").over(Window.partitionBy(*keys)).alias("n"))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("to") > rank) & (F.col("to") - F.col("c") <= rank), F.col(value)))

    n = F.col("n")
    return placed.groupBy(*keys).agg(F.sum("c").alias("n"), at(F.floor(n / 2)).alias("median"), at(F.floor(F.lit(low) * (n - 1))).alias("low"))


def cost_totals(rows: DataFrame, keys: list[str], parts: Mapping[str, Column], digits: int = 6) -> DataFrame:
    """Sum of each cost component and of all; a component of unknown usage counts as nothing."""
    g = rows.groupBy(*keys).agg(*(F.coalesce(F.sum(c), F.lit(0.0)).alias(n) for n, c in parts.items()))
    total = sum((F.col(n) for n in parts), F.lit(0.0))
    return g.select(*keys, *(F.round(n, digits).alias(n) for n in parts), F.round(total, digits).alias("total"))


def usage_by_model(calls: DataFrame, model: str, amounts: list[str]) -> DataFrame:
    """Calls and summed amounts by model, null amounts as 0."""
    return calls.groupBy(model).agg(F.count(F.lit(1)).alias("calls"), *(F.sum(F.coalesce(F.col(a), F.lit(0))).alias(a) for a in amounts))


def collapse(members: DataFrame, keys: list[str], score: str, digits: int = 9) -> DataFrame:
    """Mean of the members that have a score; groups without one are dropped."""
    g = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_members"), F.count(score).alias("n_scored"), F.round(F.avg(score), digits).alias("mean"))
    return g.where("n_scored > 0").select(*keys, "n_members", "n_scored", (F.col("n_members") == F.col("n_scored")).alias("complete"), "mean")


def attribution(rows: DataFrame, first: Column, passed: Column, digits: int = 9) -> DataFrame:
    """Pass rates of two tiers with z, two-sided p and p < 0.05, in one row."""
    g = rows.agg(
        F.count_if(first).alias("n_first"), F.count_if(first & passed).alias("k_first"), F.count_if(~first).alias("n_other"), F.count_if(~first & passed).alias("k_other")
    )
    g = g.withColumn("z", s.two_proportion_z(F.col("k_first"), F.col("n_first"), F.col("k_other"), F.col("n_other")))
    g = g.withColumn("p", s.two_sided_p(F.col("z")))
    return g.select("n_first", "k_first", "n_other", "k_other", F.round("z", digits).alias("z"), F.round("p", digits).alias("p"), (F.col("p") < 0.05).alias("significant"))


def uncertainty(groups: DataFrame, shares: list[float], z: float = s.Z95) -> DataFrame:
    """One row for each share e of wrong doubtful labels: their variance added to the sampling one."""
    e, n, p = F.col("e"), F.col("n"), F.col("p")
    swept = groups.withColumn("e", F.explode(F.array(*map(F.lit, shares))))
    return swept.withColumn("half_width", z * F.sqrt(p * (1 - p) / n + F.col("low") * e * (1 - e) / (n * n)))


def value_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """field, value, n: counts of each column's values in one pass."""
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x"))
    return long.groupBy("x.field", "x.value").agg(F.count(F.lit(1)).alias("n"))


def weakest(tier: Column, order: list[str]) -> Column:
    """Aggregate: the lowest of ordered tiers (the first of ``order`` is the lowest)."""
    rank = F.array_position(F.array(*map(F.lit, order)), tier)
    return F.min(F.struct(rank.alias("r"), tier.alias("t")))["t"]


def duplicate_groups(rows: DataFrame, content: Column, member: str) -> DataFrame:
    """digest, n, member: contents that more than one member shares, one row for each member.

    A group may have any number of members, so they are rows and not an array.
    """
    each = rows.select(F.sha2(content, 256).alias("digest"), F.col(member).alias("member")).distinct()
    shared = each.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return each.join(shared, "digest").select("digest", "n", "member")


def medians(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys and median (the mean of the two middle values), null values left out.

    Values are counted before they are ordered, and the distinct values of one key are cut into ranges, so a
    key with most of the rows, all of them different, is many tasks.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    placed = cumulative(counts, keys, value, ["c"])
    totals = counts.select(*(F.col(k).alias(f"_{k}") for k in keys), "c").groupBy(*(f"_{k}" for k in keys)).agg(F.sum("c").alias("n"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    ranked = placed.join(totals, same)
    holds = lambda rank: (F.col("before_c") <= rank) & (rank < F.col("before_c") + F.col("c"))
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    middle = ranked.where(holds(low) | holds(high))
    both = (F.max(F.when(holds(low), F.col(value))) + F.max(F.when(holds(high), F.col(value)))) / 2
    return middle.groupBy(*keys).agg(both.alias("median"))


def rate_outliers(rows: DataFrame, group: str, rate: Column, low: float = 0.5, high: float = 2.0) -> DataFrame:
    """Rows whose rate is outside [low, high] times their group's median."""
    rated = rows.withColumn("rate", rate)
    middle = medians(rated, [group], "rate")
    return rated.join(middle, group).where((F.col("rate") < low * F.col("median")) | (F.col("rate") > high * F.col("median")))


def coverage(rows: DataFrame, key: str, source: str, sources: list[str]) -> DataFrame:
    """One row for each key: which sources it has, how many, and whether just one."""
    flags = [F.max((F.col(source) == x).cast("int")).alias(f"has_{x}") for x in sources]
    g = rows.groupBy(key).agg(*flags)
    n = sum((F.col(f"has_{x}") for x in sources), F.lit(0))
    only = F.when(n == 1, F.coalesce(*(F.when(F.col(f"has_{x}") == 1, F.lit(x)) for x in sources)))
    return g.withColumns({"n_sources": n, "only": only})


def coverage_matrix(rows: DataFrame, key: str, source: str, sources: list[str]) -> DataFrame:
    """measure, n: keys by source, in any, in two or more, in all, in one only, in none."""
    c = coverage(rows, key, source, sources)
    n = F.col("n_sources")
    measures = {f"has_{x}": F.col(f"has_{x}") == 1 for x in sources} | {"any": n >= 1, "two_or_more": n >= 2, "all": n == len(sources), "none": n == 0}
    measures |= {f"only_{x}": F.col("only") == x for x in sources}
    summed = c.agg(*(F.count_if(F.coalesce(m, F.lit(False))).alias(k) for k, m in measures.items()))
    return summed.select(F.explode(F.create_map(*[x for k in measures for x in (F.lit(k), F.col(k))])).alias("measure", "n"))
