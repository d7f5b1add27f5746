"""Pass rates, agreement, row scores, summaries and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import stats as s
from lodestone.operators import aggregates as a
from lodestone.operators import frames
from lodestone.operators import similarity as sim
from lodestone.operators import windows as w

from .registry import Tables, query

Z = s.Z95


def judged(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "lang", "source", "n_chars").join(t.labels, "doc_id")


def seconds(ts):
    """Seconds since 1970 of a timestamp without zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts) / 1e6


def _rate_sql(key: str) -> str:
    return f"""
with g as (select {key} stratum, count(*) n, sum(quality)::bigint k from documents join labels using (doc_id) group by 1)
select stratum, n, k, round(k / n, 9) rate,
       round(greatest(0.0, (k/n + {Z}*{Z}/(2*n)) / (1 + {Z}*{Z}/n) - {Z}*sqrt(k/n*(1-k/n)/n + {Z}*{Z}/(4.0*n*n)) / (1 + {Z}*{Z}/n)), 9) ci_low,
       round(least(1.0, (k/n + {Z}*{Z}/(2*n)) / (1 + {Z}*{Z}/n) + {Z}*sqrt(k/n*(1-k/n)/n + {Z}*{Z}/(4.0*n*n)) / (1 + {Z}*{Z}/n)), 9) ci_high
from g"""


@query(_rate_sql("lang"))
def pass_rate_by_lang(t: Tables) -> DataFrame:
    return a.pass_rates(judged(t), F.col("quality") == 1, "lang")


@query(_rate_sql("source"))
def pass_rate_by_source(t: Tables) -> DataFrame:
    return a.pass_rates(judged(t), F.col("quality") == 1, "source")


@query("""
select coalesce(lang, '*') lang, coalesce(source, '*') source, count(*) n, sum(quality)::bigint k
from documents join labels using (doc_id) group by grouping sets ((), (lang), (source))""")
def pass_rate_all_strata(t: Tables) -> DataFrame:
    """Overall and by each stratum in one pass over the rows."""
    rows = judged(t).groupingSets([[], ["lang"], ["source"]], "lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").cast("long").alias("k"))
    return rows.select(F.coalesce("lang", F.lit("*")).alias("lang"), F.coalesce("source", F.lit("*")).alias("source"), "n", "k")


@query("""
with j as (select lang, quality * 5 a, case when n_chars >= 1000 then 5 when n_chars >= 400 then 4 else 2 end b from documents join labels using (doc_id)),
p as (select lang, a, b, a >= 4 pa, b >= 4 pb from j),
g as (select coalesce(lang, '*') lang, count(*) n, avg((a = b)::int) exact, avg((abs(a - b) <= 1)::int) within_one, avg((pa = pb)::int) pass_agreement,
  avg(a - b) mean_gap, avg(pa::int) pass_a, avg(pb::int) pass_b, sum((abs(a - b) >= 2 or pa <> pb)::int)::bigint flagged,
  sum((pa and pb)::int) x, sum((pa and not pb)::int) y, sum((pb and not pa)::int) z, sum((not pa and not pb)::int) o from p group by rollup (lang))
select lang, n, round(exact, 9) exact, round(within_one, 9) within_one, round(pass_agreement, 9) pass_agreement, round(mean_gap, 9) mean_gap,
 round(pass_a, 9) pass_a, round(pass_b, 9) pass_b, flagged,
 round(case when (x+y)/n*((x+z)/n) + (z+o)/n*((y+o)/n) >= 1 then 1.0 else ((x+o)/n - ((x+y)/n*((x+z)/n) + (z+o)/n*((y+o)/n))) / (1 - ((x+y)/n*((x+z)/n) + (z+o)/n*((y+o)/n))) end, 9) kappa
from g""")
def agreement_by_lang(t: Tables) -> DataFrame:
    b = F.when(F.col("n_chars") >= 1000, 5).when(F.col("n_chars") >= 400, 4).otherwise(2)
    return a.agreement(judged(t).select("lang", (F.col("quality") * 5).alias("a"), b.alias("b")), "lang")


@query("""
with j as (select doc_id, quality * 5 a, case when n_chars >= 1000 then 5 when n_chars >= 400 then 4 else 2 end b from documents join labels using (doc_id))
select doc_id, a, b, a - b gap, case when (a >= 4) <> (b >= 4) then 'pass/fail' else 'gap' end reason
from j where abs(a - b) >= 2 or (a >= 4) <> (b >= 4)""")
def divergence_worklist(t: Tables) -> DataFrame:
    """All disagreements, pass against fail first, then the widest."""
    b = F.when(F.col("n_chars") >= 1000, 5).when(F.col("n_chars") >= 400, 4).otherwise(2)
    return a.divergences(judged(t).select("doc_id", (F.col("quality") * 5).alias("a"), b.alias("b")), "doc_id")


SPAN_SQL = """spans as (select l_orderkey, l_linenumber, l_partkey, case when l_discount * 10 <= 0.2 then 5 when l_discount * 10 <= 0.45 then 4 when l_discount * 10 <= 0.95 then 3 when l_discount * 10 <= 1.7 then 2 when l_discount * 10 <= 2.8 then 1 else 0 end score from lineitem)"""


def spans(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", s.cut_score(F.col("l_discount") * 10).alias("score"))


@query(f"""
with {SPAN_SQL}
select l_orderkey, min(score) worst, round_even(avg(score), 0)::int mean, max(score) best, max(score) - min(score) spread,
       arg_min(l_linenumber, score * 1000 + l_linenumber) limiting from spans group by 1""")
def order_scores(t: Tables) -> DataFrame:
    """Row scores from member scores: worst, mean (halves to even), best, and the limiting member."""
    return a.row_scores(spans(t), ["l_orderkey"], "score", "l_linenumber").select("l_orderkey", "worst", "mean", "best", "spread", "limiting")


@query(f"""
with {SPAN_SQL}, r as (select l_orderkey, min(score) worst, round_even(avg(score), 0) mean, max(score) best from spans group by 1),
u as (unpivot (select worst::double worst, mean::double mean, best::double best from r) on worst, mean, best into name aggregator value score)
select aggregator, count(*) n, round(avg((score >= 4)::int), 9) pass_rate, round(avg(score), 9) mean_score, round(max(avg((score >= 4)::int)) over () - min(avg((score >= 4)::int)) over (), 9) max_delta from u group by 1""")
def aggregator_sensitivity(t: Tables) -> DataFrame:
    rows = a.row_scores(spans(t), ["l_orderkey"], "score", "l_linenumber")
    return a.sensitivity(rows)


@query(f"""
with {SPAN_SQL}, g as (select l_orderkey, count(*) n, list_sort(list(score)) xs from spans group by 1)
select l_orderkey, n, xs[n // 2 + 1] median, xs[n] - xs[1] spread, xs[n] = xs[1] unanimous from g where n >= 3 and n % 2 = 1""")
def panel_median(t: Tables) -> DataFrame:
    """Median of odd panels of at least three judges."""
    return a.panel_median(spans(t), ["l_orderkey"], "score", 3)


@query("""
with g as (select user_id, count(*) judges, count(case when event_type <> 'error' then value end) ok, median(case when event_type <> 'error' then value end) m from events group by 1)
select user_id, judges, ok, ok >= greatest(1, judges - 1) scoreable, case when ok >= greatest(1, judges - 1) then round(m, 9) end score from g""")
def panel_with_failures(t: Tables) -> DataFrame:
    """Median over judges that answered; null if more than one failed."""
    return a.panel_with_failures(t.events.withColumn("failed", F.col("event_type") == "error"), ["user_id"], "value", "failed")


RANKS = "least(len(xs) - 1, round_even({p} * (len(xs) - 1), 0))::int + 1"


@query(f"""
with g as (select event_type, list_sort(list(value)) xs, avg(value) mean, max(value) most, count(*) n from events where value is not null group by 1)
select event_type, n, round(mean, 9) mean, most, xs[{RANKS.format(p=0.5)}] p50, xs[{RANKS.format(p=0.9)}] p90, xs[{RANKS.format(p=0.99)}] p99 from g""")
def nearest_rank_latency(t: Tables) -> DataFrame:
    return a.latency(t.events, ["event_type"], "value")


@query("""
with g as (select l_returnflag, list_sort(list(l_extendedprice)) xs, count(*) n from lineitem group by 1)
select l_returnflag, n, xs[n // 2 + 1] median, xs[floor(0.1 * (n - 1))::int + 1] p10 from g""")
def upper_median_low_tenth(t: Tables) -> DataFrame:
    return a.middle_and_low(t.lineitem, ["l_returnflag"], "l_extendedprice", 0.1).withColumnRenamed("low", "p10")


@query("""
select event_type, count(*) n, sum((value >= 50)::int)::bigint ok, sum((value < 10)::int)::bigint errors, count(distinct user_id) users,
       round(sum(value), 6) as seconds, round(sum(case when value >= 50 then value * 0.002 + 0.01 else 0 end), 6) cost,
       concat(sum((value >= 50)::int)::bigint, '/', count(*)) coverage from events group by 1""")
def run_summary(t: Tables) -> DataFrame:
    ok = F.col("value") >= 50
    return t.events.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(ok).alias("ok"),
        F.count_if(F.col("value") < 10).alias("errors"),
        F.countDistinct("user_id").alias("users"),
        F.round(F.sum("value"), 6).alias("seconds"),
        F.round(F.sum(F.when(ok, F.col("value") * 0.002 + 0.01).otherwise(0.0)), 6).alias("cost"),
        F.concat(F.count_if(ok).cast("string"), F.lit("/"), F.count(F.lit(1)).cast("string")).alias("coverage"),
    )


@query("""
select l_returnflag, l_linestatus, round(sum(l_quantity * 0.01), 6) per_item, round(sum(l_extendedprice * l_tax * 0.001), 6) per_tax,
       round(sum(l_quantity * 0.01) + sum(l_extendedprice * l_tax * 0.001), 6) total, sum((l_tax = 0)::int)::bigint untaxed from lineitem group by 1, 2""")
def cost_totals(t: Tables) -> DataFrame:
    """Usage times prices, summed by component."""
    parts = {"per_item": F.col("l_quantity") * 0.01, "per_tax": F.col("l_extendedprice") * F.col("l_tax") * 0.001}
    return a.cost_totals(t.lineitem, ["l_returnflag", "l_linestatus"], parts).join(
        t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count_if(F.col("l_tax") == 0).alias("untaxed")), ["l_returnflag", "l_linestatus"]
    )


@query("""
select l_orderkey, l_linenumber, array_to_string(list_filter([case when round(l_quantity * 0.01, 4) <> 0 then 'items' end, case when l_tax <> 0 then 'tax' end, case when l_discount <> 0 then 'discount' end], lambda x: x is not null), ',') components from lineitem""")
def cost_components(t: Tables) -> DataFrame:
    """Names of the components of each line's cost that aren't zero."""
    costs = F.create_map(F.lit("items"), F.round(F.col("l_quantity") * 0.01, 4), F.lit("tax"), F.col("l_tax"), F.lit("discount"), F.col("l_discount"))
    return t.lineitem.select("l_orderkey", "l_linenumber", F.array_join(F.map_keys(F.map_filter(costs, lambda _, v: v != 0)), ",").alias("components"))


@query("""
select o_orderkey, count(l_linenumber) n_members, count(case when l_discount > 0.02 then 1 end) n_scored, count(l_linenumber) = count(case when l_discount > 0.02 then 1 end) complete,
       round(avg(case when l_discount > 0.02 then l_discount end), 9) mean from orders join lineitem on o_orderkey = l_orderkey group by 1 having count(case when l_discount > 0.02 then 1 end) > 0""")
def collapse_products(t: Tables) -> DataFrame:
    """Products from their members: mean of those scored, dropped if none is."""
    rows = t.orders.select("o_orderkey").join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
    return a.collapse(rows.withColumn("score", F.when(F.col("l_discount") > 0.02, F.col("l_discount"))), ["o_orderkey"], "score")


@query("""
with d as (select n_chars, toxic = 1 bad from documents join labels using (doc_id)),
g as (select n_chars, sum(bad::int) p, sum((not bad)::int) q from d group by 1),
w as (select p, q, p * (coalesce(sum(q) over (order by n_chars rows between unbounded preceding and 1 preceding), 0) + q / 2) w from g)
select sum(p)::bigint n_pos, sum(q)::bigint n_neg, round(sum(w) / (sum(p) * sum(q)), 9) auc from w""")
def auc_toxic_by_length(t: Tables) -> DataFrame:
    return s.auc(judged(t), F.col("toxic") == 1, F.col("n_chars")).withColumn("auc", F.round("auc", 9))


@query("""
select min(case when quality = 0 then n_chars end) - max(case when quality = 1 then n_chars end) error_gap, min(case when quality = 0 then n_chars end) worst_low, max(case when quality = 1 then n_chars end) best_high
from documents join labels using (doc_id)""")
def error_gap(t: Tables) -> DataFrame:
    low, high = F.min(F.when(F.col("quality") == 0, F.col("n_chars"))), F.max(F.when(F.col("quality") == 1, F.col("n_chars")))
    return judged(t).agg((low - high).alias("error_gap"), low.alias("worst_low"), high.alias("best_high"))


@query("""
select case when n_chars > 2000 then 'long' else 'short' end kind, count(*) n, round(avg(quality), 9) pass_rate, round(avg((quality = 1 and toxic = 0)::int), 9) correct_rate, round(avg(n_chars), 6) mean_error, round(avg(toxic), 9) confusable_rate
from documents join labels using (doc_id) group by 1""")
def stress_summary(t: Tables) -> DataFrame:
    kind = F.when(F.col("n_chars") > 2000, "long").otherwise("short")
    mean = lambda c: F.round(F.avg(c), 9)
    return judged(t).groupBy(kind.alias("kind")).agg(
        F.count(F.lit(1)).alias("n"), mean("quality").alias("pass_rate"), mean(((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")).alias("correct_rate"), F.round(F.avg("n_chars"), 6).alias("mean_error"), mean("toxic").alias("confusable_rate")
    )


@query("""
with e as (select user_id, event_type, value, extract(epoch from ts)::double x from events where value is not null),
r as (select event_type, rank() over (partition by event_type order by value) + (count(*) over (partition by event_type, value) - 1) / 2 ra,
             rank() over (partition by event_type order by x) + (count(*) over (partition by event_type, x) - 1) / 2 rb from e)
select event_type, count(*) n, round(case when count(*) < 4 then null when stddev_pop(ra) = 0 or stddev_pop(rb) = 0 then 0.0 else corr(ra, rb) end, 8) rho from r group by 1""")
def spearman_by_type(t: Tables) -> DataFrame:
    rows = t.events.where("value is not null").select("event_type", "value", seconds(F.col("ts")).alias("x"))
    return s.spearman(rows, ["event_type"], "value", "x").withColumn("rho", F.round("rho", 8))


TWO = """with g as (select l.lang, sum(quality) k, count(*) n from (select doc_id, lang from documents) l join labels using (doc_id) group by 1),
p as (select a.lang a, b.lang b, a.k k1, a.n n1, b.k k2, b.n n2, (a.k + b.k) / (a.n + b.n) q from g a join g b on a.lang < b.lang)"""


@query(f"""{TWO}
select a, b, round(case when q * (1 - q) > 0 then (k1 / n1 - k2 / n2) / sqrt(q * (1 - q) * (1 / n1 + 1 / n2)) else 0 end, 9) z,
       round((1.959963984540054 + 0.8416212335729143) * sqrt(2 * q * (1 - q) / ((n1 + n2) / 2)), 9) detectable from p""")
def two_proportions(t: Tables) -> DataFrame:
    """Every pair of languages (a bounded dimension) with z and the least detectable gap."""
    g = judged(t).groupBy("lang").agg(F.sum("quality").alias("k"), F.count(F.lit(1)).alias("n"))
    x, y = (g.select(*(F.col(c).alias(f"{c}_{i}") for c in g.columns)) for i in (1, 2))
    pool = (F.col("k_1") + F.col("k_2")) / (F.col("n_1") + F.col("n_2"))
    z = s.two_proportion_z(F.col("k_1"), F.col("n_1"), F.col("k_2"), F.col("n_2"))
    gap = s.detectable_gap(pool, (F.col("n_1") + F.col("n_2")) / 2)
    return x.join(F.broadcast(y), F.col("lang_1") < F.col("lang_2")).select(F.col("lang_1").alias("a"), F.col("lang_2").alias("b"), F.round(z, 9).alias("z"), F.round(gap, 9).alias("detectable"))


@query()
def attribution_by_length(t: Tables) -> DataFrame:
    """Pass rates of long and short texts with z, two-sided p and whether p < 0.05."""
    return a.attribution(judged(t), F.col("n_chars") >= 1000, F.col("quality") == 1)


@query("""
with g as (select lang, count(*) n, avg(quality) p, sum((n_chars < 500)::int) low from documents join labels using (doc_id) group by 1)
select lang, e, round(p, 9) p, round(1.959963984540054 * sqrt(p * (1 - p) / n + low * e * (1 - e) / (n * n)), 9) half_width, n - low::bigint confirmed, round((n - low) / n, 9) confirmed_share
from g, (values (0.0), (0.1), (0.2), (0.3)) v(e)""")
def uncertainty_sweep(t: Tables) -> DataFrame:
    """Half width of the interval if a share e of doubtful labels were wrong."""
    g = judged(t).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.avg("quality").alias("p"), F.count_if(F.col("n_chars") < 500).alias("low"))
    return a.uncertainty(g, [0.0, 0.1, 0.2, 0.3]).select("lang", "e", F.round("p", 9).alias("p"), F.round("half_width", 9).alias("half_width"), (F.col("n") - F.col("low")).alias("confirmed"), F.round((F.col("n") - F.col("low")) / F.col("n"), 9).alias("confirmed_share"))


@query("""
with g as (select source, count(*) n from documents group by 1)
select source, n, round(100e0 * (1.959963984540054e0 + 0.8416212335729143e0) * sqrt(2e0 * 0.7e0 * 0.3e0 / n), 6) gap_pp, round(100e0 * 1.959963984540054e0 * sqrt(0.7e0 * 0.3e0 / n), 6) half_pp from g""")
def power_table(t: Tables) -> DataFrame:
    g = t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return g.select("source", "n", F.round(100 * s.detectable_gap(F.lit(0.7), F.col("n")), 6).alias("gap_pp"), F.round(100 * Z * F.sqrt(F.lit(0.7) * 0.3 / F.col("n")), 6).alias("half_pp"))


@query("""
with o as (select event_type, avg((value >= 50)::int) observed, count(*) n from events group by 1),
p(event_type, published) as (values ('click', 0.5), ('view', 0.45), ('purchase', 0.6), ('login', 0.3))
select event_type, n, round(observed, 9) observed, published, round(100 * (observed - published), 6) gap_pp from o join p using (event_type)""")
def published_gap(t: Tables) -> DataFrame:
    """Observed rates against a published list; systems in both only."""
    published = t.spark.createDataFrame([("click", 0.5), ("view", 0.45), ("purchase", 0.6), ("login", 0.3)], "event_type string, published double")
    o = t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("value") >= 50).cast("int")).alias("observed"))
    return o.join(F.broadcast(published), "event_type").select("event_type", "n", F.round("observed", 9).alias("observed"), "published", F.round(100 * (F.col("observed") - F.col("published")), 6).alias("gap_pp"))


@query("""
with b as (select event_id, value, 100 - value d, case when value >= 80 then '80+' when value >= 60 then '60-80' when value >= 40 then '40-60' else 'under 40' end band from events where value is not null)
select band, count(*) n, round(count(*) / (select count(*) from b), 9) share, round(sum(greatest(80 - value, 0)) / (select sum(greatest(80 - value, 0)) from b), 7) deficit from b group by 1""")
def band_deficit(t: Tables) -> DataFrame:
    """Bands of a score with their share of rows and of the shortfall to a goal of 80."""
    x = F.col("value")
    band = F.when(x >= 80, "80+").when(x >= 60, "60-80").when(x >= 40, "40-60").otherwise("under 40")
    g = t.events.where(x.isNotNull()).groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.greatest(80 - x, F.lit(0.0))).alias("d"))
    whole = Window.partitionBy()  # four rows
    return g.select("band", "n", F.round(F.col("n") / F.sum("n").over(whole), 9).alias("share"), F.round(F.col("d") / F.sum("d").over(whole), 7).alias("deficit"))


@query("select event_type, count(*) n, sum((abs(value - 50) <= 0.1)::int)::bigint near from events group by 1")
def near_cutoff(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs(F.col("value") - 50) <= 0.1).alias("near"))


@query("select 'lang' as field, lang as value, count(*) n from documents group by all union all select 'source', source, count(*) from documents group by all")
def value_counts(t: Tables) -> DataFrame:
    return a.value_counts(t.documents, ["lang", "source"])


@query("""
with o as (select user_id, event_id, value, row_number() over (partition by user_id order by ts, event_id) rn from events where value is not null),
l as (select user_id, list(value order by rn) xs from o group by 1)
select user_id, len(xs)::int n, list_reduce(xs, lambda a, x: case when x > a + 0.005 then x else a end) best, xs[1] as first from l""")
def running_best(t: Tables) -> DataFrame:
    """Best so far where a candidate must beat it by a margin, in time order."""
    return w.running_best(t.events.where("value is not null"), ["user_id"], ["ts", "event_id"], "value", 0.005)


@query("""
with o as (select user_id, event_type, ts, event_id, lag(event_type) over (partition by user_id order by ts, event_id) prev from events),
g as (select *, sum((prev is null or prev <> event_type)::int) over (partition by user_id order by ts, event_id) run from o)
select user_id, run::bigint run, any_value(event_type) event_type, count(*) n, min(ts) first_ts, max(ts) last_ts from g group by user_id, run""")
def event_runs(t: Tables) -> DataFrame:
    return w.runs(t.events, ["user_id"], ["ts", "event_id"], "event_type", "ts")


@query("""
with o as (select event_id, user_id, epoch(ts)::double a, epoch(ts)::double + 0.2 b from events),
n as (select *, lag(b) over w pb, lead(a) over w na from o window w as (partition by user_id order by a, event_id))
select event_id, round(a - case when pb is null then 0.15 else greatest(0, least((a - pb) / 2, 0.15)) end, 6) wide_from, round(b + case when na is null then 0.15 else greatest(0, least((na - b) / 2, 0.15)) end, 6) wide_to from n""")
def gap_midpoints(t: Tables) -> DataFrame:
    """Intervals widened by half the gap to each neighbour, at most 0.15."""
    rows = t.events.select("event_id", "user_id", seconds(F.col("ts")).alias("a"), (seconds(F.col("ts")) + 0.2).alias("b"))
    wide = w.widen(rows, ["user_id"], "event_id", "a", "b", 0.15)
    return wide.select("event_id", F.round("wide_from", 6).alias("wide_from"), F.round("wide_to", 6).alias("wide_to"))


@query("select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) r from events) where r = 1")
def latest_per_user(t: Tables) -> DataFrame:
    """The last record of each key wins."""
    return w.last_per_key(t.events, ["user_id"], ["ts", "event_id"], ["event_id", "event_type", "value"])


@query("""
with n as (select p_partkey, p_retailprice, length(p_name) len, count(*) over () n, row_number() over (order by length(p_name), p_partkey) - 1 r1, row_number() over (order by p_retailprice, p_partkey) - 1 r2 from part),
f as (select p_partkey, n, r1 / greatest(n - 1, 1) fr, 0.4 * r1 / greatest(n - 1, 1) + 0.4 * (1 - r2 / greatest(n - 1, 1)) + 0.2 * (p_partkey % 3) / 2 composite from n),
b as (select *, row_number() over (order by composite, p_partkey) - 1 rn from f)
select p_partkey, round(fr, 9) rank_fraction, round(composite, 9) composite, least(floor(rn / (n / 3)), 2)::int band from b""")
def tertile_bands(t: Tables) -> DataFrame:
    """Rank fractions, a composite of them, and its three bands."""
    rows = t.part.select("p_partkey", F.length("p_name").alias("len"), "p_retailprice")
    rows = w.rank_fraction(rows, "len", "p_partkey", "r1")
    rows = w.rank_fraction(rows, "p_retailprice", "p_partkey", "r2")
    composite = 0.4 * F.col("r1") + 0.4 * (1 - F.col("r2")) + 0.2 * (F.col("p_partkey") % 3) / 2
    rows = w.tertiles(rows.withColumn("composite", composite), "composite", "p_partkey", "band")
    return rows.select("p_partkey", F.round("r1", 9).alias("rank_fraction"), F.round("composite", 9).alias("composite"), "band")


@query("""
with n as (select p_name, length(p_name) len from (select distinct p_name from part)), d as (select a.p_name, a.len, min(levenshtein(a.p_name, b.p_name)) near from n a join n b on a.p_name <> b.p_name group by 1, 2),
r as (select *, count(*) over () n, row_number() over (order by len, p_name) - 1 r1, row_number() over (order by near, p_name) - 1 r2 from d),
f as (select *, r1 / greatest(n - 1, 1) fr, 1 - r2 / greatest(n - 1, 1) crowd from r), c as (select *, 0.4e0 * fr + 0.4e0 * crowd + 0.2e0 * (len % 3) / 2 composite from f),
b as (select *, row_number() over (order by composite, p_name) - 1 rn from c)
select p_name, near::int near, round(fr, 9) length_rank, round(crowd, 9) crowding_rank, round(composite, 9) composite, least(floor(rn / (n / 3)), 2)::int band from b""")
def difficulty_profile(t: Tables) -> DataFrame:
    """Names by how hard they are to say and to tell from their nearest neighbour, in three bands."""
    near = sim.nearest(t.part, t.part, "p_name", 1, 40).select(F.col("query").alias("p_name"), F.col("distance").alias("near"))
    rows = near.withColumn("len", F.length("p_name"))
    bands = w.difficulty_bands(rows, "p_name", "len", "near", (F.col("len") % 3) / 2)
    return bands.select("p_name", "near", *(F.round(c, 9).alias(c) for c in ("length_rank", "crowding_rank", "composite")), "band")


@query("""
with f as (select user_id clip, row_number() over (partition by user_id order by ts, event_id) - 1 frame, event_type label, coalesce(value, 0) score from events),
n as (select *, case when lag(label) over w = label then 0 else 1 end new from f window w as (partition by clip order by frame)), g as (select *, sum(new) over (partition by clip order by frame) run from n),
r as (select clip, run, any_value(label) label, min(frame) s, max(frame) + 1 e, avg(score) score from g where label <> 'view' group by 1, 2),
p as (select *, row_number() over (partition by clip order by run) - 1 place from r),
o as (select *, lag(e) over w b, lead(s) over w a from p window w as (partition by clip order by place)),
q as (select clip, arg_min(s, place) s, arg_min({'x': b}, place).x b, arg_max(e, place) e, arg_max({'x': a}, place).x a, sum(score * (e - s)) / sum(e - s) score from o where place % 3 = 1 and clip % 4 > 0 group by 1)
select clip, round(case when b is null then greatest(0, s * 0.02 - 0.03) else s * 0.02 - least((s - b) / 2 * 0.02, 0.15) end, 9) from_s,
  round(case when a is null then least(c * 0.02, e * 0.02 + 0.03) else e * 0.02 + least((a - e) / 2 * 0.02, 0.15) end, 9) to_s, round(score, 9) score
from q join (select user_id, count(*) c from events group by 1) l on l.user_id = q.clip""")
def aligned_words(t: Tables) -> DataFrame:
    """Spans of every third token of a clip by its frames' labels; every fourth clip was said otherwise."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    frames_ = t.events.select(F.col("user_id").alias("clip"), (F.row_number().over(order) - 1).alias("frame"), F.col("event_type").alias("label"), F.coalesce("value", F.lit(0.0)).alias("p"))
    found = frames.segments(frames_, ["clip"], "frame", "label", "p", "view")
    said = F.when((F.col("clip") % 4 == 0) & (F.col("place") == 0), "other").otherwise(F.col("label"))
    tokens = found.select("clip", "place", said.alias("label"), (F.col("place") % 3 == 1).alias("wanted"))
    lengths = frames_.groupBy("clip").agg(F.count(F.lit(1)).alias("frames")).withColumn("seconds", F.col("frames") * 0.02)
    spans = frames.aligned_spans(found, tokens, lengths, ["clip"])
    return spans.select("clip", *(F.round(c, 9).alias(c) for c in ("from_s", "to_s", "score")))
