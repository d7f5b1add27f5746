"""Whole reports: one long table of sections, made of the operators of single measures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import stats as s
from lodestone.operators import aggregates as a

from .registry import Tables, query

_LONG = ("section", "system", "stratum", "measure", "value")


def _long(frame: DataFrame, section: str, system: Column, stratum: Column, measures: dict[str, Column], digits: int = 9) -> DataFrame:
    """A row for each measure of each row."""
    pairs = F.array(*(F.struct(F.lit(name).alias("measure"), F.round(c.cast("double"), digits).alias("value")) for name, c in measures.items()))
    flat = frame.select(F.lit(section).alias("section"), system.cast("string").alias("system"), stratum.cast("string").alias("stratum"), F.explode(pairs).alias("m"))
    return flat.select("section", "system", "stratum", "m.*")


def fidelity_sections(results: DataFrame, published: DataFrame, dimensions: list[str], baseline: float = 0.7, errors: tuple[float, ...] = (0.1, 0.2, 0.3)) -> DataFrame:
    """section, system, stratum, measure, value: everything about systems' pass rates.

    ``results`` has system, key, passed, low (is the reference doubtful?) and the ``dimensions``; ``published`` has
    system and published (a rate). Sections: rate (of every system, overall and by dimension, with intervals),
    doubt (failures that doubtful references could explain), gap and correlation (against the published rates, of
    systems in both), power (what gap the number of keys can tell), effective (keys with a sound reference) and
    uncertainty (half widths if a share of the doubtful labels were wrong, at the mean of the systems' rates).
    Rows are read in one pass for all rates; the other sections come from sums by system.
    """
    which = F.coalesce(*(F.when(F.grouping(d) == 0, F.lit(d)) for d in dimensions), F.lit("all"))
    counts = [F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("k"), F.count_if("low").alias("low"), F.count_if(~F.col("passed") & F.col("low")).alias("low_fails")]
    g = results.groupingSets([["system"], *(["system", d] for d in dimensions)], "system", *dimensions).agg(which.alias("dimension"), *counts)
    name = F.when(F.col("dimension") == "all", "*").otherwise(F.coalesce(*(F.when(F.col("dimension") == d, F.concat(F.lit(f"{d}="), F.col(d).cast("string"))) for d in dimensions)))
    rates = g.select("system", name.alias("stratum"), "n", "k", "low", "low_fails")
    n, k = F.col("n"), F.col("k")
    system, stratum, every = F.col("system"), F.col("stratum"), F.lit("*")
    parts = [_long(rates, "rate", system, stratum, {"n": n, "k": k, "rate": k / n, "ci_low": s.wilson_low(k, n), "ci_high": s.wilson_high(k, n)})]
    overall = rates.where("stratum = '*'")
    parts.append(_long(overall, "doubt", system, every, {"fails": n - k, "low_fails": F.col("low_fails"), "share": F.coalesce(F.try_divide("low_fails", n - k), F.lit(0.0))}))
    both = overall.select("system", (k / n).alias("rate")).join(published, "system")
    parts.append(_long(both, "gap", system, every, {"gap_pp": 100 * (F.col("rate") - F.col("published"))}))
    rho = s.spearman(both.withColumn("all", F.lit(1)), ["all"], "rate", "published")
    parts.append(_long(rho, "correlation", every, every, {"n": n, "rho": F.col("rho")}))
    keys = results.groupBy("key").agg(F.bool_or("low").alias("low")).agg(F.count(F.lit(1)).alias("n"), F.count_if("low").alias("low"))
    level = overall.agg(F.avg(k / n).alias("p"))  # one row
    whole = keys.withColumn("one", F.lit(1)).join(level.withColumn("one", F.lit(1)), "one").where("n > 0")
    passed = F.round(baseline * n)
    power = {"n": n, "min_gap_pp": 100 * s.detectable_gap(F.lit(baseline), n), "half_pp": 50 * (s.wilson_high(passed, n) - s.wilson_low(passed, n))}
    parts.append(_long(whole, "power", every, every, power))
    parts.append(_long(whole, "effective", every, every, {"total": n, "low": F.col("low"), "confirmed": n - F.col("low"), "share": (n - F.col("low")) / n}))
    p = F.col("p")
    for e in errors:
        sampling = p * (1 - p) / n
        wide = F.sqrt(sampling + F.col("low") * e * (1 - e) / (n * n))
        parts.append(_long(whole, "uncertainty", every, F.lit(str(e)), {"sampling_pp": 100 * s.Z95 * F.sqrt(sampling), "half_pp": 100 * s.Z95 * wide}))
    return reduce(DataFrame.unionAll, parts)


def coverage_sections(universe: DataFrame, clips: DataFrame, sources: list[str]) -> DataFrame:
    """section, system, stratum, measure, value: which names have clips from which sources.

    ``universe`` has name, type and tier (names are unique); ``clips`` has name, source, digest and part (whether the
    clip is only of a part of the name). Sections: headline (names by source, in any, two or more, all, one only
    and none, with shares; clips of parts don't count), parts (names with clips of parts by source), type and tier
    (crosstabs with what covers a name), duplicates (groups of equal contents and their clips).
    """
    whole = clips.where(~F.col("part"))
    covered = a.coverage(whole.where(F.col("source").isin(sources)), "name", "source", sources)
    joined = universe.join(covered, "name", "left").withColumn("n", F.coalesce("n_sources", F.lit(0)))
    has = {x: F.coalesce(F.col(f"has_{x}"), F.lit(0)) == 1 for x in sources}
    n = F.col("n")
    flags = {f"has_{x}": c for x, c in has.items()} | {"any": n >= 1, "two_or_more": n >= 2, "all": n == len(sources)}
    flags |= {f"only_{x}": has[x] & (n == 1) for x in sources} | {"none": n == 0}
    total = F.count(F.lit(1))
    head = joined.agg(total.alias("total"), *(F.count_if(c).alias(name) for name, c in flags.items()))
    every = F.lit("*")
    shares = [F.struct(F.lit(name).alias("stratum"), F.col(name).alias("n"), F.coalesce(F.try_divide(name, "total"), F.lit(0.0)).alias("share")) for name in ("total", *flags)]
    lines = head.select(F.explode(F.array(*shares)).alias("x")).select("x.*")
    parts = [_long(lines, "headline", every, F.col("stratum"), {"n": n, "share": F.col("share")})]
    part = clips.where("part").groupBy("source").agg(F.countDistinct("name").alias("n"))
    parts.append(_long(part, "parts", F.col("source"), every, {"n": n}))
    group = F.when(n >= 2, "two_or_more").when(n == 0, "none")
    for x in sources:
        group = group.when(has[x], f"only_{x}")
    kinds = joined.groupBy("type", group.alias("group")).agg(total.alias("c"))
    parts.append(_long(kinds, "type", F.col("type"), F.col("group"), {"n": F.col("c")}))
    level = F.when(n >= 2, "two_or_more").when(n == 1, "one").otherwise("none")
    tiers = joined.groupBy("tier", level.alias("group")).agg(total.alias("c"))
    parts.append(_long(tiers, "tier", F.col("tier"), F.col("group"), {"n": F.col("c")}))
    each = clips.select("digest", "name", "source").distinct()
    shared = each.groupBy("digest").agg(total.alias("c")).where("c > 1").agg(total.alias("groups"), F.coalesce(F.sum("c"), F.lit(0)).alias("clips"))
    parts.append(_long(shared, "duplicates", every, every, {"groups": F.col("groups"), "clips": F.col("clips")}))
    return reduce(DataFrame.unionAll, parts)


_WILSON = "({k}/{n} + z*z/(2*{n})) / (1 + z*z/{n}) {sign} z*sqrt({k}/{n}*(1-{k}/{n})/{n} + z*z/(4.0*{n}*{n})) / (1 + z*z/{n})"
_LOW, _HIGH = (f"{f}({x}, {_WILSON.format(k='{k}', n='{n}', sign=sign)})" for f, x, sign in (("greatest", "0.0", "-"), ("least", "1.0", "+")))


def _rows(section: str, system: str, stratum: str, source: str, **measures: str) -> str:
    return " union all ".join(f"select '{section}' section, {system} system, {stratum} stratum, '{name}' measure, round(({m})::double, 9) as value from {source}" for name, m in measures.items())


_POWER = {"n": "n", "min_gap_pp": "100 * (z + 0.8416212335729143) * sqrt(2 * 0.7::double * 0.3::double / n)", "half_pp": f"50 * ({_HIGH.format(k='b', n='n')} - {_LOW.format(k='b', n='n')})"}


@query(f"""
with r as (select doc_id as key, source system, quality = 1 passed, n_chars < 500 low, lang, case when n_chars >= 1000 then 'long' else 'short' end size from documents join labels using (doc_id)),
g as (select system, '*' stratum, count(*) n, count(*) filter (passed) k, count(*) filter (not passed and low) f from r group by 1 union all select system, 'lang=' || lang, count(*), count(*) filter (passed), 0 from r group by 1, 2
  union all select system, 'size=' || size, count(*), count(*) filter (passed), 0 from r group by 1, 2), zz as (select 1.959963984540054e0 z),
o as (select *, k / n rate, 0.3 + (length(system) + ascii(right(system, 1))) % 7 / 10 published from g where stratum = '*'),
rk as (select *, rank() over (order by rate) + (count(*) over (partition by rate) - 1) / 2 a, rank() over (order by published) + (count(*) over (partition by published) - 1) / 2 b from o),
rho as (select count(*) n, case when count(*) < 4 then null when stddev_pop(a) = 0 or stddev_pop(b) = 0 then 0 else corr(a, b) end rho from rk),
w as (select *, round(0.7 * n) b from (select count(distinct key) n, count(distinct key) filter (low) low from r), (select avg(rate) p from o), zz)
{_rows('rate', 'system', 'stratum', 'g, zz', n='n', k='k', rate='k / n', ci_low=_LOW.format(k='k', n='n'), ci_high=_HIGH.format(k='k', n='n'))}
union all {_rows('doubt', 'system', "'*'", 'o', fails='n - k', low_fails='f', share='case when n = k then 0 else f / (n - k) end')}
union all {_rows('gap', 'system', "'*'", 'o', gap_pp='100 * (rate - published)')} union all {_rows('correlation', "'*'", "'*'", 'rho', n='n', rho='rho')}
union all {_rows('power', "'*'", "'*'", 'w', **_POWER)} union all {_rows('effective', "'*'", "'*'", 'w', total='n', low='low', confirmed='n - low', share='(n - low) / n')}
union all {" union all ".join(_rows('uncertainty', "'*'", f"'{e}'", 'w', sampling_pp='100 * z * sqrt(p * (1 - p) / n)', half_pp=f'100 * z * sqrt(p * (1 - p) / n + low * {e}::double * (1 - {e}::double) / (n * n))') for e in (0.1, 0.2, 0.3))}""")
def whole_fidelity_report(t: Tables) -> DataFrame:
    """Rates, doubt, gaps, correlation, power and uncertainty of sources as systems."""
    rows = t.documents.join(t.labels, "doc_id")
    results = rows.select(F.col("doc_id").alias("key"), F.col("source").alias("system"), (F.col("quality") == 1).alias("passed"), (F.col("n_chars") < 500).alias("low"), "lang", F.when(F.col("n_chars") >= 1000, "long").otherwise("short").alias("size"))
    last = F.ascii(F.right("system", F.lit(1)))
    published = results.select("system").distinct().withColumn("published", 0.3 + (F.length("system") + last) % 7 / 10)
    return fidelity_sections(results, published, ["lang", "size"])


_KINDS = ("click", "view", "purchase")
_GROUP = "case when n >= 2 then 'two_or_more' when n = 0 then 'none' " + " ".join(f"when {x} = 1 then 'only_{x}'" for x in _KINDS) + " end"
_FLAGS = {f"has_{x}": f"{x} = 1" for x in _KINDS} | {"any": "n >= 1", "two_or_more": "n >= 2", "all": "n = 3"} | {f"only_{x}": f"{x} = 1 and n = 1" for x in _KINDS} | {"none": "n = 0"}


@query(f"""
with u as (select distinct user_id as name, case when user_id % 3 = 0 then 'brand' else 'generic' end type, case user_id % 4 when 0 then 'high' when 1 then 'medium' else 'low' end tier from events),
c as (select user_id as name, event_type source, round(value)::int digest, event_id % 5 = 0 part from events where value > 150 and event_type in {_KINDS}),
h as (select name, {", ".join(f"max((source = '{x}')::int) {x}" for x in _KINDS)} from c where not part group by 1),
j as (select u.*, {", ".join(f"coalesce({x}, 0) {x}" for x in _KINDS)}, {" + ".join(f"coalesce({x}, 0)" for x in _KINDS)} n from u left join h using (name)),
d as (select digest, count(*) c from (select distinct digest, name, source from c) group by 1 having count(*) > 1),
l as (select 'total' s, count(*) n, count(*) total from j {" ".join(f"union all select '{k}', count(*) filter ({v}), count(*) from j" for k, v in _FLAGS.items())})
{_rows('headline', "'*'", 's', 'l', n='n', share='n / total')}
union all {_rows('parts', 'source', "'*'", "(select source, count(distinct name) n from c where part group by 1)", n='n')}
union all {_rows('type', 'type', 'g', f"(select type, {_GROUP} g, count(*) n from j group by 1, 2)", n='n')}
union all {_rows('tier', 'tier', 'g', "(select tier, case when n >= 2 then 'two_or_more' when n = 1 then 'one' else 'none' end g, count(*) n from j group by 1, 2)", n='n')}
union all {_rows('duplicates', "'*'", "'*'", "(select count(*) groups, coalesce(sum(c), 0) clips from d)", groups='groups', clips='clips')}""")
def whole_coverage_report(t: Tables) -> DataFrame:
    """Users as names, their large events as clips by kind; every fifth is of a part only."""
    name = F.col("user_id").alias("name")
    tier = F.when(F.col("user_id") % 4 == 0, "high").when(F.col("user_id") % 4 == 1, "medium").otherwise("low")
    universe = t.events.select(name, F.when(F.col("user_id") % 3 == 0, "brand").otherwise("generic").alias("type"), tier.alias("tier")).distinct()
    large = t.events.where((F.col("value") > 150) & F.col("event_type").isin(*_KINDS))
    clips = large.select(name, F.col("event_type").alias("source"), F.rint("value").cast("int").alias("digest"), (F.col("event_id") % 5 == 0).alias("part"))
    return coverage_sections(universe, clips, list(_KINDS))
