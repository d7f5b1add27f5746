"""Operator 10: document rules and host-level rules, in DataFrame functions only.

Base figures of each text, then failures counted by host. A host's failure rate is shrunk towards
the mean of all hosts with a beta prior whose two parameters are fitted to the hosts' rates by the
method of moments, so a host with few documents is not judged on them alone. A host whose shrunk
rate is above ``max_rate`` is rejected, and its documents with it.

Null texts have no words and fail the base rule. Rows without a host get no host verdict, and a host
named ``null`` is a host. Repeated rows count as often as they occur. A rate equal to ``max_rate`` is
kept. Extra columns, of whatever name, are not read. An empty table gives no rows. Very long texts stay
within their row: windows are compared by 64-bit hashes, which sort in n log n.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_small_ids, materialize

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words inside a window of five words that the text holds twice or more."""
    starts = F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, WINDOW)))

    def covered(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts_of(s: Column) -> Column:
            same = lambda j, k: F.coalesce(F.get(s, j)["h"] == F.get(s, k)["h"], F.lit(False))
            twice = F.filter(F.transform(s, lambda x, j: F.when(same(j, j - 1) | same(j, j + 1), x["i"])), lambda i: i.isNotNull())
            return let(F.array_sort(twice), steps)

        def steps(p: Column) -> Column:
            gaps = F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
            return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(ordered, starts_of)).otherwise(F.lit(0))

    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(let(hashes, covered)).cast("long")


def base_figures(docs: DataFrame) -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    split = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("host"),
        text.alias("body"),
        F.array_remove(F.split(text, SPACE), "").alias("words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    figures = split.select(
        "doc_id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("body") - F.length(F.regexp_replace("body", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
    )
    return figures.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def host_rates(figures: DataFrame, least_strength: float = 1.0, most_strength: float = 10_000.0) -> DataFrame:
    """host, host_docs, host_failed, host_rate: the failure rate shrunk by the fitted beta prior."""
    hosts = figures.where("host is not null").groupBy("host").agg(
        F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failed")
    )
    hosts = materialize(hosts, "op10-hosts")
    mean = hosts.agg((F.sum("host_failed") / F.sum("host_docs")).alias("m")).first()["m"]
    if mean is None:
        return hosts.withColumn("host_rate", F.lit(0.0))
    rate = F.col("host_failed") / F.col("host_docs")
    spread = hosts.agg(F.avg((rate - F.lit(mean)) * (rate - F.lit(mean)) - F.lit(mean * (1 - mean)) / F.col("host_docs")).alias("v")).first()["v"]
    strength = most_strength if spread <= 0 else min(max(mean * (1 - mean) / spread - 1, least_strength), most_strength)
    return hosts.withColumn("host_rate", (F.col("host_failed") + F.lit(mean * strength)) / (F.col("host_docs") + F.lit(strength)))


def quality_rules(docs: DataFrame, max_rate: float = 0.5) -> DataFrame:
    """Base figures with ``base_failed``, ``host_rate`` and ``kept`` for every row."""
    figures = materialize(base_figures(docs), "op10-figures")
    verdicts = materialize(host_rates(figures).select("host", "host_rate"), "op10-rates")
    joined = join_small_ids(figures, verdicts, verdicts.count(), ["host"], "left")
    rejected = F.coalesce(F.col("host_rate") > max_rate, F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~rejected).drop("host")


ORACLE = r"""
with w as (select row_number() over () rid, doc_id, source, coalesce(text, '') body,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws from documents),
g as (select rid, i, ws[i:i + 4] win from w, unnest(range(1, len(ws) - 3)) u(i)),
r as (select rid, i from (select rid, i, count(*) over (partition by rid, win) c from g) where c >= 2),
c as (select rid, count(distinct p) n from (select rid, unnest(range(i, i + 5)) p from r) group by rid),
l as (select rid, list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls from w),
f as (select rid, doc_id, source, len(ws)::bigint n_words, length(array_to_string(ws, ''))::bigint word_chars,
             (length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')))::bigint n_symbols,
             (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines, coalesce(n, 0)::bigint n_repeat_words
      from w join l using (rid) left join c using (rid)),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed from f),
h as (select source, count(*) host_docs, sum(base_failed::int) host_failed from b where source is not null group by source),
m as (select sum(host_failed) / sum(host_docs) m from h),
v as (select any_value(m) m, avg((host_failed / host_docs - m) * (host_failed / host_docs - m) - m * (1 - m) / host_docs) v from h, m),
s as (select m, case when v <= 0 then 10000.0 else least(greatest(m * (1 - m) / v - 1, 1.0), 10000.0) end s from v),
k as (select source, (host_failed + m * s) / (host_docs + s) host_rate from h, s)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and not coalesce(host_rate > 0.5, false) kept
from b left join k on b.source = k.source
"""
