"""Names, what was found about them, and what was scored: joins and reports over reference evidence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.functions import variants as v

from .resolve import pending, require


def resolve_terms(claims: DataFrame, term: str = "term") -> DataFrame:
    """term, variants (structs of symbols and shown), n_sources, tier of every term with a claim.

    ``claims`` has term, rank (of the source), source, symbols and shown. Variants keep the order of
    their sources, one for each symbols; fragments and fused ones are left out. The tier is high for
    several sources, medium for one, low if no variant is left.
    """
    first = claims.groupBy(term, "symbols").agg(F.min(F.struct("rank", "shown")).alias("x"))
    listed = first.groupBy(term).agg(F.array_sort(F.collect_list(F.struct(F.col("x.rank").alias("rank"), "symbols", F.col("x.shown").alias("shown")))).alias("every"))
    counted = claims.groupBy(term).agg(F.countDistinct("source").alias("n_sources"))
    plain = F.transform("every", lambda e: F.struct(e["symbols"].alias("symbols"), e["shown"].alias("shown")))
    found = listed.join(counted, term).select(term, v.usable_variants(F.col(term), plain).alias("variants"), "n_sources")
    tier = F.when(F.size("variants") == 0, "low").when(F.col("n_sources") > 1, "high").otherwise("medium")
    return found.withColumn("tier", tier)


def resolve_names(names: DataFrame, claims: DataFrame, name: str = "name") -> DataFrame:
    """name, variants, tier, by_words: the whole name's variants, or those of its words joined.

    A name of several words falls back to its words if nothing was found for it or no variant covers
    it. Words answer only together; the tier is then that of the weakest word.
    """
    terms = resolve_terms(claims)
    whole = names.join(terms.select(F.col("term").alias(name), "variants", "tier"), name, "left")
    none = F.array().cast("array<struct<symbols:string,shown:string>>")
    whole = whole.select(name, F.coalesce("variants", none).alias("variants"), F.coalesce("tier", F.lit("low")).alias("tier"))
    several = F.contains(F.col(name), F.lit(" "))
    falls = several & ((F.col("tier") == "low") | ~v.covers_name(F.col(name), F.col("variants")))
    words = whole.where(falls).select(name, F.posexplode(F.split(name, " ")).alias("place", "term")).where("term <> ''")
    order = F.array(*map(F.lit, ("high", "medium", "low")))
    found = words.join(terms, "term", "left").select(name, "place", F.get("variants", F.lit(0)).alias("best"), F.array_position(order, F.coalesce("tier", F.lit("low"))).alias("rank"))
    joined = found.groupBy(name).agg(
        F.bool_and(F.col("best").isNotNull()).alias("complete"), F.array_sort(F.collect_list(F.struct("place", "best"))).alias("parts"), F.max("rank").alias("rank")
    )
    text = lambda field: F.array_join(F.transform("parts", lambda p: p["best"][field]), " ")
    one = F.when(F.col("complete"), F.array(F.struct(text("symbols").alias("symbols"), text("shown").alias("shown")))).otherwise(none)
    joined = joined.select(name, one.alias("variants"), F.element_at(order, F.col("rank").cast("int")).alias("tier"), F.lit(True).alias("by_words"))
    return whole.where(~falls).withColumn("by_words", F.lit(False)).unionByName(joined)


def reference_maps(resolved: DataFrame, name: str) -> DataFrame:
    """name in lower case, its best variant's symbols ('' without any) and tier."""
    best = F.coalesce(F.get("variants", F.lit(0))["symbols"], F.lit(""))
    return resolved.select(F.lower(name).alias(name), best.alias("best"), "tier")


def evaluation_items(hard: DataFrame, dataset: DataFrame, references: DataFrame, key: str, name: str, sentence: str) -> DataFrame:
    """Hard items with the sentence that speaks them, the span there and their references ([] without any).

    An item without a sentence that holds its name is an error. Join keys are case-folded.
    """
    fold = lambda d: d.withColumn("_k", F.lower(key))
    found = fold(hard).join(fold(dataset).select("_k", sentence), "_k", "left").join(fold(references).drop(key), "_k", "left")
    at = tx.locate(F.col(sentence), F.col(name))
    spoken = tx.cut_span(F.col(sentence), at, at + F.length(name))
    rows = require(found.withColumn("spoken", spoken), "spoken")
    lists = [f.name for f in references.schema if f.name != key]
    return rows.select(*hard.columns, sentence, "spoken", *(F.coalesce(c, F.array().cast(references.schema[c].dataType)).alias(c) for c in lists))


def pairs_by_note(rows: DataFrame, key: str, note: str, pattern: str) -> DataFrame:
    """(key, other): rows whose note names another row's key, joined to that row; the own key is no pair."""
    other = F.trim(F.split(F.regexp_extract(F.col(note), pattern, 1), ";")[0])
    named = rows.select(key, F.lower(other).alias("_o")).where("_o <> ''")
    keys = rows.select(F.lower(key).alias("_o"), F.col(key).alias("other")).distinct()
    return named.join(keys, "_o").where(F.lower(key) != F.col("_o")).select(key, "other")


def cited_chunks(rows: DataFrame, keys: list[str], supports: str, chunks: str) -> DataFrame:
    """One row for each chunk that a support cites: keys, segment, place, chunk. Places beyond the chunks are no citation."""
    each = rows.select(*keys, chunks, F.explode(supports).alias("s")).select(*keys, chunks, F.col("s.segment").alias("segment"), F.explode("s.places").alias("place"))
    return each.select(*keys, "segment", "place", F.get(chunks, F.col("place")).alias("chunk")).where("chunk is not null")


def verified_claims(answers: DataFrame, keys: list[str], accepted: DataFrame, pattern: str) -> DataFrame:
    """keys, claim, domain: what an answer claims, with the domains that are cited for it.

    ``answers`` has supports (structs of segment and places), chunks (domains) and text. Claims are taken
    from segments and belong to the chunks cited there; an answer without any accepted one is read as a
    whole and all its chunks are cited. ``accepted`` (claim) is the judge's answer table. Answers that
    guess, or cite nothing, claim nothing. A claim counts once for each domain.
    """
    told = answers.where((F.size("chunks") > 0) & ~v.speculative_answer(F.col("text")))
    claims = lambda c: F.explode(F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), F.lit(0))))
    cited = cited_chunks(told, keys, "supports", "chunks").select(*keys, claims(F.col("segment")).alias("claim"), F.col("chunk").alias("domain"))
    judged = accepted.select("claim").distinct()
    precise = cited.join(judged, "claim", "left_semi").select(*keys, "claim", "domain").distinct()
    rest = told.join(precise.select(*keys).distinct(), keys, "left_anti")
    whole = rest.select(*keys, "chunks", claims(F.col("text")).alias("claim")).join(judged, "claim", "left_semi")
    return precise.unionByName(whole.select(*keys, "claim", F.explode("chunks").alias("domain")).distinct())


def cited_union(cited: Column, modelled: Column) -> Column:
    """What is cited, with what the model said that folds to something cited; without citations the model's."""
    folds = F.transform(cited, v.folded)
    both = F.concat(cited, F.filter(modelled, lambda m: F.array_contains(folds, v.folded(m))))
    return v.dominated_pruned(F.when(F.size(cited) > 0, both).otherwise(modelled))


def preferred(rows: DataFrame, fresh: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows with the fresh values of some columns where there are any."""
    new = fresh.select(*keys, *(F.col(c).alias(f"_{c}") for c in columns))
    return rows.join(new, keys, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns])


def first_existing(rows: DataFrame, key: str, candidates: Column, stored: DataFrame, name: str, size: str, least: int = 500) -> DataFrame:
    """key and the first of its candidate names that is stored with more than ``least`` bytes; null if none is."""
    each = rows.select(key, F.posexplode(candidates).alias("place", name))
    found = each.join(stored.where(F.col(size) > least).select(name).distinct(), name).groupBy(key).agg(F.min_by(name, "place").alias(name))
    return rows.select(key).join(found, key, "left")


def variant_options(parts: DataFrame, cache: DataFrame, seed: DataFrame, keys: list[str]) -> DataFrame:
    """keys, options: published variants of the cache whose page is for the part, then the seed's, each once."""
    usable = cache.where(v.page_is_for(F.col("part"), F.col("url"))).select("part", F.posexplode("variants").alias("place", "option"))
    both = parts.join(usable, "part").select(*keys, F.lit(0).alias("rank"), "place", "option").unionByName(parts.join(seed, "part").select(*keys, F.lit(1).alias("rank"), F.lit(0).alias("place"), "option"))
    clean = both.withColumn("option", v.stripped(F.col("option"))).where(v.source_ipa(F.col("option")))
    first = clean.groupBy(*keys, "option").agg(F.min(F.struct("rank", "place")).alias("at"))
    listed = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "option"))).alias("xs")).select(*keys, F.transform("xs", lambda x: x["option"]).alias("options"))
    return parts.select(*keys).distinct().join(listed, keys, "left").withColumn("options", F.coalesce("options", F.array().cast("array<string>")))


def with_references(rows: DataFrame, references: DataFrame, key: str, values: str) -> DataFrame:
    """Rows with their references by case-folded key, [] without any."""
    known = references.select(F.lower(key).alias("_k"), values)
    return rows.withColumn("_k", F.lower(key)).join(known, "_k", "left").drop("_k").withColumn(values, F.coalesce(values, F.array().cast(references.schema[values].dataType)))


def all_references(clips: DataFrame, key: str, order: str, usable: Column) -> DataFrame:
    """Every usable clip of a key, numbered in order, as rows: a key may have any number."""
    return clips.where(usable).withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(order)))


def selected_in_order(order: list[str], key: str, tables: dict[str, DataFrame], score: str, digits: int = 4) -> DataFrame:
    """A short list of keys in its own order with the scores of two tables and their difference (null-safe)."""
    (a, left), (b, right) = tables.items()
    picked = left.sparkSession.createDataFrame([(i, k) for i, k in enumerate(order)], f"place int, {key} string")
    for name, frame in ((a, left), (b, right)):
        picked = picked.join(frame.select(F.lower(key).alias(key), F.col(score).alias(name)), key, "left")
    return picked.withColumn("delta", F.round(F.col(b) - F.col(a), digits)).orderBy("place")


# Reports.


def tier_blocks(rows: DataFrame, tier: str, metrics: dict[str, tuple[Column, Column]], failed: Column, digits: int = 3) -> DataFrame:
    """n, failures and, for each metric, how many were scored and their pass rate, by tier and overall ('*').

    ``metrics`` maps a name to (scored, passed). Both groupings come from one pass over the rows.
    """
    each = [
        x
        for name, (scored, passed) in metrics.items()
        for x in (
            F.count_if(scored).alias(f"{name}_scored"),
            F.round(F.avg(F.when(scored, F.coalesce(passed, F.lit(False)).cast("int"))), digits).alias(f"{name}_pass_rate"),
        )
    ]
    groups = rows.groupingSets([[], [tier]], tier).agg(F.grouping(tier).alias("_all"), F.count(F.lit(1)).alias("n"), *each, F.count_if(failed).alias("failures"))
    return groups.withColumn(tier, F.when(F.col("_all") == 1, "*").otherwise(F.col(tier))).drop("_all")


def score_condition(items: DataFrame, heard: DataFrame, key: str, threshold: float = 4.0) -> DataFrame:
    """Items with two nullable scores and why one is missing.

    ``heard`` has key, found (a recording was there), aligned, phoneme and f1 scores (0 to 5). A metric is
    scored if the span was aligned and the item has what the metric compares with.
    """
    joined = items.join(heard, key, "left")
    error = F.when(~F.coalesce("found", F.lit(False)), "missing wav").when(~F.coalesce("aligned", F.lit(False)), "align returned none")
    out = joined.withColumn("error", error)
    for metric, reference in (("phoneme", "has_variants"), ("f1", "has_clip")):
        ok = F.col("error").isNull() & F.col(reference) & F.col(metric).isNotNull()
        out = out.withColumn(f"{metric}_scoreable", ok).withColumn(metric, F.when(ok, F.col(metric))).withColumn(f"{metric}_pass", F.when(ok, F.col(metric) >= threshold))
    return out


def stem_backtest(rows: DataFrame, suffix: str, plain: str, stem: str, digits: int = 9) -> DataFrame:
    """For each suffix n, the mean errors of both ways, the mean improvement and whether it is kept."""
    g = rows.groupBy(suffix).agg(F.count(F.lit(1)).alias("n"), F.avg(plain).alias("p"), F.avg(stem).alias("s"), F.avg(F.col(plain) - F.col(stem)).alias("i"))
    return g.select(suffix, "n", F.round("p", digits).alias("plain_error"), F.round("s", digits).alias("stem_error"), F.round("i", digits).alias("improvement"), (F.col("i") > 0).alias("kept"))


def kept_aggregate(summary: DataFrame, digits: int = 6) -> DataFrame:
    """Means over the kept suffixes, weighted by their examples."""
    kept = summary.where("kept")
    mean = lambda c: F.sum(F.col(c) * F.col("n")) / F.sum("n")
    return kept.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.round(mean("plain_error"), digits).alias("plain_error"), F.round(mean("stem_error"), digits).alias("stem_error"))


def prf_compare(rows: DataFrame, metrics: list[str], gap: float, first: str = "hyphen", second: str = "compact") -> DataFrame:
    """One row: for each metric the means, wins and ties of two forms, and how the other metrics fall among
    the rows that the last metric gives to each form. ``rows`` has columns <form>_<metric>."""
    win = {m: F.when(F.col(f"{first}_{m}") >= F.col(f"{second}_{m}") + gap, first).when(F.col(f"{second}_{m}") >= F.col(f"{first}_{m}") + gap, second).otherwise("tie") for m in metrics}
    out = [F.count(F.lit(1)).alias("n")]
    for m in metrics:
        out += [F.round(F.avg(f"{x}_{m}"), 6).alias(f"{x}_{m}") for x in (first, second)]
        out += [F.count_if(win[m] == x).alias(f"{m}_{x}") for x in (first, second, "tie")]
    last = metrics[-1]
    for x in (first, second):
        out += [F.count_if((win[last] == x) & (win[m] == y)).alias(f"{last}_{x}_{m}_{y}") for m in metrics[:-1] for y in (first, second)]
    return rows.agg(*out)


def ladder(expected: DataFrame, key: str, steps: list[tuple[str, DataFrame]], value: str) -> DataFrame:
    """key, value, by: the first of several tables that has a usable value; by is null for a miss."""
    out, first, by = expected.select(key).distinct(), F.lit(None), F.lit(None)
    for name, frame in reversed(steps):
        one = frame.where(F.col(value).isNotNull()).groupBy(key).agg(F.min(value).alias(f"_{name}"))
        out = out.join(one, key, "left")
        first = F.when(F.col(f"_{name}").isNotNull(), F.col(f"_{name}")).otherwise(first)
        by = F.when(F.col(f"_{name}").isNotNull(), name).otherwise(by)
    return out.select(key, first.alias(value), by.alias("by"))


def ingest_clips(found: DataFrame, expected: DataFrame, keys: list[str], least_s: float, most_s: float) -> tuple[DataFrame, DataFrame]:
    """(clips with flags and status, expected keys that were not found and found ones not expected).

    ``found`` has keys, readable and seconds. Flags: undecodable, too_short, too_long.
    """
    flags = F.array_compact(
        F.array(F.when(~F.col("readable"), "undecodable"), F.when(F.col("readable") & (F.col("seconds") < least_s), "too_short"), F.when(F.col("readable") & (F.col("seconds") > most_s), "too_long"))
    )
    clips = found.withColumn("flags", flags).withColumn("status", F.when(F.size("flags") == 0, "ok").otherwise("flagged"))
    a, b = expected.select(*keys).distinct(), found.select(*keys).distinct()
    mismatch = a.join(b, keys, "left_anti").withColumn("kind", F.lit("missing")).unionByName(b.join(a, keys, "left_anti").withColumn("kind", F.lit("unexpected")))
    return clips, mismatch


def rescored(rows: DataFrame, sources: DataFrame, keys: list[str], source: str, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows whose reference source changed, scored again with the new one; the others as they are."""
    new = sources.select(*keys, F.col(source).alias("_new"))
    changed = rows.join(new, keys).where(~F.col(source).eqNullSafe(F.col("_new"))).withColumn(source, F.col("_new")).drop("_new")
    return pending(rows, changed, keys).unionByName(score(changed).select(*rows.columns))


def combo_members(rows: DataFrame, name: str, members: str, sentence: str) -> DataFrame:
    """Members of combinations that have no row of their own, with their span in the combination's sentence."""
    own = rows.select(F.lower(name).alias("_m")).distinct()
    each = rows.where(F.size(members) > 1).select(name, sentence, F.explode(members).alias("member")).withColumn("_m", F.lower("member"))
    at = tx.locate(F.col(sentence), F.col("member"))
    return each.join(own, "_m", "left_anti").select(name, "member", at.alias("start"), (at + F.length("member")).alias("end"), F.when(at.isNull(), "not in the sentence").otherwise("ok").alias("status"))


def endpoint_report(entries: DataFrame, stages: list[tuple[str, DataFrame]], key: str, score: str, digits: int = 4) -> tuple[DataFrame, DataFrame]:
    """(rows of entries that passed all stages, the worst first; the first missing stage of the others).

    The last stage has the score.
    """
    missing, rows = F.lit(None).cast("string"), entries
    for name, frame in reversed(stages[:-1]):
        rows = rows.join(frame.select(key, F.lit(True).alias(f"_{name}")).distinct(), key, "left")
        missing = F.when(F.col(f"_{name}").isNull(), name).otherwise(missing)
    name, last = stages[-1]
    rows = rows.join(last.select(key, score), key, "left").withColumn("missing", F.coalesce(missing, F.when(F.col(score).isNull(), name)))
    scored = rows.where("missing is null").select(*entries.columns, F.round(score, digits).alias(score)).orderBy(score, key)
    return scored, rows.where("missing is not null").select(key, "missing")


# Answers of services, as JSON.

ANSWER = "struct<candidates: array<struct<content: struct<parts: array<struct<text: string>>>, groundingMetadata: struct<groundingChunks: array<struct<web: struct<uri: string, title: string, domain: string>>>, webSearchQueries: array<string>, searchEntryPoint: struct<renderedContent: string>>>>>"
HEARD = "struct<results: array<struct<alternatives: array<struct<transcript: string, confidence: double, words: array<struct<word: string>>>>>>>"


def answer_text(answer: Column) -> Column:
    """The texts of the first candidate's parts, joined; '' without a candidate."""
    parts = F.get(F.from_json(answer, ANSWER)["candidates"], F.lit(0))["content"]["parts"]
    return F.coalesce(F.array_join(F.transform(parts, lambda p: p["text"]), ""), F.lit(""))


def answer_citations(answer: Column) -> Column:
    """struct<uris, queries, chips>: cited pages, search queries and links of the search entry."""
    meta = F.get(F.from_json(answer, ANSWER)["candidates"], F.lit(0))["groundingMetadata"]
    none = F.array().cast("array<string>")
    uris = F.filter(F.transform(meta["groundingChunks"], lambda c: c["web"]["uri"]), lambda u: u.isNotNull())
    chips = F.regexp_extract_all(F.coalesce(meta["searchEntryPoint"]["renderedContent"], F.lit("")), F.lit(r'href="(https://[^"]+)"'), F.lit(1))
    return F.struct(F.coalesce(uris, none).alias("uris"), F.coalesce(meta["webSearchQueries"], none).alias("queries"), chips.alias("chips"))


def heard_words(answer: Column) -> Column:
    """struct<words, confidence>: words of every result's first alternative (its transcript without words),
    and the mean of the confidences that are given."""
    tops = F.filter(F.transform(F.from_json(answer, HEARD)["results"], lambda r: F.get(r["alternatives"], F.lit(0))), lambda a: a.isNotNull())
    none = F.array().cast("array<string>")
    split = lambda t: F.filter(F.split(F.coalesce(t, F.lit("")), r"\s+"), lambda w: w != "")
    own = lambda a: F.when(F.size(F.coalesce(a["words"], F.array().cast("array<struct<word:string>>"))) > 0, F.transform(a["words"], lambda w: w["word"])).otherwise(split(a["transcript"]))
    sure = F.filter(F.transform(tops, lambda a: a["confidence"]), lambda c: c.isNotNull())
    mean = F.when(F.size(sure) > 0, F.aggregate(sure, F.lit(0.0), lambda a, c: a + c) / F.size(sure))
    return F.struct(F.coalesce(F.flatten(F.transform(tops, own)), none).alias("words"), mean.alias("confidence"))
