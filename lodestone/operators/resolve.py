"""Joins that resolve records against references, upserts, and runs that resume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.sources.tables import byte_count, stored


def lookup(rows: DataFrame, references: DataFrame, name: str, key: str) -> DataFrame:
    """Left join on the case-folded name. ``references`` has one row for each folded key."""
    folded = references.withColumn("_k", F.lower(key)).drop(key)
    return rows.withColumn("_k", F.lower(name)).join(folded, "_k", "left").drop("_k")


def require(rows: DataFrame, column: str) -> DataFrame:
    """The rows; reading one whose ``column`` is null is an error."""
    checked = F.when(F.col(column).isNull(), F.raise_error(F.lit(f"no match: {column}"))).otherwise(F.lit(True))
    return rows.where(checked)


def missing_keys(rows: DataFrame, references: DataFrame, name: str, key: str) -> DataFrame:
    """Distinct names without a reference, case-folded."""
    return rows.select(F.lower(name).alias(name)).distinct().join(references.select(F.lower(key).alias(name)).distinct(), name, "left_anti")


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work whose key isn't done."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def resumable(work: DataFrame, manifest: DataFrame, key: str, text: str, files: DataFrame | None = None) -> DataFrame:
    """work with ``eligible``: its last manifest record is ok, for the same text, and its file exists."""
    last = manifest.groupBy(key).agg(F.max_by(F.struct("status", "text_sha256", *(["path"] if files is not None else [])), "seq").alias("m"))
    joined = work.join(last, key, "left")
    ok = (F.col("m.status") == "ok") & (F.col("m.text_sha256") == F.sha2(F.col(text), 256))
    if files is not None:
        joined = joined.join(files.select(F.col("path").alias("_path"), F.lit(True).alias("_there")), F.col("m.path") == F.col("_path"), "left")
        ok = ok & F.coalesce(F.col("_there"), F.lit(False))
    return joined.withColumn("eligible", F.coalesce(ok, F.lit(False))).select(*work.columns, "eligible")


def replace_source(old: DataFrame, fresh: DataFrame, source: str, value: str) -> DataFrame:
    """All rows of one source replaced by fresh ones."""
    return old.where(~F.col(source).eqNullSafe(F.lit(value))).unionByName(fresh, allowMissingColumns=True)


def upsert(old: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    return pending(old, fresh, keys).unionByName(fresh, allowMissingColumns=True)


def zip_members(rows: DataFrame, keep: list[str], left: str, right: str) -> DataFrame:
    """One row for each pair at the same place of two arrays, up to the shorter, with its position."""
    n = F.least(F.size(left), F.size(right))
    zipped = F.arrays_zip(F.slice(left, 1, n).alias("a"), F.slice(right, 1, n).alias("b"))
    return rows.where(n > 0).select(*keep, F.posexplode(zipped).alias("position", "x")).select(*keep, "position", F.col("x.a").alias(left), F.col("x.b").alias(right))


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], width: int = 64) -> DataFrame:
    """Pairs of ranges [start, end) of the same key that overlap.

    Both sides are dealt to cells of ``width`` so the join is an equality; a pair is kept only in the
    cell where the later of its starts lies, so it appears once.
    """
    cells = lambda d, p: d.select(*keys, *(F.col(c).alias(f"{p}_{c}") for c in d.columns if c not in keys), F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))).alias("cell"))
    pairs = cells(a, "a").join(cells(b, "b"), [*keys, "cell"])
    later = F.greatest("a_start", "b_start")
    return pairs.where((F.col("a_start") < F.col("b_end")) & (F.col("a_end") > F.col("b_start")) & (F.floor(later / width) == F.col("cell"))).drop("cell")


def word_prefixes(name: Column) -> Column:
    """All word-prefixes of a name, itself included: 'a b c' gives 'a', 'a b', 'a b c'."""
    words = F.split(F.trim(name), r"\s+")
    return F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, 1, n), " "))


def prefix_join(long: DataFrame, short: DataFrame, name: str, prefix: str) -> DataFrame:
    """Pairs where ``prefix`` equals ``name`` or some words of its beginning: an equality join."""
    bare = F.lower(F.regexp_replace(F.col(name), r"\s*\([^()]*\)\s*$", ""))
    return long.withColumn("_p", F.explode(word_prefixes(bare))).join(short.withColumn("_p", F.lower(F.trim(prefix))), "_p").drop("_p")


def resolve_words(texts: DataFrame, key: str, words: Column, lexicon: DataFrame, word: str, value: str) -> DataFrame:
    """key, n_words, resolved: every word's value in order, null unless all words have one.

    Whether a text has a word that the lexicon lacks is asked of its distinct words alone; only the other texts
    get a row for each place. The lexicon is sent to all tasks if its rows, at 64 bytes each, are under Spark's
    limit for that; else hot words are left to adaptive joins. Equal keys are one text.
    """
    known = stored(lexicon.select(word, value).where(F.col(word).isNotNull()), "lexicon")
    limit = texts.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")
    small = known.count() * 64 <= byte_count(limit)
    held = F.broadcast(known) if small else known
    rows = texts.select(key, words.alias("_words")).where(F.size("_words") > 0)
    lacking = rows.select(key, F.explode(F.array_distinct("_words")).alias(word)).join(held.where(F.col(value).isNotNull()), word, "left_anti").select(key).distinct()
    counted = stored(rows.groupBy(key).agg(F.sum(F.size("_words")).alias("n_words")).join(lacking.withColumn("_lacks", F.lit(True)), key, "left"), "resolvable")
    whole = rows.join(counted.where("_lacks is null").select(key), key, "left_semi")
    found = whole.select(key, F.posexplode("_words").alias("place", word)).join(held, word)
    joined = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", value))).alias("xs"))
    resolved = joined.select(key, F.array_join(F.transform("xs", lambda x: x[value]), " ").alias("resolved"))
    return counted.select(key, "n_words").join(resolved, key, "left")


def miss_reasons(expected: DataFrame, stages: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """Expected keys that some stage lacks, with the first stage that does."""
    out, reason = expected.select(key).distinct(), F.lit(None).cast("string")
    for name, frame in reversed(stages):
        out = out.join(frame.select(key).distinct().withColumn(f"_{name}", F.lit(True)), key, "left")
        reason = F.when(F.col(f"_{name}").isNull(), name).otherwise(reason)
    return out.select(key, reason.alias("reason")).where("reason is not null")


def source_tier(claims: DataFrame, key: str, source: str) -> DataFrame:
    """n_sources and a tier: high for two or more, medium for one."""
    g = claims.groupBy(key).agg(F.countDistinct(source).alias("n_sources"))
    return g.withColumn("tier", F.when(F.col("n_sources") > 1, "high").when(F.col("n_sources") == 1, "medium").otherwise("low"))


def claim_tier(claims: DataFrame, key: str, value: Column, domain: Column) -> DataFrame:
    """high if all claims agree and come from two domains or more; low without claims; else medium."""
    g = claims.groupBy(key).agg(F.countDistinct(value).alias("n_values"), F.countDistinct(domain).alias("n_domains"))
    return g.withColumn("tier", F.when((F.col("n_values") == 1) & (F.col("n_domains") > 1), "high").when(F.col("n_values") == 0, "low").otherwise("medium"))


def variant_union(rows: DataFrame, key: str, variants: str, order: str) -> DataFrame:
    """key, variants: distinct values of all rows' arrays in the order they were first seen."""
    each = rows.select(key, order, F.posexplode(variants).alias("place", "v"))
    first = each.groupBy(key, "v").agg(F.min(F.struct(order, "place")).alias("at"))
    return first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("xs")).select(key, F.transform("xs", lambda x: x["v"]).alias(variants))


def earliest_approved(rows: DataFrame, key: str, date: str, number: str, original: Column, approved: Column) -> DataFrame:
    """Least (date, number) among original approvals, else among other approvals."""
    at = F.struct(F.col(date).alias("date"), F.col(number).alias("number"))
    best = F.coalesce(F.min(F.when(original & approved, at)), F.min(F.when(approved & ~original, at)))
    return rows.groupBy(key).agg(best.alias("x")).select(key, "x.date", "x.number")


def best_reference(scored: DataFrame, keys: list[str], source: str, score: str, order: str) -> DataFrame:
    """Best score over references, its source (first on ties) and how many; a source's last score counts."""
    last = scored.groupBy(*keys, source).agg(F.max_by(score, order).alias(score), F.min(order).alias(order))
    return last.groupBy(*keys).agg(F.max(score).alias("best"), F.min(F.struct((-F.col(score)).alias("s"), F.col(order), F.col(source)))[source].alias("by"), F.count(F.lit(1)).alias("n"))


def pair_arms(base: DataFrame, arm: DataFrame, keys: list[str], score: str) -> DataFrame:
    """keys, base, arm, delta for keys that both have."""
    return base.select(*keys, F.col(score).alias("base")).join(arm.select(*keys, F.col(score).alias("arm")), keys).withColumn("delta", F.col("arm") - F.col("base"))


def paired_summary(pairs: DataFrame, by: list[str], eps: float = 1e-6, digits: int = 6) -> DataFrame:
    d = F.col("delta")
    cut = lambda c: F.round(F.avg(c), digits)
    return pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), cut("base").alias("mean_base"), cut("arm").alias("mean_arm"), cut("delta").alias("mean_delta"), F.count_if(d > eps).alias("n_up"), F.count_if(d < -eps).alias("n_down"))


def outcome(a: Column, b: Column, gap: float) -> Column:
    """win, loss or tie of ``a`` against ``b`` with a margin."""
    return F.when(a >= b + gap, "win").when(b >= a + gap, "loss").otherwise("tie")


def tripwire(pairs: DataFrame, limit: float = 0.2, digits: int = 6) -> DataFrame:
    """n, improved, share, mean delta, flagged: too many candidates better than their baseline."""
    g = pairs.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("delta") > 0).alias("improved"), F.round(F.avg("delta"), digits).alias("mean_delta"))
    share = F.col("improved") / F.col("n")
    return g.select("n", "improved", F.round(share, digits).alias("share"), "mean_delta", (share > limit).alias("flagged"))
