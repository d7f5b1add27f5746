"""Queries over notations and trials. Names stand in for dictionary entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import notation as n
from lodestone.functions import phones
from lodestone.functions import respelling as r
from lodestone.operators import trials

from .phonetics import spelled
from .registry import Tables, query

_SUFFIXES = ["ring", "bolt", "gear", "ear", "t", "alve"]


@query("""
with p as (select p_partkey, regexp_extract_all(p_name, '[a-zA-Z]+') w from part)
select p_partkey, lower(w[1]) || '-' || upper(w[2]) || array_to_string(list_transform(w[3:], lambda x: '-' || lower(x)), '') respelling, false inferred from p where p_partkey % 2 = 0 and len(w) >= 2
union all select p_partkey, upper(w[1]) || '-' || array_to_string(list_transform(w[2:], lambda x: lower(x)), '-'), true from p where p_partkey % 2 = 1 and len(w) >= 2""")
def one_primary(t: Tables) -> DataFrame:
    """Names as syllables with one in capitals; the second is marked for even keys."""
    words = F.regexp_extract_all("p_name", F.lit("[a-zA-Z]+"), F.lit(0))
    rows = t.part.select("p_partkey", words.alias("w")).where(F.size("w") >= 2)
    parts = F.transform("w", lambda x, i: F.when((i == 1) & (F.col("p_partkey") % 2 == 0), F.upper(x)).otherwise(F.lower(x)))
    return rows.select("p_partkey", n.one_primary(parts).alias("x")).select("p_partkey", "x.*")


@query("""
with p as (select p_partkey, regexp_extract_all(p_name, '[a-zA-Z]+') w from part)
select p_partkey, w[1] || '-' || w[2] || '-o|' || w[1] || '-' || w[2] || '-' || w[1] || '|' || w[2] || '-' || w[2] || '-o' forms from p where len(w) >= 2""")
def expanded_alternates(t: Tables) -> DataFrame:
    """Alternates that shorten their head, their tail, or both."""
    w = F.regexp_extract_all("p_name", F.lit("[a-zA-Z]+"), F.lit(0))
    rows = t.part.select("p_partkey", w.alias("w")).where(F.size("w") >= 2).select("p_partkey", F.get("w", F.lit(0)).alias("a"), F.get("w", F.lit(1)).alias("b"))
    raw = F.concat("a", F.lit("-"), "b", F.lit("-o, -"), "a", F.lit(", "), "b", F.lit("-, -x-"))
    return rows.select("p_partkey", F.array_join(n.expand_alternates(raw), "|").alias("forms"))


@query(f"""
with p as (select p_partkey, lower(p_name) b from part)
select p_partkey, nullif(regexp_extract(b, '^.+?({"|".join(sorted(_SUFFIXES, key=lambda s: (-len(s), s)))})$', 1), '') suffix from p""")
def name_suffix(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", n.suffix_of(F.col("p_name"), _SUFFIXES).alias("suffix"))


@query("select n_nationkey, replace(replace(replace(lower(n_name), 'a', 'A:'), 'e', '@'), 'i', '\"I') xsampa from nation")
def alphabets(t: Tables) -> DataFrame:
    """Names in a made-up phonetic spelling, turned into X-SAMPA."""
    ipa = F.lower("n_name")
    for a, b in (("a", "ɑː"), ("e", "ə"), ("i", "ˈɪ")):
        ipa = F.replace(ipa, F.lit(a), F.lit(b))
    return t.nation.select("n_nationkey", n.xsampa(ipa).alias("xsampa"))


@query()
def phoneme_forms(t: Tables) -> DataFrame:
    """Symbols and marked text of names read as phonetic letters."""
    return t.nation.select("n_name", n.phonemes(F.lower("n_name")).alias("x")).select("n_name", "x.*")


@query()
def nearest_windows(t: Tables) -> DataFrame:
    """The run of a turn's words nearest to its third to sixth word."""
    words = F.split(F.trim("text"), r"\s+")
    rows = t.conversations.where("text is not null").select("conv_id", "turn", words.alias("heard"), F.slice(words, 3, 4).alias("wanted"))
    return rows.select("conv_id", "turn", F.array_join(n.nearest_window(F.col("heard"), F.col("wanted")), " ").alias("window"))


def _references(t: Tables) -> DataFrame:
    ref = spelled(F.col("n_name"))
    rows = t.nation.select("n_nationkey", F.col("n_name").alias("name"), F.array(ref, F.concat(F.lit("HH "), ref)).alias("variants"))
    other = rows.select((F.col("n_nationkey") - 1).alias("n_nationkey"), F.get("variants", F.lit(0)).alias("other"))
    return rows.join(other, "n_nationkey", "left")


@query()
def stress_test(t: Tables) -> DataFrame:
    """Every kind of change of every name: how often each kind passes and how far it is off."""
    return trials.stress_report(trials.stress_trials(_references(t)))[0]


@query()
def simulated_system(t: Tables) -> DataFrame:
    """A made-up system's answers for all names."""
    return trials.simulated(_references(t).withColumn("item_id", F.col("n_nationkey").cast("string")))


@query("""
with e as (select event_id, value * 0.05 secs, (event_id % 100) / 100.0e0 lvl, (event_id % 7) / 100.0e0 clip, event_type = 'error' failed, length(props) n from events where value is not null),
p as (select *, secs * 1000 / greatest(n, 1) per from e)
select event_id, round(case when failed then 0e0 else greatest(0e0, least(5e0, 5e0 * (0.5e0 * case when per < 40 then greatest(0e0, 1 - abs(per - 40) / 40) when per > 130 then greatest(0e0, 1 - abs(per - 130) / 130) else 1e0 end
  + 0.3e0 * case when lvl < 0.02 then greatest(0e0, lvl / 0.02) when lvl > 0.5 then greatest(0e0, 1 - (lvl - 0.5) * 2) else 1e0 end + 0.2e0 * greatest(0e0, 1 - clip * 20)))) end, 9) score from p""")
def sound_plausibility(t: Tables) -> DataFrame:
    e = t.events.where("value is not null")
    score = trials.sound_score(F.length("props"), F.col("value") * 0.05, (F.col("event_id") % 100) / 100.0, (F.col("event_id") % 7) / 100.0, F.col("event_type") == "error")
    return e.select("event_id", F.round(score, 9).alias("score"))


@query(r"""
select page_id, nullif(trim(regexp_extract(replace(url, '*', ''), '/([^/\s][^/]{1,40}[^/\s])/', 1)), '') in_url,
  nullif(trim(regexp_extract(replace(html, '*', ''), '/([^/\s][^/]{1,40}[^/\s])/', 1)), '') in_html from pages""")
def slashed_phonetics(t: Tables) -> DataFrame:
    """The first text between slashes of every page and its address."""
    return t.pages.select("page_id", r.slashed_phonetics(F.col("url")).alias("in_url"), r.slashed_phonetics(F.col("html")).alias("in_html"))


@query("""
with p as (select p_partkey, regexp_extract_all(lower(p_name), '[a-z]+') w from part)
select p_partkey, w[1] || '-' || w[2] hyphenated, w[1] || '-' || upper(w[2]) primed, upper(w[1]) || '-' || w[2] capitals
from p where len(w) >= 2 and length(w[1]) <= 8 and length(w[2]) <= 8""")
def respelled_names(t: Tables) -> DataFrame:
    """A sentence that gives a name in three notations, and what each extractor finds in it."""
    w = F.regexp_extract_all(F.lower("p_name"), F.lit("[a-z]+"), F.lit(0))
    rows = t.part.select("p_partkey", F.get(w, F.lit(0)).alias("a"), F.get(w, F.lit(1)).alias("b")).where((F.length("a") <= 8) & (F.length("b") <= 8))
    text = F.format_string("The 7 \"%1$s-%2$s\", (%3$s %2$s), 7. %1$s %2$s\u2032. *%3$s-%2$s*", F.col("a"), F.col("b"), F.upper("a"))
    rows = rows.select("p_partkey", text.alias("text"))
    return rows.select("p_partkey", F.array_join(r.hyphenated_respellings(F.col("text")), "|").alias("hyphenated"), r.primed_respelling(F.col("text")).alias("primed"), r.capitals_respelling(F.col("text")).alias("capitals"))


@query()
def respellings_in_text(t: Tables) -> DataFrame:
    """Every candidate of every page, by notation."""
    text = F.col("html")
    return t.pages.select("page_id", F.array_join(r.hyphenated_respellings(text), "|").alias("hyphenated"), r.primed_respelling(text).alias("primed"), r.capitals_respelling(text).alias("capitals"))


@query()
def stem_stresses(t: Tables) -> DataFrame:
    """Names' symbols with the last two taken as a stem, stressed in each mode."""
    vowels = [s for s in phones.SYMBOLS if s[0] in "AEIOU"]
    bare = F.split(F.regexp_replace(spelled(F.col("n_name")), "[0-2]", ""), " ")
    modes = F.explode(F.array(F.lit("before"), F.lit("stem"), F.lit("keep"))).alias("mode")
    rows = t.nation.select("n_name", bare.alias("phones"), F.slice(bare, -2, 2).alias("tail"), modes)
    rows = rows.withColumn("root", r.root_of(F.col("phones"), F.col("tail"), vowels))
    marked = r.stem_stress(F.col("root"), F.col("tail"), F.col("mode"), F.lit(0), vowels)
    return rows.select("n_name", "mode", F.array_join(marked, " ").alias("symbols"))


@query()
def phone_edits(t: Tables) -> DataFrame:
    """Names' symbols moved towards the next nation's, by kind of edit."""
    vowels = [s for s in phones.TOKENS if s[0] in "AEIOU"]
    rows = _references(t).where("other is not null").select("n_nationkey", F.split(F.get("variants", F.lit(0)), " ").alias("own"), F.split("other", " ").alias("wanted"))
    kinds = ("vowels", "consonants", "all", "one")
    return rows.select("n_nationkey", *(F.array_join(r.moved_towards(F.col("own"), F.col("wanted"), k, vowels), " ").alias(f"by_{k}") for k in kinds))


@query("""
with p as (select p_partkey, regexp_extract_all(lower(p_name), '[a-z]+') w from part)
select p_partkey, 'uh-' || upper(w[1]) || '-' || w[2] || 'ay' respelling, true canonical from p where len(w) >= 2""")
def dictionary_respelling(t: Tables) -> DataFrame:
    """Names in a dictionary's letters, written as respellings."""
    w = F.regexp_extract_all(F.lower("p_name"), F.lit("[a-z]+"), F.lit(0))
    raw = F.concat(F.lit("ə-ˈ"), F.get(w, F.lit(0)), F.lit("-"), F.get(w, F.lit(1)), F.lit("(ā), -x"))
    rows = t.part.where(F.size(w) >= 2).select("p_partkey", r.from_dictionary(raw).alias("respelling"))
    return rows.withColumn("canonical", r.is_canonical(F.col("respelling")))
