"""Phonetic scoring queries over letter-derived symbol sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import fuzzy, phones
from lodestone.functions import stats as s
from lodestone.functions import text as x
from lodestone.operators import nearest

from .registry import Tables, query

# A symbol for each letter, enough to turn test names into sequences.
LETTERS = dict(zip("abcdefghijklmnopqrstuvwxyz", "AE1 B K D EH0 F G HH IH0 JH K L M N AO0 P K R S T AH0 V W K Y Z".split(), strict=True))


def spelled(name):
    table = F.create_map(*[F.lit(x) for kv in LETTERS.items() for x in kv])
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(name), F.lit("[a-z]"), F.lit(0)), lambda c: F.try_element_at(table, c)), " ")


def _values(rows: list[tuple], tables: tuple[dict, ...]) -> str:
    """Feature rows as SQL values, names by their numbers."""
    out = []
    for name, *fields in rows:
        out.append(f"('{name}', " + ", ".join(str(float(t[f])) if t else str(f) for f, t in zip(fields, tables, strict=True)) + ")")
    return ", ".join(out)


_SONORANT = [name for name, _, manner, _ in phones.CONSONANTS if manner in ("nasal", "liquid", "glide")]
_LISTED = ", ".join(f"('{x}', '{y}', {c})" for pair, c in phones.PAIRS.items() for x, y in (pair, pair[::-1]))
_WEIGHED = " + ".join(f"{w} * abs(x.f{i} - y.f{i})" for i, w in enumerate(phones.VOWEL_WEIGHTS))


_LETTER_VALUES = ", ".join(f"('{c}', '{x}')" for c, symbols in LETTERS.items() for x in symbols.rstrip("012").split())


@query(f"""
with c(s, place, manner, voiced) as (values {_values(phones.CONSONANTS, (phones.PLACES, phones.MANNERS, {}))}),
v(s, f0, f1, f2, f3, f4, f5, f6) as (values {_values(phones.VOWELS, (phones.HEIGHTS, phones.BACKNESS, {}, {}, {}, phones.HEIGHTS, phones.BACKNESS))}),
l(a, b, cost) as (values {_LISTED}), n as (select s from c union all select s from v),
letter(c, s) as (values {_LETTER_VALUES}), met as (select distinct s from (select unnest(regexp_extract_all(lower(p_name), '[a-z]')) c from part) join letter using (c)),
p as (select x.s a, y.s b, x.s in (select s from met) and y.s in (select s from met) met from n x join n y on x.s < y.s),
cc as (select x.s a, y.s b, ({phones.CONSONANT_WEIGHTS[0]} * abs(x.place - y.place) + {phones.CONSONANT_WEIGHTS[1]} * abs(x.manner - y.manner) + {phones.CONSONANT_WEIGHTS[2]} * abs(x.voiced - y.voiced)) / {sum(phones.CONSONANT_WEIGHTS)} cost from c x, c y),
vv as (select x.s a, y.s b, ({_WEIGHED}) / {sum(phones.VOWEL_WEIGHTS)} cost from v x, v y)
select p.a, p.b, round(coalesce(l.cost, cc.cost, vv.cost, case when p.a in {tuple(_SONORANT)} or p.b in {tuple(_SONORANT)} then {phones.ACROSS_SONORANT} else {phones.ACROSS} end)::double, 9) cost, p.met
from p left join l on l.a = p.a and l.b = p.b left join cc on cc.a = p.a and cc.b = p.b left join vv on vv.a = p.a and vv.b = p.b""")
def symbol_pairs(t: Tables) -> DataFrame:
    """The cost of every pair of symbols, and whether the names' references have both."""
    symbols = F.filter(F.transform(F.split(spelled(F.col("p_name")), " "), lambda x: F.regexp_replace(x, "[012]$", "")), lambda x: x != "")
    met = t.part.select(F.explode(F.array_distinct(symbols)).alias("s")).agg(F.collect_set("s").alias("met"))  # at most the inventory's symbols
    every = F.array(*map(F.lit, sorted(phones.SYMBOLS)))
    pairs = met.select(F.explode(every).alias("a"), "met").select("a", F.explode(F.filter(every, lambda b: b > F.col("a"))).alias("b"), "met")
    both = F.array_contains("met", F.col("a")) & F.array_contains("met", F.col("b"))
    return pairs.select("a", "b", F.round(phones.pair_cost("a", "b"), 9).alias("cost"), both.alias("met"))


@query()
def phonetic_scores(t: Tables) -> DataFrame:
    """Each nation's name against variants of its reference: the best variant's error and score."""
    rows = t.nation.select(F.col("n_name").alias("item"), spelled(F.col("n_name")).alias("ref"))
    variants = rows.select("item", F.posexplode(F.array("ref", F.concat_ws(" ", F.lit("HH"), F.col("ref")))).alias("variant", "ref"))
    heard = variants.join(rows.select("item", F.regexp_replace("ref", "^[A-Z]+[0-9]? ?", "").alias("hyp")), "item").where("hyp <> ''")
    scored = heard.withColumn("a", phones.align("ref", "hyp")).withColumn("error", phones.normalized_error(F.col("a")))
    best = scored.groupBy("item").agg(F.min_by(F.struct("variant", "error", F.col("a.ops").alias("ops")), F.struct("error", "variant")).alias("x"))
    return best.select("item", "x.variant", F.round("x.error", 9).alias("error"), s.cut_score(F.col("x.error")).alias("score"), phones.worst_syllable(F.col("x.ops")).alias("worst_syllable"))


@query()
def phonetic_neighbours(t: Tables) -> DataFrame:
    """Three nearest other names by scaled alignment cost, whatever their lengths."""
    names = t.part.select(F.col("p_name").alias("item")).distinct().withColumn("ref", spelled(F.col("item")))
    near = nearest.nearest_names(names, "item", "ref", 3)
    return near.select("item", "neighbour", F.round("distance", 9).alias("distance"), "place")


@query("""
with n as (select distinct p_name a, split_part(p_name, ' ', 1) || split_part(p_name, ' ', 2) b from part)
select a, b, round(jaro_winkler_similarity(a, b), 9) similarity from n""")
def name_similarity(t: Tables) -> DataFrame:
    n = t.part.select(F.col("p_name").alias("a"), F.replace("p_name", F.lit(" "), F.lit("")).alias("b")).distinct()
    return n.select("a", "b", F.round(fuzzy.jaro_winkler("a", "b"), 9).alias("similarity"))


@query()
def gated_scores(t: Tables) -> DataFrame:
    n = t.part.select(F.col("p_name").alias("a"), F.replace("p_name", F.lit(" "), F.lit("")).alias("b")).distinct()
    return n.select("a", "b", F.round(fuzzy.gated_score(F.col("a"), F.col("b"), x.phonetic_code(F.col("a")) == x.phonetic_code(F.col("b"))), 9).alias("score"), F.round(fuzzy.matching_ratio("a", "b"), 9).alias("ratio"))


@query()
def spans_in_hypotheses(t: Tables) -> DataFrame:
    """Where the second to fourth word of a turn stands in the same turn without its first word."""
    words = F.split(F.trim("text"), r"\s+")
    rows = t.conversations.select("conv_id", "turn", words.alias("ref"), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(1))).alias("hyp")).where(F.size("ref") >= 5)
    at = fuzzy.span_in_hypothesis("ref", "hyp", F.lit(1), F.lit(4))
    return rows.withColumn("at", at).select("conv_id", "turn", "at.first", "at.last")
