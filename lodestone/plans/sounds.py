"""Queries over sounds: letters read aloud, notations unified, templates, loops and scorers."""

from __future__ import annotations

import contextlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import notation as n
from lodestone.functions import phones, scorers
from lodestone.functions import respelling as r
from lodestone.functions import sounds as so
from lodestone.functions import stats as s
from lodestone.operators import evidence as e
from lodestone.operators import loops
from lodestone.sources.tables import fresh_path

from .phonetics import spelled
from .registry import Tables, query
from .variants import vocabulary


@query()
def letter_sounds(t: Tables) -> DataFrame:
    """Every word's likely pronunciations from its letters."""
    rows = vocabulary(t).select("word", so.letter_sounds("word").alias("s")).select("word", so.spoken_variants(F.col("s")).alias("v"))
    return rows.select("word", F.array_join(F.transform("v", lambda x: F.array_join(x, " ")), "|").alias("variants"), so.shown(F.get("v", F.lit(0))).alias("shown"))


@query()
def dictionary_sounds(t: Tables) -> DataFrame:
    """Names in a dictionary's letters, with a shortened alternate, as symbols and phonetic text."""
    w = F.split("p_name", " ")
    raw = F.concat(F.lit("ə-ˌ"), w[0], F.lit("-ˈ"), w[1], F.lit("(ə)-ēn, -"), w[1], F.lit("-īn"))
    return t.part.select("p_name").distinct().select("p_name", F.explode(so.dictionary_phonemes(raw)).alias("x")).select("p_name", "x.*")


@query("""
with w as (select conv_id, turn, regexp_extract_all(text, '[A-Za-z]+') w from conversations), x as (select conv_id, turn, lower(w[1]) a, lower(w[2]) b from w where length(w[1]) between 2 and 8 and length(w[2]) between 2 and 8),
f as (select conv_id, turn, unnest([[1, 0], [2, 9], [3, 1], [4, 1], [5, 2], [6, 9]]) k, a, b from x)
select conv_id, turn, k[1]::int form, case k[2] when 0 then a || '-' || upper(b) when 9 then null else upper(a) || '-' || b end respelling, case k[2] when 9 then null else k[2] = 2 end inferred from f""")
def canonical_forms(t: Tables) -> DataFrame:
    """One name in six notations, each as a canonical respelling where it has one."""
    w = F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), F.lower)
    rows = t.conversations.select("conv_id", "turn", F.get(w, F.lit(0)).alias("a"), F.get(w, F.lit(1)).alias("b")).where(F.length("a").between(2, 8) & F.length("b").between(2, 8))
    a, b = F.col("a"), F.col("b")
    form = lambda raw, source="nci": F.struct(raw.alias("raw"), F.lit(source).alias("source"))
    plain = F.concat(a, F.lit("-"), F.upper(b))
    forms = [form(plain), form(F.concat(F.lit("ɪ"), a)), form(F.concat(a, F.lit("’ "), b)), form(F.concat(F.lit("("), F.upper(a), F.lit(" "), b, F.lit(")"))), form(F.concat(a, F.lit(" "), b)), form(plain, "wikipedia")]
    each = rows.select("conv_id", "turn", F.posexplode(F.array(*forms)).alias("form", "x")).withColumn("c", so.canonical(F.col("x.raw"), F.col("x.source")))
    return each.select("conv_id", "turn", (F.col("form") + 1).alias("form"), F.col("c.respelling").alias("respelling"), F.col("c.inferred").alias("inferred"))


@query("""
with w as (select conv_id, turn, regexp_extract_all(text, '[A-Za-z]+') w from conversations), x as (select conv_id, turn, lower(w[1]) a, lower(w[2]) b from w where length(w[1]) between 2 and 8 and length(w[2]) between 2 and 8)
select conv_id, turn, case when turn % 3 = 0 then 'usan' when turn % 3 = 1 then 'nci' end source, case when turn % 3 = 0 then upper(a) || '-' || b when turn % 3 = 1 then a || '-' || upper(b) end respelling,
  case when turn % 3 = 0 then 'wikipedia,nci' when turn % 3 = 1 then 'wikipedia,usan' else 'wikipedia,nci,usan' end dropped from x""")
def homogenized_records(t: Tables) -> DataFrame:
    """The first source of several with a canonical respelling, and the names of the others."""
    w = F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), F.lower)
    rows = t.conversations.select("conv_id", "turn", F.get(w, F.lit(0)).alias("a"), F.get(w, F.lit(1)).alias("b")).where(F.length("a").between(2, 8) & F.length("b").between(2, 8))
    a, b, kind = F.col("a"), F.col("b"), F.col("turn") % 3
    source = lambda name, raw: F.struct(F.lit(name).alias("name"), raw.alias("raw"))
    sources = F.array(
        source("wikipedia", F.concat(a, F.lit("-"), F.upper(b))),
        source("nci", F.when(kind < 2, F.concat(a, F.lit("-"), F.upper(b))).otherwise(F.concat(a, F.lit("ɪ")))),
        source("usan", F.when(kind == 0, F.concat(a, F.lit("’ "), b)).otherwise("")),
    )
    x = rows.select("conv_id", "turn", so.homogenized(sources, ["usan", "dailymed", "nci"]).alias("x"))
    return x.select("conv_id", "turn", "x.source", "x.respelling", F.array_join("x.dropped", ",").alias("dropped"))


@query("""
with p as (select distinct p_name from part), x as (select p_name, string_split(p_name, ' ')[1] a, string_split(p_name, ' ')[2] b from p), f as (select *, unnest([1, 2, 3, 4, 5]) k from x)
select p_name, k::int k, case k when 1 then 'ipa' when 2 then 'ipa' when 3 then 'respell' when 4 then 'ipa' end kind, case k when 1 then a || b when 2 then b when 3 then a || '|' || b when 4 then a end raw from f""")
def page_templates(t: Tables) -> DataFrame:
    """A page's own pronunciation: from its box, an antibody's box, or the text at its title."""
    a, b = (F.split("p_name", " ")[i] for i in (0, 1))
    cat = lambda *ps: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in ps])
    box = cat("{{Infobox drug\n| pronounce = {{IPAc-en|", a, "|", b, "}}\n| x = {{respell|no}}\n}}\n'''", a, "''' {{IPA-en|wrong}}")
    antibody = cat("{{Infobox\n| pronounce = \n| mab_type = mab\n| source = {{IPA|en|", b, "}}\n}}")
    prose = cat("'''", F.upper(a), "''' is ({{respell|", a, "|", b, "}}), sold as '''", b, "''' ({{IPAc-en|no}})")
    whole = cat("no bold name here {{IPA|en|", a, "}} and {{IPA|en|no}}")
    other = cat("'''", a, "''' sold as '''", b, "''' ({{IPAc-en|no}})")
    rows = t.part.select("p_name").distinct().select("p_name", a.alias("title"), F.posexplode(F.array(box, antibody, prose, whole, other)).alias("k", "text"))
    return rows.select("p_name", (F.col("k") + 1).alias("k"), so.page_notation(F.col("text"), F.col("title")).alias("x")).select("p_name", "k", "x.kind", "x.raw")


@query("""
with x as (select event_id, case event_id % 4 when 0 then 'k eɪ f' when 1 then 's p iː ɛ l' when 2 then 'ɛ f ɛ s t' else 'tɛst' end || case when user_id % 2 = 0 then ' v iː' else '' end heard from events)
select event_id, heard, (select count(*) from (values ('eɪ tʃ'), ('k eɪ'), ('p iː'), ('ɛ l'), ('ɛ s'), ('ɛ n'), ('ɛ m'), ('ɛ f'), ('t iː'), ('d iː'), ('aɪ ɛ'), ('eɪ ɑːɹ'), ('v iː'), ('eɪ eɪ')) v(p) where contains(' ' || heard || ' ', ' ' || p || ' ')) >= 2 spelled from x""")
def spelled_names(t: Tables) -> DataFrame:
    """Whether what was heard is letter names."""
    k = F.col("event_id") % 4
    heard = F.concat(F.when(k == 0, "k eɪ f").when(k == 1, "s p iː ɛ l").when(k == 2, "ɛ f ɛ s t").otherwise("tɛst"), F.when(F.col("user_id") % 2 == 0, " v iː").otherwise(""))
    return t.events.select("event_id", heard.alias("heard")).withColumn("spelled", so.spelled_out(F.col("heard")))


def _texts(t: Tables) -> DataFrame:
    """Words as phonetic text, and the same as people and as a voice would be heard to say it."""
    rows = vocabulary(t).select("word", so.letter_sounds("word").alias("symbols"))
    rows = rows.where(F.size("symbols") > 0).select("word", so.shown(so.stressed(F.col("symbols"), F.lit(2))).alias("ipa"))
    human = F.concat(F.lit("ɑ "), F.array_join(so.bare_phones(F.reverse("ipa")), " "))
    return rows.select("word", "ipa", human.alias("human"), F.replace("ipa", F.lit("ə"), F.lit("ɪ")).alias("synthetic"))


@query()
def voice_texts(t: Tables) -> DataFrame:
    """Phonetic text made fit for a voice, and what each round would try."""
    rows = _texts(t)
    official = F.when(F.length("word") % 3 == 0, F.array(F.concat("ipa", F.lit("ə")))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumns({"official": official, "clean": so.sanitized(F.concat("ipa", "ipa"), F.concat_ws(" ", "ipa", "ipa"))})
    return so.proposals(rows, "ipa", "human", "synthetic", "official").drop("human", "synthetic", "official")


def _closeness(frame: DataFrame) -> DataFrame:
    """A form's likeness to the word that it should be, from 0 to 1."""
    wanted = F.regexp_replace("key", "[^a-z]", "")
    return frame.withColumn("score", F.round(1 - F.levenshtein("form", wanted) / F.greatest(F.length("form"), F.length(wanted), F.lit(1)), 9))


@query("""
with n as (select distinct p_name k from part), x as (select k, replace(k, ' ', '') w, upper(k) f0, lower(k) f1, replace(lower(k), 'e', 'a') f2, replace(k, ' ', '') f3 from n),
sc as (select k, w, [f0, f1, f2, f3] fs, list_transform([f0, f1, f2, f3], lambda f: round(1 - levenshtein(f, w) / greatest(length(f), length(w), 1), 9)) ss from x),
r1 as (select *, case when ss[1] < 0.9 and ss[2] > ss[1] then 2 else 1 end b1 from sc), r2 as (select *, case when ss[b1] < 0.9 and ss[3] > ss[b1] then 3 else b1 end b2 from r1), r3 as (select *, case when ss[b2] < 0.9 and ss[4] > ss[b2] then 4 else b2 end b3 from r2)
select k as key, fs[b3] form, ss[b3] score, b3::int - 1 round from r3""")
def climbed_names(t: Tables) -> DataFrame:
    """Rounds of proposals for the names still too far off; the better form is kept."""
    start = _closeness(t.part.select(F.col("p_name").alias("key")).distinct().withColumn("form", F.upper("key")))
    step = lambda f: lambda open_rows: open_rows.select("key", f.alias("form"))
    proposals = [step(F.lower("key")), step(F.replace(F.lower("key"), F.lit("e"), F.lit("a"))), step(F.replace("key", F.lit(" "), F.lit("")))]
    return loops.hill_climb(start, "key", proposals, _closeness, 0.9)


def _walk_score(frame: DataFrame) -> DataFrame:
    return frame.withColumn("score", F.round(F.length(F.array_join("used", "")) / 20, 9))


@query("""
with n as (select distinct p_name k from part), x as (select k, string_split(k, ' ')[1] a, string_split(k, ' ')[2] b from n),
o as (select k, a, b, [a || b, b, a || b || a, a || b || a || b] os from x), t0 as (select *, (length(a || b)) / 20 s0 from o),
v as (select *, (length(os[1]) + length(b)) / 20 s1, (length(os[2]) + length(b)) / 20 s2, (length(os[3]) + length(b)) / 20 s3 from t0)
select k as key, case when s0 >= 0.6 then a when s1 < s0 + 0.05 then a else os[1] end || '|' || b used, round(case when s0 >= 0.6 or s1 < s0 + 0.05 then s0 else s1 end, 9) score,
  case when s0 >= 0.6 then 0 when s1 < s0 + 0.05 then 1 when s1 >= 0.6 then 1 else 2 end tries from v""")
def walked_variants(t: Tables) -> DataFrame:
    """Next variants tried while they gain enough, three at most."""
    a, b = (F.split("key", " ")[i] for i in (0, 1))
    names = t.part.select(F.col("p_name").alias("key")).distinct()
    rows = _walk_score(names.select("key", F.array(a, b).alias("used")))
    options = names.select("key", F.array(F.array(F.concat(a, b), b, F.concat(a, b, a), F.concat(a, b, a, b)), F.array(b)).alias("options"))
    done = loops.retry_variants(rows, options, "key", _walk_score, 0.6, 0.05)
    return done.select("key", F.array_join("used", "|").alias("used"), "score", "tries")


@query()
def backtested_stems(t: Tables) -> DataFrame:
    """Letters alone against a stem's own sounds, both scored against a reference with the stem."""
    tails = {"ion": "AH N", "er": "ER", "en": "EH N", "an": "AE N"}
    table = F.create_map(*[F.lit(x) for kv in tails.items() for x in kv])
    rows = vocabulary(t).select("word", n.suffix_of(F.col("word"), list(tails)).alias("suffix")).where("suffix is not null")
    rows = rows.select("word", "suffix", so.letter_sounds("word").alias("plain"), F.split(F.try_element_at(table, F.col("suffix")), " ").alias("tail"))
    rows = rows.withColumn("root", r.root_of(F.col("plain"), F.col("tail"), so.VOWEL_SYMBOLS)).where("root is not null")
    stem = r.stem_stress(F.col("root"), F.col("tail"), F.lit("before"), F.lit(0), so.VOWEL_SYMBOLS)
    text = lambda c: F.array_join(c, " ")
    reference = F.concat_ws(" ", text(so.stressed(F.slice("plain", 1, F.greatest(F.size("plain") - 1, F.lit(1))), F.lit(1))), text(so.stressed(F.col("tail"), F.lit(9))))
    rows = rows.select("suffix", text(so.stressed(F.col("plain"), F.lit(3))).alias("g2p"), text(stem).alias("by_stem"), reference.alias("ref"))
    costs = rows.select("suffix", phones.aligned_cost("ref", "g2p").alias("p"), phones.aligned_cost("ref", "by_stem").alias("s"))
    return e.stem_backtest(costs.select("suffix", *(phones.normalized_error(F.col(c)).alias(c) for c in ("p", "s"))), "suffix", "p", "s")


@query("""
with e as (select event_id, case when event_id % 3 > 0 then value / 200 end f from events)
select event_id::varchar item_id, case when f is not null then round(least(greatest(1 + 4 * greatest(f, 0.0) / 0.747, 1.0), 5.0), 9) end score, f is not null scoreable, case when f is null then 'no reference' end error, case when f is not null then least(greatest(1 + 4 * greatest(f, 0.0) / 0.747, 1.0), 5.0) >= 4 end passed from e""")
def similarity_scores(t: Tables) -> DataFrame:
    """A registered scorer over items of which some have no reference."""
    rows = t.events.select(F.col("event_id").cast("string").alias("item_id"), F.when(F.col("event_id") % 3 > 0, F.col("value") / 200).alias("f1"))
    return scorers.build_scorer("speech-similarity")(rows).withColumn("score", F.round("score", 9))


@query()
def phoneme_distances(t: Tables) -> DataFrame:
    """A registered scorer: names heard without their first sound, against one or two variants."""
    ref = spelled(F.col("p_name"))
    names = t.part.select("p_name").distinct().select(F.col("p_name").alias("item_id"), F.regexp_replace(ref, "^[A-Z]+[0-9]? ", "").alias("heard"), F.when(F.length("p_name") % 5 > 0, F.array(ref, F.concat(F.lit("HH "), ref))).otherwise(F.array().cast("array<string>")).alias("variants"))
    return scorers.build_scorer("phoneme-distance")(names)


@query("""
with e as (select event_id, value / 100 x from events where value is not null)
select event_id, round(5.0 * least(greatest(1.0 - x / 3.853, 0.0), 1.0), 3) score from e""")
def distance_scores(t: Tables) -> DataFrame:
    """The mapping of distances to scores."""
    return t.events.where("value is not null").select("event_id", scorers.rate_to_score(F.col("value") / 100).alias("score"))


def _said(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z]", "")


def _alike(a: Column, b: Column) -> Column:
    return F.round(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1)), 4)


def _refusing(asked: DataFrame) -> DataFrame:
    """A service that turns away words with a double letter, by name, and others when more than four are left."""
    bad = F.get(F.filter("phrases", lambda p: F.rlike(p, F.lit("ee|ll|oo|pp|rr|tt"))), F.lit(0))
    message = F.when(bad.isNotNull(), F.concat(F.lit("not taken: "), bad)).when(F.size("phrases") > 4, "too many")
    return asked.select("key", F.array_join("phrases", "").alias("answer"), message.alias("message"))


@query("""
with n as (select min(p_partkey) id, p_name k from part group by 2), x as (select *, string_split(k, ' ') w from n),
c as (select *, case when id % 5 = 0 then replace(k, ' ', '') end cached, case when id % 7 <> 0 then replace(replace(k, 'e', 'a'), ' ', '-') end alias from x),
p as (select *, case when cached is not null then w else list_filter(w, lambda y: not regexp_matches(y, 'ee|ll|oo|pp|rr|tt'))[1:4] end l,
  case when cached is not null then [] else list_concat(list_filter(w, lambda y: regexp_matches(y, 'ee|ll|oo|pp|rr|tt')), list_reverse(list_filter(w, lambda y: not regexp_matches(y, 'ee|ll|oo|pp|rr|tt'))[5:])) end d from c),
a as (select *, coalesce(cached, case when len(l) > 0 then array_to_string(l, '') end) one, regexp_replace(lower(alias), '[^a-z]', '', 'g') two, case when id % 2 = 0 then replace(upper(k), ' ', '') end clip from p),
s as (select *, case when alias is not null then round(1 - levenshtein(one, two) / greatest(length(one), length(two), 1), 4) end alike from a),
e as (select *, case when alias is null then 'no_respelling' when one is null then 'no_ipa' when alike < 0.55 then 'mixup_ipa' end error from s),
f as (select *, case when error is null then round(1 - levenshtein(one, lower(clip)) / greatest(length(one), length(clip), 1), 4) end v1, case when error is null then round(1 - levenshtein(two, lower(clip)) / greatest(length(two), length(clip), 1), 4) end v2 from e)
select k as key, case when one is null or error = 'mixup_ipa' then '' else array_to_string(l, '|') end used, array_to_string(d, '|') dropped, error, alike, v1 phrases_vs_clip, v2 alias_vs_clip, round(v1 - v2, 4) delta from f""")
def two_arm_rows(t: Tables) -> DataFrame:
    """Names by their words, without those that a service refuses, against names by a respelling."""
    names = t.part.groupBy(F.col("p_name").alias("key")).agg(F.min("p_partkey").alias("id"))
    joined = F.replace("key", F.lit(" "), F.lit(""))
    rows = names.select("key", "id", F.split("key", " ").alias("phrases"), F.when(F.col("id") % 7 != 0, F.replace(F.replace("key", F.lit("e"), F.lit("a")), F.lit(" "), F.lit("-"))).alias("alias"), F.when(F.col("id") % 5 == 0, joined).alias("cached"))
    speak = lambda d: d.select("key", _said(F.col("alias")).alias("answer"))
    clips = names.where("id % 2 = 0").select("key", F.lower(joined).alias("clip"))
    found = loops.two_arms(rows, "key", _refusing, speak, _alike, clips, 0.55)
    return found.withColumns({c: F.array_join(c, "|") for c in ("used", "dropped")})


def _trial_score(frame: DataFrame) -> DataFrame:
    """Likeness of a form of a user's digits to the wanted ones."""
    return frame.withColumn("score", F.round(1 - F.levenshtein("form", F.lpad("key", 6, "7")) / 6, 9))


@query("""
with u as (select distinct user_id::varchar k from events), s as (select k, lpad(k, 6, '7') w, [lpad('', 6, '0'), lpad(k, 6, '0'), reverse(lpad(k, 6, '7')), lpad(k, 6, '7')[1:5] || 'x', lpad(k, 6, '7')[1:3] || lpad('', 3, '7'), lpad('', 6, '7')] f from u),
x as (select *, list_transform(f, lambda y: round(1 - levenshtein(y, w) / 6, 9)) p from s),
b1 as (select *, case when p[1] < 0.95 and p[2] > p[1] + 0.05 then 2 else 1 end b from x), b2 as (select * exclude (b), case when p[b] < 0.95 and p[3] > p[b] + 0.05 then 3 else b end b from b1),
b3 as (select * exclude (b), case when p[b] < 0.95 and p[4] > p[b] + 0.05 then 4 else b end b from b2), b4 as (select * exclude (b), case when p[b] < 0.95 and p[5] > p[b] + 0.05 then 5 else b end b from b3),
b5 as (select * exclude (b), case when p[b] < 0.95 and p[6] > p[b] + 0.05 then 6 else b end b from b4)
select k as key, f[b] form, p[b] score, (b - 1)::int round from b5""")
def resumed_climb(t: Tables) -> DataFrame:
    """Five rounds of proposals, killed within the fourth and gone on with from the stored rounds."""
    users = t.events.select(F.col("user_id").cast("string").alias("key")).distinct()
    start = _trial_score(users.withColumn("form", F.lit("000000")))
    padded = F.lpad("key", 6, "7")
    forms = [F.lpad("key", 6, "0"), F.reverse(padded), F.concat(F.left(padded, F.lit(5)), F.lit("x")), F.concat(F.left(padded, F.lit(3)), F.lit("777")), F.lit("777777")]
    steps = [lambda d, f=f: d.select("key", f.alias("form")) for f in forms]
    folder = fresh_path(t.spark, "climb")

    def killed(rows: DataFrame) -> DataFrame:
        raise KeyboardInterrupt

    with contextlib.suppress(KeyboardInterrupt):
        loops.hill_climb(start, "key", [*steps[:3], killed], _trial_score, 0.95, 0.05, folder)
    return loops.hill_climb(start, "key", steps, _trial_score, 0.95, 0.05, folder)
