"""Names, texts, pages, JSON and similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import stats as s
from lodestone.functions import text as x
from lodestone.functions import variants as v
from lodestone.operators import similarity as sim

from .registry import Tables, query


@query("""
select p_partkey, replace(replace(lower(trim(n)), ' ', '-'), '/', '-') dash, trim(regexp_replace(lower(n), '[^a-z0-9]+', '-', 'g'), '-') dash_runs, replace(lower(n), ' ', '_') underscore,
 regexp_replace(lower(n), '[^a-z0-9]', '', 'g') squeezed, trim(regexp_replace(lower(n), '[^a-z0-9]+', '_', 'g'), '_') underscore_runs from (select p_partkey, p_name || ' / ' || p_brand n from part)""")
def name_slugs(t: Tables) -> DataFrame:
    n = F.concat("p_name", F.lit(" / "), "p_brand")
    return t.part.select("p_partkey", x.slug_dash_spaces(n).alias("dash"), x.slug_dash_runs(n).alias("dash_runs"), x.slug_underscore_spaces(n).alias("underscore"), x.slug_squeezed(n).alias("squeezed"), x.slug_underscore_runs(n).alias("underscore_runs"))


@query("""
with n as (select p_partkey, p_name || case p_partkey % 3 when 0 then ' (Generic)' when 1 then '-abcd' else ' salt' end n, p_partkey % 3 k from part)
select p_partkey, trim(regexp_replace(n, '\\s*\\((?:generic|brand|inn)\\)\\s*$', '', 'i')) bare, regexp_extract(n, '-([a-z]{4})$', 1) suffix, array_to_string(list_filter(regexp_split_to_array(regexp_replace(n, '-[a-z]{4}$', ''), '\\s+'), lambda w: w <> ''), ' ') spoken,
 lower(replace(n, '-', '')) compacted, regexp_replace(lower(n), '[ \\-–]', '', 'g') compare, upper(left(n, 1)) || substr(n, 2) title from n""")
def name_forms(t: Tables) -> DataFrame:
    n = F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, " (Generic)").when(F.col("p_partkey") % 3 == 1, "-abcd").otherwise(" salt"))
    return t.part.select(
        "p_partkey", x.strip_label(n, ["generic", "brand", "inn"]).alias("bare"), x.hyphen_suffix(n).alias("suffix"), F.array_join(x.spoken_words(n), " ").alias("spoken"), x.compact(n).alias("compacted"), x.compare_form(n).alias("compare"), F.element_at(x.titles(n), -1).alias("title")
    )


@query("""
with n as (select p_partkey, lower(p_name) || case when p_partkey % 2 = 0 then ' salt' else '-abcd' end n from part), b as (select p_partkey, trim(regexp_replace(n, '-[a-z]{4}$', '')) b from n), c as (select *, trim(regexp_replace(b, '\\s+(?:salt|acid)$', '')) c from b)
select p_partkey, case when b = c then case when string_split(c, ' ')[1] = c then b else b || '|' || string_split(c, ' ')[1] end else b || '|' || c || case when string_split(c, ' ')[1] = c then '' else '|' || string_split(c, ' ')[1] end end forms from c""")
def base_forms(t: Tables) -> DataFrame:
    n = F.concat(F.lower("p_name"), F.when(F.col("p_partkey") % 2 == 0, " salt").otherwise("-abcd"))
    return t.part.select("p_partkey", F.array_join(x.base_forms(n, ["salt", "acid"]), "|").alias("forms"))


@query("""
select doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array(text, ',\\s*and\\s+|,\\s*|\\s+and\\s+'), lambda p: trim(p, ' ')), lambda p: p <> ''), '|') members from documents""")
def split_members(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.array_join(x.split_list(F.col("text")), "|").alias("members"))


@query("""
with a as (select doc_id, text, case lang when 'en' then 'The' when 'de' then 'DER' when 'fr' then 'le' else 'De' end p from documents), b as (select *, instr(lower(text), lower(p)) i from a)
select doc_id, case when i > 0 then i - 1 end span_start, case when i > 0 then substring(text, i, length(p)) end span_text from b""")
def locate_spans(t: Tables) -> DataFrame:
    p = F.when(F.col("lang") == "en", "The").when(F.col("lang") == "de", "DER").when(F.col("lang") == "fr", "le").otherwise("De")
    d = t.documents.select("doc_id", "text", p.alias("p")).withColumn("span_start", x.locate(F.col("text"), F.col("p")).cast("long"))
    return d.select("doc_id", "span_start", x.cut_span(F.col("text"), F.col("span_start").cast("int"), (F.col("span_start") + F.length("p")).cast("int")).alias("span_text"))


@query("""
with w as (select doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda a: a <> '') ws from documents)
select doc_id, greatest(1, list_sum([0] || list_transform(ws, lambda a: greatest(1, len(regexp_extract_all(a, '[aeiouy]+'))))))::int syllables from w""")
def syllable_estimate(t: Tables) -> DataFrame:
    return t.spread("documents").select("doc_id", x.syllables(F.col("text")).alias("syllables"))


SYMBOLS = ["sch", "tion", "ing", "the", "er", "en", "ch", "an", "on", "re"]


@query(r"""
select doc_id, array_to_string(regexp_extract_all(text, 'tion|ing|sch|the|an|ch|en|er|on|re'), ' ') tokens from documents""")
def greedy_notation(t: Tables) -> DataFrame:
    """Longest-first tokens of a notation."""
    return t.documents.select("doc_id", F.array_join(x.greedy_tokens(F.col("text"), SYMBOLS), " ").alias("tokens"))


@query(r"""
with w as (select distinct unnest(string_split(replace(text, chr(10), ' '), ' ')) w from documents),
p as (select w, string_split(w, '-') ss from w where w <> '')
select w as word, regexp_matches(w, '^[A-Za-z]+(?:-[A-Za-z]+)*$') and len(list_filter(ss, lambda s: regexp_matches(s, '^[A-Z]+$'))) = 1 and len(list_filter(ss, lambda s: not regexp_matches(s, '^(?:[A-Z]+|[a-z]+)$'))) = 0 canonical from p""")
def canonical_words(t: Tables) -> DataFrame:
    w = t.documents.select(F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("word")).where("word <> ''").distinct()
    return w.select("word", x.canonical_respelling(F.col("word")).alias("canonical"))


@query(r"""
select doc_id, regexp_matches(text, '__GUESS__') speculative,
 (regexp_matches(text, '[A-Z]{3,}')::int + regexp_matches(text, '\d{4}')::int + regexp_matches(text, '\|')::int + regexp_matches(text, '!!')::int) >= 2 spelled from documents""".replace("__GUESS__", v.GUESSES.replace("'", "''")))
def text_detectors(t: Tables) -> DataFrame:
    """Texts that guess; and texts that hit two of a list of patterns."""
    hits = sum((F.col("text").rlike(p).cast("int") for p in ("[A-Z]{3,}", r"\d{4}", r"\|", "!!")), F.lit(0))
    return t.documents.select("doc_id", v.speculative_answer(F.col("text")).alias("speculative"), (hits >= 2).alias("spelled"))


@query(r"""
select doc_id, array_to_string(regexp_extract_all(text, '[A-Za-z]+-[A-Za-z]+') || regexp_extract_all(text, '\([A-Z]+\)') || regexp_extract_all(text, '/[a-z]+/'), '|') found from documents""")
def pattern_extracts(t: Tables) -> DataFrame:
    """Several patterns' matches, one list after the other."""
    parts = [F.regexp_extract_all("text", F.lit(p), F.lit(0)) for p in ("[A-Za-z]+-[A-Za-z]+", r"\([A-Z]+\)", "/[a-z]+/")]
    return t.documents.select("doc_id", F.array_join(F.concat(*parts), "|").alias("found"))


@query(r"""
select page_id, u.href, u.label from (select page_id, unnest(list_zip(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1), regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2))) z from pages) q, (select 1) o, lateral (select z[1] href, z[2] as label) u""")
def page_links(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.explode(x.anchors(F.col("html"))).alias("a")).select("page_id", F.col("a.href").alias("href"), F.col("a.label").alias("label"))


@query(r"""
select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?s)<(?:script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '\s+', ' ', 'g'), ' ') body,
 regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1) title, len(regexp_extract_all(html, '(?s)<p[^>]*>(.*?)</p>'))::int paragraphs from pages""")
def page_text(t: Tables) -> DataFrame:
    h = F.col("html")
    return t.spread("pages").select("page_id", x.plain_text(h).alias("body"), F.coalesce(F.get(x.blocks(h, "title"), F.lit(0)), F.lit("")).alias("title"), F.size(x.blocks(h, "p")).alias("paragraphs"))


@query(r"""
select page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) host, regexp_replace(string_split(regexp_replace(url, '[?#].*$', ''), '/')[-1], '\.[A-Za-z0-9]+$', '') slug,
 case when contains(url, '://m.') then 'mobile' when contains(url, '.org') then 'organisation' when contains(url, 'example.net') then 'network' else 'other' end kind, contains(url, 'page=') or contains(url, 'ref=') denied from pages""")
def url_classes(t: Tables) -> DataFrame:
    u = F.col("url")
    kind = x.url_class(u, [("://m.", "mobile"), (".org", "organisation"), ("example.net", "network")], "other")
    return t.pages.select("page_id", x.host(u).alias("host"), x.document_slug(u).alias("slug"), kind.alias("kind"), x.contains_any(u, ["page=", "ref="]).alias("denied"))


@query("""
with l as (select distinct regexp_extract(url, '^https?://([^/?#]+)', 1) host, unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)) href from pages)
select host, count(*) n, min(href) as first_link from l group by 1""")
def merged_entries(t: Tables) -> DataFrame:
    """Entries that point to the same host, their links unioned."""
    rows = t.pages.select(x.host(F.col("url")).alias("host"), F.explode(F.transform(x.anchors(F.col("html")), lambda a: a["href"])).alias("href")).distinct()
    return rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.min("href").alias("first_link"))


@query("""
with s as (select distinct lower(unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1))) w, page_id from pages), n as (select distinct lower(regexp_extract(text, '^[A-Za-z]+')) w from documents)
select page_id, w as word from s join n using (w)""")
def page_name_matches(t: Tables) -> DataFrame:
    """Link labels that name an entity: an equality join on the folded name."""
    labels = t.pages.select("page_id", F.explode(F.transform(x.anchors(F.col("html")), lambda a: F.lower(a["label"]))).alias("word")).distinct()
    return labels.join(t.documents.select(F.lower(F.regexp_extract("text", "^[A-Za-z]+", 0)).alias("word")).distinct(), "word")


@query("select event_id, (props::json->>'k')::int k, (props::json->>'missing')::int missing from events")
def json_props(t: Tables) -> DataFrame:
    o = F.from_json("props", "k int, missing int")
    return t.events.select("event_id", o["k"].alias("k"), o["missing"].alias("missing"))


@query("""
select event_id, case when event_id % 3 = 2 then null else (props::json->>'k')::int end k from events""")
def json_in_text(t: Tables) -> DataFrame:
    """An object in a code fence, in bare text, or absent."""
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("reply ```json\n"), "props", F.lit("\n``` end"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("it is "), "props", F.lit(" so"))).otherwise("none here")
    return t.events.select("event_id", x.json_object(text, "k int")["k"].alias("k"))


@query("""
select event_id, case when k < 20 then 'ok' when k in (29, 30, 31) then 'retry' else 'permanent' end status, round(least(0.5e0 * 2e0 ** (k % 8), 30e0), 6) wait from (select event_id, (props::json->>'k')::int k from events)""")
def retry_plan(t: Tables) -> DataFrame:
    k = F.from_json("props", "k int")["k"]
    code = F.when(k < 20, 200 + k).when(k == 29, 429).when(k == 30, 500).when(k == 31, 503).otherwise(404)
    return t.events.select("event_id", x.status_class(code).alias("status"), F.round(s.backoff(k % 8 + 1), 6).alias("wait"))


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') iso, sha256(strftime(o_orderdate, '%Y%m%d')) digest from orders")
def dates_and_digests(t: Tables) -> DataFrame:
    raw = F.date_format("o_orderdate", "yyyyMMdd")
    return t.orders.select("o_orderkey", x.iso_date(raw).alias("iso"), F.sha2(raw, 256).alias("digest"))


@query("""
select event_id, case when value < 3 then 'short' when value > 200 then 'long' else '' end duration_flag,
 round(case when greatest(value, 0) / 100 >= 1 then 5e0 else 5e0 * (greatest(1 - value / 100, 0) ** 1.6e0) end, 6) as score from events""")
def thresholds(t: Tables) -> DataFrame:
    v = F.col("value")
    flag = F.when(v < 3, "short").when(v > 200, "long").otherwise("")
    return t.events.select("event_id", flag.alias("duration_flag"), F.round(F.when(v / 100 >= 1, 5.0).otherwise(s.rate_score(v / 100)), 6).alias("score"))


@query("""
with a as (select conv_id, turn, regexp_replace(lower(text), '[^a-z]', '', 'g') a, regexp_replace(lower(coalesce(lag(text) over (partition by conv_id order by turn), '')), '[^a-z]', '', 'g') b from conversations), d as (select *, greatest(length(a), length(b)) m from a)
select conv_id, turn, round(case when m = 0 then 0e0 when length(a) = 0 or length(b) = 0 then 1e0 else levenshtein(a, b) / m end, 9) error_rate from d""")
def letter_error_rate(t: Tables) -> DataFrame:
    """How far each turn's letters are from those of the turn before."""
    letters = lambda c: F.regexp_replace(F.lower(c), "[^a-z]", "")
    before = F.coalesce(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(""))
    rows = t.conversations.select("conv_id", "turn", letters("text").alias("a"), letters(before).alias("b"))
    return rows.select("conv_id", "turn", F.round(sim.error_rate(F.col("a"), F.col("b")), 9).alias("error_rate"))


@query()
def token_error_rate(t: Tables) -> DataFrame:
    """How far each turn's words are from those of the turn before."""
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    before = F.coalesce(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(""))
    rows = t.conversations.select("conv_id", "turn", words("text").alias("a"), words(before).alias("b"))
    return rows.select("conv_id", "turn", F.round(sim.token_error_rate(F.col("a"), F.col("b")), 9).alias("error_rate"))


@query("""
with n as (select distinct p_name q from part), m as (select a.q as query, b.q neighbour, levenshtein(a.q, b.q) distance from n a join n b on a.q <> b.q),
r as (select *, row_number() over (partition by query order by distance, neighbour) place from m)
select query, neighbour, distance::int distance, place::int place from r where place <= 3""")
def nearest_names(t: Tables) -> DataFrame:
    """Three nearest names, whatever the distance: no two names differ by more edits than the longest is long."""
    longest = t.part.agg(F.max(F.length("p_name")).alias("n")).first()["n"] or 1
    return sim.nearest(t.part, t.part, "p_name", 3, longest)


@query("""
with n as (select n_name q from nation), m as (select a.q a, b.q b, levenshtein(a.q, b.q) distance from n a join n b on a.q < b.q)
select a, b, distance::int distance from m order by distance, a, b limit 12""")
def closest_pairs(t: Tables) -> DataFrame:
    """The twelve closest pairs of a small dimension."""
    n = t.nation.select(F.col("n_name").alias("a"))
    return n.join(F.broadcast(n.withColumnRenamed("a", "b")), F.col("a") < F.col("b")).withColumn("distance", F.levenshtein("a", "b")).orderBy("distance", "a", "b").limit(12)


@query("""
with f as (select label clip, vec_id frame, list_transform(embedding, lambda e: e::double / (sqrt(list_sum(list_transform(embedding, lambda z: z::double * z::double))) + 1e-8)) v from embeddings),
s as (select x.clip a, y.clip b, x.frame fa, y.frame fb, list_sum(list_transform(range(1, 65), lambda i: x.v[i] * y.v[i])) s from f x join f y on x.clip < y.clip),
p as (select a, b, avg(m) p from (select a, b, fa, max(s) m from s group by all) group by all), r as (select a, b, avg(m) r from (select a, b, fb, max(s) m from s group by all) group by all)
select a, b, round(p, 6) as "precision", round(r, 6) recall, round(case when p + r <= 0 then 0 else 2 * p * r / (p + r) end, 6) f1 from p join r using (a, b)""")
def max_similarity(t: Tables) -> DataFrame:
    """Frame sets of all pairs of clips compared by their best matches."""
    f = t.embeddings.select(F.col("label").alias("clip"), F.col("vec_id").alias("frame"), sim.unit(F.col("embedding")).alias("v"))
    c = t.embeddings.select(F.col("label").alias("a")).distinct()
    pairs = c.join(c.withColumnRenamed("a", "b"), F.col("a") < F.col("b"))
    return sim.max_similarity(f, f, pairs)


@query(r"""
with l as (select page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)) href from pages)
select page_id, href, case when regexp_matches(href, '^[a-z]+:') then href when starts_with(href, '//') then regexp_extract(url, '^([a-z]+:)', 1) || href when starts_with(href, '/') then regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || href
  else regexp_replace(regexp_replace(url, '[?#].*$', ''), '/[^/]*$', '/') || href end target from l""")
def absolute_links(t: Tables) -> DataFrame:
    """Links of every page in full."""
    rows = t.pages.select("page_id", "url", F.explode(x.anchors(F.col("html"))["href"]).alias("href"))
    return rows.select("page_id", "href", x.absolute(F.col("url"), F.col("href")).alias("target"))


@query(r"""
with p as (select page_id, html || '<audio><source type="a" src="' || page_id || '.mp3"></audio>' h from pages)
select page_id, unnest(regexp_extract_all(h, '<source[^>]*src="([^"]+)"', 1)) src from p""")
def page_sounds(t: Tables) -> DataFrame:
    """Addresses of the sounds that a page plays."""
    html = F.concat("html", F.lit('<audio><source type="a" src="'), F.col("page_id").cast("string"), F.lit('.mp3"></audio>'))
    return t.pages.select("page_id", F.explode(x.sources(html)).alias("src"))


@query("select distinct p_name, array_to_string(list_transform(list_filter(string_split(replace(lower(p_name), ' ', ''), ''), lambda c: c <> ''), lambda c: c || 'ee'), ' ') letters from part")
def letter_names(t: Tables) -> DataFrame:
    """Names spelled out letter by letter."""
    names = {c: f"{c}ee" for c in "abcdefghijklmnopqrstuvwxyz"}
    return t.part.select("p_name").distinct().select("p_name", x.spelled_out(F.replace("p_name", F.lit(" "), F.lit("")), names).alias("letters"))


@query(r"""
with w as (select distinct w from (select unnest(regexp_extract_all(text, '[!-~]+')) w from conversations)) select w as word, regexp_replace(w, '^[^A-Za-z0-9_]+|[^A-Za-z0-9_]+$', '', 'g') bare from w""")
def edge_stripped(t: Tables) -> DataFrame:
    """Words without punctuation at their edges."""
    w = t.conversations.select(F.explode(F.regexp_extract_all("text", F.lit("[!-~]+"), F.lit(0))).alias("word")).distinct()
    return w.select("word", x.edge_stripped(F.col("word")).alias("bare"))


@query("""
with n as (select distinct p_name q from part), d as (select a.q as query, b.q neighbour, levenshtein(a.q, b.q) distance from n a join n b on a.q <> b.q), f as (select *, row_number() over (partition by query order by distance, neighbour) place from d)
select query, neighbour, (distance - length(query) % 4)::int margin, distance - length(query) % 4 <= 0 confusable, distance - length(query) % 4 > 0 and distance - length(query) % 4 < 2 narrow from f where place = 1""")
def name_margins(t: Tables) -> DataFrame:
    """How far each name's nearest other name lies beyond its own distance."""
    near = sim.nearest(t.part, t.part, "p_name", 1, 40)
    return sim.margins(near, F.length("query") % 4, 2)
