"""Queries over evidence: resolution, citations, candidates and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.functions import variants as v
from lodestone.operators import evidence as e
from lodestone.operators import titles

from .registry import Tables, query
from .variants import _EXPECTED, _sounds, _spoken, _symbols, sounds, symbols, vocabulary, WORDS

_LISTED = "list({'sy': sy, 'sh': sh} order by rank, sy)"


@query(f"""
with names as (select distinct p_name name from part), wd as (select distinct w from (select unnest(string_split(name, ' ')) w from names)),
claims as (
  select name term, 1 rank, 'a' source, {_symbols("replace(name, ' ', '')")} sy, 'ˈ' || {_sounds("string_split(name, ' ')[1]")} || ' ˈ' || {_sounds("string_split(name, ' ')[2]")} sh from names where length(name) % 2 = 0
  union all select name, 2, 'b', {_symbols("string_split(name, ' ')[1]")}, 'ˈ' || {_sounds("string_split(name, ' ')[1]")} from names where length(name) % 3 = 0
  union all select w, 1, 'a', {_symbols("w")}, 'ˈ' || {_sounds("w")} from wd where length(w) <= 5
  union all select w, 2, 'b', {_symbols("w || 'a'")}, 'ˈ' || {_sounds("w || 'a'")} from wd where length(w) >= 4),
f as (select term, sy, min(rank) rank, arg_min(sh, rank) sh from claims group by 1, 2),
l as (select term, {_LISTED} vs from f group by 1), c as (select term, count(distinct source) n from claims group by 1),
x as (select term, vs, n, {_EXPECTED.replace("name", "term")} expected from l join c using (term)),
r as (select term, n, list_filter(vs, lambda q: {_spoken("q.sy")} >= expected * 0.6 and len(list_filter(string_split(q.sh, ' '), lambda p: length(p) - length(replace(p, 'ˈ', '')) > 1)) = 0) vs from x),
g as (select term, vs, case when len(vs) = 0 then 'low' when n > 1 then 'high' else 'medium' end tier from r),
w as (select name, coalesce(vs, []) vs, coalesce(tier, 'low') tier, {_EXPECTED} expected from names left join g on term = name),
z as (select *, tier = 'low' or len(list_filter(vs, lambda q: {_spoken("q.sy")} >= expected * 0.75)) = 0 falls from w),
p as (select name, i place, string_split(name, ' ')[i] term from z, unnest(range(1, 3)) u(i) where falls),
b as (select name, place, vs[1] best, list_position(['high', 'medium', 'low'], coalesce(tier, 'low')) k from p left join g using (term)),
j as (select name, bool_and(best is not null) ok, string_agg(best.sy, ' ' order by place) sy, string_agg(best.sh, ' ' order by place) sh, max(k) k from b group by 1)
select name, tier, array_to_string(list_transform(vs, lambda q: q.sh), '|') shown, coalesce(vs[1].sy, '') best, false by_words from z where not falls
union all select name, ['high', 'medium', 'low'][k], case when ok then sh else '' end, case when ok then sy else '' end, true from j""")
def resolved_names(t: Tables) -> DataFrame:
    """Names resolved from ranked sources as a whole, else word by word."""
    names = t.part.select(F.col("p_name").alias("name")).distinct()
    words = names.select(F.explode(F.split("name", " ")).alias("w")).distinct()
    mark, w = F.lit(v.PRIMARY), F.split("name", " ")

    def claim(frame: DataFrame, term: str, rank: int, sy, sh) -> DataFrame:
        return frame.select(F.col(term).alias("term"), F.lit(rank).alias("rank"), F.lit("ab"[rank - 1]).alias("source"), symbols(sy).alias("symbols"), sh.alias("shown"))

    claims = claim(names.where("length(name) % 2 = 0"), "name", 1, F.replace("name", F.lit(" "), F.lit("")), F.concat(mark, sounds(w[0]), F.lit(" "), mark, sounds(w[1])))
    claims = claims.unionAll(claim(names.where("length(name) % 3 = 0"), "name", 2, w[0], F.concat(mark, sounds(w[0]))))
    claims = claims.unionAll(claim(words.where("length(w) <= 5"), "w", 1, F.col("w"), F.concat(mark, sounds(F.col("w")))))
    longer = F.concat("w", F.lit("a"))
    claims = claims.unionAll(claim(words.where("length(w) >= 4"), "w", 2, longer, F.concat(mark, sounds(longer))))
    found = e.resolve_names(names, claims)
    shown = F.array_join(F.transform("variants", lambda x: x["shown"]), "|")
    return found.select("name", "tier", shown.alias("shown"), F.coalesce(F.get("variants", F.lit(0))["symbols"], F.lit("")).alias("best"), "by_words")


@query("""
with h as (select distinct o_custkey from orders where o_orderpriority = '1-URGENT'), r as (select o_custkey, list(o_orderkey order by o_orderkey) os from orders where o_orderstatus = 'F' group by 1)
select lower(c_name) name, 'Call ' || c_name || ' now' sentence, c_name spoken, len(coalesce(os, [])) n, coalesce(os[1], -1) first_ref from h join customer on c_custkey = h.o_custkey left join r using (o_custkey)""")
def evaluation_items(t: Tables) -> DataFrame:
    """Hard items with their sentence, the span there and their references."""
    key = F.col("o_custkey").cast("string").alias("key")
    people = t.customer.select(F.col("c_custkey").cast("string").alias("key"), "c_name")
    hard = t.orders.where("o_orderpriority = '1-URGENT'").select(key).distinct().join(people.select("key", F.lower("c_name").alias("name")), "key")
    dataset = people.select("key", F.concat(F.lit("Call "), "c_name", F.lit(" now")).alias("sentence"))
    refs = t.orders.where("o_orderstatus = 'F'").groupBy(key).agg(F.array_sort(F.collect_list("o_orderkey")).alias("os"))
    found = e.evaluation_items(hard, dataset, refs, "key", "name", "sentence")
    return found.select("name", "sentence", "spoken", F.size("os").cast("long").alias("n"), F.coalesce(F.get("os", F.lit(0)), F.lit(-1)).alias("first_ref"))


@query("select a.p_partkey::varchar as key, b.p_partkey::varchar other from part a join part b on b.p_partkey = (a.p_partkey * 7) % 4001 where a.p_partkey <> b.p_partkey")
def note_pairs(t: Tables) -> DataFrame:
    """Rows whose note names another row."""
    note = F.concat(F.lit("a separate clip on this page: '"), ((F.col("p_partkey") * 7) % 4001).cast("string"), F.lit("; more'"))
    return e.pairs_by_note(t.part.select(F.col("p_partkey").cast("string").alias("key"), note.alias("note")), "key", "note", "clip on this page: '([^']+)'")


@query("""
with s as (select conv_id, turn, string_split(text, ' ') chunks, regexp_extract_all(text, '[^.]+') ss from conversations), x as (select conv_id, turn, chunks, i - 1 i, ss[i] segment from s, unnest(range(1, len(ss) + 1)) u(i)),
p as (select *, unnest([i, 2 * i + 1])::int place from x)
select conv_id, turn, segment, place, chunks[place + 1] chunk from p where place < len(chunks)""")
def cited_chunks(t: Tables) -> DataFrame:
    """What each segment of a turn cites, by place."""
    segments = F.transform(F.regexp_extract_all("text", F.lit("[^.]+"), F.lit(0)), lambda s, i: F.struct(s.alias("segment"), F.array(i, 2 * i + 1).alias("places")))
    rows = t.conversations.select("conv_id", "turn", F.split("text", " ").alias("chunks"), segments.alias("supports"))
    return e.cited_chunks(rows, ["conv_id", "turn"], "supports", "chunks")


_GUESS = v.GUESSES.replace("'", "''")


@query(f"""
with a as (select conv_id, turn, text, ['d' || conv_id % 5, 'e' || turn] chunks, regexp_extract_all(text, '[^.]+') ss from conversations where not regexp_matches(text, '{_GUESS}')),
s as (select conv_id, turn, chunks[(i - 1) % 3 + 1] as "domain", unnest(regexp_extract_all(ss[i], '[A-Z][a-z]{{4,}}')) claim from a, unnest(range(1, len(ss) + 1)) u(i) where (i - 1) % 3 < 2),
p as (select distinct conv_id, turn, claim, "domain" from s where length(claim) % 2 = 0),
w as (select conv_id, turn, chunks, unnest(regexp_extract_all(text, '[A-Z][a-z]{{4,}}')) claim from a anti join p using (conv_id, turn))
select * from p union all select distinct conv_id, turn, claim, unnest(chunks) from w where length(claim) % 2 = 0""")
def verified_claims(t: Tables) -> DataFrame:
    """Claims of answers with the domains cited for them."""
    segments = F.transform(F.regexp_extract_all("text", F.lit("[^.]+"), F.lit(0)), lambda s, i: F.struct(s.alias("segment"), F.array(i % 3).alias("places")))
    domains = F.array(F.concat(F.lit("d"), (F.col("conv_id") % 5).cast("string")), F.concat(F.lit("e"), F.col("turn").cast("string")))
    answers = t.conversations.select("conv_id", "turn", "text", segments.alias("supports"), domains.alias("chunks"))
    accepted = answers.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{4,}"), F.lit(0))).alias("claim")).where("length(claim) % 2 = 0").distinct()
    return e.verified_claims(answers, ["conv_id", "turn"], accepted, "[A-Z][a-z]{4,}")


@query(f"""
with {WORDS}, s as (select word, {_sounds("word")} x from words)
select word, case when length(word) % 2 = 0 then 'ˈ' || x || case when contains(x, 'ɡ') then '|' || replace(x, 'ɡ', 'g') else '' end
  else case when contains(x, 'ɡ') then replace(x, 'ɡ', 'g') || '|' else '' end || 'x' || x end variants from s""")
def cited_variants(t: Tables) -> DataFrame:
    """Cited variants with what a model said of them; the model's alone without a citation."""
    x = sounds(F.col("word"))
    cited = F.when(F.length("word") % 2 == 0, F.array(F.concat(F.lit("ˈ"), x))).otherwise(F.array().cast("array<string>"))
    return vocabulary(t).select("word", F.array_join(e.cited_union(cited, F.array(F.replace(x, F.lit("ɡ"), F.lit("g")), F.concat(F.lit("x"), x))), "|").alias("variants"))


@query("select event_id, user_id, case when event_id % 3 = 0 and value is not null then value * 2 else value end as value from events")
def preferred_scores(t: Tables) -> DataFrame:
    """Scores with the fresh ones where there are any."""
    rows = t.events.select("event_id", "user_id", "value")
    return e.preferred(rows, rows.where("event_id % 3 = 0").select("event_id", (F.col("value") * 2).alias("value")), ["event_id"], ["value"])


@query("""
with s as (select case when p_partkey % 3 = 0 then replace(p_name, ' ', '-') else replace(p_name, ' ', '_') end || '.' || p_partkey % 50 nm, p_retailprice size from part),
k as (select distinct nm from s where size > 950), c as (select p_partkey, i, case when i = 1 then replace(p_name, ' ', '-') else replace(p_name, ' ', '_') end || '.' || (p_partkey + i) % 50 nm from part, unnest(range(1, 4)) u(i))
select p.p_partkey, f.nm from part p left join (select p_partkey, arg_min(nm, i) nm from c join k using (nm) group by 1) f using (p_partkey)""")
def first_existing(t: Tables) -> DataFrame:
    """The first of a key's candidate names that is stored and large enough."""
    dash, under = (F.replace("p_name", F.lit(" "), F.lit(x)) for x in "-_")
    end = lambda n: F.concat(F.lit("."), ((F.col("p_partkey") + n) % 50).cast("string"))
    stored = t.part.select(F.concat(F.when(F.col("p_partkey") % 3 == 0, dash).otherwise(under), end(0)).alias("nm"), F.col("p_retailprice").alias("size"))
    names = F.array(F.concat(dash, end(1)), F.concat(under, end(2)), F.concat(under, end(3)))
    return e.first_existing(t.part.select("p_partkey", "p_name"), "p_partkey", names, stored, "nm", "size", 950)


@query("""
with r as (select p_name, list(p_partkey order by p_partkey) ks from part where p_size > 45 group by 1)
select distinct upper(p.p_name) || case when p.p_partkey % 2 = 0 then '!' else '' end shown, case when p.p_partkey % 2 = 0 then 0 else len(coalesce(ks, [])) end n from part p left join r using (p_name)""")
def listed_references(t: Tables) -> DataFrame:
    """References by case-folded name, none for unknown names."""
    refs = t.part.where("p_size > 45").groupBy("p_name").agg(F.array_sort(F.collect_list("p_partkey")).alias("ks"))
    rows = t.part.select(F.concat(F.upper("p_name"), F.when(F.col("p_partkey") % 2 == 0, "!").otherwise("")).alias("p_name")).distinct()
    found = e.with_references(rows, refs, "p_name", "ks")
    return found.select(F.col("p_name").alias("shown"), F.size("ks").cast("long").alias("n"))


@query("select label, vec_id, row_number() over (partition by label order by vec_id) place from embeddings where vec_id % 3 <> 0")
def all_references(t: Tables) -> DataFrame:
    """Every usable vector of a label, numbered."""
    return e.all_references(t.embeddings.select("label", "vec_id"), "label", "vec_id", F.col("vec_id") % 3 != 0)


@query("""
with o(place, k) as (values (0, 'view'), (1, 'signup'), (2, 'absent')), a as (select event_type k, round(avg(value), 6) x from events where user_id % 2 = 0 group by 1), b as (select event_type k, round(avg(value), 6) y from events where user_id % 2 = 1 group by 1)
select place::int place, k as kind, x plain, y tuned, round(y - x, 4) delta from o left join a using (k) left join b using (k)""")
def arm_selection(t: Tables) -> DataFrame:
    """A chosen order of keys with two arms' scores and their difference."""
    arm = lambda r: t.events.where(F.col("user_id") % 2 == r).groupBy(F.col("event_type").alias("kind")).agg(F.round(F.avg("value"), 6).alias("score"))
    return e.selected_in_order(["view", "signup", "absent"], "kind", {"plain": arm(0), "tuned": arm(1)}, "score")


@query("""
with w as (select event_id, user_id, value from events where value is not null order by value, event_id limit 12)
select w.event_id, count(*) n, round(max(e.value - w.value), 6) gain from w join events e using (user_id) where e.value is not null group by 1""")
def worst_rerun(t: Tables) -> DataFrame:
    """The twelve worst scores against all others of their user."""
    scored = t.events.where("value is not null").select("event_id", "user_id", "value")
    worst = scored.orderBy("value", "event_id").limit(12).select("event_id", "user_id", F.col("value").alias("low"))
    pairs = scored.select("user_id", "value").join(F.broadcast(worst), "user_id")
    return pairs.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max(F.col("value") - F.col("low")), 6).alias("gain"))


@query("""
with h as (select event_id, event_type, value, event_id % 7 > 0 found, event_id % 5 > 0 aligned, user_id % 2 = 0 has_v, user_id % 3 = 0 has_c from events),
s as (select event_type tier, case when not found then 'missing wav' when not aligned then 'align returned none' end error, has_v, has_c, value / 40 p, value / 60 f from h),
x as (select tier, error, error is null and has_v and p is not null ps, p >= 4 pp, error is null and has_c and f is not null fs, f >= 4 fp from s)
select coalesce(tier, '*') tier, count(*) n, count(*) filter (ps) phoneme_scored, round(avg(case when ps then pp::int end), 3) phoneme_pass_rate, count(*) filter (fs) f1_scored, round(avg(case when fs then fp::int end), 3) f1_pass_rate, count(*) filter (error is not null) failures
from x group by grouping sets ((), (tier))""")
def tier_report(t: Tables) -> DataFrame:
    """Two nullable metrics of a condition, by tier and overall."""
    ev = t.events
    items = ev.select("event_id", F.col("event_type").alias("tier"), (F.col("user_id") % 2 == 0).alias("has_variants"), (F.col("user_id") % 3 == 0).alias("has_clip"))
    heard = ev.select("event_id", (F.col("event_id") % 7 > 0).alias("found"), (F.col("event_id") % 5 > 0).alias("aligned"), (F.col("value") / 40).alias("phoneme"), (F.col("value") / 60).alias("f1"))
    rows = e.score_condition(items, heard, "event_id")
    metrics = {m: (F.col(f"{m}_scoreable"), F.col(f"{m}_pass")) for m in ("phoneme", "f1")}
    return e.tier_blocks(rows, "tier", metrics, F.col("error").isNotNull())


_STEMS = ["ion", "en", "er", "an", "s", "e"]
_STEM_SQL = f"""
with {WORDS}, m as (select word, regexp_extract(word, '^.+?(ion|an|en|er|e|s)$', 1) suffix, length(word) % 7 / 7 p, length(word) % 5 / 5 s from words),
g as (select suffix, count(*) n, avg(p) p, avg(s) s, avg(p - s) i from m where suffix <> '' group by 1)"""


def _backtest(t: Tables) -> DataFrame:
    from lodestone.functions.notation import suffix_of

    rows = vocabulary(t).select(suffix_of(F.col("word"), _STEMS).alias("suffix"), (F.length("word") % 7 / 7).alias("p"), (F.length("word") % 5 / 5).alias("s"))
    return e.stem_backtest(rows.where("suffix is not null"), "suffix", "p", "s")


@query(_STEM_SQL + "select suffix, n, round(p, 9) plain_error, round(s, 9) stem_error, round(i, 9) improvement, i > 0 kept from g")
def stem_backtest(t: Tables) -> DataFrame:
    """Errors of two ways to say names, by their suffix."""
    return _backtest(t)


@query(_STEM_SQL + "select coalesce(sum(n), 0)::bigint n, round(sum(p * n) / sum(n), 6) plain_error, round(sum(s * n) / sum(n), 6) stem_error from g where i > 0")
def stem_aggregate(t: Tables) -> DataFrame:
    """Errors over the suffixes that are kept, weighted by their examples."""
    return e.kept_aggregate(_backtest(t))


def _win_sql(m: str) -> str:
    return f"case when hyphen_{m} >= compact_{m} + 0.05 then 'hyphen' when compact_{m} >= hyphen_{m} + 0.05 then 'compact' else 'tie' end w_{m}"


_PRF = ["precision", "recall", "f1"]


@query(f"""
with s as (select value - floor(value) hyphen_precision, value * 3 - floor(value * 3) hyphen_recall, value * 7 - floor(value * 7) hyphen_f1, value * 5 - floor(value * 5) compact_precision, value * 11 - floor(value * 11) compact_recall, value * 13 - floor(value * 13) compact_f1 from events where value is not null),
w as (select *, {", ".join(map(_win_sql, _PRF))} from s)
select count(*) n, {", ".join(f"round(avg({x}_{m}), 6) {x}_{m}, count(*) filter (w_{m} = '{x}') {m}_{x}" for m in _PRF for x in ("hyphen", "compact"))},
  {", ".join(f"count(*) filter (w_{m} = 'tie') {m}_tie" for m in _PRF)},
  {", ".join(f"count(*) filter (w_f1 = '{x}' and w_{m} = '{y}') f1_{x}_{m}_{y}" for x in ("hyphen", "compact") for m in ("precision", "recall") for y in ("hyphen", "compact"))} from w""")
def form_comparison(t: Tables) -> DataFrame:
    """Means, wins and how the metrics part among wins, of two forms."""
    part = lambda k: F.col("value") * k - F.floor(F.col("value") * k)
    names = [f"{x}_{m}" for x in ("hyphen", "compact") for m in _PRF]
    rows = t.events.where("value is not null").select(*(part(k).alias(n) for n, k in zip(names, (1, 3, 7, 5, 11, 13), strict=True)))
    return e.prf_compare(rows, _PRF, 0.05)


@query("""
with s as (select o_custkey, min(o_totalprice) filter (o_orderstatus = 'P') p, min(o_totalprice) filter (o_orderstatus = 'F') f, min(o_totalprice) filter (o_orderstatus = 'O' and o_totalprice > 200000) o from orders group by 1)
select c_custkey o_custkey, coalesce(p, f, o) price, case when p is not null then 'api' when f is not null then 'page' when o is not null then 'search' end as "by" from customer left join s on c_custkey = o_custkey""")
def source_ladder(t: Tables) -> DataFrame:
    """The first source with a value for each key, and which; misses stay."""
    of = lambda w: t.orders.where(w).select("o_custkey", F.col("o_totalprice").alias("price"))
    steps = [("api", of("o_orderstatus = 'P'")), ("page", of("o_orderstatus = 'F'")), ("search", of("o_orderstatus = 'O' and o_totalprice > 200000"))]
    return e.ladder(t.customer.select(F.col("c_custkey").alias("o_custkey")), "o_custkey", steps, "price")


def _clips(t: Tables):
    found = t.events.where("event_type <> 'signup'").select("event_id", (F.col("event_id") % 11 > 0).alias("readable"), (F.col("value") / 20).alias("seconds"))
    return e.ingest_clips(found, t.events.where("event_type <> 'error'"), ["event_id"], 0.3, 6.0)


@query("""
select event_id, concat_ws(',', case when event_id % 11 = 0 then 'undecodable' end, case when event_id % 11 > 0 and value / 20 < 0.3 then 'too_short' end, case when event_id % 11 > 0 and value / 20 > 6.0 then 'too_long' end) flags,
  case when event_id % 11 = 0 or coalesce(value / 20 < 0.3 or value / 20 > 6.0, false) then 'flagged' else 'ok' end status from events where event_type <> 'signup'""")
def ingested_clips(t: Tables) -> DataFrame:
    """Clips with what is wrong with them."""
    return _clips(t)[0].select("event_id", F.array_join("flags", ",").alias("flags"), "status")


@query("select event_id, 'missing' kind from events where event_type = 'signup' union all select event_id, 'unexpected' from events where event_type = 'error'")
def clip_mismatches(t: Tables) -> DataFrame:
    """Expected clips that were not found, and found ones that were not expected."""
    return _clips(t)[1]


@query("""
select event_id, case when event_id % 4 = 0 then 'new' else 'old' end source, case when event_id % 4 = 0 then value + 100 else value end score from events""")
def rescored_rows(t: Tables) -> DataFrame:
    """Only rows whose reference changed are scored again."""
    rows = t.events.select("event_id", F.lit("old").alias("source"), F.col("value").alias("score"))
    sources = t.events.select("event_id", F.when(F.col("event_id") % 4 == 0, "new").otherwise("old").alias("source"))
    return e.rescored(rows, sources, ["event_id"], "source", lambda d: d.withColumn("score", F.col("score") + 100))


@query("""
with r as (select distinct p_name, string_split(p_name, ' ') m from part), c as (select p_name, unnest(m) member, 'The ' || p_name s from r union all select p_name, 'none', 'The ' || p_name from r)
select p_name, member, case when member <> 'none' then strpos(s, member) - 1 end::int as start, case when member <> 'none' then strpos(s, member) - 1 + length(member) end::int as "end", case when member = 'none' then 'not in the sentence' else 'ok' end status
from c where member not in (select m[1] from r where len(m) = 1)""")
def combo_members(t: Tables) -> DataFrame:
    """Members without a row of their own, cut from the combination's sentence."""
    rows = t.part.select("p_name").distinct().select("p_name", F.concat(F.split("p_name", " "), F.array(F.lit("none"))).alias("members"), F.concat(F.lit("The "), "p_name").alias("sentence"))
    return e.combo_members(rows, "p_name", "members", "sentence")


def _endpoint(t: Tables):
    keys = t.orders.select("o_orderkey")
    stages = [("no-sentence", keys.where("o_orderkey % 9 > 0")), ("no-gold", keys.where("o_orderkey % 8 > 0")), ("no-span", t.orders.where("o_orderkey % 7 > 0").select("o_orderkey", (F.col("o_totalprice") / 1e6).alias("f1")))]
    return e.endpoint_report(keys, stages, "o_orderkey", "f1")


@query("select o_orderkey, round(o_totalprice / 1e6, 4) f1 from orders where o_orderkey % 9 > 0 and o_orderkey % 8 > 0 and o_orderkey % 7 > 0")
def endpoint_scores(t: Tables) -> DataFrame:
    """Scored entries of an endpoint, the worst first."""
    return _endpoint(t)[0]


@query("select o_orderkey, case when o_orderkey % 9 = 0 then 'no-sentence' when o_orderkey % 8 = 0 then 'no-gold' else 'no-span' end missing from orders where o_orderkey % 9 = 0 or o_orderkey % 8 = 0 or o_orderkey % 7 = 0")
def endpoint_missing(t: Tables) -> DataFrame:
    """Why the other entries have no score."""
    return _endpoint(t)[1]


@query("""
with r as (select event_id, value - floor(value) a, value * 7 - floor(value * 7) b, case when event_id % 3 > 0 then value * 3 - floor(value * 3) end c, value / 10 ratio from events where value is not null and user_id not in (select user_id from events where event_type = 'signup' and value > 150)),
k as (select case when a >= 0.7 then 'agree' when b >= 0.75 and (ratio >= 1.8 or c is null or c < 0.75) then 'hyphen_artifact' when c >= 0.75 then 'ipa_suspect' when b < 0.7 then 'split' else 'ipa_suspect' end bucket from r)
select bucket, count(*) n from k group by 1""")
def diverging_counts(t: Tables) -> DataFrame:
    """Rows without a clip by how their forms diverge."""
    part = lambda k: F.col("value") * k - F.floor(F.col("value") * k)
    clips = t.events.where("event_type = 'signup' and value > 150").select("user_id").distinct()
    rows = t.events.where("value is not null").join(clips, "user_id", "left_anti")
    bucket = v.divergence_bucket(part(1), part(7), F.when(F.col("event_id") % 3 > 0, part(3)), F.col("value") / 10)
    return rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("select conv_id, turn, text || role answer, case when turn % 2 = 0 then 'https://a.example/' || conv_id else '' end uris, 'q1|' || role queries, 'https://c.example/' || turn chips from conversations")
def answer_parts(t: Tables) -> DataFrame:
    """Text and citations of a service's answer, from its JSON."""
    c = t.conversations
    web = F.struct(F.when(F.col("turn") % 2 == 0, F.concat(F.lit("https://a.example/"), F.col("conv_id").cast("string"))).alias("uri"))
    meta = F.struct(
        F.array(F.struct(web.alias("web"))).alias("groundingChunks"),
        F.array(F.lit("q1"), F.col("role")).alias("webSearchQueries"),
        F.struct(F.concat(F.lit('<a href="https://c.example/'), F.col("turn").cast("string"), F.lit('">x</a>')).alias("renderedContent")).alias("searchEntryPoint"),
    )
    content = F.struct(F.array(F.struct(F.col("text")), F.struct(F.col("role").alias("text"))).alias("parts"))
    answer = F.to_json(F.struct(F.array(F.struct(content.alias("content"), meta.alias("groundingMetadata"))).alias("candidates")))
    rows = c.select("conv_id", "turn", answer.alias("a")).select("conv_id", "turn", e.answer_text(F.col("a")).alias("answer"), e.answer_citations(F.col("a")).alias("c"))
    return rows.select("conv_id", "turn", "answer", *(F.array_join(f"c.{n}", "|").alias(n) for n in ("uris", "queries", "chips")))


@query(r"""
with w as (select conv_id, turn, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') ws from conversations)
select conv_id, turn, array_to_string(list_concat([case when turn % 2 = 0 then 'first' else 'other' end], ws), ' ') words, case when turn % 3 = 0 then 0.75 else 0.5 end confidence from w""")
def heard_words(t: Tables) -> DataFrame:
    """Words and mean confidence of a recogniser's answer, from its JSON."""
    one = F.struct(F.lit("unused").alias("transcript"), F.lit(0.5).alias("confidence"), F.array(F.struct(F.when(F.col("turn") % 2 == 0, "first").otherwise("other").alias("word"))).alias("words"))
    two = F.struct(F.col("text").alias("transcript"), F.when(F.col("turn") % 3 == 0, 1.0).alias("confidence"), F.lit(None).cast("array<struct<word:string>>").alias("words"))
    result = lambda a: F.struct(F.array(a).alias("alternatives"))
    answer = F.to_json(F.struct(F.array(result(one), result(two)).alias("results")))
    rows = t.conversations.select("conv_id", "turn", e.heard_words(answer).alias("h"))
    return rows.select("conv_id", "turn", F.array_join("h.words", " ").alias("words"), F.col("h.confidence").alias("confidence"))


@query("select p_partkey, p_name, regexp_matches(p_name, 'ring|bolt') preferred, length(p_name) size from part order by preferred desc, size, p_name, p_partkey")
def work_order(t: Tables) -> DataFrame:
    """Work in the order of preference, then length, then name, then key."""
    rows = t.part.select("p_partkey", "p_name", F.col("p_name").rlike("ring|bolt").alias("preferred"), F.length("p_name").cast("long").alias("size"))
    return rows.orderBy(F.desc("preferred"), "size", "p_name", "p_partkey")


def best_names(t: Tables) -> DataFrame:
    """The stored name most like each target, by title or slug, of all names."""
    names = t.part.select("p_name").distinct()
    pool = names.select(F.col("p_name").alias("title"), tx.slug_dash_runs(F.concat("p_name", F.lit(" salt"))).alias("slug"))
    return titles.best_matches(names.select(F.concat("p_name", F.lit("s")).alias("target")), "target", pool, ["title", "slug"])


query()(best_names)
