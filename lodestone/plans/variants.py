"""Queries over variants of names, phonetic texts, pages and lists. Words of the documents stand in for names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import variants as v
from lodestone.operators.containment import contained_names, undominated
from lodestone.sources.tables import dealt

from .registry import Tables, query

# Fixed values of the stand-in: one phonetic letter for each plain one.
PLAIN, SOUNDS = "abcdefghijklmnopqrstuvwxyz", "æbkdɛfɡhɪʒklmnɒpkrstʌvwxjz"
WORDS = "words as (select distinct lower(w) word from (select unnest(regexp_extract_all(text, '[A-Za-z]+')) w from documents))"


def vocabulary(t: Tables) -> DataFrame:
    """Distinct plain words of all documents, over all tasks."""
    return dealt(t.spread("documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("w")).select(F.lower("w").alias("word")).distinct())


def sounds(word: Column) -> Column:
    return F.translate(word, PLAIN, SOUNDS)


def symbols(word: Column) -> Column:
    """One symbol for each letter, vowels with a stress digit."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.upper(word), "([A-Z])", "$1 "), "[AEIOUY] ", "AH1 "))


def _sounds(x: str) -> str:
    return f"translate({x}, '{PLAIN}', '{SOUNDS}')"


def _symbols(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(upper({x}), '([A-Z])', '\1 ', 'g'), '[AEIOUY] ', 'AH1 ', 'g'))"


def _spoken(x: str) -> str:
    return f"len(list_filter(string_split({x}, ' '), lambda s: regexp_matches(s, '[0-2]$')))"


_EXPECTED = r"""greatest(1, list_sum(list_transform(list_filter(string_split_regex(lower(trim(name)), '\s+'), lambda x: x <> ''),
    lambda x: greatest(1, len(regexp_extract_all(regexp_replace(x, '-[a-z]{4}$', ''), '[aeiouy]+'))))))"""


@query(f"""
with {WORDS}, n as (select word, reverse(word) back, case when length(word) % 2 = 1 then word || ' ' || reverse(word) else word || '-abcd' end name from words),
x as (select word, name, {_EXPECTED} expected, [
   {{'sy': {_symbols("word")}, 'sh': 'ˈ' || {_sounds("word")}}},
   {{'sy': {_symbols("word || back")}, 'sh': 'ˈ' || {_sounds("word")} || ' ˈ' || {_sounds("back")}}},
   {{'sy': {_symbols("word || back")}, 'sh': 'ˈ' || {_sounds("word")} || 'ˈ' || {_sounds("back")}}},
   {{'sy': {_symbols("left(word, 2)")}, 'sh': {_sounds("left(word, 2)")}}}] vs from n),
y as (select *, list_filter(vs, lambda r: {_spoken("r.sy")} >= expected * 0.6 and len(list_filter(string_split(r.sh, ' '), lambda p: length(p) - length(replace(p, 'ˈ', '')) > 1)) = 0) good from x)
select word, expected::int expected, not contains(name, ' ') or len(list_filter(vs, lambda r: {_spoken("r.sy")} >= expected * 0.75)) > 0 covered,
  len(good)::int n_usable, array_to_string(list_transform(good, lambda r: r.sh), '|') usable from y""")
def variant_rules(t: Tables) -> DataFrame:
    """Which variants of each name can stand for it, and whether any covers the whole name."""
    word, back = F.col("word"), F.reverse("word")
    name = F.when(F.length("word") % 2 == 1, F.concat(word, F.lit(" "), back)).otherwise(F.concat(word, F.lit("-abcd")))
    one = lambda sy, sh: F.struct(symbols(sy).alias("symbols"), sh.alias("shown"))
    mark = F.lit(v.PRIMARY)
    both = F.concat(word, back)
    four = F.array(
        one(word, F.concat(mark, sounds(word))),
        one(both, F.concat(mark, sounds(word), F.lit(" "), mark, sounds(back))),
        one(both, F.concat(mark, sounds(word), mark, sounds(back))),
        one(F.left(word, F.lit(2)), sounds(F.left(word, F.lit(2)))),
    )
    rows = vocabulary(t).select("word", name.alias("name"), four.alias("variants"))
    good = v.usable_variants(F.col("name"), F.col("variants"))
    rows = rows.select("word", v.expected_syllables(F.col("name")).alias("expected"), v.covers_name(F.col("name"), F.col("variants")).alias("covered"), good.alias("good"))
    return rows.select("word", "expected", "covered", F.size("good").alias("n_usable"), F.array_join(F.transform("good", lambda x: x["shown"]), "|").alias("usable"))


_BARE = "trim(trim(form), '/[]() ')"
_CLEAN = f"case when lower(trim(form)) in ('', 'n/a', 'none', 'null', 'unknown') then '' else replace(replace({_BARE}, '''', 'ˈ'), 'ˈˈ', 'ˈ') end"
_SAME = "translate(regexp_replace({}, '[. ]', '', 'g'), 'ɹɡ', 'rg')"


@query(f"""
with {WORDS}, s as (select word, {_sounds("word")} ipa from words),
f as (select word, k::int k, ['/ˈ' || ipa || '/', ipa, word || '-' || upper(word), left(ipa, 1) || 'ˈ' || substr(ipa, 2), 'ˈ' || ipa || '..', '[ˈ' || ipa || '.' || ipa || ']', 'N/A', '', upper(word) || 'ˈ' || ipa, '''' || ipa || ' ' || ipa, word || '"x'][k] form, 'ˈ' || ipa first from s, unnest(range(1, 12)) u(k)),
g as (select *, {_BARE} b, lower({_BARE}) l, {_CLEAN} cleaned from f),
h as (select *, regexp_replace(cleaned, '[.\\s]', '', 'g') flat, list_filter(string_split_regex(regexp_replace(l, '[ˈˌ]', '', 'g'), '[. ]+'), lambda x: x <> '') syl from g)
select word, k, cleaned, regexp_replace(translate(lower(flat), 'ɹɡ', 'rg'), '[ˈˌː. /\\[\\]()-]', '', 'g') fold, translate(regexp_replace(cleaned, '[ˈˌ ]', '', 'g'), 'r', 'ɹ') phonemes,
  {_SAME.format("b")} <> '' and {_SAME.format("b")} = {_SAME.format("first")} same,
  case when regexp_matches(form, '[{v.LENIENT_MARKS}]') then true when form = '' or regexp_matches(form, '[A-Za-z]{{3,}}.*[''"]') or regexp_matches(form, '[- ]') then false else regexp_matches(form, '(?i)[aeiouyæ]') end lenient,
  l <> '' and not regexp_matches(b, '[āēīōüăěŏ"“”]|\\.\\.|[-–]|[A-Z]{{2,}}') and regexp_matches(l, '[{v.IPA_MARKS}]') and not regexp_matches(l, '[ʝχβɲʎɣʔɓɗ]|[\\x{{0300}}-\\x{{036F}}]')
   and len(regexp_extract_all(l, '[{v.IPA_VOWELS}]+')) >= 2 and not regexp_matches(l, '(?:^|[^{v.IPA_VOWELS}])[{v.IPA_CONSONANTS}][ˈˌ][{v.IPA_VOWELS}]')
   and len(list_filter(syl, lambda x: not regexp_matches(x, '[{v.IPA_VOWELS}]') or (length(regexp_extract(x, '^([^{v.IPA_VOWELS}]*)', 1)) >= 3 and not regexp_matches(x, '^[sʃ]')))) = 0 published
from h""")
def phonetic_texts(t: Tables) -> DataFrame:
    """Forms of phonetic text of each word: cleaned, folded, compared and judged."""
    w, ipa = F.col("word"), sounds(F.col("word"))
    cat = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    forms = F.array(
        cat("/ˈ", ipa, "/"), ipa, cat(w, "-", F.upper(w)), cat(F.left(ipa, F.lit(1)), "ˈ", F.substr(ipa, F.lit(2))), cat("ˈ", ipa, ".."), cat("[ˈ", ipa, ".", ipa, "]"),
        F.lit("N/A"), F.lit(""), cat(F.upper(w), "ˈ", ipa), cat("'", ipa, " ", ipa), cat(w, '"x'),
    )
    rows = vocabulary(t).select("word", cat("ˈ", ipa).alias("first"), F.posexplode(forms).alias("k", "form"))
    form = F.col("form")
    return rows.select(
        "word",
        (F.col("k") + 1).alias("k"),
        v.unwrapped(form).alias("cleaned"),
        v.folded(form).alias("fold"),
        v.plain_phonemes(v.unwrapped(form)).alias("phonemes"),
        v.same_with_stress(form, F.col("first")).alias("same"),
        v.lenient_ipa(form).alias("lenient"),
        v.source_ipa(form).alias("published"),
    )


_MARKED = "'ˈ' || translate(left(word, 3), '{0}', '{1}') || '.' || translate(substr(word, 4), '{0}', '{1}')".format(PLAIN, SOUNDS)


@query(f"""
with {WORDS}, f as (select left(word, 3) head, list(distinct {_MARKED} order by {_MARKED}) items from words where length(word) between 3 and 9 group by 1),
k as (select *, list_transform(items, lambda x: regexp_replace(x, '[. ]', '', 'g')) keys from f)
select head, array_to_string(list_filter(items, lambda x, i: list_position(keys, keys[i]) = i and len(list_filter(keys, lambda y: length(y) > length(keys[i]) and contains(y, keys[i]))) = 0)[1:3], '|') kept from k""")
def pruned_variants(t: Tables) -> DataFrame:
    """Of the phonetic texts with one beginning those that no longer one contains, three at most."""
    shown = F.concat(F.lit("ˈ"), sounds(F.left("word", F.lit(3))), F.lit("."), sounds(F.substr(F.col("word"), F.lit(4))))
    rows = vocabulary(t).where(F.length("word").between(3, 9)).select(F.left("word", F.lit(3)).alias("head"), shown.alias("item"))
    kept = undominated(rows, "head", "item", 3)
    return kept.groupBy("head").agg(F.array_join(F.array_sort(F.collect_list("item")), "|").alias("kept"))


_REWRITES = [("tʃ", "ʧ"), ("dʒ", "ʤ"), ("æɪ", "A"), ("ɒʌ", "W"), ("ɛɪ", "I"), ("ː", "")]
_LETTERS = "ˈæbkdɛfɡhɪʒlmnɒpɹstʌvwxjzʧʤAWI"


def _engine(x: str) -> str:
    for old, new in _REWRITES:
        x = f"replace({x}, '{old}', '{new}')"
    return f"translate({x}, 'rg', 'ɹɡ')"


@query(f"with {WORDS} select word, {_engine('chr(712) || ' + _sounds('word'))} engine from words")
def engine_letters(t: Tables) -> DataFrame:
    """Phonetic text in an engine's alphabet; a letter outside it would be an error."""
    return vocabulary(t).select("word", v.engine_alphabet(F.concat(F.lit("/'"), sounds(F.col("word")), F.lit("/")), _REWRITES, _LETTERS).alias("engine"))


_SQUEEZED = "regexp_replace(lower({}), '[^a-z0-9]+', '', 'g')"


@query(f"""
with p as (select page_id, regexp_extract(url, '://([a-z]+)', 1) word, ['https://en.wikipedia.org/wiki/' || regexp_extract(url, '://([a-z]+)', 1) || '_(x)', url, 'https://en.wiktionary.org/w/' || regexp_extract(url, '://([a-z]+)', 1), 'https://en.wikipedia.org/wiki/%C3%A9' || right(url, 3), ''] us, html from pages),
u as (select page_id, word, k::int k, us[k] u from p, unnest(range(1, 6)) x(k)),
v as (select *, lower(url_decode(regexp_extract(u, '^https?://[^/?#]+(/[^?#]*)', 1))) path, lower(regexp_extract(u, '^https?://([^/?#]+)', 1)) host from u)
select page_id, k, word || ':2' as shown, word headword, case when u = '' then true when word = '' then false when contains(host, 'wikipedia.org') or contains(host, 'wiktionary.org')
  then contains(path, '/wiki/') and contains({_SQUEEZED.format("regexp_extract(path, '.*/wiki/(.*)$', 1)")}, word) else true end fits from v""")
def page_for_word(t: Tables) -> DataFrame:
    """Whether a page is about the word: an encyclopedia's by its title, others always."""
    word, url = F.regexp_extract("url", "://([a-z]+)", 1), F.col("url")
    urls = F.array(
        F.concat(F.lit("https://en.wikipedia.org/wiki/"), word, F.lit("_(x)")), url, F.concat(F.lit("https://en.wiktionary.org/w/"), word), F.concat(F.lit("https://en.wikipedia.org/wiki/%C3%A9"), F.right(url, F.lit(3))), F.lit("")
    )
    rows = t.pages.select("page_id", word.alias("word"), F.posexplode(urls).alias("k", "u"))
    shown = F.concat("word", F.lit(":2"))
    return rows.select("page_id", (F.col("k") + 1).alias("k"), shown.alias("shown"), v.headword(shown).alias("headword"), v.page_is_for(F.col("word"), F.col("u")).alias("fits"))


@query(f"""
with n as (select distinct w from (select unnest(string_split(p_name, ' ')) w from part)), p as (select page_id, {_SQUEEZED.format("html")} blob, {_SQUEEZED.format("url")} own from pages)
select page_id, w other from p, n where length(w) >= 4 and contains(blob, w) and not contains(own, w)""")
def names_on_pages(t: Tables) -> DataFrame:
    """Other names that a page's text contains, whatever the number of names."""
    words = t.part.select(F.explode(F.split("p_name", " ")).alias("other")).distinct()
    return contained_names(t.pages, ["page_id"], "html", "url", words, "other", 4)


@query(r"""
with b as (select p_brand, string_agg(distinct p_name, '; ' order by p_name) names from part group by 1),
l as (select p_brand, 'x (oral); y (' || names || ' (many more))' lab, names || ' (and many more)' flat from b)
select p_brand, array_to_string(['x (oral)', 'y'], '|') generics, replace(regexp_replace(flat, ' \(and many more\)$', ''), '; ', '|') brands, len(string_split(flat, ';'))::int n, 'x' bare from l""")
def label_lists(t: Tables) -> DataFrame:
    """A label's generics and the brands in its last balanced parenthesis."""
    names = F.array_join(F.array_sort(F.collect_set("p_name")), "; ")
    rows = t.part.groupBy("p_brand").agg(names.alias("names"))
    label = F.concat(F.lit("x (oral); y ("), "names", F.lit(" (many more))"))
    flat = F.concat("names", F.lit(" (and many more)"))
    rows = rows.select("p_brand", v.label_groups(label).alias("g"), F.size(v.list_members(flat)).alias("n"))
    return rows.select("p_brand", F.array_join("g.generics", "|").alias("generics"), F.array_join("g.brands", "|").alias("brands"), "n", v.without_annotation(F.get("g.generics", F.lit(0))).alias("bare"))


@query("""
with w as (select conv_id, turn, regexp_extract_all(text, '[A-Za-z]+') w from conversations), x as (select *, lower(w[1]) || '-' || upper(w[2]) || ' ' || upper(w[3]) r, w[1] || ' ' || w[2] || ' ' || lower(w[3]) || ' ' || w[4] || '-abcd' n from w where len(w) >= 4)
select conv_id, turn, replace(lower(r), '-', ' ') spaced, lower(r) hyphenated,
  lower(w[1]) || '-' || case when length(w[2]) >= 2 then upper(w[2][1]) || lower(substr(w[2], 2)) else upper(w[2]) end || ' ' || case when length(w[3]) >= 2 then upper(w[3][1]) || lower(substr(w[3], 2)) else upper(w[3]) end titled,
  array_to_string(list_concat([lower(w[1]), lower(w[2]), lower(w[3])], list_filter([lower(w[3]), lower(w[4])], lambda x: not list_contains([lower(w[1]), lower(w[2]), lower(w[3])], x))), ' ') alias_text from x""")
def spoken_aliases(t: Tables) -> DataFrame:
    """Ways to hand a respelling to a voice."""
    w = F.col("w")
    rows = t.conversations.select("conv_id", "turn", F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)).alias("w")).where(F.size("w") >= 4)
    respelling = F.concat(F.lower(w[0]), F.lit("-"), F.upper(w[1]), F.lit(" "), F.upper(w[2]))
    name = F.concat_ws(" ", w[0], w[1], F.lower(w[2]), F.concat(w[3], F.lit("-abcd")))
    forms = v.spoken_forms(respelling)
    return rows.select("conv_id", "turn", forms["spaced"].alias("spaced"), forms["hyphenated"].alias("hyphenated"), v.capital_titled(respelling).alias("titled"), v.spoken_alias(respelling, name).alias("alias_text"))


@query(r"""
with p as (select conv_id, turn, regexp_extract_all(text, '\S+|\s+') ps from conversations), e as (select conv_id, turn, i, ps[i] word, coalesce(list_sum(list_transform(ps[1:i - 1], lambda x: length(x))), 0)::int s from p, unnest(range(1, len(ps) + 1)) u(i))
select conv_id, turn, s as start, s + length(word)::int as "end", word from e where regexp_matches(word, '^\S')""")
def word_places(t: Tables) -> DataFrame:
    """Every word of each turn with its place."""
    rows = t.conversations.select("conv_id", "turn", F.explode(v.word_offsets(F.col("text"))).alias("x"))
    return rows.select("conv_id", "turn", F.col("x.start").alias("start"), F.col("x.end").alias("end"), F.col("x.word").alias("word"))


@query(r"""
with w as (select conv_id, turn, string_split(text, ' ') ws from conversations), x as (select *, lower(ws[2] || ' ' || ws[3]) name from w where len(ws) >= 3 and ws[2] <> '' and ws[3] <> '' and not regexp_matches(ws[2] || ws[3], '\s')),
y as (select *, list_position(list_transform(range(1, len(ws)), lambda i: lower(ws[i] || ' ' || ws[i + 1])), name) found from x)
select conv_id, turn, array_to_string(list_transform(ws, lambda x, i: case when i = found then '#' when i = found + 1 then '' else x end), ' ') replaced from y""")
def replaced_runs(t: Tables) -> DataFrame:
    """The first run of tokens that spells a name of two words, replaced."""
    ws = F.split("text", " ")
    rows = t.conversations.select("conv_id", "turn", ws.alias("ws")).where((F.size("ws") >= 3) & (F.get("ws", F.lit(1)) != "") & (F.get("ws", F.lit(2)) != "") & ~F.concat(F.get("ws", F.lit(1)), F.get("ws", F.lit(2))).rlike(r"\s"))
    name = F.concat_ws(" ", F.col("ws")[1], F.col("ws")[2])
    return rows.select("conv_id", "turn", F.array_join(v.replaced_run(F.col("ws"), name, F.lit("#")), " ").alias("replaced"))


@query("""
with w as (select conv_id, turn, regexp_extract_all(text, '[A-Za-z]+') w from conversations), x as (select conv_id, turn, w[1] a, w[2] b, w[3] c, w[4] d, w[5] e from w where len(w) >= 5 and conv_id % 2 = 0),
y as (select conv_id, turn, w[1] a, w[2] b, w[3] c, w[4] d, w[5] e from w where len(w) >= 5 and conv_id % 2 = 1)
select conv_id, turn, a || ' ' || b first_group, a || ' ' || b || '  ' || c || ' ' || d || ' ' || e kept from x
union all select conv_id, turn, null, a || ' ' || b || ' ' || c || ' ' || d || ' ' || e from y""")
def gap_boundaries(t: Tables) -> DataFrame:
    """Syllables whose widest gap tells where a word ends; even gaps tell nothing."""
    w = F.col("w")
    rows = t.conversations.select("conv_id", "turn", F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)).alias("w")).where(F.size("w") >= 5)
    raw = F.concat(w[0], F.lit(" "), w[1], F.when(F.col("conv_id") % 2 == 0, "   ").otherwise(" "), w[2], F.lit(" "), w[3], F.lit(" "), w[4])
    return rows.select("conv_id", "turn", v.first_word_group(raw).alias("first_group"), v.squeezed_words(raw, F.lit("one two")).alias("kept"))


@query("""
with e as (select event_id, user_id, event_type, (value - floor(value)) a, (value * 7 - floor(value * 7)) b, case when event_id % 3 > 0 then value * 3 - floor(value * 3) end c, value / 10 ratio from events where value is not null)
select event_id, case when a >= 0.7 then 'agree' when b >= 0.75 and (ratio >= 1.8 or c is null or c < 0.75) then 'hyphen_artifact' when c >= 0.75 then 'ipa_suspect' when b < 0.7 then 'split' else 'ipa_suspect' end bucket,
  coalesce(a < 0.70 or b - 0.5 < -0.03 or (user_id % 5 = 0 and a < 0.72), false) is_open, coalesce(c, b) best_score,
  case event_type when 'click' then 'full' else 'component' end coverage,
  concat_ws(',', case when event_type = 'view' then 'multiword' end, case when event_type = 'error' and 10 * a > 0 and 10 * b > 1.4 * (10 * a) then 'suffix_gap' end) flags,
  case when event_id % 2 = 0 then 'LINEAR16' else 'MP3' end encoding, case when event_id % 2 = 0 then 16000 else 8000 end rate, case when event_id % 4 = 0 then 2 end channels,
  event_type || case when user_id % 2 = 0 then '/combination' else '' end stratum
from e""")
def event_verdicts(t: Tables) -> DataFrame:
    """Buckets, open gaps, first scores, coverage, caveats, encodings and strata of scored rows."""
    part = lambda k: F.col("value") * k - F.floor(F.col("value") * k)
    e = t.events.where("value is not null").select("event_id", "user_id", "event_type", part(1).alias("a"), part(7).alias("b"), F.when(F.col("event_id") % 3 > 0, part(3)).alias("c"), (F.col("value") / 10).alias("ratio"))
    kind = F.col("event_type")
    name = F.when(kind == "view", "a b").when(kind == "error", "a-b").otherwise("a")
    clip = v.clip_encoding(F.when(F.col("event_id") % 2 == 0, "wav").otherwise("mp3"), F.lit(8000), F.lit(16000), F.when(F.col("event_id") % 4 == 0, 2).otherwise(1))
    return e.select(
        "event_id",
        v.divergence_bucket(F.col("a"), F.col("b"), F.col("c"), F.col("ratio")).alias("bucket"),
        v.open_gap(F.col("a"), F.col("b") - 0.5, F.col("user_id") % 5 == 0).alias("is_open"),
        F.coalesce("c", "b").alias("best_score"),
        v.coverage_class(F.upper(kind), F.lit("Click")).alias("coverage"),
        F.array_join(v.caveats(name, 10 * F.col("b"), 10 * F.col("a")), ",").alias("flags"),
        clip["encoding"].alias("encoding"),
        clip["rate"].alias("rate"),
        clip["channels"].alias("channels"),
        F.concat(kind, F.when(F.col("user_id") % 2 == 0, "/combination").otherwise("")).alias("stratum"),
    )


@query("""
select doc_id, regexp_matches(text, '(?i)was not (?:\\w+\\s+){0,2}found|not found in the search|no direct pronunciation|highly probable|would likely be|is likely (?:to be|pronounced)|probably (?:pronounced|follows)|could not find|couldn''t find|unable to find|does not appear to have|no specific pronunciation|i couldn''t find|was not available|not available within|did not list|was not (?:\\w+\\s+){0,2}available') guess,
 regexp_matches('It was not ' || lang || ' found', '(?i)was not (?:\\w+\\s+){0,2}found') told from documents""".replace("\\\\", "\\"))
def guessing_texts(t: Tables) -> DataFrame:
    """Texts that say that they found nothing or guess."""
    return t.documents.select("doc_id", v.speculative_answer(F.col("text")).alias("guess"), v.speculative_answer(F.concat(F.lit("It was not "), "lang", F.lit(" found"))).alias("told"))


@query("""
with p as (select distinct p_name from part), c as (select p_name target, unnest([p_name, upper(p_name) || '  extra', replace(p_name, ' ', '-') || '_salt', p_name || 's', 'x ' || p_name]) candidate from p)
select target, candidate, regexp_replace(lower(trim(candidate)), '[\\s_-]+', ' ', 'g') = target or starts_with(regexp_replace(lower(trim(candidate)), '[\\s_-]+', ' ', 'g'), target || ' ') is_form from c""".replace("\\\\", "\\"))
def salt_forms(t: Tables) -> DataFrame:
    """Candidates that are the target, or the target and then more words."""
    n = F.col("target")
    forms = F.array(n, F.concat(F.upper(n), F.lit("  extra")), F.concat(F.replace(n, F.lit(" "), F.lit("-")), F.lit("_salt")), F.concat(n, F.lit("s")), F.concat(F.lit("x "), n))
    rows = t.part.select(F.col("p_name").alias("target")).distinct().select("target", F.explode(forms).alias("candidate"))
    return rows.withColumn("is_form", v.is_salt_form(F.col("target"), F.col("candidate")))


@query(f"""
with {WORDS}, x as (select word, reverse(word) g, case when length(word) % 7 = 0 then 'n/a' else 'ˈ' || {_sounds("word")} || '..' end ipa, case when length(word) % 5 = 0 then 'https://howtopronounce.com/' || word when length(word) % 5 = 1 then 'https://x.org/' || reverse(word) else 'https://x.org/a' end url from words),
y as (select *, {_sounds("word")} a, {_sounds("g")} b, contains(regexp_replace(lower(ipa || url), '[^a-z0-9]+', '', 'g'), g) named, contains('howtopronouncecomx' || word, 'pronounce') p from x),
z as (select *, levenshtein(translate(a, '{SOUNDS}', '{PLAIN}'), translate(b, '{SOUNDS}', '{PLAIN}')) / length(word) <= 0.35 near from y)
select word, case when ipa = 'n/a' then 'no_ipa' else concat_ws(' ', 'not_ipa_glyphs', case when contains(url, 'howtopronounce') and not contains(word, 'pronounce') then 'url_other:pronounce' end,
  case when near then 'ipa_matches_generic:' || g end, case when named and not near then 'citation_generic:' || g end, case when length(word) % 5 = 0 then 'howtopronounce' end,
  case when length(word) % 2 = 0 and contains(a, 'mæb') and not contains(word, 'mab') then 'mab_ipa_on_non_mab_brand' end) end flags from z""".replace(f"levenshtein(translate(a, '{SOUNDS}', '{PLAIN}'), translate(b, '{SOUNDS}', '{PLAIN}'))", "levenshtein(replace(replace(word, 'q', 'k'), 'c', 'k'), replace(replace(g, 'q', 'k'), 'c', 'k'))"))
def mixup_flags(t: Tables) -> DataFrame:
    """Signs that a word's phonetic text belongs to another."""
    w, n = F.col("word"), F.length("word")
    ipa = F.when(n % 7 == 0, "n/a").otherwise(F.concat(F.lit("ˈ"), sounds(w), F.lit("..")))
    url = F.when(n % 5 == 0, F.concat(F.lit("https://howtopronounce.com/"), w)).when(n % 5 == 1, F.concat(F.lit("https://x.org/"), F.reverse(w))).otherwise("https://x.org/a")
    flags = v.mixup_flags(w, ipa, url, F.array(F.lit("pronounce"), F.lit("org")), F.reverse(w), sounds(F.reverse(w)), n % 2 == 0)
    return vocabulary(t).select("word", F.array_join(flags, " ").alias("flags"))


@query("""
with n as (select distinct p_name k, case when length(p_name) % 2 = 0 then string_split(p_name, ' ')[2] else '' end o from part)
select k as name, unnest(case when o = '' then [k || ' IPA transcription', '"' || k || '" IPA', k || ' brand name IPA', k || ' dictionary IPA'] else [k || ' IPA transcription', '"' || k || '" IPA', k || ' brand name IPA', k || ' dictionary IPA', k || ' IPA -' || o, 'saying ' || k || ' and not ' || o || ', IPA'] end) query from n""")
def query_variants(t: Tables) -> DataFrame:
    """Search texts for every name."""
    names = t.part.select(F.col("p_name").alias("name")).distinct()
    other = F.when(F.length("name") % 2 == 0, F.split("name", " ")[1]).otherwise("")
    return names.select("name", F.explode(v.query_variants(F.col("name"), other)).alias("query"))


@query("""
select n_nationkey, '<speak>A &amp; &quot;' || '<phoneme alphabet="ipa" ph="ˈx&quot;">' || n_name || '</phoneme>' || '&quot; &lt; b</speak>' markup from nation""")
def speech_markups(t: Tables) -> DataFrame:
    """Sentences as speech markup with the name's phonetic text."""
    sentence = F.concat(F.lit('A & "'), "n_name", F.lit('" < b'))
    return t.nation.select("n_nationkey", v.speech_markup(sentence, F.lower("n_name"), F.lit('ˈx"')).alias("markup"))


@query("""
with s as (select lang || '/' || case when n_chars >= 1000 then 'long' else 'short' end stratum, doc_id % 5 = 0 combo from documents)
select stratum, count(*) n, count(*) filter (combo) combos from s group by 1 union all select '*', count(*), count(*) filter (combo) from s""")
def sample_summary(t: Tables) -> DataFrame:
    """A sample's rows by stratum, and how many are of a special kind."""
    rows = t.documents.select(F.concat("lang", F.when(F.col("n_chars") >= 1000, "/long").otherwise("/short")).alias("stratum"), (F.col("doc_id") % 5 == 0).alias("combo"))
    g = rows.rollup("stratum").agg(F.count(F.lit(1)).alias("n"), F.count_if("combo").alias("combos"))
    return g.select(F.coalesce("stratum", F.lit("*")).alias("stratum"), "n", "combos")


@query("""
with b as (select p_brand, string_agg(distinct p_name, '; ' order by p_name) || ' (and many more)' head from part group by 1), m as (select distinct p_brand, p_name component from part),
i as (select distinct p_name || case when length(p_name) % 2 = 0 then ' salt' else '' end ingredient from part)
select p_brand, component, ingredient from m join i on ingredient = component or starts_with(ingredient, component || ' ')""")
def headed_ingredients(t: Tables) -> DataFrame:
    """Members of headings with every ingredient that they name, exactly or as its first words."""
    from lodestone.operators.resolve import prefix_join

    heads = t.part.groupBy("p_brand").agg(F.concat(F.array_join(F.array_sort(F.collect_set("p_name")), "; "), F.lit(" (and many more)")).alias("head"))
    members = heads.select("p_brand", F.explode(v.list_members(F.col("head"))).alias("component")).withColumn("component", v.without_annotation(F.col("component")))
    names = t.part.select(F.concat("p_name", F.when(F.length("p_name") % 2 == 0, " salt").otherwise("")).alias("ingredient")).distinct()
    return prefix_join(names, members, "ingredient", "component").select("p_brand", "component", "ingredient")
