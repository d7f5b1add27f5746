"""Whether a transcription, page or citation can stand for a name: column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIMARY = "ˈ"
# What marks published phonetic text, its vowels and its consonants.
IPA_MARKS = "ɪʊɛæɑɒɔʌəɚɝʃʒθðŋɡːˈˌɹɐɨᵻ"
IPA_VOWELS = "iɪeɛæaɑɒɔoʊuʌəɚɝɨᵻyɐ"
IPA_CONSONANTS = "bdfghjklmnpqrstvwxyzʃʒθðŋɡɹɾ"
LENIENT_MARKS = "ɪʊɛæɑɒɔʌəɚɝʃʒθðŋɡːˈˌ"
# Answers that mean nothing was found, and phrases of an answer that guesses.
NO_ANSWER = ["", "n/a", "none", "null", "unknown"]
GUESSES = (
    r"(?i)was not (?:\w+\s+){0,2}found|not found in the search|no direct pronunciation|highly probable|would likely be|"
    r"is likely (?:to be|pronounced)|probably (?:pronounced|follows)|could not find|couldn't find|unable to find|"
    r"does not appear to have|no specific pronunciation|i couldn't find|was not available|not available within|did not list|"
    r"was not (?:\w+\s+){0,2}available"
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


# Names against variants (symbols: spaced phonetic letters with stress digits; shown: phonetic text).


def expected_syllables(name: Column) -> Column:
    """Vowel groups of every word, a word's four-letter hyphen code left out; one at least for each word."""
    words = F.filter(F.split(F.lower(F.trim(name)), r"\s+"), lambda w: w != "")
    each = F.transform(words, lambda w: F.greatest(F.lit(1), F.regexp_count(F.regexp_replace(w, "-[a-z]{4}$", ""), F.lit("[aeiouy]+"))))
    return F.greatest(F.lit(1), F.aggregate(each, F.lit(0), lambda a, n: a + n))


def spoken_syllables(symbols: Column) -> Column:
    """Symbols with a stress digit, which only vowels carry."""
    return F.size(F.filter(F.split(symbols, " "), lambda s: s.rlike("[0-2]$")))


def is_fragment(name: Column, symbols: Column, share: float = 0.6) -> Column:
    """The variant has fewer syllables than that share of what the name's spelling suggests."""
    return spoken_syllables(symbols) < expected_syllables(name) * F.lit(share)


def is_fused(shown: Column) -> Column:
    """Some space-delimited word has two primary stresses, so two words were run together."""
    return F.exists(F.split(shown, " "), lambda w: F.length(w) - F.length(F.replace(w, F.lit(PRIMARY), F.lit(""))) > 1)


def covers_name(name: Column, variants: Column, share: float = 0.75) -> Column:
    """A name of several words is covered if some variant has that share of its syllables."""
    enough = F.exists(variants, lambda v: spoken_syllables(v["symbols"]) >= expected_syllables(name) * F.lit(share))
    return ~F.contains(name, F.lit(" ")) | enough


def usable_variants(name: Column, variants: Column) -> Column:
    """Variants (structs of symbols and shown) that are neither fragments nor fused."""
    return F.filter(variants, lambda v: ~is_fragment(name, v["symbols"]) & ~is_fused(v["shown"]))


def coverage_class(query: Column, name: Column) -> Column:
    """full if the query is the whole name, else component."""
    return F.when(F.lower(query) == F.lower(name), "full").otherwise("component")


# Phonetic text.


def bare(text: Column) -> Column:
    """Without slashes, brackets and blanks at its edges."""
    return F.btrim(F.trim(text), F.lit("/[]() "))


def unwrapped(text: Column) -> Column:
    """:func:`bare`, an apostrophe as the primary mark; answers that mean nothing are empty."""
    marked = F.replace(F.replace(bare(text), F.lit("'"), F.lit(PRIMARY)), F.lit(PRIMARY * 2), F.lit(PRIMARY))
    return F.when(F.lower(F.trim(F.coalesce(text, F.lit("")))).isin(*NO_ANSWER), "").otherwise(marked)


def stripped(text: Column) -> Column:
    """:func:`unwrapped` without syllable dots and white space."""
    return F.translate(unwrapped(text), ". \t\n\x0b\f\r", "")


def folded(text: Column) -> Column:
    """Sounds alone, to compare two transcriptions: no stress, length, dots, blanks or brackets."""
    return F.translate(F.lower(stripped(text)), "ɹɡˈˌː. /[]()-", "rg")


def same_with_stress(a: Column, b: Column) -> Column:
    """Equal sounds and equal stress, whatever the dots, blanks and letters for r and g."""
    form = lambda c: F.translate(bare(F.coalesce(c, F.lit(""))), "ɹɡ. ", "rg")
    return F.coalesce(F.nullif(form(a), F.lit("")) == form(b), F.lit(False))


def plain_phonemes(text: Column) -> Column:
    """Without stress and blanks, with one letter for r, before sounds are compared."""
    return F.translate(text, "rˈˌ ", "ɹ")


def source_ipa(text: Column) -> Column:
    """Published phonetic text of a whole word; respellings, fragments and misplaced stress are not."""
    v, c = IPA_VOWELS, IPA_CONSONANTS

    def judged(b: Column, t: Column) -> Column:
        syllables = F.filter(F.split(F.translate(t, "ˈˌ", ""), "[. ]+"), lambda s: s != "")
        spoken = F.forall(syllables, lambda s: s.rlike(f"^(?:[^{v}]{{0,2}}|[sʃ][^{v}]*)[{v}]"))
        return (
            (t != "")
            & ~b.rlike(r'[āēīōüăěŏ"“”–-]|\.\.|[A-Z]{2}')
            & t.rlike(f"[{IPA_MARKS}]")
            & ~t.rlike(r"[ʝχβɲʎɣʔɓɗ\x{0300}-\x{036F}]")
            & t.rlike(f"[{v}][^{v}]+[{v}]")
            & ~t.rlike(f"(?:^|[^{v}])[{c}][ˈˌ][{v}]")
            & spoken
        )

    return _let(bare(F.coalesce(text, F.lit(""))), lambda b: _let(F.lower(b), lambda t: judged(b, t)))


def lenient_ipa(text: Column) -> Column:
    """The older test: a phonetic letter, or one run of plain letters with a vowel."""
    marked = text.rlike(f"[{LENIENT_MARKS}]")
    quoted = text.rlike("[A-Za-z]{3,}.*['\"]")
    return F.when(marked, True).when((text == "") | quoted | text.rlike("[- ]"), False).otherwise(text.rlike("(?i)[aeiouyæ]"))


def speculative_answer(text: Column) -> Column:
    """The answer says that it found nothing or guesses."""
    return text.rlike(GUESSES)


def dominated_pruned(items: Column, most: int = 3) -> Column:
    """Distinct phonetic texts in order, those inside a longer one left out, the first few kept."""
    key = lambda x: F.regexp_replace(x, "[. ]", "")
    keys = F.transform(items, lambda x: key(x))
    first = F.filter(items, lambda x, i: F.array_position(keys, key(x)) == i + 1)
    longer = lambda x: F.exists(keys, lambda k: (F.length(k) > F.length(key(x))) & F.contains(k, key(x)))
    return F.slice(F.filter(first, lambda x: ~longer(x)), 1, most)


def engine_alphabet(text: Column, rewrites: list[tuple[str, str]], letters: str) -> Column:
    """Ordered rewrites of phonetic text into an engine's alphabet; a letter outside it is an error."""
    out = F.regexp_replace(F.replace(F.regexp_replace(F.trim(text), r"^[/\[\]]+|[/\[\]]+$", ""), F.lit("'"), F.lit(PRIMARY)), r"\.", "")
    for old, new in rewrites:
        out = F.replace(out, F.lit(old), F.lit(new))
    out = F.replace(F.translate(out, "rg", "ɹɡ"), F.lit(" "), F.lit(""))
    bad = F.translate(out, letters, "")
    return F.when(bad == "", out).otherwise(F.raise_error(F.concat(F.lit("not in the alphabet: "), bad)))


# Pages, labels and lists.

WORD_HOSTS = ("wikipedia.org", "wiktionary.org")  # fixed values: hosts whose pages are about one word


def squeezed(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def page_is_for(word: Column, url: Column) -> Column:
    """An encyclopedia's page must have the word in its title; other pages are taken. No page is no objection."""
    path = F.lower(F.try_url_decode(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))))
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    title = squeezed(F.substring_index(path, "/wiki/", -1))
    about_words = F.contains(host, F.lit(WORD_HOSTS[0])) | F.contains(host, F.lit(WORD_HOSTS[1]))
    found = F.contains(path, F.lit("/wiki/")) & F.contains(title, squeezed(word))
    return F.when(F.coalesce(url, F.lit("")) == "", True).when(squeezed(word) == "", False).when(about_words, found).otherwise(True)


def names_in(text: Column, names: Column, own: Column, least: int = 6) -> Column:
    """Of a row's own short list of names those, squeezed, that a squeezed text contains though the own name does
    not. Names of any number are looked up by ``operators.containment``."""
    return F.filter(names, lambda n: (F.length(squeezed(n)) >= least) & F.contains(squeezed(text), squeezed(n)) & ~F.contains(squeezed(own), squeezed(n)))


def list_members(text: Column) -> Column:
    """Members of 'a; b; c (and many more)': the note dropped, blanks trimmed, empty ones left out."""
    parts = F.split(F.regexp_replace(text, r"(?i)\s*\((?:and\s+)?many more\)\s*$", ""), ";")
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def without_annotation(name: Column) -> Column:
    """Without one trailing parenthesis: 'x (inhaled)' is 'x'."""
    return F.trim(F.regexp_replace(name, r"\s*\([^)]*\)\s*$", ""))


def headword(text: Column) -> Column:
    """Lower case, without the number that tells equal headwords apart."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r":\d+$", "")))


def label_groups(label: Column) -> Column:
    """struct<generics, brands>: the last balanced parenthesis holds the brands, what is before it the others.

    Depth is counted from the end: the group opens at the last place where as many parentheses have
    opened as closed from there on.
    """
    text = F.trim(label)
    letters = F.reverse(F.split(text, ""))
    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("seen"), F.lit(0).alias("at"))

    def step(a: Column, ch: Column) -> Column:
        depth = a["depth"] + F.when(ch == ")", 1).when(ch == "(", -1).otherwise(0)
        seen = a["seen"] + F.length(ch)
        return F.struct(depth.alias("depth"), seen.alias("seen"), F.when((a["at"] == 0) & (ch == "(") & (depth == 0), seen).otherwise(a["at"]).alias("at"))

    def cut(at: Column) -> Column:
        head, inner = F.left(text, F.length(text) - at), F.substr(text, F.length(text) - at + 2, at - 2)
        whole = F.struct(list_members(text).alias("generics"), F.array().cast("array<string>").alias("brands"))
        return F.when(text.endswith(")") & (at > 0), F.struct(list_members(head).alias("generics"), list_members(inner).alias("brands"))).otherwise(whole)

    return _let(F.aggregate(letters, zero, step)["at"], cut)


def is_salt_form(target: Column, candidate: Column) -> Column:
    """The candidate is the target, or the target and then more words; separators count as blanks."""
    form = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"[\s_-]+", " ")
    return (form(candidate) == form(target)) | form(candidate).startswith(F.concat(form(target), F.lit(" ")))


def spoken_alias(respelling: Column, name: Column) -> Column:
    """Syllables of a respelling parted by blanks, then the words of the name beyond the respelled ones,
    without four-letter codes and those that are said already."""
    said = F.filter(F.split(F.lower(respelling), r"[-·•\s]+"), lambda s: s != "")
    words = F.filter(F.split(name, r"\s+"), lambda w: w != "")
    n = F.size(F.filter(F.split(F.trim(respelling), r"\s+"), lambda s: s != ""))
    rest = F.transform(F.slice(words, n + 1, F.greatest(F.size(words) - n, F.lit(0))), lambda w: F.lower(F.regexp_replace(w, "-[a-z]{4}$", "")))
    return F.array_join(F.concat(said, F.filter(rest, lambda w: ~F.array_contains(said, w))), " ")


def spoken_forms(respelling: Column) -> Column:
    """struct<spaced, hyphenated>: the two ways to hand a respelling to a voice."""
    return F.struct(F.lower(F.replace(respelling, F.lit("-"), F.lit(" "))).alias("spaced"), F.lower(respelling).alias("hyphenated"))


def capital_titled(respelling: Column) -> Column:
    """Each run of two capitals or more with its first letter alone in capitals."""
    runs = F.regexp_extract_all(respelling, F.lit("[A-Z]{2,}|[^A-Z]+|[A-Z]"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^[A-Z]{2,}$"), F.concat(F.left(r, F.lit(1)), F.lower(F.substr(r, F.lit(2))))).otherwise(r)), "")


def word_offsets(text: Column) -> Column:
    """array<struct<word, start, end>> of the runs without white space."""
    parts = F.regexp_extract_all(text, F.lit(r"\S+|\s+"), F.lit(0))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<word:string,start:int,end:int>>").alias("out"))

    def step(a: Column, p: Column) -> Column:
        end = (a["at"] + F.length(p)).cast("int")
        one = F.array(F.struct(p.alias("word"), a["at"].alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(p.rlike(r"^\S"), F.concat(a["out"], one)).otherwise(a["out"]).alias("out"))

    return F.aggregate(parts, zero, step)["out"]


def replaced_run(tokens: Column, name: Column, value: Column) -> Column:
    """Tokens with the first run that spells the name, case aside, replaced: its first token by the value,
    the others by ''. No such run is an error."""
    want = F.split(F.lower(name), r"\s+")
    n = F.size(want)
    lower = F.transform(tokens, lambda t: F.lower(t))
    at = F.array_position(F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(1))), lambda i: F.slice(lower, i, n) == want), F.lit(True))

    def put(a: Column) -> Column:
        new = F.transform(tokens, lambda t, i: F.when(i + 1 == a, value).when((i + 1 > a) & (i + 1 < a + n), "").otherwise(t))
        return F.when(a > 0, new).otherwise(F.raise_error(F.concat(F.lit("not among the tokens: "), name)).cast("array<string>"))

    return _let(at, put)


def wide_gaps(raw: Column) -> Column:
    """struct<parts, at>: words between blanks and the gaps (from 1) wider than the commonest width.

    Of widths that are equally common the one met first counts. No gap is wide if all are equal.
    """
    parts = F.split(F.trim(raw), " +")
    gaps = F.transform(F.regexp_extract_all(F.trim(raw), F.lit(" +"), F.lit(0)), lambda g: F.length(g))
    counted = lambda g: F.transform(g, lambda x, i: F.struct(F.size(F.filter(g, lambda y: y == x)).alias("n"), (-i).alias("first"), x.alias("w")))

    def wide(g: Column) -> Column:
        mode = F.array_max(counted(g))["w"]
        return F.filter(F.transform(g, lambda x, i: F.when(x > mode, i + 1)), lambda i: i.isNotNull())

    return F.struct(parts.alias("parts"), _let(gaps, lambda g: F.when(F.size(g) > 0, wide(g)).otherwise(F.array().cast("array<int>"))).alias("at"))


def first_word_group(raw: Column) -> Column:
    """Syllables before the first wide gap; null if no gap is wide."""
    return _let(wide_gaps(raw), lambda x: F.when(F.size(x["at"]) > 0, F.array_join(F.slice(x["parts"], 1, x["at"][0]), " ")))


def word_groups(raw: Column, n_words: Column) -> Column:
    """Syllables cut at the wide gaps; null unless these make just so many words."""

    def cut(x: Column) -> Column:
        ends = F.concat(x["at"], F.array(F.size(x["parts"])))
        begin = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(ends, i - 1))
        groups = F.transform(ends, lambda e, i: F.array_join(F.slice(x["parts"], begin(i) + 1, e - begin(i)), " "))
        return F.when((n_words >= 2) & (F.size(x["at"]) == n_words - 1), groups)

    return _let(wide_gaps(raw), cut)


def squeezed_words(raw: Column, name: Column) -> Column:
    """Blanks squeezed to one, but to two between the words of a name of several words where they can be told."""
    n = F.size(F.filter(F.split(name, r"\s+"), lambda w: w != ""))
    return F.coalesce(F.array_join(word_groups(raw, n), "  "), F.trim(F.regexp_replace(raw, r"\s+", " ")))


# Verdicts.


def divergence_bucket(whole: Column, compact: Column, both: Column, ratio: Column, agree: float = 0.75, diverge: float = 0.70) -> Column:
    """agree, hyphen_artifact, ipa_suspect or split, from three similarities and a ratio of lengths."""
    compact_ok = F.coalesce(compact >= agree, F.lit(False))
    return (
        F.when(whole >= diverge, "agree")
        .when(compact_ok & ((ratio >= 1.8) | both.isNull() | (both < agree)), "hyphen_artifact")
        .when(both >= agree, "ipa_suspect")
        .when(compact < diverge, "split")
        .otherwise("ipa_suspect")
    )


def mixup_flags(name: Column, ipa: Column, url: Column, others: Column, generic: Column, generic_ipa: Column, brand: Column) -> Column:
    """Signs that phonetic text belongs to another name: none, not phonetic, another name in the address, like
    the generic's sound, the generic named beside it, a site of users' guesses, an antibody's ending."""
    flat = stripped(ipa)
    a, b = folded(ipa), folded(F.coalesce(generic_ipa, F.lit("")))
    near = (a != "") & (b != "") & (F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)) <= 0.35)
    near = F.coalesce(near, F.lit(False))
    named = F.coalesce((squeezed(generic) != "") & F.contains(squeezed(F.concat(ipa, url)), squeezed(generic)), F.lit(False))
    address = F.regexp_replace(url, "^https?://", "")
    found = names_in(address, others, name)
    flags = F.array(
        F.when(~source_ipa(ipa), "not_ipa_glyphs"),
        F.when(F.size(found) > 0, F.concat(F.lit("url_other:"), F.array_join(F.slice(found, 1, 3), ","))),
        F.when(near, F.concat(F.lit("ipa_matches_generic:"), generic)),
        F.when(named & ~near, F.concat(F.lit("citation_generic:"), generic)),
        F.when(F.contains(url, F.lit("howtopronounce.com")), "howtopronounce"),
        F.when(brand & flat.rlike("mæb|juːmæb|umab") & ~F.contains(F.lower(name), F.lit("mab")), "mab_ipa_on_non_mab_brand"),
    )
    return F.when(flat == "", F.array(F.lit("no_ipa"))).otherwise(F.array_compact(flags))


def query_variants(name: Column, other: Column) -> Column:
    """Search texts for a name; with a paired name some leave that one out."""
    say = lambda pattern: F.format_string(pattern, name)
    plain = F.array(say("%s IPA transcription"), say('"%s" IPA'), say("%s brand name IPA"), say("%s dictionary IPA"))
    apart = F.array(F.format_string("%s IPA -%s", name, other), F.format_string("saying %s and not %s, IPA", name, other))
    return F.when(F.coalesce(other, F.lit("")) == "", plain).otherwise(F.concat(plain, apart))


def speech_markup(sentence: Column, name: Column, ipa: Column) -> Column:
    """The sentence as speech markup with the name's phonetic text, all text escaped."""
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    at = F.instr(F.lower(sentence), F.lower(name))
    spoken = F.substr(sentence, at, F.length(name))
    tagged = F.format_string('<phoneme alphabet="ipa" ph="%s">%s</phoneme>', escape(ipa), escape(spoken))
    return F.when(at > 0, F.concat(F.lit("<speak>"), escape(F.left(sentence, at - 1)), tagged, escape(F.substr(sentence, at + F.length(name))), F.lit("</speak>")))


def open_gap(best: Column, delta: Column, holdout: Column) -> Column:
    """Worth another round: a low best score, a loss against the plain form, or a low score in the holdout."""
    return F.coalesce((best < 0.70) | (delta < -0.03) | (holdout & (best < 0.72)), F.lit(False)) & best.isNotNull()


def caveats(name: Column, heard: Column, wanted: Column) -> Column:
    """Flags of a distance between a name's heard and wanted phonemes (their numbers)."""
    many = F.when(F.contains(F.trim(name), F.lit(" ")), "multiword")
    suffix = F.when(F.contains(name, F.lit("-")) & (wanted > 0) & (heard > 1.4 * wanted), "suffix_gap")
    return F.array_compact(F.array(many, suffix))


def clip_encoding(kind: Column, manifest_rate: Column, header_rate: Column, channels: Column) -> Column:
    """struct<encoding, rate, channels>: a wav's header beats the manifest; channels only if several."""
    bad = F.raise_error(F.concat(F.lit("no such format: "), kind)).cast("struct<encoding:string,rate:int,channels:int>")
    wav = F.struct(F.lit("LINEAR16").alias("encoding"), header_rate.alias("rate"), F.when(channels > 1, channels).alias("channels"))
    mp3 = F.struct(F.lit("MP3").alias("encoding"), manifest_rate.alias("rate"), F.lit(None).cast("int").alias("channels"))
    return F.when(kind == "wav", wav).when(kind == "mp3", mp3).otherwise(bad)
