"""Between spellings, notations and sounds: letters to symbols, dictionary text to symbols, any notation to
the canonical respelling, templates of wiki text, and edits of phonetic text towards what was heard."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from . import notation as n
from . import respelling as r
from .text import greedy_tokens

_let = n._let

# What a letter or group of letters sounds like, tried in this order at each place of a word.
# A "~" stands for a last e that is silent. Rules of the last block don't repeat the symbol before them.
LETTER_RULES = [
    ("c(?=[eiy])", "S"),
    ("c(?![hk])", "K"),
    ("g(?=[eiy])", "JH"),
    ("g", "G"),
    ("ti(?=[ao])", "SH"),
    ("(?<=[aeiouy])s(?=[aeiouy])", "Z"),
    ("s", "S"),
    (r"ng\Z", "NG"),
    ("ai|ay|ei|ey", "EY"),
    ("ee|ea|ie", "IY"),
    ("oa|oe", "OW"),
    ("oo|ue|ui|eu|ew", "UW"),
    ("ou|ow", "AW"),
    ("oi|oy", "OY"),
    ("au|aw", "AO"),
    ("a(?=r)", "AA"),
    ("o(?=r)", "AO"),
    ("[eiuy]r", "ER"),
]
# Vowels before at most one consonant and a vowel, and elsewhere.
OPEN = {"a": "EY", "e": "IY", "i": "AY", "o": "OW", "u": "UW", "y": "AY"}
CLOSED = {"a": "AE", "e": "EH", "i": "IH", "o": "AA", "u": "AH", "y": "IH"}
# Consonants, longer groups first.
CONSONANT_RULES = [
    ("tch", "CH"), ("psy", "S AY"), ("ph", "F"), ("th", "TH"), ("ch", "K"), ("ck", "K"), ("qu", "K W"), ("wr", "R"), ("kn", "N"), ("x", "K S"),
    ("j", "JH"), ("z", "Z"), ("v", "V"), ("f", "F"), ("b", "B"), ("p", "P"), ("d", "D"), ("t", "T"), ("k", "K"), ("m", "M"), ("n", "N"), ("l", "L"), ("r", "R"), ("w", "W"), ("h", "HH"),
]
# Phonetic letters of the symbols.
SYMBOL_LETTERS = {
    "AA": "ɑ", "AE": "æ", "AH": "ə", "AO": "ɔ", "AW": "aʊ", "AY": "aɪ", "EH": "ɛ", "ER": "ɚ", "EY": "eɪ", "IH": "ɪ", "IY": "i", "OW": "oʊ", "OY": "ɔɪ", "UH": "ʊ", "UW": "u",
    "B": "b", "CH": "tʃ", "D": "d", "DH": "ð", "F": "f", "G": "ɡ", "HH": "h", "JH": "dʒ", "K": "k", "L": "l", "M": "m", "N": "n", "NG": "ŋ", "P": "p", "R": "ɹ", "S": "s", "SH": "ʃ",
    "T": "t", "TH": "θ", "V": "v", "W": "w", "Y": "j", "Z": "z", "ZH": "ʒ",
}
VOWEL_SYMBOLS = [s for s in SYMBOL_LETTERS if s[0] in "AEIOU"]

_EVERY = [*LETTER_RULES, *((f"{v}(?=[bcdfghjklmnpqrstvwxyz]?[aeiou])", s) for v, s in OPEN.items()), *CLOSED.items()]
_GROUPS = [s.split() for _, s in (*_EVERY, *CONSONANT_RULES)]
_LETTERS = re.compile("|".join(f"({p})" for p, _ in (*_EVERY, *CONSONANT_RULES)))


def _word_symbols(word: str) -> list[str]:
    out: list[str] = []
    for m in _LETTERS.finditer(re.sub("(?<=..[^aeiouy])e$", "~", word)):
        said = _GROUPS[m.lastindex - 1]
        if m.lastindex <= len(_EVERY) or said != out[-1:]:
            out += said
    return out


@F.pandas_udf(ArrayType(StringType()))
def letter_sounds(words: pd.Series) -> pd.Series:
    """Unstressed symbols of each spelled word; other characters than letters are skipped."""
    said = {w: _word_symbols(re.sub("[^a-z]", "", w.lower())) for w in words.dropna().unique()}
    return words.map(said)


# A filter on the symbols stays behind them: below a distinct it would sound every occurrence of every word.
letter_sounds = letter_sounds.asNondeterministic()


def stressed(symbols: Column, from_end: Column) -> Column:
    """Stress digits on the vowels: primary on the one that many from the end, or the first of fewer;
    secondary on the first of four or more."""
    nuclei = F.array_compact(F.transform(symbols, lambda s, i: F.when(s.isin(*VOWEL_SYMBOLS), i + 1)))

    def marked(ns: Column) -> Column:
        first = F.get(ns, F.greatest(F.size(ns) - from_end, F.lit(0)))
        second = F.when(F.size(ns) >= 4, F.get(ns, F.lit(0)))
        digit = lambda i: F.when((i + 1).eqNullSafe(first), "1").when((i + 1).eqNullSafe(second), "2").otherwise("0")
        return F.transform(symbols, lambda s, i: F.when(F.array_contains(ns, i + 1), F.concat(s, digit(i))).otherwise(s))

    return _let(nuclei, marked)


def spoken_variants(symbols: Column) -> Column:
    """Likely stresses of unstressed symbols, the likeliest first; nothing to say is one weak vowel."""
    syllables = F.size(F.filter(symbols, lambda s: s.isin(*VOWEL_SYMBOLS)))
    variants = F.array(
        stressed(symbols, F.when(syllables >= 3, 3).otherwise(syllables)), F.when(syllables >= 2, stressed(symbols, F.lit(2))), F.when(syllables >= 4, stressed(symbols, F.lit(4)))
    )
    return F.when(F.size(symbols) == 0, F.array(F.array(F.lit("AH0")))).otherwise(F.array_distinct(F.array_compact(variants)))


def shown(symbols: Column) -> Column:
    """Phonetic text of symbols, a stress mark before each stressed vowel."""
    table = n._table({s: F.lit(x) for s, x in SYMBOL_LETTERS.items()})
    mark = lambda s: F.when(s.endswith("1"), n.PRIMARY).when(s.endswith("2"), n.SECONDARY).otherwise("")
    return F.array_join(F.transform(symbols, lambda s: F.concat(mark(s), F.try_element_at(table, F.regexp_replace(s, "[0-2]$", "")))), "")


# A dictionary's letters, their symbols and how they are shown, longer ones first.
DICTIONARY_VOWELS = [
    ("au̇", "AW", "aʊ"), ("ȯi", "OY", "ɔɪ"), ("ər", "ER", "ər"), ("ā", "EY", "eɪ"), ("ē", "IY", "iː"), ("ī", "AY", "aɪ"), ("ō", "OW", "oʊ"), ("ü", "UW", "uː"), ("u̇", "UH", "ʊ"),
    ("ȯ", "AO", "ɔ"), ("ä", "AA", "ɑ"), ("ə", "AH", "ə"), ("ᵊ", "AH", "ə"), ("a", "AE", "æ"), ("e", "EH", "ɛ"), ("i", "IH", "ɪ"), ("o", "AA", "ɑ"), ("u", "AH", "ʌ"),
]
DICTIONARY_CONSONANTS = [
    ("th̸", "DH", "ð"), ("ch", "CH", "tʃ"), ("sh", "SH", "ʃ"), ("zh", "ZH", "ʒ"), ("th", "TH", "θ"), ("ng", "NG", "ŋ"), ("ŋ", "NG", "ŋ"), ("j", "JH", "dʒ"), ("y", "Y", "j"), ("k", "K", "k"),
    ("g", "G", "ɡ"), ("p", "P", "p"), ("b", "B", "b"), ("t", "T", "t"), ("d", "D", "d"), ("m", "M", "m"), ("n", "N", "n"), ("l", "L", "l"), ("r", "R", "r"), ("s", "S", "s"), ("z", "Z", "z"),
    ("f", "F", "f"), ("v", "V", "v"), ("w", "W", "w"), ("h", "HH", "h"),
]


def dictionary_phonemes(raw: Column) -> Column:
    """array<struct<symbols, shown>>: each alternate of a dictionary's text, those without sounds left out.

    A syllable's mark stresses its first vowel. Without a primary mark the first syllable with a vowel gets
    it, in place of a secondary one. An optional mark, in parentheses, is none. Composed Unicode is taken.
    """
    rows = [*DICTIONARY_VOWELS, *DICTIONARY_CONSONANTS]
    symbol, letters = n._table({g: F.lit(s) for g, s, _ in rows}), n._table({g: F.lit(x) for g, _, x in rows})
    vowels = [g for g, *_ in DICTIONARY_VOWELS]
    pattern = F.lit("|".join(g for g, *_ in rows))

    def syllable(x: Column) -> Column:
        stress = F.when(x.startswith(n.PRIMARY), "1").when(x.startswith(n.SECONDARY), "2").otherwise("0")
        return F.struct(stress.alias("stress"), F.regexp_extract_all(x, pattern, F.lit(0)).alias("ts"))

    def written(text: Column) -> Column:
        clean = F.translate(F.regexp_replace(text, r"\([ˈˌ]\)", ""), "()’'`· ", "")
        parts = F.filter(F.transform(F.split(clean, "-"), syllable), lambda p: F.size(p["ts"]) > 0)
        return _let(parts, joined)

    def joined(parts: Column) -> Column:
        voiced = F.array_position(F.transform(parts, lambda p: F.exists(p["ts"], lambda t: t.isin(*vowels))), F.lit(True))
        primary = F.exists(parts, lambda p: p["stress"] == "1")
        level = lambda p, i: F.when(~primary & (i + 1 == voiced), "1").otherwise(p["stress"])
        first = lambda p: F.array_position(F.transform(p["ts"], lambda t: t.isin(*vowels)), F.lit(True))
        one = lambda p, i: F.transform(p["ts"], lambda t, j: F.concat(F.try_element_at(symbol, t), F.when(~t.isin(*vowels), "").when(j + 1 == first(p), level(p, i)).otherwise("0")))
        mark = lambda p, i: F.when(level(p, i) == "1", n.PRIMARY).when(level(p, i) == "2", n.SECONDARY).otherwise("")
        text = F.transform(parts, lambda p, i: F.concat(mark(p, i), F.array_join(F.transform(p["ts"], lambda t: F.try_element_at(letters, t)), "")))
        return F.when(F.size(parts) > 0, F.struct(F.array_join(F.flatten(F.transform(parts, one)), " ").alias("symbols"), F.array_join(text, "").alias("shown")))

    return F.array_compact(F.transform(n.expand_alternates(raw), written))


def listed_variants(raw: Column) -> Column:
    """array<struct<symbols, shown>> of phonetic text with alternates by commas and "_" for blanks.

    Shortened alternates (a hyphen at an end) and those with a word without sounds are left out.
    """
    each = F.transform(F.split(raw, ","), lambda a: F.trim(F.translate(a, "_", " ")))
    whole = F.filter(each, lambda a: (a != "") & ~a.startswith("-") & ~a.endswith("-"))
    words = lambda a: F.transform(F.filter(F.split(a, " +"), lambda w: w != ""), n.phonemes)
    join = lambda ws, field: F.array_join(F.transform(ws, lambda w: w[field]), " ")
    one = lambda ws: F.when(~F.exists(ws, lambda w: w.isNull()), F.struct(join(ws, "symbols").alias("symbols"), join(ws, "shown").alias("shown")))
    return F.array_compact(F.transform(whole, lambda a: _let(words(a), one)))


# Sources that give phonetic text, letters that only phonetic text has, marks of a dictionary.
PHONETIC_SOURCES = ["wikipedia", "wiktionary", "cmudict"]
PHONETIC_ONLY = "[ɪʊɛæɑɒɔʌʃʒθðɡɹːᵻ]"
DICTIONARY_MARKS = "[āēīōüäȯəᵊˈˌ]|u̇"
_PRIME = f"[{r.PRIMES}{r.DOUBLE_PRIMES}]"


def canonical(raw: Column, source: Column) -> Column:
    """struct<respelling, inferred> of a citation in any of three notations; null where it is none.

    A dictionary's letters, syllables with stress marks behind them, or hyphenated and spaced syllables with
    one in capitals. Words are parted by two blanks or more. ``inferred`` says that no stress was marked and
    the first syllable got it. Phonetic text is not turned into a respelling.
    """
    text = F.regexp_replace(F.trim(raw), r"^[()\[\]]+|[()\[\]]+$", "")

    def word(w: Column) -> Column:
        plain = F.regexp_replace(F.translate(w, "–—", "--"), "(?i)^(?:pronounced|pronunciation)\\s+", "")
        spaced = F.filter(F.split(F.regexp_replace(F.replace(plain, F.lit("-"), F.lit(" ")), f"({_PRIME})(?=[A-Za-z])", "$1 "), r"\s+"), lambda t: t != "")
        marked = r.from_any_primes(spaced)
        cased = F.exists(spaced, lambda t: t.rlike("^[A-Za-z]+$")) & (F.exists(spaced, lambda t: t.rlike("[A-Z]")) | ~F.contains(plain, F.lit("-")))
        found = (
            F.when(F.contains(plain, F.lit("-")) & ~plain.rlike(_PRIME), n.one_primary(F.split(plain, "-")))
            .when(marked.isNotNull(), n.one_primary(F.split(marked, "-")))
            .when(cased, n.one_primary(spaced))
        )
        return _let(found, lambda x: F.when(x["respelling"] != "", x))

    words = F.filter(F.split(text, r"\s{2,}"), lambda w: F.trim(w) != "")
    parts = F.transform(words, word)

    def joined(ps: Column) -> Column:
        said = F.array_join(F.transform(ps, lambda p: p["respelling"]), " ")
        return F.when(~F.exists(ps, lambda p: p.isNull()) & r.is_canonical(said), F.struct(said.alias("respelling"), F.exists(ps, lambda p: p["inferred"]).alias("inferred")))

    looks = F.coalesce(source, F.lit("")).startswith("merriam-webster") | text.rlike(DICTIONARY_MARKS)
    dictionary = F.when(looks, r.from_dictionary(text))
    other = F.coalesce(source, F.lit("")).isin(*PHONETIC_SOURCES) | text.rlike(PHONETIC_ONLY) | text.startswith("/") | (F.coalesce(text, F.lit("")) == "")
    return F.when(~other, F.coalesce(F.when(dictionary.isNotNull(), F.struct(dictionary.alias("respelling"), F.lit(False).alias("inferred"))), _let(parts, joined)))


def homogenized(sources: Column, priority: list[str]) -> Column:
    """struct<source, raw, respelling, inferred, dropped> of sources (structs of name and raw).

    The first source in the order of priority that has a canonical respelling; ``dropped`` lists the names
    of the others, of all of them if none has one.
    """
    forms = F.transform(sources, lambda s: F.struct(F.array_position(F.array(*map(F.lit, priority)), s["name"]).alias("rank"), s["name"].alias("name"), s["raw"].alias("raw"), canonical(s["raw"], s["name"]).alias("c")))
    usable = lambda fs: F.filter(fs, lambda f: (f["rank"] > 0) & f["c"].isNotNull())
    best = lambda fs: F.element_at(F.array_sort(F.transform(usable(fs), lambda f: F.struct(f["rank"].alias("rank"), f["name"].alias("name"), f["raw"].alias("raw"), f["c"].alias("c")))), 1)
    none = F.lit(None).cast("string")

    def told(x: Column) -> Column:
        names = F.transform(sources, lambda s: s["name"])
        dropped = F.filter(names, lambda s: x.isNull() | (s != x["name"]))
        return F.struct(F.coalesce(x["name"], none).alias("source"), x["raw"].alias("raw"), x["c"]["respelling"].alias("respelling"), F.coalesce(x["c"]["inferred"], F.lit(False)).alias("inferred"), dropped.alias("dropped"))

    return _let(forms, lambda fs: _let(F.when(F.size(usable(fs)) > 0, best(fs)), told))


# Templates of wiki text.

_ARGS = r"\|([^{}]*)\}\}"


def template_notation(text: Column) -> Column:
    """struct<kind, raw> of the first pronunciation template: phonetic text before a respelling."""
    arguments = lambda name: F.regexp_extract(text, r"(?is)\{\{\s*(?:" + name + r")\s*" + _ARGS, 1)
    plain = lambda c: F.filter(F.transform(F.split(c, r"\|"), lambda a: F.trim(a)), lambda a: (a != "") & ~F.contains(a, F.lit("=")) & (a != "en"))
    letters, whole, respelled = (plain(arguments(x)) for x in ("IPAc-en", "IPA-en|IPA", "respell"))
    kind = lambda k, raw: F.struct(F.lit(k).alias("kind"), raw.alias("raw"))
    return F.when(F.size(letters) > 0, kind("ipa", F.array_join(letters, ""))).when(F.size(whole) > 0, kind("ipa", F.get(whole, F.lit(0)))).when(F.size(respelled) > 0, kind("respell", F.array_join(respelled, "|")))


def page_notation(text: Column, title: Column) -> Column:
    """A page's own pronunciation: its box's pronounce field, the source field of an antibody's box, or a
    template between the title in bold and the next other bold name (the whole text if no bold is the title)."""
    field = lambda name: F.regexp_extract(text, rf"(?m)^\s*\|\s*{name}\s*=[ \t]*(.*)$", 1)
    own = F.regexp_replace(F.lower(title), "[^a-z0-9]", "")
    pieces = F.split(text, "'''")  # bold names stand at the odd places
    fold = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")

    def region(ps: Column) -> Column:
        bold = F.transform(ps, lambda p, i: F.when(i % 2 == 1, fold(p)))
        start = F.array_position(bold, own)
        later = F.filter(F.transform(bold, lambda b, i: F.when(b.isNotNull() & (b != own) & (i + 1 > start), i + 1)), lambda i: i.isNotNull())
        end = F.coalesce(F.get(later, F.lit(0)), F.size(ps) + 1)
        return F.when(start > 0, F.array_join(F.slice(ps, (start + 1).cast("int"), (end - start - 1).cast("int")), "'''")).otherwise(text)

    antibody = F.when(F.contains(text, F.lit("mab_type")), template_notation(field("source")))
    return F.coalesce(template_notation(field("pronounce")), antibody, template_notation(_let(pieces, region)))


# What was heard.

# Runs of sounds that letter names make; two of them mean that a name was spelled out.
LETTER_NAMES = ["eɪ tʃ", "k eɪ", "p iː", "ɛ l", "ɛ s", "ɛ n", "ɛ m", "ɛ f", "t iː", "d iː", "aɪ ɛ", "eɪ ɑːɹ", "v iː", "eɪ eɪ"]
# Sounds beside those of the notation, what a voice takes for some, and the first letters of vowels.
MORE_PHONES = ["ɹ", "ɚ", "ɐ", "ᵻ", "eː", "ɜː", "o", "g"]
VOICE_PHONES = {"ɹ": "r", "ɐ": "ə", "ᵻ": "ə", "ɚ": "ər", "eː": "eɪ", "g": "ɡ", "a": "ɑ", "o": "oʊ"}
VOWEL_LETTERS = "aeiouæɑɒɔɛɜɪʊʌəɐᵻɚ"

PHONES = sorted({row[0] for row in n._ROWS} | set(MORE_PHONES))
VOWEL_PHONES = [p for p in PHONES if p[0] in VOWEL_LETTERS]


def spelled_out(heard: Column) -> Column:
    """Two or more letter names are among the spaced sounds."""
    return sum((F.concat(F.lit(" "), heard, F.lit(" ")).contains(f" {x} ").cast("int") for x in LETTER_NAMES), F.lit(0)) >= 2


def phone_tokens(ipa: Column) -> Column:
    """Longest sounds of phonetic text, stress marks as tokens of their own; others are skipped."""
    return greedy_tokens(F.replace(F.coalesce(ipa, F.lit("")), F.lit(" "), F.lit("")), [n.PRIMARY, n.SECONDARY, *PHONES])


def bare_phones(ipa: Column) -> Column:
    return F.filter(phone_tokens(ipa), lambda p: ~p.isin(n.PRIMARY, n.SECONDARY))


def heard_phones(heard: Column) -> Column:
    """Sounds of a decoder: parted by blanks, else cut."""
    parts = F.filter(F.split(F.coalesce(heard, F.lit("")), r"\s+"), lambda p: p != "")
    return F.when(F.size(parts) > 0, parts).otherwise(bare_phones(heard))


def voiced(phones: Column, like: Column) -> Column:
    """Phonetic text for a voice, with primary stress on the first vowel if ``like`` has one."""
    table = n._table({k: F.lit(x) for k, x in VOICE_PHONES.items()})
    body = F.transform(phones, lambda p: F.coalesce(F.try_element_at(table, p), p))
    vowels = [*VOWEL_PHONES, *VOICE_PHONES.values()]
    return F.when(F.contains(F.coalesce(like, F.lit("")), F.lit(n.PRIMARY)), r.stress_first_vowel(body, vowels)).otherwise(F.array_join(body, ""))


def word_spaced(ipa: Column, like: Column) -> Column:
    """Fused phonetic text cut at blanks in the places that ``like`` has them, in proportion to its words."""
    words = F.filter(F.split(F.coalesce(like, F.lit("")), r"\s+"), lambda w: w != "")

    def cut(x: Column) -> Column:
        total = F.aggregate(x["lens"], F.lit(0), lambda a, v: a + v)
        takes = _let(total, lambda all_: F.transform(x["lens"], lambda v: F.greatest(F.lit(1), F.rint(F.size(x["phones"]) * v / all_).cast("int"))))

        def said(ts: Column) -> Column:
            begin = lambda i: F.aggregate(F.slice(ts, 1, i), F.lit(0), lambda a, v: a + v)
            chunk = lambda v, i: F.slice(x["phones"], begin(i) + 1, F.when(i + 1 == F.size(ts), F.size(x["phones"])).otherwise(v))
            return F.transform(ts, lambda v, i: voiced(chunk(v, i), F.get(words, i)))

        return F.when(F.size(x["phones"]) > 0, F.array_join(F.filter(_let(takes, said), lambda w: w != ""), " ")).otherwise(ipa)

    lens = F.transform(words, lambda w: F.greatest(F.lit(1), F.size(bare_phones(w))))
    fused = F.contains(F.coalesce(like, F.lit("")), F.lit(" ")) & ~F.contains(ipa, F.lit(" "))
    return F.when(fused, _let(F.struct(bare_phones(ipa).alias("phones"), lens.alias("lens")), cut)).otherwise(ipa)


def sanitized(ipa: Column, like: Column) -> Column:
    """Phonetic text that a voice takes: doubled r and l single, a stressed schwa open. Text of more than
    three sounds with fewer than two vowels is junk, and ``like`` the answer; blanks follow ``like``."""
    clean = F.replace(F.replace(F.replace(F.coalesce(ipa, F.lit("")), F.lit("rr"), F.lit("r")), F.lit("ll"), F.lit("l")), F.lit("ˈə"), F.lit("ˈʌ"))

    def checked(x: Column) -> Column:
        junk = (F.size(x["phones"]) > 3) & (F.size(F.filter(x["phones"], lambda p: p.isin(*VOWEL_PHONES))) < 2)
        known = F.coalesce(like, F.lit("")) != ""
        return F.when(known & junk, like).when(known, word_spaced(x["text"], like)).otherwise(x["text"])

    return _let(F.struct(clean.alias("text"), bare_phones(clean).alias("phones")), checked)


def _edited(own: list[str], wanted: list[str], kinds: tuple[str, ...], like: str, vowels: frozenset[str], said: frozenset[str]) -> list[str]:
    """:func:`moved_towards` and then :func:`voiced`, for one pair of short sequences, by each kind of edit."""
    blocks, out = r._blocks(own, wanted) if own and wanted else None, []
    for kind in kinds:
        body = [VOICE_PHONES.get(p, p) for p in r._moved(own, wanted, kind, vowels, blocks)]
        first = next((i for i, p in enumerate(body) if p in said), None)
        if n.PRIMARY in like and first is not None:
            body.insert(first, n.PRIMARY)
        out.append("".join(body))
    return out


def _with_edits(rows: DataFrame, own: str, wanted: str, like: str, kinds: tuple[str, ...]) -> DataFrame:
    """``rows`` with a column ``_kind`` for each kind of edit; one pass of Arrow batches for all of them."""
    vowels, said = frozenset(VOWEL_PHONES), frozenset([*VOWEL_PHONES, *VOICE_PHONES.values()])
    schema = rows.schema
    for kind in kinds:
        schema = StructType([*schema.fields, StructField(f"_{kind}", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            triples = zip(*(batch.column(c).to_pylist() for c in (own, wanted, like)), strict=True)
            edits = [_edited(a, b, kinds, x, vowels, said) for a, b, x in triples]
            made = [pa.array([e[k] for e in edits], pa.string()) for k in range(len(kinds))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=schema.names)

    return rows.mapInArrow(run, schema)


def proposals(rows: DataFrame, ipa: str, human: str, synthetic: str, official: str) -> DataFrame:
    """The rows with round1 to round5: what each round would try, from the text in use, what people and a voice
    were heard to say, and official texts: the first of these or what people say; the second or their vowels;
    one edit towards them; one edit if the voice still differs; schwas opened, else one edit."""
    text = F.coalesce(F.col(ipa), F.lit(""))
    cut = rows.withColumns({"_text": text, "_own": bare_phones(text), "_said": heard_phones(F.col(human)), "_voice": heard_phones(F.col(synthetic))})
    near = cut.withColumns({"_span": n.nearest_window(F.col("_said"), F.col("_own")), "_voice": n.nearest_window(F.col("_voice"), F.col("_own"))})
    edited = _with_edits(near, "_own", "_span", "_text", ("vowels", "one"))
    one = F.when((F.size("_own") > 0) & (F.size("_span") > 0), F.col("_one")).otherwise(text)
    same = (F.coalesce(synthetic, F.lit("")) != "") & (voiced(F.col("_span"), F.lit("")) == voiced(F.col("_voice"), F.lit("")))
    folded = F.replace(text, F.lit("ə"), F.lit("ʌ"))
    rounds = {
        "round1": F.coalesce(F.get(official, F.lit(0)), voiced(F.col("_span"), text)),
        "round2": F.coalesce(F.get(official, F.lit(1)), F.col("_vowels")),
        "round3": one,
        "round4": F.when(same, text).otherwise(one),
        "round5": F.when(folded != text, folded).otherwise(one),
    }
    return edited.select(*rows.columns, *(c.alias(k) for k, c in rounds.items()))
