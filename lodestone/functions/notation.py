"""Pronunciation notations as column expressions: normal forms, alternates and phonetic alphabets.

Nothing here leaves the JVM. Phonetic text is taken as composed Unicode.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import greedy_tokens

PRIMARY, SECONDARY = "ˈ", "ˌ"

# Phonetic letters of vowels, their symbols and the form in which they are shown.
IPA_VOWELS = """
ɜːr ER ɜːr
ər ER ər
ɪər IH+R ɪər
ʊər UH+R ʊər
ɛər EH+R ɛər
ɑːr AA+R ɑːr
ɔːr AO+R ɔːr
eɪ EY eɪ
aɪ AY aɪ
ɔɪ OY ɔɪ
aʊ AW aʊ
oʊ OW oʊ
iː IY iː
ɑː AA ɑː
ɔː AO ɔː
uː UW uː
æ AE æ
ɛ EH ɛ
ɪ IH ɪ
ɒ AA ɒ
ʊ UH ʊ
ʌ AH ʌ
ə AH ə
ᵻ AH ə
ᵿ UH ᵿ
i IY i
u UW u
a AA a
"""
# The same for consonants.
IPA_CONSONANTS = """
tʃ CH tʃ
dʒ JH dʒ
hw HH+W hw
p P p
b B b
t T t
d D d
k K k
ɡ G ɡ
g G ɡ
f F f
v V v
θ TH θ
ð DH ð
s S s
z Z z
ʃ SH ʃ
ʒ ZH ʒ
h HH h
m M m
n N n
ŋ NG ŋ
l L l
r R r
j Y j
w W w
x HH x
"""
# X-SAMPA for the letters that differ; a length mark and stress marks included.
XSAMPA = {
    "ɝ": "3`", "ɚ": "@`", "ɹ": "r", "æ": "{", "ə": "@", "ɪ": "I", "ʊ": "U", "ɛ": "E", "ɑ": "A", "ɔ": "O", "ʌ": "V", "ɒ": "Q", "ɜ": "3",
    "ʃ": "S", "ʒ": "Z", "θ": "T", "ð": "D", "ŋ": "N", "ɡ": "g", "ᵻ": "I", "ᵿ": "U", "ɐ": "6", "ˈ": '"', "ˌ": "%", "ː": ":",
}

_VOWEL_ROWS = [r.split() for r in IPA_VOWELS.strip().splitlines()]
_ROWS = _VOWEL_ROWS + [r.split() for r in IPA_CONSONANTS.strip().splitlines()]
_VOWEL_SYMBOLS = sorted({s.split("+")[0] for _, s, _ in _VOWEL_ROWS})


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def one_primary(parts: Column) -> Column:
    """struct<respelling, inferred>: syllables joined by hyphens, exactly one in capitals.

    It is the first that has a capital; without any, the first one, and ``inferred`` is true. A lone
    syllable without capitals stays as it is. Nothing but letters is kept; no letters give ''.
    """
    clean = F.filter(F.transform(parts, lambda p: F.regexp_replace(p, "[^a-zA-Z]", "")), lambda p: p != "")

    def marked(c: Column) -> Column:
        at = F.array_position(F.transform(c, lambda p: p.rlike("[A-Z]")), F.lit(True))
        lone = (F.size(c) <= 1) & (at == 0)
        place = F.when(at == 0, F.lit(1)).otherwise(at)
        cased = F.transform(c, lambda p, i: F.when((i + 1 == place) & ~lone, F.upper(p)).otherwise(F.lower(p)))
        return F.struct(F.array_join(cased, "-").alias("respelling"), ((at == 0) & ~lone).alias("inferred"))

    return _let(clean, marked)


def expand_alternates(raw: Column) -> Column:
    """Comma-separated alternates, each in full.

    One that begins with a hyphen replaces the last syllables of the first form, one that ends with
    a hyphen its first syllables; one with both is ambiguous and left out.
    """
    parts = F.filter(F.transform(F.split(raw, ","), lambda p: F.trim(p)), lambda p: p != "")

    def expanded(ps: Column) -> Column:
        base = F.split(F.get(ps, F.lit(0)), "-")
        size = F.size(base)

        def full(p: Column, i: Column) -> Column:
            own = F.split(F.regexp_replace(p, "^-+|-+$", ""), "-")
            head = F.slice(base, 1, F.greatest(size - F.size(own), F.lit(1)))
            tail = F.slice(base, F.size(own) + 1, F.greatest(size - F.size(own), F.lit(0)))
            begins, ends = p.startswith("-"), p.endswith("-")
            return (
                F.when(i == 0, p)
                .when(begins & ends, F.lit(None))
                .when(begins, F.array_join(F.concat(head, own), "-"))
                .when(ends, F.array_join(F.concat(own, tail), "-"))
                .otherwise(p)
            )

        return F.array_compact(F.transform(ps, full))

    return _let(parts, expanded)


def _table(values: dict[str, Column]) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])


def phonemes(ipa: Column) -> Column:
    """struct<symbols, shown>: symbols with stress digits on vowels, and the text with its marks.

    A mark's stress goes to the next vowel. Without a primary one the first vowel gets it, and
    ``shown`` a mark before that vowel. Unknown letters are skipped; null if nothing is left.
    """
    symbols = _table({g: F.array(*map(F.lit, s.split("+"))) for g, s, _ in _ROWS})
    shown = _table({g: F.lit(out) for g, _, out in _ROWS} | {m: F.lit(m) for m in (PRIMARY, SECONDARY)})
    is_vowel = lambda s: s.isin(*_VOWEL_SYMBOLS)
    cleaned = F.regexp_replace(ipa, r"[/\[\]().‿ ]|\p{Mn}", "")
    tokens = greedy_tokens(cleaned, [PRIMARY, SECONDARY, *(g for g, _, _ in _ROWS)])
    state = lambda out, pending, primary: F.struct(out.alias("out"), pending.alias("pending"), primary.alias("primary"))

    def step(a: Column, t: Column) -> Column:
        new = F.coalesce(F.try_element_at(symbols, t), F.array().cast("array<string>"))
        marked = F.transform(new, lambda s: F.when(is_vowel(s), F.concat(s, a["pending"])).otherwise(s))
        rest = F.when(t == PRIMARY, F.lit("1")).when(t == SECONDARY, F.lit("2")).when(F.exists(new, is_vowel), F.lit("0")).otherwise(a["pending"])
        return state(F.concat(a["out"], marked), rest, a["primary"] | (t == PRIMARY))

    def finished(ts: Column) -> Column:
        folded = F.aggregate(ts, state(F.array().cast("array<string>"), F.lit("0"), F.lit(False)), step)
        return _let(folded, lambda f: placed(ts, f))

    def placed(ts: Column, f: Column) -> Column:
        first = F.array_position(F.transform(f["out"], lambda s: s.rlike("[0-2]$")), F.lit(True))
        own = F.transform(f["out"], lambda s, i: F.when(~f["primary"] & (i + 1 == first), F.concat(F.regexp_replace(s, "[0-2]$", ""), F.lit("1"))).otherwise(s))
        letters = F.transform(ts, lambda t: F.coalesce(F.exists(F.try_element_at(symbols, t), is_vowel), F.lit(False)))
        vowel = F.array_position(letters, F.lit(True))
        text = F.transform(ts, lambda t, i: F.concat(F.when(~f["primary"] & (i + 1 == vowel), F.lit(PRIMARY)).otherwise(F.lit("")), F.try_element_at(shown, t)))
        return F.when(F.size(f["out"]) > 0, F.struct(F.array_join(own, " ").alias("symbols"), F.array_join(text, "").alias("shown")))

    return _let(tokens, finished)


def xsampa(ipa: Column) -> Column:
    """The same sounds in X-SAMPA; other letters stay."""
    table = _table({k: F.lit(v) for k, v in XSAMPA.items()})
    return F.array_join(F.transform(F.split(ipa, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")


def suffix_of(name: Column, suffixes: list[str]) -> Column:
    """The longest listed suffix that leaves a root, after an added four-letter code; else null."""
    base = F.regexp_replace(F.lower(name), "-[a-z]{4}$", "")
    found = F.regexp_extract(base, "^.+?(" + "|".join(sorted(suffixes, key=lambda s: (-len(s), s))) + ")$", 1)
    return F.when(found != "", found)


def as_letters(a: Column, b: Column) -> Column:
    """struct<a, b>: two arrays of tokens as strings of one letter for each token.

    Letters are given by place among the pair's distinct tokens, so equal letters are equal tokens
    (for up to 20,000 distinct ones in a pair) and the built-in edit distance counts tokens.
    """
    known = F.array_distinct(F.concat(a, b))

    def letter(ks: Column, t: Column) -> Column:
        code = F.conv(F.hex((F.array_position(ks, t) + F.lit(0x4E00)).cast("long")), 16, 16)
        return F.decode(F.unhex(F.lpad(code, 4, "0")), "UTF-16BE")

    spelled = lambda ks, x: F.array_join(F.transform(x, lambda t: letter(ks, t)), "")
    return _let(known, lambda ks: F.struct(spelled(ks, a).alias("a"), spelled(ks, b).alias("b")))


def nearest_window(heard: Column, wanted: Column) -> Column:
    """The run of ``heard`` tokens nearest to ``wanted``, its length one less to one more.

    The leading run of equal length is the first candidate; another replaces it only if it is nearer,
    shorter runs before longer ones and earlier before later ones. Tokens that are at most one more
    than wanted are kept whole; if a side is empty the other is the answer.
    """
    n, m = F.size(wanted), F.size(heard)
    place = lambda at, w: F.struct(at.alias("at"), w.alias("w"))
    windows = F.flatten(F.transform(F.array(n - 1, n, n + 1), lambda w: F.when((w >= 3) & (w <= m), F.transform(F.sequence(F.lit(1), m - w + 1), lambda i: place(i, w))).otherwise(F.array().cast("array<struct<at:int,w:int>>"))))
    every = F.concat(F.array(place(F.lit(1), n)), windows)

    def nearest(p: Column) -> Column:
        """The place of the least distance; tokens become letters once for all windows."""
        distance = lambda x: F.levenshtein(F.substr(p["a"], x["at"], x["w"]), p["b"])
        return F.array_min(F.transform(every, lambda x, i: F.struct(distance(x).alias("d"), i.alias("i"), x.alias("x"))))["x"]

    found = _let(_let(as_letters(heard, wanted), nearest), lambda x: F.slice(heard, x["at"], x["w"]))
    return F.when(m == 0, wanted).when((n == 0) | (m <= n + 1), heard).otherwise(found)
