"""Names, pages and text as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Five ways to make a slug; they differ on purpose and each keeps its name.


def slug_dash_spaces(name: Column) -> Column:
    return F.translate(F.lower(F.trim(name)), " /", "--")


def slug_dash_runs(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-|-$", "")


def slug_underscore_spaces(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit(" "), F.lit("_"))


def slug_squeezed(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def slug_underscore_runs(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_|_$", "")


def strip_label(name: Column, labels: list[str]) -> Column:
    """The name without a trailing label in parentheses."""
    return F.trim(F.regexp_replace(name, r"(?i)\s*\((?:" + "|".join(labels) + r")\)\s*$", ""))


def split_list(text: Column) -> Column:
    """Members of 'a, b, and c': trimmed, empty ones dropped."""
    parts = F.split(text, r",\s*and\s+|,\s*|\s+and\s+")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def locate(text: Column, part: Column) -> Column:
    """Start of the first match, case-folded, from 0; null if there is none."""
    at = F.instr(F.lower(text), F.lower(part))
    return F.when(at > 0, at - 1)


def cut_span(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def hyphen_suffix(name: Column) -> Column:
    """The four letters after a last hyphen, or empty."""
    return F.regexp_extract(name, r"-([a-z]{4})$", 1)


def spoken_words(name: Column) -> Column:
    """Words of the name, the last one without a four-letter suffix."""
    return F.filter(F.split(F.regexp_replace(name, r"-[a-z]{4}$", ""), r"\s+"), lambda x: x != "")


def base_forms(name: Column, modifiers: list[str]) -> Column:
    """Ordered distinct forms to look up: stripped, without a last modifier, first word."""
    bare = F.trim(F.regexp_replace(F.lower(name), r"-[a-z]{4}$", ""))
    short = F.trim(F.regexp_replace(bare, r"\s+(?:" + "|".join(modifiers) + r")$", ""))
    return F.filter(F.array_distinct(F.array(bare, short, F.split(short, " ")[0])), lambda x: x != "")


def titles(name: Column) -> Column:
    """Titles to try: the name, its stem, without hyphens, capitalised."""
    stem = F.regexp_replace(name, r"-[a-z]{4}$", "")
    return F.array_distinct(F.array(name, stem, F.replace(name, F.lit("-"), F.lit("")), F.concat(F.upper(F.left(name, F.lit(1))), F.substr(name, F.lit(2)))))


def syllables(text: Column) -> Column:
    """Estimated syllables: vowel groups of each word, at least one a word and one in all.

    No group crosses a blank, so groups are counted over the whole text, and words without any added.
    """
    low = F.lower(text)
    mute = F.regexp_count(low, F.lit(r"(?<!\S)[^\saeiouy]++(?!\S)"))
    return F.greatest(F.lit(1), F.regexp_count(low, F.lit("[aeiouy]+")) + mute)


def compare_form(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[ \\-–]", "")


def compact(text: Column) -> Column:
    """Hyphens inside words dropped, lower case, spaces squeezed."""
    return F.trim(F.regexp_replace(F.lower(F.replace(text, F.lit("-"), F.lit(""))), r"\s+", " "))


def edge_stripped(word: Column) -> Column:
    """Without punctuation at the edges; inner hyphens stay."""
    return F.regexp_replace(word, r"(?U)^[^\w]+|[^\w]+$", "")


def canonical_respelling(text: Column) -> Column:
    """Hyphenated ASCII with one ALL-CAPS syllable in each word, one at least in all."""
    words = F.split(text, " ")
    upper = lambda w: F.size(F.filter(F.split(w, "-"), lambda s: s.rlike("^[A-Z]+$")))
    lone = lambda w: w.rlike("^[a-z]+$")
    shaped = text.rlike("^[A-Za-z]+(?:-[A-Za-z]+)*(?: [A-Za-z]+(?:-[A-Za-z]+)*)*$")
    cased = F.forall(words, lambda w: F.forall(F.split(w, "-"), lambda s: s.rlike("^(?:[A-Z]+|[a-z]+)$")))
    return shaped & cased & F.forall(words, lambda w: (upper(w) == 1) | lone(w)) & F.exists(words, lambda w: upper(w) == 1)


def spelled_out(word: Column, names: dict[str, str]) -> Column:
    """Letter names of a word, joined by spaces; another character is an error."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    bad = F.raise_error(F.concat(F.lit("not a letter in "), word)).cast("string")
    return F.array_join(F.transform(F.filter(F.split(F.lower(word), ""), lambda c: c != ""), lambda c: F.coalesce(F.try_element_at(table, c), bad)), " ")


def greedy_tokens(text: Column, symbols: list[str]) -> Column:
    """Longest-first tokens of a notation; characters outside it are skipped."""
    longest = sorted(symbols, key=lambda s: (-len(s), s))
    pattern = "|".join("".join(f"\\{c}" if not c.isalnum() else c for c in s) for s in longest)
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


# Pages.


def anchors(html: Column) -> Column:
    """array<struct<href, label>> of the page's links."""
    pattern = F.lit(r'<a href="([^"]*)">([^<]*)</a>')
    return F.arrays_zip(F.regexp_extract_all(html, pattern, F.lit(1)).alias("href"), F.regexp_extract_all(html, pattern, F.lit(2)).alias("label"))


def sources(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'<source[^>]*src="([^"]+)"'), F.lit(1))


def blocks(html: Column, tag: str) -> Column:
    """Inner text of each block of a tag, over lines."""
    return F.regexp_extract_all(html, F.lit(f"(?s)<{tag}[^>]*>(.*?)</{tag}>"), F.lit(1))


# The entities that pages use most.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&amp;": "&"}


def plain_text(html: Column) -> Column:
    """Without scripts, styles and tags; entities decoded once; white space squeezed."""
    text = F.regexp_replace(html, r"(?s)<(?:script|style)[^>]*>.*?</(?:script|style)>", " ")
    text = F.regexp_replace(text, "<[^>]+>", " ")
    for entity, char in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def absolute(url: Column, href: Column) -> Column:
    """The link in full: as it is with a scheme, else against the page's scheme, site or folder."""
    site = F.regexp_extract(url, "^([a-z]+://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_replace(url, "[?#].*$", ""), "/[^/]*$", "/")
    return (
        F.when(href.rlike("^[a-z]+:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(url, "^([a-z]+:)", 1), href))
        .when(href.startswith("/"), F.concat(site, href))
        .otherwise(F.concat(folder, href))
    )


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^https?://([^/?#]+)", 1)


def document_slug(url: Column) -> Column:
    """The last part of the path, without query and extension."""
    path = F.regexp_replace(url, r"[?#].*$", "")
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[A-Za-z0-9]+$", "")


def contains_any(text: Column, parts: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(text, p))


def url_class(url: Column, rules: list[tuple[str, str]], other: str) -> Column:
    """The class of the first rule whose text the url contains."""
    out = F.lit(other)
    for part, name in reversed(rules):
        out = F.when(F.contains(url, F.lit(part)), name).otherwise(out)
    return out


def json_object(text: Column, schema: str) -> Column:
    """The object inside a text: within a code fence, else from the first brace to the last."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    bare = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.from_json(F.when(fenced != "", fenced).otherwise(bare), schema)


def iso_date(text: Column) -> Column:
    """20200131 as 2020-01-31; anything else unchanged."""
    return F.when(text.rlike(r"^\d{8}$"), F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")).otherwise(text)


def status_class(code: Column) -> Column:
    # Statuses worth another try.
    return F.when(code.between(200, 299), "ok").when(code.isin(408, 409, 425, 429, 500, 502, 503, 504), "retry").otherwise("permanent")


def declared_rate(mime: Column, default: int) -> Column:
    """The rate= of a MIME type, else the configured one."""
    return F.coalesce(F.nullif(F.regexp_extract(mime, r"rate=(\d+)", 1), F.lit("")).cast("int"), F.lit(default))


def pcm_seconds(n_bytes: Column, width: int, channels: int, rate: int) -> Column:
    return n_bytes / (width * channels * rate)


# The rules of the published Metaphone code, in an order in which each can be applied to a whole word.
# Small letters are spelling, capitals and 0 are sounds that are settled; rules look at spelling around them.
CODE_RULES = [
    (r"([abd-z])\1+", "$1"),  # doubled letters but c
    (r"^(?:k(?=n)|g(?=n)|p(?=n)|a(?=e)|w(?=r))", ""),
    (r"(?<=m)b$", ""),
    ("g(?=n(?:ed)?$)", ""),
    ("sch", "SK"),
    ("t(?=ch)", ""),
    ("ch|c(?=ia)", "X"),
    ("c(?=[iey])", "S"),
    ("ck|c", "K"),
    ("dg(?=[iey])", "J"),
    ("d", "T"),
    ("gh(?=[^aeiou])", ""),
    ("g(?=[iey])", "J"),
    ("g", "K"),
    ("ph", "F"),
    ("sh|s(?=i[oa])", "X"),
    ("t(?=i[oa])", "X"),
    ("th", "0"),
    ("s", "S"),
    ("t", "T"),
    ("^wh", "W"),
    ("(?<=[aeiou])h(?![aeiou])", ""),
    ("h", "H"),
    ("[wy](?![aeiou])", ""),
    ("w", "W"),
    ("y", "Y"),
    ("^x", "S"),
    ("x", "KS"),
    ("v", "F"),
    ("q", "K"),
    ("z", "S"),
    ("(?<!^)[aeiou]", ""),
]


def phonetic_code(name: Column) -> Column:
    """The Metaphone code of a name's letters: consonants by sound, a vowel only at the beginning."""
    out = F.regexp_replace(F.lower(name), "[^a-z]", "")
    for pattern, to in CODE_RULES:
        out = F.regexp_replace(out, pattern, to)
    return F.upper(out)
