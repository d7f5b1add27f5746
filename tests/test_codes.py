"""The sound code against a scan of letters, and scores and ratios against plain functions."""

from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lodestone.functions import fuzzy
from lodestone.functions import text as x
from lodestone.plans import catalog

VOWELS = "aeiou"


def scanned(name):
    """Metaphone letter by letter, as published."""
    w = "".join(c for c in name.lower() if "a" <= c <= "z")
    w = "".join(c for i, c in enumerate(w) if i == 0 or c == "c" or c != w[i - 1])
    if w[:2] in ("kn", "gn", "pn", "ae", "wr"):
        w = w[1:]
    out, i = [], 0

    def at(k):
        return w[k] if 0 <= k < len(w) else ""

    while i < len(w):
        c, n, nn, step = w[i], at(i + 1), at(i + 2), 1
        if c in VOWELS:
            out.append(c if i == 0 else "")
        elif c == "b":
            out.append("" if at(i - 1) == "m" and not n else "b")
        elif c == "c":
            if at(i - 1) == "s" and n == "h":
                out.append("k")
                step = 2
            elif n == "h":
                out.append("x")
                step = 2
            elif n == "i" and nn == "a":
                out.append("x")
            elif n and n in "iey":
                out.append("s")
            else:
                out.append("k")
                step = 2 if n == "k" else 1
        elif c == "d":
            j = n == "g" and nn and nn in "iey"
            out.append("j" if j else "t")
            step = 2 if j else 1
        elif c == "g":
            if n == "h" and nn and nn not in VOWELS:
                step = 2
            elif n == "n" and w[i + 1 :] in ("n", "ned"):
                pass
            else:
                out.append("j" if n and n in "iey" else "k")
        elif c == "h":
            out.append("" if at(i - 1) and at(i - 1) in VOWELS and not (n and n in VOWELS) else "h")
        elif c == "p":
            out.append("f" if n == "h" else "p")
            step = 2 if n == "h" else 1
        elif c == "s":
            if n == "h":
                out.append("x")
                step = 2
            else:
                out.append("x" if n == "i" and nn and nn in "oa" else "s")
        elif c == "t":
            if n == "c" and nn == "h":
                pass
            elif n == "h":
                out.append("0")
                step = 2
            else:
                out.append("x" if n == "i" and nn and nn in "oa" else "t")
        elif c == "w":
            if i == 0 and n == "h":
                out.append("w")
                step = 2
            else:
                out.append("w" if n and n in VOWELS else "")
        elif c == "x":
            out.append("s" if i == 0 else "ks")
        elif c == "y":
            out.append("y" if n and n in VOWELS else "")
        else:
            out.append({"v": "f", "q": "k", "z": "s"}.get(c, c))
        i += step
    return "".join(out).upper()


WORDS = "knight gnome wrack aerial thumb thumbs scheme church special cyst back edge adder laugh night signed sign ghost gem singer phone shush mission ratio thin match vivid whale know xenon axle yes boy buzz quick accent hoax rhythm apple tatty".split()


def test_metaphone(spark):
    rows = spark.createDataFrame([(w,) for w in [*WORDS, "Big-Apple 9", "", "é"]], "w string")
    got = {r.w: r.code for r in rows.select("w", x.phonetic_code(F.col("w")).alias("code")).collect()}
    assert got == {w: scanned(w) for w in got}
    assert got["knight"] == "NT" and got["phone"] == "FN" and got["thumb"] == "0M" and got["xenon"] == "SNN" and got["match"] == "MX"


def test_metaphone_of_corpus_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    words = docs.select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w")).where("w <> ''").distinct()
    got = words.select("w", x.phonetic_code(F.col("w")).alias("code")).collect()
    wrong = [(r.w, r.code, scanned(r.w)) for r in got if r.code != scanned(r.w)]
    assert len(got) > 1000 and not wrong


def winkler(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach, used, pairs = max(len(a), len(b)) // 2 - 1, set(), []
    for i, c in enumerate(a):
        j = next((j for j in range(len(b)) if j not in used and b[j] == c and abs(i - j) <= reach), None)
        if j is not None:
            used.add(j)
            pairs.append((i, j))
    if not pairs:
        return 0.0
    m = len(pairs)
    half = sum(a[i] != b[j] for (i, _), j in zip(pairs, sorted(used), strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - half) / m) / 3
    same = 0
    while same < min(4, len(a), len(b)) and a[same] == b[same]:
        same += 1
    return jaro + 0.1 * same * (1 - jaro)


def test_gated_scores_query(spark):
    folder = "/root/testdata/sf0.001"
    got = catalog.queries()["gated_scores"](spark, folder).collect()
    names = {r.p_name for r in spark.read.parquet(f"{folder}/part.parquet").select("p_name").collect()}
    pairs = [(n, n.replace(" ", "")) for n in names]
    want = []
    for a, b in pairs:
        j = winkler(a, b)
        want.append((round(5.0 if a == b else 3.5 + 1.5 * j if scanned(a) == scanned(b) else 3 * j, 9), round(SequenceMatcher(None, a, b).ratio(), 9)))
    found = sorted((r.score, r.ratio) for r in got)
    assert len(found) == len(want) and all(f == pytest.approx(w) for f, w in zip(found, sorted(want), strict=True))


def test_spans_in_hypotheses_query(spark):
    """Words two to four of a turn, found again in the turn without its first word."""
    folder = "/root/testdata/sf0.001"
    got = {(r.conv_id, r.turn): r for r in catalog.queries()["spans_in_hypotheses"](spark, folder).collect()}
    seen = 0
    for r in spark.read.parquet(f"{folder}/conversations.parquet").collect():
        words = (r.text or "").strip().split()
        if len(words) < 5:
            continue
        seen += 1
        places = [j + i - a for tag, a, z, j, _ in SequenceMatcher(None, words, words[1:], autojunk=False).get_opcodes() for i in range(max(1, a), min(4, z)) if tag == "equal"]
        row = got[r.conv_id, r.turn]
        assert (row["first"], row["last"]) == (min(places), max(places) + 1)
    assert seen > 20


def test_fuzzy_helpers_take_nulls(spark):
    row = spark.createDataFrame([(None, "a")], "a string, b string")
    assert row.select(fuzzy.jaro_winkler("a", "b").alias("x")).first().x is None
