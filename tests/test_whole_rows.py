"""Rows of queries without a SQL twin, worked out in plain Python from the tables."""

import math
import re
import zlib
from collections import defaultdict

import pytest

from lodestone.functions import phones
from lodestone.plans import catalog
from lodestone.plans.phonetics import LETTERS

FOLDER = "/root/testdata/sf0.001"
CUTS = ((0.20, 5), (0.45, 4), (0.95, 3), (1.70, 2), (2.80, 1))


def rows_of(spark, table):
    return spark.read.parquet(f"{FOLDER}/{table}.parquet").collect()


def spelled(name):
    return [LETTERS[c] for c in name.lower() if c in LETTERS]


def bare(token):
    return token.rstrip("012")


def vowel(token):
    return token[-1] in "012"


def swap(a, b):
    cost = phones.symbol_cost(bare(a), bare(b))
    return cost * phones.UNSTRESSED_SHARE if vowel(a) and vowel(b) and a[-1] == b[-1] == "0" else cost


def segmental(ref, hyp):
    """Least cost over all alignments, written out cell by cell."""
    best = {(0, 0): 0.0}
    for i in range(len(ref) + 1):
        for j in range(len(hyp) + 1):
            ways = []
            if i and j:
                ways.append(best[i - 1, j - 1] + swap(ref[i - 1], hyp[j - 1]))
            if i:
                ways.append(best[i - 1, j] + (phones.DROP_VOWEL if vowel(ref[i - 1]) else phones.DROP_CONSONANT))
            if j:
                ways.append(best[i, j - 1] + (phones.ADD_VOWEL if vowel(hyp[j - 1]) else phones.ADD_CONSONANT))
            if ways:
                best[i, j] = min(ways)
    return best[len(ref), len(hyp)]


def error(ref, hyp):
    """Scaled cost; a hypothesis that only lost symbols has no stress to change."""
    return segmental(ref, hyp) / math.sqrt(max(len(ref), phones.LEAST_LENGTH) / phones.PIVOT_LENGTH)


def score(e):
    return next((s for most, s in CUTS if e <= most), 0)


def test_phonetic_scores(spark):
    got = {r.item: r for r in catalog.queries()["phonetic_scores"](spark, FOLDER).collect()}
    names = [r.n_name for r in rows_of(spark, "nation")]
    want = {}
    for n in names:
        ref, hyp = spelled(n), spelled(n)[1:]
        if hyp:
            want[n] = min((error(v, hyp), i) for i, v in enumerate((ref, ["HH", *ref])))
    assert got.keys() == want.keys() and len(want) > 20
    for n, (e, variant) in want.items():
        assert got[n].error == pytest.approx(e, abs=1e-8) and got[n].variant == variant and got[n].score == score(e), n


def test_judged_rows(spark):
    """Lines of orders as members: every line is scored, then the order's worst, mean, best and limiting line."""
    names = {r.p_partkey: r.p_name.lower() for r in rows_of(spark, "part")}
    known, orders, seen = {}, defaultdict(list), set()
    for r in rows_of(spark, "lineitem"):
        item = f"{r.l_orderkey}#{r.l_linenumber}#{r.l_partkey}"
        if item in seen or r.l_partkey not in names:
            continue
        seen.add(item)
        ref = spelled(names[r.l_partkey])
        hyp = ref[1:] if zlib.crc32(item.encode()) % 3 == 0 else ref
        pair = (tuple(ref), tuple(hyp))
        if pair not in known:
            known[pair] = score(error(ref, hyp))
        orders[r.l_orderkey].append((r.l_linenumber, known[pair]))
    want = {}
    for key, lines in orders.items():
        scores = [s for _, s in lines]
        worst = min(scores)
        want[key] = (worst, round(sum(scores) / len(scores)), max(scores), max(scores) - worst, min(p for p, s in lines if s == worst))
    got = {r.row_id: (r.worst, r.mean, r.best, r.spread, r.limiting) for r in catalog.queries()["judged_rows"](spark, FOLDER).collect()}
    assert got == want and len(want) > 1000 and len({w[0] for w in want.values()}) > 1


def test_attribution_by_length(spark):
    labels = {r.doc_id: r.quality for r in rows_of(spark, "labels")}
    tiers = defaultdict(list)
    for r in rows_of(spark, "documents"):
        if r.doc_id in labels:
            tiers[r.n_chars >= 1000].append(labels[r.doc_id] == 1)
    (n1, k1), (n2, k2) = ((len(x), sum(x)) for x in (tiers[True], tiers[False]))
    pool = (k1 + k2) / (n1 + n2)
    z = (k1 / n1 - k2 / n2) / math.sqrt(pool * (1 - pool) * (1 / n1 + 1 / n2))
    p = math.erfc(abs(z) / math.sqrt(2))
    got = catalog.queries()["attribution_by_length"](spark, FOLDER).first()
    assert (got.n_first, got.k_first, got.n_other, got.k_other) == (n1, k1, n2, k2)
    assert got.z == pytest.approx(z, abs=1e-8) and got.p == pytest.approx(p, abs=1e-8) and got.significant == (p < 0.05)


def test_token_codes_of_texts_are_letters(spark):
    """The helper of these tests reads names as the queries do."""
    part = rows_of(spark, "part")[0].p_name
    assert len(spelled(part)) == len(re.sub("[^a-z]", "", part.lower()))
