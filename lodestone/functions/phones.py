"""Phoneme symbols, their distances and batch alignment.

Values under "Fixed values" define results. Distances become one matrix; alignments run as dynamic
programs over whole Arrow batches, one numpy step for each cell of the longest pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

# Consonants as place, manner, voiced.
PLACES = {"bilabial": 0.00, "labiodental": 0.15, "dental": 0.30, "alveolar": 0.42, "postalveolar": 0.58, "palatal": 0.70, "velar": 0.85, "glottal": 1.00}
MANNERS = {"stop": 0.00, "affricate": 0.22, "fricative": 0.42, "nasal": 0.62, "liquid": 0.82, "glide": 1.00}
CONSONANTS = [
    ("P", "bilabial", "stop", 0),
    ("B", "bilabial", "stop", 1),
    ("T", "alveolar", "stop", 0),
    ("D", "alveolar", "stop", 1),
    ("K", "velar", "stop", 0),
    ("G", "velar", "stop", 1),
    ("CH", "postalveolar", "affricate", 0),
    ("JH", "postalveolar", "affricate", 1),
    ("F", "labiodental", "fricative", 0),
    ("V", "labiodental", "fricative", 1),
    ("TH", "dental", "fricative", 0),
    ("DH", "dental", "fricative", 1),
    ("S", "alveolar", "fricative", 0),
    ("Z", "alveolar", "fricative", 1),
    ("SH", "postalveolar", "fricative", 0),
    ("ZH", "postalveolar", "fricative", 1),
    ("HH", "glottal", "fricative", 0),
    ("M", "bilabial", "nasal", 1),
    ("N", "alveolar", "nasal", 1),
    ("NG", "velar", "nasal", 1),
    ("L", "alveolar", "liquid", 1),
    ("R", "postalveolar", "liquid", 1),
    ("W", "velar", "glide", 1),
    ("Y", "palatal", "glide", 1),
    ("DX", "alveolar", "stop", 1),
]
# Vowels as height, backness, rounded, tense, rhotic, and the glide's height and backness.
HEIGHTS = {"low": 0.00, "mid_low": 0.33, "mid": 0.50, "mid_high": 0.70, "high": 1.00}
BACKNESS = {"front": 0.00, "central": 0.50, "back": 1.00}
VOWELS = [
    ("IY", "high", "front", 0, 1, 0, "high", "front"),
    ("IH", "mid_high", "front", 0, 0, 0, "mid_high", "front"),
    ("EH", "mid_low", "front", 0, 0, 0, "mid_low", "front"),
    ("AE", "low", "front", 0, 0, 0, "low", "front"),
    ("AA", "low", "back", 0, 1, 0, "low", "back"),
    ("AO", "mid_low", "back", 1, 1, 0, "mid_low", "back"),
    ("UH", "mid_high", "back", 1, 0, 0, "mid_high", "back"),
    ("UW", "high", "back", 1, 1, 0, "high", "back"),
    ("AH", "mid", "central", 0, 0, 0, "mid", "central"),
    ("ER", "mid", "central", 0, 1, 1, "mid", "central"),
    ("EY", "mid_high", "front", 0, 1, 0, "high", "front"),
    ("AY", "low", "central", 0, 1, 0, "high", "front"),
    ("OY", "mid_low", "back", 1, 1, 0, "high", "front"),
    ("AW", "low", "central", 0, 1, 0, "high", "back"),
    ("OW", "mid_high", "back", 1, 1, 0, "high", "back"),
]
# Weights of the features in the order of the rows above.
CONSONANT_WEIGHTS = (1.00, 1.00, 0.60)
VOWEL_WEIGHTS = (1.00, 1.00, 0.50, 0.35, 0.80, 0.40, 0.40)
# Pairs with a cost of their own, and costs across the classes.
PAIRS = {("ER", "R"): 0.12, ("AH", "IH"): 0.22, ("AH", "EH"): 0.24, ("IH", "IY"): 0.20, ("UH", "UW"): 0.20, ("AA", "AO"): 0.16, ("T", "DX"): 0.10, ("D", "DX"): 0.10}
ACROSS, ACROSS_SONORANT = 1.00, 0.72
# Costs of a lost and an added vowel or consonant, of a stress change, the share kept
# of a cost between two unstressed vowels, and the stress levels of the digits.
DROP_VOWEL, DROP_CONSONANT, ADD_VOWEL, ADD_CONSONANT = 1.15, 0.90, 1.00, 0.80
STRESS_CHANGE, UNSTRESSED_SHARE = 0.20, 0.35
STRESS_LEVEL = {"": 0.0, "0": 0.0, "2": 0.5, "1": 1.0}
# Length scale.
PIVOT_LENGTH, LEAST_LENGTH = 8, 4
# Clusters that may open a syllable.
ONSETS = {
    ("S", "P", "R"), ("S", "P", "L"), ("S", "T", "R"), ("S", "K", "R"), ("S", "K", "W"), ("S", "K", "L"), ("S", "P", "Y"), ("S", "T", "Y"), ("S", "K", "Y"), ("P", "R"),
    ("B", "R"), ("T", "R"), ("D", "R"), ("K", "R"), ("G", "R"), ("F", "R"), ("TH", "R"), ("SH", "R"), ("P", "L"), ("B", "L"), ("K", "L"), ("G", "L"), ("F", "L"),
    ("S", "L"), ("T", "W"), ("D", "W"), ("K", "W"), ("G", "W"), ("S", "W"), ("TH", "W"), ("P", "Y"), ("B", "Y"), ("K", "Y"), ("G", "Y"), ("F", "Y"), ("V", "Y"),
    ("M", "Y"), ("N", "Y"), ("HH", "Y"), ("L", "Y"), ("S", "P"), ("S", "T"), ("S", "K"), ("S", "M"), ("S", "N"), ("S", "F"), ("Z", "L"), ("V", "R"), ("DH", "R"),
}


def _features() -> tuple[dict[str, np.ndarray], dict[str, np.ndarray], set[str]]:
    consonants, vowels, sonorant = {}, {}, set()
    for name, place, manner, voiced in CONSONANTS:
        consonants[name] = np.array([PLACES[place], MANNERS[manner], float(voiced)])
        if manner in ("nasal", "liquid", "glide"):
            sonorant.add(name)
    for name, height, back, rounded, tense, rhotic, glide_height, glide_back in VOWELS:
        vowels[name] = np.array([HEIGHTS[height], BACKNESS[back], float(rounded), float(tense), float(rhotic), HEIGHTS[glide_height], BACKNESS[glide_back]])
    return consonants, vowels, sonorant


_CONSONANT_FEATURES, _VOWEL_FEATURES, _SONORANT = _features()
SYMBOLS = [*_CONSONANT_FEATURES, *_VOWEL_FEATURES]


def symbol_cost(a: str, b: str) -> float:
    """Distance of two symbols without stress, 0 to 1."""
    if a == b:
        return 0.0
    for pair in ((a, b), (b, a)):
        if pair in PAIRS:
            return PAIRS[pair]
    for table, weights in ((_CONSONANT_FEATURES, CONSONANT_WEIGHTS), (_VOWEL_FEATURES, VOWEL_WEIGHTS)):
        if a in table and b in table:
            return float(np.dot(weights, np.abs(table[a] - table[b])) / sum(weights))
    return ACROSS_SONORANT if _SONORANT & {a, b} else ACROSS


@F.pandas_udf(DoubleType())
def pair_cost(a: pd.Series, b: pd.Series) -> pd.Series:
    """:func:`symbol_cost` of two symbols each; an unknown symbol raises."""
    known = {(x, y): symbol_cost(x, y) for x, y in set(zip(a, b, strict=True)) if x in SYMBOLS and y in SYMBOLS}
    return pd.Series([known[x, y] for x, y in zip(a, b, strict=True)], dtype=float)


#: Tokens are consonants, and vowels without or with a stress digit.
TOKENS = [*_CONSONANT_FEATURES, *(v + d for v in _VOWEL_FEATURES for d in STRESS_LEVEL)]
CODE = {t: i for i, t in enumerate(TOKENS)}
_BARE = [t.rstrip("012") for t in TOKENS]
IS_VOWEL = np.array([b in _VOWEL_FEATURES for b in _BARE])
_LEVEL = np.array([STRESS_LEVEL[t[len(b) :]] for t, b in zip(TOKENS, _BARE, strict=True)])
_PLAIN = np.array([[symbol_cost(a, b) for b in _BARE] for a in _BARE])
_WEAK = IS_VOWEL & (_LEVEL == 0)
SWAP = _PLAIN * np.where(_WEAK[:, None] & _WEAK[None, :], UNSTRESSED_SHARE, 1.0)
DROP = np.where(IS_VOWEL, DROP_VOWEL, DROP_CONSONANT)
ADD = np.where(IS_VOWEL, ADD_VOWEL, ADD_CONSONANT)
STRESS = STRESS_CHANGE * np.abs(_LEVEL[:, None] - _LEVEL[None, :]) * (IS_VOWEL[:, None] & IS_VOWEL[None, :])


def parse(text: str) -> list[int]:
    """Token codes of a space-separated sequence; an unknown symbol raises."""
    out = []
    for t in text.upper().split():
        if t not in CODE:
            raise ValueError(f"unknown symbol {t}")
        out.append(CODE[t])
    return out


def _padded(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(r) for r in rows], np.int64)
    out = np.zeros((len(rows), int(lengths.max(initial=0))), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out, lengths


def cost_tables(refs: list[list[int]], hyps: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cost of every pair of prefixes, for all pairs at once: (pairs, n + 1, m + 1), and the padded codes."""
    r, n = _padded(refs)
    h, m = _padded(hyps)
    table = np.zeros((len(refs), r.shape[1] + 1, h.shape[1] + 1))
    np.cumsum(DROP[r], axis=1, out=table[:, 1:, 0])
    np.cumsum(ADD[h], axis=1, out=table[:, 0, 1:])
    for i in range(r.shape[1]):
        lost = DROP[r[:, i]]
        for j in range(h.shape[1]):
            across = table[:, i, j] + SWAP[r[:, i], h[:, j]]
            table[:, i + 1, j + 1] = np.minimum(np.minimum(across, table[:, i, j + 1] + lost), table[:, i + 1, j] + ADD[h[:, j]])
    return table, r, n, h, m


def opening(consonants: list[str]) -> int:
    """How many of the consonants between two vowels open the second one's syllable."""
    tails = [tuple(consonants[-n:]) for n in (3, 2)]
    return next((len(t) for t in tails if t in ONSETS), 1 if consonants else 0)


def syllable_starts(ref: list[int]) -> list[int]:
    """Where each syllable begins: a vowel takes the longest allowed opening from the consonants before it."""
    starts, between, spoken = [0], [], False
    for place, code in enumerate(ref):
        if not IS_VOWEL[code]:
            between.append(TOKENS[code])
            continue
        if spoken:
            starts.append(place - opening(between))
        between, spoken = [], True
    return starts


OPS = ArrayType(StructType([StructField("kind", StringType()), StructField("ref", StringType()), StructField("hyp", StringType()), StructField("cost", DoubleType()), StructField("stress", DoubleType()), StructField("ref_index", IntegerType()), StructField("hyp_index", IntegerType()), StructField("syllable", IntegerType())]))
ALIGNMENT = StructType([StructField("segmental", DoubleType()), StructField("stress", DoubleType()), StructField("ref_length", IntegerType()), StructField("ops", OPS)])


def trace(table: np.ndarray, ref: list[int], hyp: list[int]) -> list[dict]:
    """Operations of one alignment from its table: a swap before a loss before an addition."""
    starts = np.array(syllable_starts(ref))
    i, j, ops = len(ref), len(hyp), []
    while i or j:
        here = table[i, j]
        if i and j and here == table[i - 1, j - 1] + SWAP[ref[i - 1], hyp[j - 1]]:
            i, j = i - 1, j - 1
            cost = float(SWAP[ref[i], hyp[j]])
            op = ("sub" if cost else "match", TOKENS[ref[i]], TOKENS[hyp[j]], cost, float(STRESS[ref[i], hyp[j]]), i, j, i)
        elif i and (not j or here == table[i - 1, j] + DROP[ref[i - 1]]):
            i -= 1
            op = ("del", TOKENS[ref[i]], None, float(DROP[ref[i]]), 0.0, i, None, i)
        else:
            j -= 1
            op = ("ins", None, TOKENS[hyp[j]], float(ADD[hyp[j]]), 0.0, None, j, max(i - 1, 0))
        at = int(np.searchsorted(starts, op[-1], "right")) - 1
        ops.append(dict(zip(("kind", "ref", "hyp", "cost", "stress", "ref_index", "hyp_index", "syllable"), (*op[:-1], at), strict=True)))
    return ops[::-1]


@F.pandas_udf(ALIGNMENT)
def align(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Least-cost alignment of two symbol sequences; stress is charged on the pairs it makes."""
    for refs, hyps in parts:
        rows = []
        for lo in range(0, len(refs), 512):
            r, h = [parse(x) for x in refs[lo : lo + 512]], [parse(x) for x in hyps[lo : lo + 512]]
            table, *_ = cost_tables(r, h)
            for k, (a, b) in enumerate(zip(r, h, strict=True)):
                ops = trace(table[k], a, b)
                rows.append((float(table[k, len(a), len(b)]), sum(o["stress"] for o in ops), len(a), ops))
        yield pd.DataFrame(rows, columns=["segmental", "stress", "ref_length", "ops"])


def path_stress(table: np.ndarray, r: np.ndarray, n: np.ndarray, h: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What :func:`trace` charges for stress, summed in its order, for all pairs of :func:`cost_tables` at once."""
    total, steps = np.zeros(len(n)), []
    if not r.shape[1] or not h.shape[1]:
        return total
    rows, i, j = np.arange(len(n)), n.copy(), m.copy()
    while (live := (i > 0) | (j > 0)).any():
        here, before, above = table[rows, i, j], np.maximum(i - 1, 0), np.maximum(j - 1, 0)
        a, b = r[rows, before], h[rows, above]
        swap = (i > 0) & (j > 0) & (here == table[rows, before, above] + SWAP[a, b])
        drop = ~swap & (i > 0) & ((j == 0) | (here == table[rows, before, j] + DROP[a]))
        steps.append(np.where(swap, STRESS[a, b], 0.0))
        i, j = i - (swap | drop), j - (live & ~drop)
    lost = np.zeros(len(n))  # compensated, as the built-in sum of floats is
    for s in reversed(steps):
        new = total + s
        lost += np.where(total >= s, (total - new) + s, (s - new) + total)
        total = new
    return total + lost


#: Cells of the tables that are filled at once; a longer pair is on its own.
CELLS = 2_000_000


def _blocks(n: np.ndarray, m: np.ndarray) -> Iterator[np.ndarray]:
    """Pairs of about the same lengths, so that a long one does not make the tables of short ones large."""
    order = np.lexsort((m, n))
    lo = 0
    while lo < len(order):
        hi = min(lo + 512, len(order))
        while hi - lo > 1 and (hi - lo) * (int(n[order[hi - 1]]) + 1) * (int(m[order[lo:hi]].max()) + 1) > CELLS:
            hi = lo + (hi - lo) // 2
        yield order[lo:hi]
        lo = hi


@F.pandas_udf(StructType(ALIGNMENT.fields[:3]))
def aligned_cost(refs: pd.Series, hyps: pd.Series) -> pd.DataFrame:
    """:func:`align` without its operations, for :func:`normalized_error`."""
    r, h = [parse(x) for x in refs], [parse(x) for x in hyps]
    n, m = (np.array([len(x) for x in xs], np.int64) for xs in (r, h))
    segmental, stress = np.zeros(len(r)), np.zeros(len(r))
    for at in _blocks(n, m):
        table, *pair = cost_tables([r[k] for k in at], [h[k] for k in at])
        segmental[at] = table[np.arange(len(at)), n[at], m[at]]
        stress[at] = path_stress(table, *pair)
    return pd.DataFrame({"segmental": segmental, "stress": stress, "ref_length": n.astype(np.int32)})


@F.pandas_udf(DoubleType())
def segmental_cost(refs: pd.Series, hyps: pd.Series) -> pd.Series:
    """The alignment's cost alone."""
    out = []
    for lo in range(0, len(refs), 512):
        r, h = [parse(x) for x in refs[lo : lo + 512]], [parse(x) for x in hyps[lo : lo + 512]]
        table, _, n, _, m = cost_tables(r, h)
        out.append(table[np.arange(len(r)), n, m])
    return pd.Series(np.concatenate(out) if out else [], dtype=float)


BARE = list(dict.fromkeys(_BARE))
_BARE_OF = np.array([BARE.index(b) for b in _BARE])
#: Least cost of any swap between two symbols, whatever their stress.
_LEAST_SWAP = np.array([[SWAP[np.ix_(_BARE_OF == a, _BARE_OF == b)].min() for b in range(len(BARE))] for a in range(len(BARE))])
_LEAST_DROP = np.array([DROP[_BARE_OF == a].min() for a in range(len(BARE))])
_LEAST_ADD = np.array([ADD[_BARE_OF == a].min() for a in range(len(BARE))])
LEAST_STEP = float(min(DROP.min(), ADD.min()))


def symbol_counts(rows: list[list[int]]) -> np.ndarray:
    """How often each sequence has each symbol (without stress)."""
    out = np.zeros((len(rows), len(BARE)))
    for i, r in enumerate(rows):
        out[i] = np.bincount(_BARE_OF[r], minlength=len(BARE)) if r else 0
    return out


def least_lost(present: np.ndarray) -> np.ndarray:
    """For sets of symbols (rows of 0/1): what each symbol of a reference costs at least against one with them."""
    return np.minimum(_LEAST_DROP, np.where(present[:, None, :] > 0, _LEAST_SWAP[None], np.inf).min(axis=2))


def least_added(present: np.ndarray) -> np.ndarray:
    """For sets of symbols: what each symbol of a hypothesis costs at least against a reference with them."""
    return np.minimum(_LEAST_ADD, np.where(present[:, :, None] > 0, _LEAST_SWAP[None], np.inf).min(axis=1))


def least_costs(refs: np.ndarray, hyps: np.ndarray) -> np.ndarray:
    """A bound from below of the cost of every pair, from symbol counts alone: every symbol of a side is lost,
    or swapped for its cheapest partner on the other side; what is over in length is lost or added."""
    n, m = refs.sum(axis=1), hyps.sum(axis=1)
    over = np.maximum(n[:, None] - m[None, :], 0) * DROP.min() + np.maximum(m[None, :] - n[:, None], 0) * ADD.min()
    return np.maximum(over, np.maximum(refs @ least_lost(hyps).T, least_added(refs) @ hyps.T))


def bounded_costs(refs: list[list[int]], hyps: list[list[int]], ceilings: np.ndarray) -> np.ndarray:
    """The cost of every pair, or infinity once it is known to lie above the pair's ceiling.

    A cell d places off the diagonal costs at least d times the least step, so only a band that the ceilings
    allow is computed; a pair whose whole row lies above its ceiling is left out of the following rows.
    """
    out = np.full(len(refs), np.inf)
    if not len(refs):
        return out
    r, n = _padded(refs)
    h, m = _padded(hyps)
    slack = ceilings + 1e-9
    live = np.flatnonzero(np.abs(n - m) * LEAST_STEP <= slack)
    width = h.shape[1]
    row = np.full((len(live), width + 1), np.inf)
    row[:, 0] = 0
    np.cumsum(ADD[h[live]], axis=1, out=row[:, 1:])
    for i in range(r.shape[1] + 1):
        if i:
            band = int(min(width + r.shape[1], slack[live].max() / LEAST_STEP)) if len(live) else 0
            lo, hi = max(0, i - band), min(width, i + band)
            code = r[live, i - 1]
            new = np.full_like(row, np.inf)
            new[:, lo] = row[:, lo] + DROP[code]
            if lo:
                new[:, lo] = np.minimum(new[:, lo], row[:, lo - 1] + SWAP[code, h[live, lo - 1]])
            for j in range(lo + 1, hi + 1):
                across = row[:, j - 1] + SWAP[code, h[live, j - 1]]
                new[:, j] = np.minimum(np.minimum(across, row[:, j] + DROP[code]), new[:, j - 1] + ADD[h[live, j - 1]])
            row = new
        ended = n[live] == i
        at = live[ended]
        out[at] = row[ended, m[at]]
        inside = ~ended & (np.where(np.arange(width + 1) <= m[live][:, None], row, np.inf).min(axis=1) <= slack[live])
        live, row = live[inside], row[inside]
        if not len(live):
            break
    return np.where(out <= slack, out, np.inf)


def length_scale(n: Column) -> Column:
    return F.sqrt(F.greatest(n, F.lit(LEAST_LENGTH)) / PIVOT_LENGTH)


def normalized_error(alignment: Column) -> Column:
    """Segmental cost over the length scale, and stress as it is."""
    return alignment["segmental"] / length_scale(alignment["ref_length"]) + alignment["stress"]


def least_distance(n: Column, m: Column) -> Column:
    """No alignment of sequences of n and m symbols costs less, after scaling."""
    return F.abs(n - m) * ADD_CONSONANT / length_scale(n)


def syllable_costs(ops: Column) -> Column:
    """array<struct<syllable, cost>>: cost of each syllable, in order."""
    ids = F.array_sort(F.array_distinct(F.transform(ops, lambda o: o["syllable"])))
    own = lambda s: F.aggregate(F.filter(ops, lambda o: o["syllable"] == s), F.lit(0.0), lambda a, o: a + o["cost"] + o["stress"])
    return F.transform(ids, lambda s: F.struct(s.alias("syllable"), own(s).alias("cost")))


def worst_syllable(ops: Column) -> Column:
    """The syllable of most cost, the first on ties; null if nothing is wrong."""
    costs = syllable_costs(ops)
    worst = F.array_min(F.transform(costs, lambda c: F.struct((-c["cost"]).alias("k"), c["syllable"].alias("syllable"))))
    return F.when(worst["k"] < 0, worst["syllable"])
