import math
import random

import numpy as np
import pytest

from lodestone.functions import phones
from lodestone.operators.nearest import Tally, nearest_names
from lodestone.plans.phonetics import LETTERS


def all_costs(codes, x):
    others = [y for y in codes if y != x]
    table, _, n, _, m = phones.cost_tables([codes[x]] * len(others), [codes[y] for y in others])
    scale = math.sqrt(max(len(codes[x]), phones.LEAST_LENGTH) / phones.PIVOT_LENGTH)
    return sorted((float(table[i, a, b]) / scale, y) for i, (y, a, b) in enumerate(zip(others, n, m, strict=True)))


def words_of(spark, n):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").limit(400).collect()
    words = sorted({w for r in docs for w in (r.text or "").lower().split() if w.isascii() and w.isalpha() and 3 <= len(w) <= 14})
    return random.Random(3).sample(words, n)


def compare(spark, names, tally=None, **how):
    refs = {x: " ".join(LETTERS[c] for c in x if c.isalpha()) for x in names}
    codes = {x: phones.parse(t) for x, t in refs.items()}
    found = nearest_names(spark.createDataFrame(list(refs.items()), "item string, ref string"), "item", "ref", 3, tally=tally, **how).collect()
    got = {(r.item, r.place): (r.distance, r.neighbour) for r in found}
    for x in names:
        for place, (distance, _) in enumerate(all_costs(codes, x)[:3], 1):
            assert got[x, place][0] == pytest.approx(distance)
    assert len(got) == sum(min(3, len(names) - 1) for _ in names)


def test_equals_all_pairs_and_aligns_few(spark):
    names = words_of(spark, 900)
    tally = Tally(spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0))
    compare(spark, names, tally, block=64)
    assert 0 < tally.ended.value < 0.1 * len(names) ** 2
    assert tally.begun.value < 0.75 * len(names) ** 2


def test_part_names_and_short_ones(spark):
    names = [r.p_name for r in spark.read.parquet("/root/testdata/sf0.001/part.parquet").select("p_name").distinct().collect()]
    compare(spark, [*names, "a", "", "small old new red blue plate widget"], block=8, slice_rows=5)
    compare(spark, ["ab", "ba"])


def test_most_blocks_and_empty(spark):
    compare(spark, words_of(spark, 120), most_blocks=3, block=4)
    assert nearest_names(spark.createDataFrame([], "item string, ref string"), "item", "ref", 3).count() == 0


def test_bounds_hold_and_ceilings_cut():
    r = random.Random(1)
    refs, hyps = ([[r.randrange(len(phones.TOKENS)) for _ in range(r.randrange(0, 12))] for _ in range(400)] for _ in range(2))
    table, _, n, _, m = phones.cost_tables(refs, hyps)
    cost = table[np.arange(400), n, m]
    least = phones.least_costs(phones.symbol_counts(refs), phones.symbol_counts(hyps))
    assert (np.diag(least) <= cost + 1e-9).all() and np.diag(least).mean() > 0.3 * cost.mean()
    for ceiling in (0.0, 1.0, 3.0, 8.0, 99.0):
        got = phones.bounded_costs(refs, hyps, np.full(400, ceiling))
        assert np.allclose(got, np.where(cost <= ceiling + 1e-9, cost, np.inf))
    mixed = np.array([r.random() * 6 for _ in range(400)])
    assert np.allclose(phones.bounded_costs(refs, hyps, mixed), np.where(cost <= mixed + 1e-9, cost, np.inf))
