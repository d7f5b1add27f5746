import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lodestone.llm.hmm import Counts, Model, Packed, carry, cut_runs, count_words, encode, expected_counts, first_model, score_texts, text_groups, train, vocabulary

from .helpers import awkward_docs, docs_frame, empty_frame, prose

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def small_model(r, symbols=5, states=3):
    norm = lambda a, axis: a / a.sum(axis=axis, keepdims=True)
    return Model(norm(r.random(states), 0), norm(r.random((states, states)), 1), norm(r.random((symbols, states)), 0))


def test_forward_and_counts_equal_enumeration():
    r = np.random.default_rng(1)
    m = small_model(r)
    lengths = [3, 1, 5, 2]
    offsets = np.cumsum([0, *lengths])
    ids = r.integers(0, 5, offsets[-1])
    got = Packed(ids, offsets)
    totals = Counts(5, 3)
    got.expected(m, totals)
    like, start, move, emit = [], np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        x = ids[a:b]
        paths = {}
        for z in np.ndindex(*[3] * len(x)):
            p = m.start[z[0]] * m.emit[x[0], z[0]]
            for i in range(1, len(x)):
                p *= m.move[z[i - 1], z[i]] * m.emit[x[i], z[i]]
            paths[z] = p
        total = sum(paths.values())
        like.append(math.log10(total))
        for z, p in paths.items():
            start[z[0]] += p / total
            for i, s in enumerate(z):
                emit[x[i], s] += p / total
                if i:
                    move[z[i - 1], s] += p / total
    assert np.allclose(got.log10_likelihood(m), like)
    assert np.allclose(totals.start, start) and np.allclose(totals.move, move) and np.allclose(totals.emit, emit)


def test_runs():
    cut, pieces = cut_runs(np.array([0, 5, 5, 7]), 2)
    assert cut.tolist() == [0, 2, 4, 5, 7] and pieces.tolist() == [3, 0, 1]


def test_runs_give_the_counts_of_whole_texts():
    """Forward and backward values are carried over borders: nothing differs from uncut texts."""
    r = np.random.default_rng(4)
    m = small_model(r)
    offsets = np.cumsum([0, 40, 1, 7, 33])
    ids = r.integers(0, 5, offsets[-1])
    whole, cut = Counts(5, 3), Counts(5, 3)
    Packed(ids, offsets).expected(m, whole)
    bounds, pieces = cut_runs(offsets, 4)
    packed = Packed(ids, bounds)
    carried = carry(packed, pieces, m)
    packed.expected(m, cut, carried)
    for name in ("start", "move", "emit", "log10"):
        assert np.allclose(getattr(whole, name), getattr(cut, name))
    likelihoods = np.bincount(np.repeat(np.arange(4), pieces), packed.log10_likelihood(m, carried.begin))
    assert np.allclose(likelihoods, Packed(ids, offsets).log10_likelihood(m))
    grouped = Counts(5, 3)
    for _, p, c, _ in text_groups(ids, offsets, m, 3):
        p.expected(m, grouped, c)
    assert np.allclose(whole.emit, grouped.emit) and np.allclose(whole.start, grouped.start) and np.allclose(whole.move, grouped.move)


def test_a_round_counts_all_partitions(spark):
    """A distributed round equals one over all texts in one place; rounds raise the likelihood."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(5)
    rows = docs.selectExpr("doc_id as row", "doc_id", "false as held_out", "text")
    v = vocabulary(count_words(rows.select("text")), rows.count(), 5000)
    encoded = encode(rows, v).select("row", "drawn", "symbols").cache()
    model, seen = train(encoded, v, 4, 2, 0.5, 0, 4, -1.0, 5.0, 512)
    assert len(seen) == 4 and all(a < b for a, b in zip(seen[:-1], seen[1:], strict=True))
    got = expected_counts(encoded, model, v.end + 1, 512)
    texts = [np.array(r.symbols) for r in encoded.orderBy(F.col("row")).collect()]
    want = Counts(v.end + 1, 4)
    Packed(np.concatenate(texts), np.cumsum([0, *map(len, texts)])).expected(model, want)
    assert np.allclose(got.emit, want.emit, rtol=1e-4, atol=1e-4) and np.allclose(got.move, want.move, rtol=1e-4) and np.allclose(got.start, want.start, rtol=1e-4, atol=1e-4)
    encoded.unpersist()


def brute_base(rows):
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    words = [SPACE.findall((t or "").translate(LOWER)) + [None] for _, t in rows]
    c = Counter(w for (d, _), ws in zip(rows, words, strict=True) if not held(d) for w in ws)
    n, v = sum(c.values()), len(c)
    out = []
    for (d, _), ws in zip(rows, words, strict=True):
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)
        out.append((d, held(d), len(ws), sum(c[w] > 0 for w in ws), n, round(base, 4)))
    return sorted(out, key=str)


def shown(frame):
    rows = frame.collect()
    assert all(math.isfinite(r.score) and r.score <= 0 for r in rows)
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows), key=str)


def test_base_scores_equal_brute_force(spark):
    rows = awkward_docs()
    for most in (65_536, 20, 0):
        assert shown(score_texts(docs_frame(spark, rows), states=3, most_words=most, warm_rounds=1, most_rounds=1)) == brute_base(rows)


def test_score_is_a_distribution(spark):
    """Probabilities of all texts over the known words up to a length sum to less than one, and grow."""
    rows = [(i, t) for i, t in enumerate(["a b", "b a a", "a", "b b c", "", "c a"] * 4)]
    vocabulary = ["a", "b", "c"]
    probes = [""] + vocabulary + [f"{x} {y}" for x in vocabulary for y in vocabulary]
    probes += [f"{p} {z}" for p in probes if " " in p for z in vocabulary]
    extra = [(j, t) for j, t in zip((x for x in range(1000, 9000) if zlib.crc32(str(x).encode()) % 7 == 2), probes, strict=False)]
    got = {r.doc_id: r.score for r in score_texts(docs_frame(spark, rows + extra), states=2, most_words=10).collect()}
    total = sum(10 ** got[d] for d, _ in extra)
    assert 0.5 < total < 1


def test_better_than_unigrams_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = score_texts(docs).where("held_out").selectExpr("sum(score) s", "sum(base_score) b", "sum(n_tokens) n").first()
    assert r.s / r.n > r.b / r.n + 0.05


def trained(spark, texts, states=4):
    frame = docs_frame(spark, list(enumerate(texts))).selectExpr("doc_id as row", "doc_id", "false as held_out", "text")
    v = vocabulary(count_words(frame.select("text")), len(texts), 1000)
    return train(encode(frame, v).select("row", "drawn", "symbols"), v, states, 4, 1 / 16, 1 << 20, 6, -1.0, 5.0, 512)


@pytest.mark.parametrize("n", [1, 2, 10, 40])
def test_states_part_on_small_tables(spark, n):
    """Few texts are all in the warm share: no state ends up like another, and likelihood grows."""
    model, seen = trained(spark, [prose(s, 60) for s in range(n)])
    for a in range(4):
        for b in range(a):
            assert np.abs(model.emit[:, a] - model.emit[:, b]).sum() > 0.05
    assert np.ptp(model.move) > 0.05 and seen[-1] > seen[0]


def test_a_share_without_texts_leaves_the_model(spark):
    frame = docs_frame(spark, [(i, prose(i, 30)) for i in range(3)]).selectExpr("doc_id as row", "doc_id", "false as held_out", "text")
    v = vocabulary(count_words(frame.select("text")), 3, 1000)
    encoded = encode(frame, v).select("row", "drawn", "symbols")
    model, _ = train(encoded, v, 3, 2, 0.0, 0, 0, 0.0, 5.0, 512)
    assert np.allclose(model.emit, first_model(v, 3).emit)


def test_scores_do_not_follow_the_layout(spark):
    """The same rows in one file or many, in another order: the same scores."""
    rows = [(i, prose(i, 80)) for i in range(120)] + [(7, prose(7, 80)), (None, "no id"), (500, None)]
    frame = docs_frame(spark, rows)
    shown = lambda f: sorted((str(r.doc_id), r.n_tokens, r.score) for r in score_texts(f, states=4, warm_tokens=2000).collect())
    one, many = shown(frame.coalesce(1)), shown(frame.repartition(7, "n_chars"))
    assert [x[:2] for x in one] == [x[:2] for x in many]
    assert np.allclose([x[2] for x in one], [x[2] for x in many], rtol=1e-9)


def test_clashing_columns(spark):
    frame = docs_frame(spark, [(i, prose(i, 20)) for i in range(5)])
    more = frame.selectExpr("*", "1 as row", "'x' as symbols", "2 as h", "3 as drawn", "true as held_out")
    assert shown(score_texts(more, states=2)) == shown(score_texts(frame, states=2))


def test_empty(spark):
    assert score_texts(empty_frame(spark)).collect() == []
