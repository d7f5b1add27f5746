import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm.neardup import components, near_duplicates

from .helpers import awkward_docs, docs_frame, edited, empty_frame, prose

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def brute_force(rows):
    sets = []
    for _, t in rows:
        w = SPACE.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("block", [512, 3])
def test_equals_brute_force(spark, block):
    rows = awkward_docs()
    got = near_duplicates(docs_frame(spark, rows), block_docs=block).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_force(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("block", [512, 16])
def test_large_groups_equal_brute_force(spark, block):
    """Groups of different near texts, linked and unlinked, cut into slices, buckets and blocks."""
    rows = []
    for g in range(4):
        base = prose(700 + g, 160)
        for i in range(40):
            rows.append((1000 * g + i, edited(base, 50 * g + i, (30, 45, 60, 90)[i % 4])))
        rows += [(None, edited(base, 9, 80)), (None, base), (None, base), (1000 * g + 3, base)]
    got = near_duplicates(docs_frame(spark, rows), block_docs=block).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_force(rows)


def test_equal_half_digests_are_told_apart(spark, monkeypatch):
    """Sets whose first 64 digest bits are equal are not merged."""
    import lodestone.llm.neardup as neardup

    full = neardup._set_digest
    monkeypatch.setattr(neardup, "_set_digest", lambda s: (full(s)[0] % 5, full(s)[1]))
    rows = awkward_docs()[:60]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.monotonically_increasing_id())
    texts = neardup.materialize(docs, "clash")
    local = [neardup.shingle_sets(*neardup.k.text_buffer(pa.array([t], pa.string())), 5)[0] for _, t in rows]
    assert len({neardup._set_digest(s)[0] for s in local if len(s)}) < len({full(s) for s in local if len(s)})
    fake = texts.collect()
    table = [(r.row, r.doc_id, len(s), *(neardup._set_digest(s) if len(s) else (None, None)), [1] if len(s) else None) for r in fake for s in neardup.shingle_sets(*neardup.k.text_buffer(pa.array([r.text], pa.string())), 5)]
    sketches = spark.createDataFrame(table, "row long, doc_id long, n_shingles long, node long, check long, keys array<long>")
    monkeypatch.setattr(neardup, "sketch", lambda *a: sketches)
    got = neardup.near_duplicates(texts, row="row").collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_force(rows)


def test_permutations():
    from lodestone.llm.neardup import RING, _permutations, ring_place

    assert all(np.array_equal(np.sort(p), np.arange(RING)) for p in _permutations())
    assert np.array_equal(np.sort(ring_place(np.arange(RING, dtype=np.uint64))), np.arange(RING))


def test_whole_table_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_force(rows)


def test_empty_table(spark):
    assert near_duplicates(empty_frame(spark)).collect() == []


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(400)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert len({got[i] for i in range(401)}) == 1 and got[1000] == got[1001] != got[0]


def test_stars_meet_in_one_round(spark, monkeypatch):
    """Nodes around least ones are one round's work, and few edges that are left need no more rounds."""
    import lodestone.llm.neardup as neardup

    stored, write = [], neardup.materialize
    monkeypatch.setattr(neardup, "materialize", lambda df, name, *a: stored.append(name) or write(df, name, *a))
    stars = [(1000 * s + i, 1000 * s) for s in range(3) for i in range(1, 300)]
    edges = spark.createDataFrame([*stars, (1005, 0), (1006, 0), (5001, 5000)], "a long, b long")
    want = {x: 0 if x < 2000 else 1000 * (x // 1000) for e in [*stars, (5001, 5000)] for x in e}
    assert {r.node: r.root for r in components(edges).collect()} == want
    assert sum("-step" in name for name in stored) == 1 and sum("-last" in name for name in stored) == 1
    stored.clear()
    assert {r.node: r.root for r in components(edges, last=0).collect()} == want
    assert sum("-step" in name for name in stored) <= 3 and not any("-last" in name for name in stored)


def test_rising_chain_takes_few_rounds(spark, monkeypatch):
    """Numbers that rise along a chain don't cost a round for each node, without the small task too."""
    import lodestone.llm.neardup as neardup

    stored, write = [], neardup.materialize
    monkeypatch.setattr(neardup, "materialize", lambda df, name, *a: stored.append(name) or write(df, name, *a))
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    roots = [r.root for r in components(edges, last=0).collect()]
    assert len(roots) == 201 and len(set(roots)) == 1
    assert sum("-step" in name for name in stored) <= 24
