import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from lodestone.llm import merkle
from lodestone.llm.merkle import audit, derive, fold, manifest, missing, pack, proof, unpack, without_newlines

from .helpers import prose


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def row_digest(row):
    return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def climb(nodes):
    """(top, for each node its siblings level by level with its place), by whole levels."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, path in enumerate(paths):
            run = nodes[at[i] // 3 * 3 : at[i] // 3 * 3 + 3]
            path.append((at[i] % 3, run[: at[i] % 3] + run[at[i] % 3 + 1 :]))
            at[i] //= 3
        nodes = [sha("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)]
    return nodes[0], paths


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops, paths = {}, {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, row_digest(r)))
        tops[g], paths[g] = climb([row_digest(r) for r in groups[g]])
    root, above = climb([tops[g] for g in order])
    out = []
    for g, up in zip(order, above, strict=True):
        for r, path in zip(groups[g], paths[g], strict=True):
            steps = path + up
            changed = r if r[0] is None or zlib.crc32(str(r[0]).encode()) % 2 or r[4] is None else (*r[:4], r[4].replace("\n", ""))
            node = row_digest(changed)
            for place, others in steps:
                node = sha("".join([*others[:place], node, *others[place:]]))
            out.append((r[0], row_digest(r), tops[g], root, sha("".join(x for _, o in steps for x in o)), node, node == root))
    return out


def rows_of_test():
    r = random.Random(5)
    rows = [(i, "hot" if i % 3 else f"s{i % 7}", "en", 10 + i, prose(i, 12) + "\nline\n") for i in range(400)]
    rows += [(500 + i, None, None, None, None) for i in range(5)] + [(600, "", "en", 0, ""), (601, "é", "en", 0, "\n"), (602, "=", "en", 0, "x"), (603, "Z", "en", 1, "lone")]
    rows += [(7, "hot", "en", 17, "same id")] * 3 + [(7, "hot", "en", 17, f"same id {i}") for i in range(3)] + [(None, "hot", "en", 1, "no\nid"), (None, None, "en", 1, "no\nid")]
    rows += [(900, "hot", "en", 5, "equal\nrows")] * 200 + [(901, "long", "en", 9, "z\n" * 60_000)]
    r.shuffle(rows)
    return rows


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize(("leaves", "fan"), [(50_000, 64), (40, 2), (7, 3)])
def test_equals_whole_levels(spark, monkeypatch, leaves, fan):
    """Also with many partitions, whose tops take several rounds."""
    monkeypatch.setattr(merkle, "FAN", fan)
    rows = rows_of_test()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = audit(manifest(docs, offered=without_newlines(docs), leaves=leaves), "offered")
    fields = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert sorted(tuple(map(repr, (r[f] for f in fields))) for r in got.collect()) == sorted(tuple(map(repr, r)) for r in brute(rows))


def test_more_partitions_than_asked_for(spark, monkeypatch):
    """What counts is how many there are: a session may deal rows to more."""
    frame = type(spark.range(0))
    asked = frame.repartitionByRange
    monkeypatch.setattr(frame, "repartitionByRange", lambda self, n, *cols: asked(self, max(n, 40), *cols))
    monkeypatch.setattr(merkle, "FAN", 4)
    rows = rows_of_test()
    docs = spark.createDataFrame(rows, SCHEMA)
    assert all(r.verified for r in audit(manifest(docs)).collect())


def test_untampered_rows_verify(spark):
    docs = spark.createDataFrame(rows_of_test(), SCHEMA)
    assert all(r.verified for r in audit(manifest(docs)).collect())


def test_extra_columns_do_not_count(spark):
    rows = rows_of_test()[:50]
    plain = spark.createDataFrame(rows, SCHEMA)
    more = spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], f"{SCHEMA}, row int, grp string, node long, field0 string")
    assert manifest(plain).first().root == manifest(more).first().root


def test_one_row_and_empty_table(spark):
    one = audit(manifest(spark.createDataFrame([(1, "s", "en", 1, "t")], SCHEMA))).collect()
    assert len(one) == 1 and one[0].leaf == one[0].subroot == one[0].root == one[0].folded_root and one[0].proof_sha256 == sha("")
    assert audit(manifest(spark.createDataFrame([], SCHEMA))).count() == 0


@pytest.mark.parametrize("size", [1, 2, 3, 4, 9, 10, 28, 100])
def test_octopus_is_minimal_and_enough(size):
    """Any set of leaves: what is fetched, with the leaves, gives the top; without any one of it, it doesn't."""
    nodes = [sha(str(i)).encode() for i in range(size)]
    whole = defaultdict(dict, {0: dict(enumerate(nodes))})
    derive(whole, size)
    r = random.Random(size)
    for _ in range(20):
        own = sorted(r.sample(range(size), r.randrange(1, min(size, 12) + 1)))
        lacking = list(missing(np.array(own), size))
        assert len(set(lacking)) == len(lacking)

        def known(without=None):
            levels = defaultdict(dict, {0: {i: nodes[i] for i in own}})
            for level, at in lacking:  # noqa: B023
                if (level, at) != without:
                    levels[level][at] = whole[level][at]
            return levels, derive(levels, size)[1]

        levels, top = known()
        assert top is not None and top.decode() == climb([n.decode() for n in nodes])[0]
        assert all(known(x)[1] is None for x in lacking)
        for i in own:
            steps = proof(levels, i, size)
            assert fold(nodes[i], steps) == top and unpack(pack(steps)) == steps
