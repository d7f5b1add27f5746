import re

import pytest

from lodestone.llm.decontaminate import decontaminate, item_blocks, items_digest, joined, mark_contaminated

from .helpers import awkward_docs, docs_frame, empty_frame, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def brute_force(rows, items, window=13):
    owners = {}
    for i, t in items:
        w = words(t)
        if i is not None and w:
            for j in range(max(1, len(w) - window + 1)):
                owners.setdefault(tuple(w[j : j + window]), set()).add(i)
    out = []
    for d, t in rows:
        w = words(t)
        hit, found = set(), set()
        for n in {len(p) for p in owners}:
            for j in range(len(w) - n + 1):
                if o := owners.get(tuple(w[j : j + n])):
                    found |= o
                    hit |= set(range(j, j + n))
        out.append((d, len(w), len(hit), len(found), items_digest(sorted(found)), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def shown(frame):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in frame.collect()), key=str)


def near_brute_force(rows, items, window=13, slop=2):
    """Items of each document with a proximity match and no exact one."""
    phrases = [(i, w[j : j + window]) for i, t in items if i is not None and (w := words(t)) for j in range(max(1, len(w) - window + 1))]
    out = []
    for d, t in rows:
        w = words(t)
        places = {}
        for j, x in enumerate(w):
            places.setdefault(x, []).append(j)
        near, exact = set(), set()
        for i, p in phrases:
            if not all(x in places for x in p):
                continue
            if any(w[b : b + len(p)] == p for b in range(len(w))):
                exact.add(i)
            for b in range(-slop, len(w) + slop):
                if all(any(abs(q - b - n) <= slop for q in places[x]) for n, x in enumerate(p)):
                    near.add(i)
                    break
        out.append((d, sorted(near - exact)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [1 << 20, 100])
def test_equals_brute_force(spark, block_bytes):
    rows = awkward_docs()
    items = [(1, prose(50, 40)), (2, rows[0][1][40:300]), (3, "one"), (4, ""), (5, None), (None, "one"), (6, "A-B c/d"), (2, rows[0][1][40:300]), (7, " ".join(rows[1][1].split()[20:33]))]
    rows += [(500, "begin " + items[0][1].upper() + " end"), (501, prose(1, 700) + " " + prose(50, 40)[:150]), (502, "not " + prose(50, 12))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate(docs_frame(spark, rows), bench, block_bytes=block_bytes)
    assert shown(got) == brute_force(rows, items)


def test_proximity(spark):
    item = " ".join(f"word{i}" for i in range(13))
    text = "x " + " ".join(f"word{i}" + (" extra" if i == 6 else "") for i in range(13))
    r = decontaminate(docs_frame(spark, [(1, text)]), spark.createDataFrame([(9, item)], "item_id long, text string")).collect()[0]
    assert (r.n_items, r.n_near, r.n_hit) == (0, 1, 0)


@pytest.mark.parametrize(("block_bytes", "parts"), [(1 << 20, 1), (1 << 20, 7), (150, 2)])
def test_proximity_equals_brute_force(spark, block_bytes, parts):
    """Near matches lie within one document, wherever the rows are dealt and whatever stands beside them."""
    items = [(i, prose(60 + i, 13 + i)) for i in range(6)] + [(10, "aa bb"), (11, "cc aa bb dd cc"), (12, "aa aa bb")]
    bases = [words(t) for _, t in items]
    rows = []
    for i, w in enumerate(bases):
        rows += [(100 + i, " ".join(w[1:])), (200 + i, " ".join(w[:4] + ["new"] + w[4:])), (300 + i, " ".join(w[:3] + w[4:5] + w[3:4] + w[5:]))]
        rows += [(400 + i, " ".join(w[: len(w) // 2])), (500 + i, " ".join(w[len(w) // 2 :])), (600 + i, "x y " + " ".join(w[:5] + ["p", "q", "r"] + w[5:]))]
    rows += [(700, "bb"), (701, "aa"), (702, "aa zz zz bb"), (703, "aa zz zz zz zz bb"), (704, "bb aa"), (705, None), (706, ""), (None, "bb x aa")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate(docs_frame(spark, rows).coalesce(1).repartition(parts), bench, block_bytes=block_bytes).collect()
    assert sorted(((r.doc_id, sorted(r.near_ids)) for r in got), key=str) == near_brute_force(rows, items)
    assert all(r.n_near == len(r.near_ids) for r in got)


def test_column_names_clash(spark):
    """Columns of the input that share a name with the operator's own are not read."""
    docs = docs_frame(spark, [(1, prose(1, 30))]).selectExpr("doc_id", "text", "5 as row", "'x' as n_words", "1 as starts", "2 as item_ids")
    r = decontaminate(docs, spark.createDataFrame([(9, prose(1, 30), 3)], "item_id long, text string, block int")).collect()
    assert [(x.doc_id, x.n_words, x.n_items) for x in r] == [(1, 30, 1)]


def test_whole_table_equals_brute_force(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert shown(decontaminate(docs, bench)) == brute_force(rows, [(r.item_id, r.text) for r in bench.collect()])


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(empty_frame(spark), none).collect() == []
    assert all(r.n_hit == 0 for r in decontaminate(docs_frame(spark), none).collect())


def bench_frame(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_marks_equal_brute_force(spark, block_bytes):
    """The verdict found in the text's own pass, with one block of items and with many."""
    passage = prose(70, 40)
    rows = awkward_docs() + [(600 + i, f"{prose(80 + i, 30 * i)} {passage if i % 2 else prose(3, 9)} {prose(90, 5)}") for i in range(12)]
    items = [(1, passage), (2, prose(0, 120)), (3, "ka lo"), (3, prose(90, 5)), (4, None), (None, prose(1, 50)), (5, "a b c d")]
    want = sorted((str(d), t or "", bad) for (d, t), bad in zip(rows, [brute_force([r], items)[0][-1] for r in rows], strict=True))
    got = mark_contaminated(docs_frame(spark, rows), bench_frame(spark, items), block_bytes=block_bytes).collect()
    assert sorted((str(r.doc_id), r.text or "", r.contaminated) for r in got) == want
    assert {r.source for r in got} == {"src0"} and mark_contaminated(empty_frame(spark), bench_frame(spark, items)).count() == 0


def test_an_item_id_that_repeats_very_often(spark):
    """Copies of an item are one item; different texts of one id are dealt over blocks."""
    copies = bench_frame(spark, [(1, prose(70, 40))] * 500 + [(2, prose(100 + i, 30)) for i in range(200)])
    blocks = list(item_blocks(copies, 13, 4000))
    assert len(blocks) > 3 and sum(len(set(b.owners.tolist()) & {2}) for b in blocks) > 3
    rows = [(i, f"{prose(i + 100, 30)} tail {prose(70, 40)}") for i in range(20)]
    items = [tuple(r) for r in copies.distinct().collect()]
    assert shown(decontaminate(docs_frame(spark, rows), copies, block_bytes=4000)) == brute_force(rows, items)


def test_joined_spans():
    assert joined([5, 9, 0, 2, 8, 12, 12, 13, 20, 21]) == [0, 2, 5, 13, 20, 21]


def test_index_in_small_row_groups(spark, tmp_path, monkeypatch):
    """A reader takes up to 4096 rows of a row group at once, and a segment's row has megabytes."""
    import pyarrow.parquet as pq

    from lodestone.llm import common

    monkeypatch.setattr(common, "shared_path", lambda spark, name: str(tmp_path / name))
    text = "array_join(transform(sequence(1, 200000), x -> concat('w', id, 'x', x)), ' ') as text"
    docs = spark.range(16).selectExpr("id as doc_id", text).coalesce(1)
    items = spark.createDataFrame([(1, " ".join(f"w3x{i}" for i in range(70, 83)))], "item_id long, text string")
    found = decontaminate(docs, items).where("n_items > 0").select("doc_id", "n_hit").collect()
    (file,) = (tmp_path / "op9-index").glob("*.parquet")
    index = pq.ParquetFile(file).metadata
    assert [tuple(r) for r in found] == [(3, 13)]
    assert max(index.row_group(i).total_byte_size for i in range(index.num_row_groups)) <= 16 << 20
