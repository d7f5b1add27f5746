"""Names within texts, fuzzy titles, spans of frames and medians, each against a plain search."""

import random
import re
import statistics
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lodestone.operators import aggregates as a
from lodestone.operators.containment import contained_names
from lodestone.operators.frames import aligned_spans, segments
from lodestone.operators.titles import best_matches, first_source, similar_texts
from lodestone.operators.windows import cumulative

squeeze = lambda x: re.sub("[^a-z0-9]+", "", (x or "").lower())


@pytest.mark.parametrize("block_bytes", [8 << 20, 40])
def test_contained_names(spark, block_bytes):
    texts = [(1, "The Big-Apple tree and ABRACADABRA", "big apple"), (2, None, "x"), (3, "abracadabra " * 5, None), (4, "", ""), (5, "cadabra", "abracadabra"), (6, "nothing here", "z")]
    names = ["bigapple", "Big Apple", "apple-tree", "cadabra", "abra", "ABRACADABRA", "", None, "treeand", "cadabraabra"]
    got = contained_names(spark.createDataFrame(texts, "id int, text string, own string"), ["id"], "text", "own", spark.createDataFrame([(x,) for x in names], "other string"), "other", 6, block_bytes)
    want = {(i, x) for i, t, o in texts for x in names if x and len(squeeze(x)) >= 6 and squeeze(x) in squeeze(t) and squeeze(x) not in squeeze(o)}
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 5


def test_a_hundred_thousand_names(spark):
    names = spark.range(100_000).select(F.concat(F.lit("name"), F.lpad(F.col("id").cast("string"), 6, "0"), F.lit("x")).alias("n"))
    texts = spark.range(50).select(F.col("id").alias("k"), F.concat(F.lit("see name 0"), F.lpad((F.col("id") * 1999).cast("string"), 5, "0"), F.lit("-x ok")).alias("t"), F.lit("").alias("o"))
    got = contained_names(texts, ["k"], "t", "o", names, "n", 6, 300_000)
    assert sorted(map(tuple, got.collect())) == [(i, f"name{i * 1999:06d}x") for i in range(50)]


def ratio(x, y):
    return SequenceMatcher(None, x, y).ratio()


def texts_near(r, n, alphabet="abcd "):
    base = ["".join(r.choice(alphabet) for _ in range(r.randrange(1, 26))) for _ in range(n)]
    out = set(base)
    for t in base:
        for _ in range(3):
            x = list(t)
            for _ in range(r.randrange(1, 4)):
                at = r.randrange(len(x) + 1)
                x[at : at + r.randrange(2)] = r.choice(["", r.choice(alphabet)])
            out.add("".join(x))
    return sorted(out)


@pytest.mark.parametrize("least", [0.85, 0.81, 0.95])
def test_no_similar_pair_is_lost(spark, least):
    r = random.Random(7)
    left, right = texts_near(r, 60), texts_near(r, 60)
    right += left[::3]
    got = similar_texts(spark.createDataFrame([(x,) for x in left], "l string"), spark.createDataFrame([(x,) for x in right], "r string"), least)
    want = {(x, y): ratio(x, y) for x in left if x for y in right if y and ratio(x, y) >= least}
    found = {(x.l, x.r): x.ratio for x in got.collect()}
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k]) for k in want) and len(want) > 100
    with pytest.raises(ValueError, match="above 0.8"):
        similar_texts(got.select("l"), got.select("r"), 0.8)


def test_best_matches_and_sources_in_turn(spark):
    targets = spark.createDataFrame([("Kolartimib",), ("velorin tamate",), ("none like it",), ("",)], "t string")
    one = spark.createDataFrame([("KOLARTIMIB and other words behind", "kolartimib"), ("kolartimib-trihydrate-x", "kolartimib-trihydrate-x"), ("Kolartimib!", "other")], "title string, slug string")
    two = spark.createDataFrame([("velorin  Tamate", "x"), ("kolartimib", "y"), (None, "z")], "title string, slug string")
    best = {r.t: (r.title, r.slug, round(r.ratio, 3)) for r in best_matches(targets, "t", one, ["title", "slug"]).collect()}
    assert best == {"Kolartimib": ("KOLARTIMIB and other words behind", "kolartimib", 1.0)}
    hits, misses = first_source(targets, "t", [("one", one), ("two", two)], ["title", "slug"])
    assert sorted((r.t, r.source) for r in hits.collect()) == [("Kolartimib", "one"), ("velorin tamate", "two")]
    assert sorted((r.t, r.missed) for r in misses.collect()) == sorted([("", ["one", "two"]), ("velorin tamate", ["one"]), ("none like it", ["one", "two"])])


def brute_spans(labels, scores, tokens, seconds, pad=0.03, most=0.15):
    runs, before = [], None
    for i, x in enumerate(labels):
        if x == before:
            runs[-1][2] = i + 1
        else:
            runs.append([x, i, i + 1])
        before = x
    runs = [r for r in runs if r[0] is not None and r[0] != "-"]
    wanted = [i for i, (_, w) in enumerate(tokens) if w]
    if [r[0] for r in runs] != [t for t, _ in tokens] or not wanted:
        return None
    stride = seconds / len(labels)
    a, z = wanted[0], wanted[-1]
    begin, end = runs[a][1], runs[z][2]
    start = max(0.0, begin * stride - pad) if a == 0 else begin * stride - min((begin - runs[a - 1][2]) / 2 * stride, most)
    stop = min(seconds, end * stride + pad) if z == len(runs) - 1 else end * stride + min((runs[z + 1][1] - end) / 2 * stride, most)
    own = [scores[f] for i in wanted for f in range(runs[i][1], runs[i][2])]
    return start, stop, sum(own) / len(own)


def test_spans_of_frames(spark):
    r = random.Random(9)
    frames, tokens, lengths, want = [], [], [], {}
    for clip in range(60):
        said = [r.choice("abc") for _ in range(r.randrange(0, 6))]
        labels = ["-"] * r.randrange(3)
        for x in said:
            labels += [x] * r.randrange(1, 4) + ["-"] * r.randrange(0 if clip % 2 else 1, 6)
        scores = [round(r.random(), 3) for _ in labels]
        marks = [(x, r.random() < 0.6) for x in said]
        if clip % 7 == 0 and marks:
            marks = marks[:-1]  # not what was said
        seconds = 0.08 * len(labels) + 0.01
        frames += [(clip, i, x, s) for i, (x, s) in enumerate(zip(labels, scores, strict=True))]
        tokens += [(clip, i, x, w) for i, (x, w) in enumerate(marks)]
        lengths.append((clip, seconds, len(labels)))
        if (span := brute_spans(labels, scores, marks, seconds)) is not None:
            want[clip] = span
    found = segments(spark.createDataFrame(frames, "clip int, frame long, label string, p double").repartition(4), ["clip"], "frame", "label", "p", "-")
    got = aligned_spans(found, spark.createDataFrame(tokens, "clip int, place int, label string, wanted boolean"), spark.createDataFrame(lengths, "clip int, seconds double, frames long"), ["clip"])
    rows = {x.clip: (x.from_s, x.to_s, x.score) for x in got.collect()}
    assert rows.keys() == want.keys() and len(want) > 20
    assert all(rows[c] == pytest.approx(want[c]) for c in want)


@pytest.mark.parametrize("most", [1 << 18, 100])
def test_medians_of_a_hot_group(spark, monkeypatch, most):
    """One group holds most rows, all different: its values stand in several partitions."""
    monkeypatch.setattr(a, "cumulative", lambda *args: cumulative(*args, most=most))
    r = random.Random(4)
    rows = [("hot", r.random()) for _ in range(3000)] + [("odd", float(x)) for x in (5, 1, 3)] + [("even", 1.0), ("even", 4.0), ("none", None), (None, 2.0), (None, 2.0)] + [("same", 7.0)] * 50
    frame = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = {x.g: x.median for x in a.medians(frame, ["g"], "v").collect()}
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    assert got == pytest.approx({g: statistics.median(v) for g, v in groups.items()})


def test_best_names_query(spark):
    """The query against all pairs of names."""
    from lodestone.plans import catalog

    folder = "/root/testdata/sf0.01"
    names = sorted({x.p_name for x in spark.read.parquet(f"{folder}/part.parquet").select("p_name").distinct().collect()})
    norm = lambda x: re.sub(r"[\s_-]+", " ", x.strip().lower())
    got = {x.target: (x.title, x.slug, x.ratio) for x in catalog.queries()["best_names"](spark, folder).collect()}
    want = {}
    for n in names:
        scored = []
        for title in names:
            slug = re.sub("[^a-z0-9]+", "-", f"{title} salt".lower()).strip("-")
            scored.append((-max(ratio(norm(n + "s"), norm(title)), ratio(norm(n + "s"), norm(slug))), title, slug))
        least = min(scored)
        if -least[0] >= 0.85:
            want[n + "s"] = (least[1], least[2], pytest.approx(-least[0]))
    assert got == want and len(got) > 50
