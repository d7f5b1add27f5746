"""Work that must not grow faster than its tables."""

import numpy as np
from pyspark.sql import functions as F

from lodestone.functions import phones
from lodestone.functions import variants as v
from lodestone.operators import similarity as sim
from lodestone.plans import catalog
from lodestone.plans.composites import judge
from lodestone.sources import jsonl


def test_blocks_are_compared_once(spark, monkeypatch):
    monkeypatch.setattr(sim, "FRAMES", 7)
    r = np.random.default_rng(3)
    clips = {c: r.normal(size=(n, 4)) for c, n in ((1, 20), (2, 7), (3, 15))}
    frames = spark.createDataFrame([(c, i, [float(x) for x in v]) for c, vs in clips.items() for i, v in enumerate(vs)], "clip int, frame int, v array<double>")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "a int, b int")
    got = sim.max_similarity(frames, frames, pairs)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    for row in got.collect():
        m = clips[row.a] @ clips[row.b].T
        assert abs(row.precision - m.max(axis=1).mean()) < 2e-6 and abs(row.recall - m.max(axis=0).mean()) < 2e-6


def test_ranges_do_not_grow_with_lines(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    for n in (20_000, 200_000):
        path = str(tmp_path / str(n))
        spark.range(n).selectExpr("to_json(struct(id)) as value").repartition(2).write.text(path)
        size = jsonl.range_bytes(spark, path, least=1_000)
        lines = jsonl.read_lines(spark, path, range_bytes=size)
        assert lines.rdd.getNumPartitions() <= 4 * cores + 2 and lines.count() == n


def test_only_distinct_words_are_sounded(spark, tmp_path):
    spark.createDataFrame([(i, "one two one") for i in range(4)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("voice_texts", "backtested_stems"):
        plan = catalog.queries()[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert "letter_sounds" in plan and "letter_sounds" not in plan[plan.index("Aggregate [word") :], name


def test_costs_without_operations(spark):
    r = np.random.default_rng(5)
    said = lambda n: " ".join(r.choice(phones.TOKENS, n))
    pairs = [(said(a), said(b)) for a, b in [(0, 0), (0, 3), (4, 0), (90, 70), *r.integers(1, 12, (300, 2))]]
    got = spark.createDataFrame(pairs, "ref string, hyp string").repartition(1).select(phones.align("ref", "hyp").alias("a"), phones.aligned_cost("ref", "hyp").alias("c")).collect()
    assert len(got) == 304 and all(x.a[:3] == tuple(x.c) for x in got)


def test_long_pairs_stand_alone():
    n = np.array([3] * 600 + [2000])
    found = list(phones._blocks(n, n))
    assert sorted(np.concatenate(found)) == list(range(601)) and [600] in [list(x) for x in found]


def test_texts_are_stripped_once(spark):
    form = F.col("form")
    frame = spark.createDataFrame([("/ˈbæ.kə/",), ("[ˈsprɪŋtən]",), ("(ˈbtkæ.kə)",), ("ab-ˈæ",), ("",), (None,)], "form string")
    judged = frame.select(v.source_ipa(form).alias("x"))
    assert judged._jdf.queryExecution().optimizedPlan().toString().count("btrim") + judged._jdf.queryExecution().optimizedPlan().toString().count("trim(both") <= 2
    assert [r.x for r in judged.collect()] == [True, True, False, False, False, False]


def test_pairs_are_judged_once(spark):
    """Repeated names and answers are aligned once, and members that bring what was heard are not grouped again."""
    members = spark.createDataFrame([(i // 3, f"i{i}", "Ab" if i % 2 else "ab", i % 3, "AE1 B" if i % 5 else "B") for i in range(60)], "row_id int, item_id string, name string, position int, hyp string")
    references = spark.createDataFrame([("ab", 0, "AE1 B"), ("ab", 1, "B")], "name string, variant int, ref string")
    got = judge(None, references, members)["members"]
    assert "min(" not in got._jdf.queryExecution().optimizedPlan().toString().split("Aggregate [name")[0]
    old = judge(members.select("item_id", "hyp"), references, members.drop("hyp"))["members"]
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(map(tuple, old.collect())) and len(rows) == 60 and {r[4] for r in rows} == {0, 1}
