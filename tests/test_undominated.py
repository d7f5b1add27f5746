"""Phonetic texts inside longer ones of their group, against all pairs."""

import random

from lodestone.operators.containment import undominated


def brute_force(rows, most):
    out = []
    for g in {g for g, _ in rows}:
        items = sorted({x for h, x in rows if h == g})
        keys = [x.replace(".", "").replace(" ", "") for x in items]
        kept = [x for i, x in enumerate(items) if keys.index(keys[i]) == i and not any(len(k) > len(keys[i]) and keys[i] in k for k in keys)]
        out += [(g, x) for x in kept[:most]]
    return sorted(out)


def test_undominated(spark):
    r = random.Random(5)
    rows = [(g, f"ˈ{g}" * (g < "c") + "".join(r.choice("æb. ") for _ in range(r.randrange(0, 7)))) for g in "abcd" for _ in range(40)]
    rows += [("e", ""), ("f", " "), ("f", "."), ("g", "b")]
    got = undominated(spark.createDataFrame(rows, "head string, item string"), "head", "item", 3)
    assert sorted(map(tuple, got.collect())) == brute_force(rows, 3)


def test_no_group_is_gathered(spark):
    """20,000 texts of one group: pairs of them would be 400 million, in one task."""
    rows = spark.range(20_000).selectExpr("'x' as head", "concat('ˈx', lpad(id, 6, '0')) as item").unionAll(spark.sql("select 'x', 'ˈx00'"))
    got = undominated(rows, "head", "item", 3)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_" not in plan and sorted(r.item for r in got.collect()) == [f"ˈx{i:06d}" for i in range(3)]


def test_words_over_all_tasks(spark):
    """Few bytes with much work for each stay apart: Spark would put their partitions together."""
    from lodestone.plans.registry import Tables
    from lodestone.plans.variants import vocabulary

    words = vocabulary(Tables(spark, "/root/testdata/sf0.001"))
    assert words.count() and words.rdd.getNumPartitions() == 4
