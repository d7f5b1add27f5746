import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import loops
from lodestone.operators.loops import Rounds, accepted_phrases, hill_climb, retry_variants


def climb_frame(spark, n=40):
    r = random.Random(1)
    rows = [(f"k{i}", "", r.choice([None, 0.0, 0.3, 0.9])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "key string, form string, score double")


def value(form):
    return round(random.Random(form).random(), 3)


def trial(key, n):
    """A key's proposal in a round, at times that of the first round again."""
    return f"{key}-{n if n % 3 else 1}"


def steps_of(spark, rounds, seen):
    def step(n):
        def propose(state):
            keys = [r.key for r in state.collect()]
            seen.setdefault(n, []).append(sorted(keys))
            return spark.createDataFrame([(k, trial(k, n)) for k in keys], "key string, form string")

        return propose

    return [step(n) for n in range(1, rounds + 1)]


def scorer(spark):
    def score(forms):
        rows = [(r.key, r.form, value(r.form)) for r in forms.collect()]
        return spark.createDataFrame(rows, "key string, form string, score double")

    return score


def brute_climb(rows, rounds, goal, gain):
    out = []
    for key, form, score in rows:
        at = 0
        for n in range(1, rounds + 1):
            if score is None or score >= goal:
                break
            new = trial(key, n)
            if new != form and value(new) > score + gain:
                form, score, at = new, value(new), n
        out.append((key, form, score, at))
    return sorted(out)


@pytest.mark.parametrize(("killed", "gain"), [(0, 0.0), (3, 0.05), (5, 0.05)])
def test_five_rounds_and_a_killed_loop(spark, tmp_path, killed, gain):
    rows, frame = climb_frame(spark)
    folder, seen = f"{tmp_path}/climb", {}
    steps = steps_of(spark, 5, seen)
    if killed:

        def dead(state):
            raise KeyboardInterrupt

        with pytest.raises(KeyboardInterrupt):
            hill_climb(frame, "key", [*steps[: killed - 1], dead], scorer(spark), 0.8, gain, folder)
    got = hill_climb(frame, "key", steps, scorer(spark), 0.8, gain, folder)
    assert sorted(map(tuple, got.collect())) == brute_climb(rows, 5, 0.8, gain)
    assert all(len(calls) == 1 for calls in seen.values())  # no round is run twice
    assert all(set(seen[n + 1][0]) <= set(seen[n][0]) for n in range(1, 5))
    again = hill_climb(frame, "key", steps, scorer(spark), 0.8, gain, folder)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got.collect())) and all(len(c) == 1 for c in seen.values())


def test_a_part_that_was_cut_off_is_made_again(spark, tmp_path):
    kept = Rounds(spark, f"{tmp_path}/r")
    made = []

    def make():
        made.append(1)
        return spark.range(5)

    assert kept.part(0) is None and kept.run(0, make).count() == 5 and kept.run(0, make).count() == 5 and len(made) == 1
    spark.range(3).write.mode("overwrite").parquet(f"{tmp_path}/r/part=0")  # not what the mark says
    assert kept.part(0) is None and kept.run(0, make).count() == 5 and len(made) == 2
    spark.range(2).write.parquet(f"{tmp_path}/r/part=1")  # a part without a mark
    assert kept.part(1) is None


def test_plans_do_not_grow(spark):
    """The last round's rows are read from its part, whatever the number of rounds."""
    _, frame = climb_frame(spark)
    plans = []
    for rounds in (1, 3):
        got = hill_climb(frame, "key", [lambda s: s.select("key", F.lit("x").alias("form"))] * rounds, lambda f: f.withColumn("score", F.lit(0.1)), 0.8)
        plans.append(got._jdf.queryExecution().optimizedPlan().toString().count("Relation"))
    assert plans == [2, 4]


def test_retry_walks(spark):
    rows = spark.createDataFrame([("a", ["p", "q"], 0.1), ("b", ["p", "q"], 0.9), ("c", ["p"], None), ("d", ["p"], 0.2)], "key string, used array<string>, score double")
    options = spark.createDataFrame([("a", [["p", "p2", "p3"], ["q"]]), ("b", [["p", "x"], ["q"]]), ("c", [["p", "p2"]])], "key string, options array<array<string>>")
    points = {"p2": 0.3, "p3": 0.7}

    def score(frame):
        return spark.createDataFrame([(r.key, points.get(r.used[0], 0.0)) for r in frame.collect()], "key string, score double")

    got = sorted(map(tuple, retry_variants(rows, options, "key", score, 0.8, 0.05).collect()))
    assert got == [("a", ["p3", "q"], 0.7, 2), ("b", ["p", "q"], 0.9, 0), ("c", ["p2"], 0.3, 1), ("d", ["p"], 0.2, 0)]


def brute_phrases(phrases, refuse):
    left, dropped, asked = list(phrases or []), [], 0
    while left:
        asked += 1
        message = refuse(left)
        if message is None:
            return left, dropped, "+".join(left), asked
        at = next((i for i, p in enumerate(left) if p in message), len(left) - 1)
        dropped.append(left.pop(at))
    return left, dropped, None, asked


def test_phrases_are_dropped_one_at_a_time(spark, tmp_path):
    def refuse(left):
        if "bad" in left or "worse" in left:
            return "phrases are invalid: " + ("worse" if "worse" in left else "bad")
        return "too many" if len(left) > 3 else None

    cases = [["a", "bad", "c"], ["bad"], [], None, ["bad", "worse", "bad", "x"], list("abcdef"), ["ok"]]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "key int, phrases array<string>")
    asked = []

    def ask(frame):
        found = frame.collect()
        asked.append(len(found))
        return spark.createDataFrame([(r.key, "+".join(r.phrases), refuse(r.phrases)) for r in found], "key int, answer string, message string")

    got = accepted_phrases(rows, "key", ask, f"{tmp_path}/phrases").select("key", "phrases", "dropped", "answer", "asked")
    want = [(i, *brute_phrases(c, refuse)) for i, c in enumerate(cases)]
    assert sorted(map(tuple, got.collect())) == want
    assert asked == [sum(w[-1] > n for w in want) for n in range(max(w[-1] for w in want))]


def test_two_arms_worked_example(spark):
    """Reused answers, no alias, nothing taken, a mix-up, and clips for some."""
    rows = spark.createDataFrame(
        [(1, ["abc", "def"], "abcdef", None), (2, ["bad"], "xyz", None), (3, ["abc"], None, None), (4, ["abc"], "zzzz", None), (5, ["bad"], "kept", "kept"), (6, ["abc", "bad"], "abd", None)],
        "key int, phrases array<string>, alias string, cached string",
    )
    ask = lambda d: d.select("key", F.array_join("phrases", "").alias("answer"), F.when(F.array_contains("phrases", "bad"), "bad is invalid").alias("message"))
    alike = lambda a, b: F.round(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)), 4)
    clips = spark.createDataFrame([(1, "abcdeg"), (4, "abc"), (6, "abc")], "key int, clip string")
    got = {r.key: r for r in loops.two_arms(rows, "key", ask, lambda d: d.select("key", F.col("alias").alias("answer")), alike, clips, 0.35).collect()}
    shown = {k: (r.used, r.dropped, r.error, r.alike, r.phrases_vs_clip, r.alias_vs_clip, r.delta) for k, r in got.items()}
    assert shown == {
        1: (["abc", "def"], [], None, 1.0, 0.8333, 0.8333, 0.0),
        2: ([], ["bad"], "no_ipa", None, None, None, None),
        3: (["abc"], [], "no_respelling", None, None, None, None),
        4: ([], [], "mixup_ipa", 0.0, None, None, None),
        5: (["bad"], [], None, 1.0, None, None, None),
        6: (["abc"], ["bad"], None, 0.6667, 1.0, 0.6667, 0.3333),
    }
