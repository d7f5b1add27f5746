"""Small cases of joins, windows, runs, sources and streams."""

import json
import random
import wave

import pytest
from pyspark.sql import functions as F

from lodestone.functions import fuzzy, phones
from lodestone.functions import text as x
from lodestone.operators import aggregates as a
from lodestone.operators import resolve as r
from lodestone.operators import runs
from lodestone.operators import sampling as sm
from lodestone.operators import similarity as sim
from lodestone.operators import windows as w
from lodestone.sources import files
from lodestone.streaming import changelog


def column(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_symbol_costs():
    cost = phones.symbol_cost
    assert cost("T", "T") == 0 and cost("ER", "R") == 0.12 and cost("AA", "P") == 1.0 and cost("AA", "N") == 0.72
    assert cost("T", "D") == pytest.approx(0.6 / 2.6)
    for p in phones.SYMBOLS:
        for q in phones.SYMBOLS:
            assert cost(p, q) == cost(q, p) and (p == q or 0 < cost(p, q) <= 1)
    assert len(phones.SYMBOLS) == 40 and len(phones.TOKENS) == 85


def plain_cost(a, b):
    row = [sum(phones.ADD[c] for c in b[:j]) for j in range(len(b) + 1)]
    for i, c in enumerate(a):
        new = [row[0] + phones.DROP[c]]
        for j, d in enumerate(b):
            new.append(min(row[j] + phones.SWAP[c, d], row[j + 1] + phones.DROP[c], new[j] + phones.ADD[d]))
        row = new
    return row[-1]


def test_alignment(spark):
    rnd = random.Random(1)
    pairs = [(" ".join(rnd.choices(phones.TOKENS, k=rnd.randrange(1, 9))), " ".join(rnd.choices(phones.TOKENS, k=rnd.randrange(0, 9)))) for _ in range(80)]
    frame = spark.createDataFrame(pairs, "ref string, hyp string").select("ref", "hyp", phones.align("ref", "hyp").alias("a"), phones.segmental_cost("ref", "hyp").alias("c"))
    for row in frame.collect():
        want = plain_cost(phones.parse(row.ref), phones.parse(row.hyp))
        assert row.a.segmental == pytest.approx(want) and row.c == pytest.approx(want)
        assert sum(o.cost for o in row.a.ops) == pytest.approx(want)
        assert [o.ref for o in row.a.ops if o.ref] == row.ref.split() and [o.hyp for o in row.a.ops if o.hyp] == row.hyp.split()


def test_stress_and_syllables(spark):
    ref, hyp = "M AH0 T OW1 P R AH0", "M AH1 T OW0 P R AH0"
    row = spark.createDataFrame([(ref, hyp)], "ref string, hyp string").select(phones.align("ref", "hyp").alias("a")).select("a", phones.normalized_error(F.col("a")).alias("e"), phones.worst_syllable(F.col("a.ops")).alias("w")).first()
    assert row.a.segmental == 0 and row.a.stress == pytest.approx(0.4) and row.e == pytest.approx(0.4) and row.w == 0
    assert phones.syllable_starts(phones.parse("M AH0 T OW1 P R AH0")) == [0, 2, 4]
    assert phones.syllable_starts(phones.parse("S T")) == [0]
    with pytest.raises(ValueError):
        phones.parse("QQ")


def test_gated_score(spark):
    row = spark.createDataFrame([("retatrutide", "retrotide"), ("same", "same"), ("a", "")], "a string, b string")
    got = [r.s for r in row.select(fuzzy.gated_score(F.col("a"), F.col("b"), x.phonetic_code(F.col("a")) == x.phonetic_code(F.col("b"))).alias("s")).collect()]
    assert got[0] < 3 and got[1:] == [5.0, 0.0]


def test_span_in_hypothesis(spark):
    frame = spark.createDataFrame([("take one tablet daily".split(), "take won tablet today".split())], "r array<string>, h array<string>")
    assert tuple(frame.select(fuzzy.span_in_hypothesis("r", "h", F.lit(1), F.lit(3)).alias("s")).first().s) == (1, 3)


@pytest.mark.parametrize("text,ok", [("met-oh-PRO-lol", True), ("MET-oh-PRO-lol", False), ("aspirin", False), ("SAL-in-ER", False), ("kon", False), ("KON tin", True), ("Met-oh", False)])
def test_canonical_respelling(spark, text, ok):
    assert column(spark, x.canonical_respelling(F.lit(text))) is ok


def test_text_forms(spark):
    assert column(spark, x.split_list(F.lit("a, b, and c and d"))) == ["a", "b", "c", "d"]
    assert column(spark, x.strip_label(F.lit("Foo (Generic)"), ["generic", "brand"])) == "Foo"
    assert column(spark, x.plain_text(F.lit("<p>a &amp;lt; b</p><script>x</script>"))) == "a &lt; b"
    assert column(spark, x.json_object(F.lit('so ```json\n{"score": 3}\n```'), "score int"))["score"] == 3
    assert column(spark, x.json_object(F.lit("none"), "score int")) is None
    assert column(spark, x.iso_date(F.lit("20240131"))) == "2024-01-31" and column(spark, x.declared_rate(F.lit("audio/L16"), 8000)) == 8000
    assert column(spark, x.spelled_out(F.lit("ab"), {"a": "ay", "b": "bee"})) == "ay bee"
    with pytest.raises(Exception, match="not a letter"):
        column(spark, x.spelled_out(F.lit("a1"), {"a": "ay"}))


def test_lookup_and_require(spark):
    rows, refs = spark.createDataFrame([("A",), ("c",)], "n string"), spark.createDataFrame([("a", 1)], "k string, v int")
    found = r.lookup(rows, refs, "n", "k")
    assert {(q.n, q.v) for q in found.collect()} == {("A", 1), ("c", None)}
    with pytest.raises(Exception, match="no match"):
        r.require(found, "v").collect()
    assert [q.n for q in r.missing_keys(rows, refs, "n", "k").collect()] == ["c"]


def test_zip_truncates(spark):
    frame = spark.createDataFrame([(1, ["a", "b"], [1]), (2, [], [1])], "k int, x array<string>, y array<int>")
    assert [tuple(q) for q in r.zip_members(frame, ["k"], "x", "y").collect()] == [(1, 0, "a", 1)]


def test_overlap_join_equals_brute_force(spark):
    rnd = random.Random(4)
    make = lambda n: [(rnd.randrange(3), s := rnd.randrange(500), s + rnd.randrange(1, 200)) for _ in range(n)]
    p, q = make(60), make(60)
    got = r.overlap_join(*(spark.createDataFrame(z, "k int, start long, end long") for z in (p, q)), ["k"]).collect()
    want = sorted((k, s, e, t, f) for k, s, e in p for j, t, f in q if k == j and s < f and e > t)
    assert sorted((g.k, g.a_start, g.a_end, g.b_start, g.b_end) for g in got) == want


def test_nearest_equals_brute_force(spark):
    rnd = random.Random(2)
    names = sorted({"".join(rnd.choices("abc", k=rnd.randrange(1, 7))) for _ in range(60)})
    frame = spark.createDataFrame([(n,) for n in names], "n string")
    all_pairs = frame.crossJoin(frame.withColumnRenamed("n", "m")).where("n <> m").withColumn("d", F.levenshtein("n", "m")).where("d <= 3").collect()
    want = {}
    for p in all_pairs:
        want.setdefault(p.n, []).append((p.d, p.m))
    want = {(n, m, d) for n, ds in want.items() for d, m in sorted(ds)[:2]}
    assert {(g.query, g.neighbour, g.distance) for g in sim.nearest(frame, frame, "n", 2, 3).collect()} == want


def test_global_rank(spark):
    rows = spark.createDataFrame([(i * 37 % 101,) for i in range(101)], "v int").repartition(7)
    ranked, total = w.global_rank(rows, ["v"], "place")
    assert total == 101 and all(q.v == q.place for q in ranked.collect())
    assert w.global_rank(rows.limit(0), ["v"], "place")[0].count() == 0


def test_order_does_not_matter(spark):
    rows = spark.createDataFrame([(i % 3, i, f"s{i * 7 % 4}", (i * 13) % 17 / 10) for i in range(90)], "k int, at int, s string, v double")
    for op in (lambda d: w.running_best(d, ["k"], ["at"], "v", 0.1), lambda d: w.runs(d, ["k"], ["at"], "s", "at"), lambda d: w.first_by_priority(d, ["k"], F.col("s"), ["s2", "s1"], ["at"], ["at", "s"])):
        assert sorted(map(tuple, op(rows.repartition(5)).collect())) == sorted(map(tuple, op(rows.orderBy(F.desc("at"))).collect()))


def test_small_windows(spark):
    rows = spark.createDataFrame([(i,) for i in range(7)], "epoch int").withColumn("k", F.lit(1))
    assert [q.epoch for q in w.epochs(rows, "epoch", 4).orderBy("epoch").collect()] == [0, 4, 6]
    assert [q.epoch for q in w.checkpoints(rows, ["k"], "epoch").orderBy("epoch").collect()] == [0, 3, 6]
    base = spark.createDataFrame([(1, 0.5), (2, 0.5)], "k int, v double")
    more = spark.createDataFrame([(1, 0.504, "a"), (1, 0.51, "b"), (2, 0.504, "a")], "k int, v double, name string")
    assert {(q.k, q.by, q.kept) for q in w.best_then_margin(base, more, ["k"], "v", "name", 0.005).collect()} == {(1, "b", True), (2, "a", False)}


def test_era_rules(spark):
    rows = spark.createDataFrame([("a", "2000-01-01"), ("a", "2010-01-01"), ("b", None), ("c", "1999-01-01"), ("c", None)], "k string, d string").withColumn("d", F.col("d").cast("timestamp_ntz"))
    got = {q.k: (q.era, q.era_confidence) for q in sm.era(rows, "k", F.col("d"), "2005-01-01", F.lit(True)).collect()}
    assert got == {"a": ("new", "high"), "b": ("new", "low"), "c": ("established", "medium")}


def test_stratified_sample_size(spark):
    rows = spark.createDataFrame([(i, "big" if i < 90 else f"s{i % 3}") for i in range(100)], "id int, s string")
    got = sm.stratified_sample(rows, "s", "id", 20, "x", 2).groupBy("s").count().collect()
    assert sum(q["count"] for q in got) == 20 and all(q["count"] >= 2 for q in got)


def test_duration_outliers_and_duplicates(spark):
    rows = spark.createDataFrame([(1, 0.4), (2, 0.42), (3, 0.38), (4, 3.5)], "id int, v double").withColumn("g", F.lit("x"))
    assert [q.id for q in a.rate_outliers(rows, "g", F.col("v")).collect()] == [4]
    same = spark.createDataFrame([("b", "x"), ("a", "x"), ("c", "y")], "n string, t string")
    assert sorted((q.n, q.member) for q in a.duplicate_groups(same, F.col("t"), "n").collect()) == [(2, "a"), (2, "b")]
    assert a.pass_rate_of_ids(rows, rows.where("id = 4"), "id", F.col("v") > 1).first()["rate"] == 1.0


def test_resumed_runs(spark):
    work = spark.createDataFrame([(f"i{i}", f"text {i}") for i in range(20)], "item_id string, text string")
    none = spark.createDataFrame([], runs.RECORD)
    first = spark.createDataFrame(runs.run_batch(work, none, "mock").collect(), runs.RECORD)
    assert first.count() == 20 and first.where("status = 'ok'").count() >= 18
    ok = first.where("status = 'ok'").count()
    assert runs.run_batch(work, first, "mock").count() == 20 - ok
    changed = work.withColumn("text", F.when(F.col("item_id") == first.where("status = 'ok'").first()["item_id"], "new").otherwise(F.col("text")))
    assert runs.run_batch(changed, first, "mock").count() == 20 - ok + 1
    total = runs.summarize_run(first).first()
    assert total["ok"] == ok and total["cost_usd"] == pytest.approx(0.001 * total["seconds"], abs=1e-6)
    with pytest.raises(KeyError):
        runs.build_provider("nothing")


def test_json_sources(spark, tmp_path):
    lines = ['{"id": "a", "seq": 1, "v": 1}', '{"id": "b", "seq": 2, "v": 2}', '{"id": "a", "seq": 3, "v": 3}']
    (tmp_path / "ok.jsonl").write_text("\n".join(lines))
    (tmp_path / "cut.jsonl").write_text("\n".join([*lines, '{"id": "c", "se']))
    schema = "id string, seq int, v int"
    assert files.read_jsonl(spark, str(tmp_path / "ok.jsonl"), schema).count() == 3
    with pytest.raises(Exception):  # noqa: B017
        files.read_jsonl(spark, str(tmp_path / "cut.jsonl"), schema).collect()
    assert {(q.id, q.v) for q in files.read_jsonl_lenient(spark, str(tmp_path / "cut.jsonl"), schema, "id", "seq").collect()} == {("a", 3), ("b", 2)}
    (tmp_path / "doc.json").write_text(json.dumps({"rows": [{"v": 1}, {"v": 2}]}))
    assert files.read_json_document(spark, str(tmp_path / "doc.json"), "v int").count() == 2


def test_collected_files(spark, tmp_path):
    for i, audio in enumerate(("AAAA", "BBBB")):
        (tmp_path / f"c{i}.json").write_text(json.dumps([{"name": "x", "audio_b64": audio}, {"name": f"only{i}", "audio_b64": "CCCC"}]))
    got = {q.name: (q.audio_b64, q.conflict) for q in files.merge_collected(spark, [str(tmp_path / f"c{i}.json") for i in range(2)], "name string, audio_b64 string", "name").collect()}
    assert got == {"x": ("BBBB", True), "only0": ("CCCC", False), "only1": ("CCCC", False)}


def test_sounds(spark, tmp_path):
    with wave.open(str(tmp_path / "a.wav"), "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(8000)
        f.writeframes(b"\0\0" * 4000)
    (tmp_path / "b.wav").write_bytes(b"junk")
    got = {q.path.rsplit("/", 1)[1]: (q.duration_s, q.problem is None) for q in files.read_sounds(spark, str(tmp_path)).collect()}
    assert got == {"a.wav": (0.5, True), "b.wav": (None, False)}
    assert len(files.newest_last(spark, str(tmp_path))) == 2


def test_cache_keeps_absence_but_not_failure(spark, tmp_path):
    cache = files.CacheTable(spark, str(tmp_path / "cache"), "k string, v string")
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    assert cache.misses(keys, "k").count() == 3
    cache.append(spark.createDataFrame([("a", "1", False), ("b", None, False), ("c", None, True)], "k string, v string, failed boolean"))
    assert [q.k for q in cache.misses(keys, "k").collect()] == ["c"]


def test_config_and_sinks(spark, tmp_path):
    systems = files.layered_config({"retry": {"n": 3, "wait": 1}, "voice": "v"}, [{"system_id": "s", "retry": {"n": 5}}])
    assert systems == [{"retry": {"n": 5, "wait": 1}, "voice": "v", "system_id": "s"}]
    assert files.config_frame(spark, systems).first()["status"] == "planned"
    rows = spark.createDataFrame([(1, float("inf")), (2, 1.5)], "id int, margin double")
    files.write_artifacts({"rows": rows}, str(tmp_path))
    assert {(q.id, q.margin) for q in spark.read.schema("id int, margin double").json(str(tmp_path / "rows")).collect()} == {(1, None), (2, 1.5)}
    for n in (1, 3):
        files.write_with_digest(rows.repartition(n), str(tmp_path / f"d{n}"), ["id"])
    assert len({spark.read.json(str(tmp_path / f"d{n}/manifest")).first()["digest"] for n in (1, 3)}) == 1
    assert files.decode_labels(spark.createDataFrame([(0,), (7,)], "t int"), "t", {0: "brand"}).collect()[0].t == "brand"


def test_streamed_changelog(spark, tmp_path):
    schema = "id string, seq int, v int"
    source, table = tmp_path / "in", str(tmp_path / "table")
    source.mkdir()
    for i, rows in enumerate(([("a", 1, 1), ("b", 2, 2)], [("a", 3, 9)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(source))
        stream = spark.readStream.schema(schema).json(str(source))
        changelog.upsert_stream(stream, table, str(tmp_path / "check"), ["id"], ["seq"]).awaitTermination()
        got = {(q.id, q.v) for q in changelog.current(spark, table, ["id"], ["seq"]).collect()}
        assert got == ({("a", 1), ("b", 2)} if i == 0 else {("a", 9), ("b", 2)})
    changelog.compact(spark, table, str(tmp_path / "one"), ["id"], ["seq"])
    assert {(q.id, q.v) for q in changelog.current(spark, str(tmp_path / "one"), ["id"], ["seq"]).collect()} == {("a", 9), ("b", 2)}


def test_windows_of_events(spark):
    rows = spark.createDataFrame([("2024-01-01 00:01:00", "x", 1), ("2024-01-01 00:09:00", "x", 0), ("2024-01-01 00:11:00", "x", 1)], "at string, g string, ok int")
    got = sorted((q.n, q.k) for q in changelog.windowed_rates(rows, "at", "10 minutes", "1 hour", "g", F.col("ok") == 1).collect())
    assert got == [(1, 1), (2, 1)]


def test_ranks_without_arrays(spark):
    rows = spark.createDataFrame([("a", float(i * 7 % 101)) for i in range(1000)] + [("b", None), ("c", 2.0), ("c", 1.0)], "k string, v double")
    found = a.middle_and_low(rows, ["k"], "v", 0.1)
    xs = sorted(i * 7 % 101 for i in range(1000))
    assert sorted(map(tuple, found.collect())) == [("a", 1000, xs[500], xs[99]), ("b", 0, None, None), ("c", 2, 2.0, 1.0)]
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_running_best_gathers_few(spark):
    rng = random.Random(3)
    data = [(i % 7 // 6, i, rng.random()) for i in range(20000)] + [(8, 0, None), (8, 1, 1.0), (9, 0, None), (10, 0, 1.0), (10, 1, None), (10, 2, 2.0)]
    rows = spark.createDataFrame(data, "k int, at int, v double").repartition(5)
    for margin in (0.005, 0.0, -0.01):
        want = []
        for k in sorted({x[0] for x in data}):
            xs = [v for kk, _, v in data if kk == k]
            best = xs[0]
            for v in xs:
                best = v if v is not None and best is not None and v > best + margin else best
            want.append((k, len(xs), best, xs[0]))
        assert sorted(map(tuple, w.running_best(rows, ["k"], ["at"], "v", margin).select("k", "n", "best", "first").collect())) == want
    assert w.rising(rows, ["k"], ["at"], "v", 0.005).where("rises").count() < 400


@pytest.mark.parametrize("parts", [4, 8, 200])
def test_global_rank_whatever_the_partitions(spark, parts):
    rows = spark.read.parquet("/root/testdata/sf0.01/part.parquet").select("p_partkey", F.length("p_name").alias("n"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {r.p_partkey: r.place for r in w.global_rank(rows, ["n", "p_partkey"], "place")[0].collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = {k: i for i, (_, k) in enumerate(sorted((r.n, r.p_partkey) for r in rows.collect()))}
    assert got == want


def test_forced_rows_in_a_sample(spark):
    from lodestone.operators import sampling as sm

    rows = spark.range(1000).selectExpr("id", "case when id % 10 = 0 then 'rare' when id % 3 = 0 then 'a' else 'b' end k")
    got = sm.stratified_sample(rows, "k", "id", 30, "s", 4, F.col("id") % 97 == 0, 5).collect()
    assert len(got) == 30 and sum(r.id % 97 == 0 for r in got) == 5 and all(sum(r.k == k for r in got) >= 3 for k in ("rare", "a", "b"))
    with pytest.raises(Exception, match="floors"):
        sm.stratified_sample(rows, "k", "id", 5, "s", 4).collect()


def test_panel_of_judges_is_checked(spark):
    scores = spark.createDataFrame([("i", "x", 4), ("i", "y", 5), ("i", "z", 1)], "item string, judge string, score int")
    assert a.panel_median(scores, ["item"], "score", judge="judge").first()["median"] == 4
    for bad, text in ((scores.unionAll(scores.limit(1)), "twice"), (scores.withColumn("score", F.col("score") + 3), "between")):
        with pytest.raises(Exception, match=text):
            a.panel_median(bad, ["item"], "score", judge="judge").collect()


def test_retries_wait_and_ship_the_provider(spark):
    from lodestone.operators import runs

    assert [runs.Retry(initial_s=1.0, most_s=3.0).wait(k) for k in (1, 2, 3)] == [1.0, 2.0, 3.0]

    class Mine(runs.Provider):
        system_id = "mine"

        def answer(self, item_id, text, attempt):
            return float(len(text))

    runs.register_provider("mine", Mine)
    work = spark.createDataFrame([("1", "ab"), ("2", "abc")], "item_id string, text string")
    done = spark.createDataFrame([], runs.RECORD)
    assert sorted(r.seconds for r in runs.run_batch(work, done, "mine").collect()) == [2.0, 3.0]
