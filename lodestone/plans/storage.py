"""Queries that go through files: what readers and sinks give back, caches, and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import stats as s
from lodestone.operators import aggregates as a
from lodestone.operators import windows as w
from lodestone.sources import files, jsonl
from lodestone.sources.tables import fresh_path
from lodestone.streaming import changelog, stateful

from .registry import Tables, query


@query("select event_id, user_id, event_type, value from events")
def jsonl_rows(t: Tables) -> DataFrame:
    """JSON Lines, written and read with a schema; a malformed line would be an error."""
    path = fresh_path(t.spark, "jsonl")
    t.events.select("event_id", "user_id", "event_type", "value").write.json(path)
    return files.read_jsonl(t.spark, path, "event_id long, user_id long, event_type string, value double")


@query("select user_id, max(event_id) event_id, arg_max(event_type, event_id) event_type from events group by 1")
def jsonl_last_records(t: Tables) -> DataFrame:
    """JSON Lines with cut lines between the records; of a key's records the last counts."""
    path = fresh_path(t.spark, "cut")
    line = F.to_json(F.struct("event_id", "user_id", "event_type"))
    cut = F.when(F.col("event_id") % 10 == 0, F.array(line, F.left(line, F.lit(20)))).otherwise(F.array(line))
    t.events.select(F.explode(cut).alias("value")).write.text(path)
    return files.read_jsonl_lenient(t.spark, path, "event_id long, user_id long, event_type string", "user_id", "event_id")


@query("select user_id, max(event_id) event_id, case when max(event_id) % 5 > 0 then arg_max(event_type, event_id) end event_type, max(event_id) % 5 > 0 typed from events group by 1")
def offset_last_records(t: Tables) -> DataFrame:
    """The last line of each key by its place in the files, with nothing in the lines that counts; a null on
    the last line counts too, and every tenth record is followed by one that was cut off."""
    path = fresh_path(t.spark, "lines")
    kind = F.when(F.col("event_id") % 5 > 0, F.col("event_type"))
    line = F.to_json(F.struct("user_id", "event_id", kind.alias("event_type")), {"ignoreNullFields": "false"})
    cut = F.when(F.col("event_id") % 10 == 0, F.array(line, F.left(line, F.lit(20)))).otherwise(F.array(line))
    ordered = t.events.repartitionByRange(max(4, t.spark.sparkContext.defaultParallelism), "event_id").sortWithinPartitions("event_id")
    ordered.select(F.explode(cut).alias("value")).write.text(path)
    ranges = jsonl.range_bytes(t.spark, path, least=50_000)
    found = jsonl.last_records(t.spark, path, "user_id long, event_id long, event_type string", "user_id", range_bytes=ranges)
    return found.select("user_id", "event_id", "event_type", (F.col("event_id") % 5 > 0).alias("typed"))


@query("select event_id, user_id, event_type from events union all select event_id, user_id, 'again' from events where event_id % 3 = 0")
def committed_lines(t: Tables) -> DataFrame:
    """Two writers append to one folder, one of them a stream whose batches are all replayed; each counts once."""
    source, path = fresh_path(t.spark, "changes"), fresh_path(t.spark, "appended")
    rows = t.events.select("event_id", "user_id", "event_type")
    cores = t.spark.sparkContext.defaultParallelism
    rows.repartition(3 * cores).write.parquet(source)  # three batches, each over all cores
    for _ in range(2):  # the second time without the progress of the first
        stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", cores).parquet(source)
        jsonl.append_stream(stream, path, fresh_path(t.spark, "progress"), "stream").awaitTermination()
    for _ in range(2):
        jsonl.append(rows.where("event_id % 3 = 0").withColumn("event_type", F.lit("again")), path, "run-1")
    return jsonl.read_records(t.spark, path, "event_id long, user_id long, event_type string", committed=True).drop("file", "offset")


@query("select p_partkey, p_name, case when p_size % 3 = 0 then 'brand' when p_size % 3 = 1 then 'generic' else '2' end kind from part")
def json_documents(t: Tables) -> DataFrame:
    """Documents with their rows in a field, one a brand; codes by the names they have."""
    path = fresh_path(t.spark, "documents")
    rows = F.collect_list(F.struct("p_partkey", "p_name", (F.col("p_size") % 3).alias("kind")))
    t.part.groupBy("p_brand").agg(rows.alias("rows")).write.partitionBy("p_brand").json(path)
    read = files.read_json_document(t.spark, path, "p_partkey long, p_name string, kind int")
    return files.decode_labels(read, "kind", {0: "brand", 1: "generic"})


@query("""
with m as (select user_id, event_id, event_type, row_number() over (partition by user_id order by event_id desc) r from events)
select user_id, event_id, event_type from m where r = 1""")
def streamed_upserts(t: Tables) -> DataFrame:
    """A stream of changes, and the last record of each key after it."""
    source, table, done = (fresh_path(t.spark, x) for x in ("changes", "upserts", "progress"))
    rows = t.events.select("event_id", "user_id", "event_type")
    rows.repartition(3).write.parquet(source)
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    changelog.upsert_stream(stream, table, done, ["user_id"], ["event_id"]).awaitTermination()
    return changelog.current(t.spark, table, ["user_id"], ["event_id"]).select("user_id", "event_id", "event_type")


@query("""
select date_trunc('hour', ts) window_start, event_type, count(*) n, count(*) filter (value > 50) k from events group by 1, 2""")
def windowed_rates(t: Tables) -> DataFrame:
    """Counts by hour and kind, as a watermarked stream would give them."""
    g = changelog.windowed_rates(t.events.select("ts", "event_type", "value"), "ts", "1 hour", "1 day", "event_type", F.col("value") > 50)
    return g.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("select p_partkey, p_name as title, p_partkey % 2 = 0 and p_partkey % 4 <> 0 conflict from part where p_partkey % 2 = 0 or p_partkey % 3 = 0")
def merged_collections(t: Tables) -> DataFrame:
    """Two collected files: the later record counts, and whether the contents differ."""
    content = lambda c: F.base64(c.cast("binary"))
    one, two = fresh_path(t.spark, "collected"), fresh_path(t.spark, "collected")

    def collect(rows: DataFrame, title, audio, path: str) -> None:
        """A file for each brand, its records as one JSON array."""
        record = F.struct("p_partkey", title.alias("title"), content(audio).alias("audio_b64"))
        rows.groupBy("p_brand").agg(F.to_json(F.collect_list(record)).alias("value")).write.partitionBy("p_brand").text(path)

    collect(t.part.where("p_partkey % 2 = 0"), F.upper("p_name"), F.col("p_name"), one)
    collect(t.part.where("p_partkey % 2 = 0 or p_partkey % 3 = 0"), F.col("p_name"), F.when(F.col("p_partkey") % 4 == 0, F.col("p_name")).otherwise("other"), two)
    merged = files.merge_collected(t.spark, [one, two], "p_partkey long, title string, audio_b64 string", "p_partkey")
    return merged.select("p_partkey", "title", "conflict")


@query("select count(*) asked, count(*) filter (c_custkey % 3 = 0) misses_first, count(*) filter (c_custkey % 15 = 0) misses_then from customer")
def cached_answers(t: Tables) -> DataFrame:
    """Misses of a cache before and after its answers; failed answers are asked for again."""
    cache = files.CacheTable(t.spark, fresh_path(t.spark, "answers"), "c_custkey long, answer string")
    keys = t.customer.select("c_custkey")
    answered = lambda d: d.select("c_custkey", F.concat(F.lit("a"), F.col("c_custkey").cast("string")).alias("answer"), F.lit(False).alias("failed"))
    cache.append(answered(keys.where("c_custkey % 3 <> 0")))
    first = cache.misses(keys, "c_custkey")
    n_first = first.count()
    cache.append(answered(first).withColumn("failed", F.col("c_custkey") % 15 == 0))
    return keys.agg(F.count(F.lit(1)).alias("asked")).select("asked", F.lit(n_first).cast("long").alias("misses_first"), F.lit(cache.misses(keys, "c_custkey").count()).cast("long").alias("misses_then"))


@query("select o_orderpriority, count(*) n, round(avg(o_totalprice), 6) mean from orders group by 1")
def artifacts(t: Tables) -> DataFrame:
    """Report frames as JSON Lines under their names, read back."""
    folder = fresh_path(t.spark, "artifacts")
    frame = t.orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 6).alias("mean"))
    files.write_artifacts({"priorities": frame}, folder)
    return t.spark.read.schema("o_orderpriority string, n long, mean double").json(f"{folder}/priorities")


@query("select count(*) n, true same from nation")
def digested_rows(t: Tables) -> DataFrame:
    """Rows with a manifest whose digest does not depend on how they are partitioned."""
    found = []
    for parts in (1, 3):
        folder = fresh_path(t.spark, "digested")
        files.write_with_digest(t.nation.repartition(parts), folder, ["n_nationkey"])
        found.append(t.spark.read.schema("rows long, digest string").json(f"{folder}/manifest").first())
    return t.spark.createDataFrame([(found[0]["rows"], found[0] == found[1])], "n long, same boolean")


@query("select c_custkey, c_name from customer")
def saved_manifest(t: Tables) -> DataFrame:
    """A manifest sorted by key over its files."""
    path = fresh_path(t.spark, "manifest")
    files.save_manifest(t.customer.select("c_custkey", "c_name"), path, ["c_custkey"])
    return files.read_jsonl(t.spark, path, "c_custkey long, c_name string")


@query("""
with e as (select user_id, event_id, event_type, epoch(ts)::double x, case when event_type = 'signup' then event_id end usage from events)
select user_id, round(min(x) filter (event_type = 'view') - min(x), 6) first_chunk, count(*) filter (event_type = 'view') chunks, coalesce(bool_or(event_type = 'error'), false) ended, arg_max(usage, x) filter (usage is not null) usage from e group by 1""")
def chunk_latency(t: Tables) -> DataFrame:
    """Per request: time to the first chunk, chunks, the end and the last usage."""
    kind = F.when(F.col("event_type") == "view", "audio").when(F.col("event_type") == "error", "done").otherwise("other")
    seconds = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts")) / 1e6
    rows = t.events.select("user_id", seconds.alias("at"), kind.alias("kind"), F.when(F.col("event_type") == "signup", F.col("event_id")).alias("usage"))
    found = changelog.first_chunk_latency(rows, "user_id", "at", "kind")
    return found.withColumn("first_chunk", F.round("first_chunk", 6))


@query("select o_orderstatus, count(*) calls, sum(coalesce(o_orderkey, 0))::bigint o_orderkey from orders group by 1")
def usage_by_model(t: Tables) -> DataFrame:
    """Calls and summed amounts of each model."""
    return a.usage_by_model(t.orders, "o_orderstatus", ["o_orderkey"])


@query("""
with b as (select user_id, max(value) value from events where event_type = 'view' and value is not null group by 1), c as (select user_id, max(value) best, arg_max(event_id, (value, event_id)) "by" from events where event_type = 'click' and value is not null group by 1)
select user_id, value, best, "by", best >= value + 1 kept from b join c using (user_id)""")
def best_then_margin(t: Tables) -> DataFrame:
    """The best candidate of each key, kept if it beats the base by a margin."""
    scored = t.events.where("value is not null")
    base = scored.where("event_type = 'view'").groupBy("user_id").agg(F.max("value").alias("value"))
    return w.best_then_margin(base, scored.where("event_type = 'click'").select("user_id", "value", "event_id"), ["user_id"], "value", "event_id", 1.0)


@query("select event_id from events, (select max(event_id) m from events) where event_id = 0 or event_id % 97 = 0 or event_id = m")
def kept_epochs(t: Tables) -> DataFrame:
    """The first, each so-many-th and the last."""
    return w.epochs(t.events.select("event_id"), "event_id", 97)


@query("select count(*) n, count(*) filter (quality = 1) k, round(avg(quality), 9) rate from labels where doc_id in (select doc_id from documents where lang = 'de')")
def rate_of_ids(t: Tables) -> DataFrame:
    """Pass rate over a subset of ids."""
    r = a.pass_rate_of_ids(t.labels, t.documents.where("lang = 'de'"), "doc_id", F.col("quality") == 1)
    return r.withColumn("rate", F.round("rate", 9))


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity * 1000 / (2 * 1 * 16000), 9) secs, round(1 + 4 * greatest(l_discount, 0) / 0.747, 9) f1 from lineitem")
def sound_seconds(t: Tables) -> DataFrame:
    """Seconds of raw sound by its bytes, and similarities as scores."""
    from lodestone.functions import text as x

    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(x.pcm_seconds(F.col("l_quantity") * 1000, 2, 1, 16000), 9).alias("secs"), F.round(s.f1_score(F.col("l_discount")), 9).alias("f1"))


@query("""
with e as (select user_id::varchar request, ts, event_id, event_type k, max((event_type = 'error')::int) over (partition by user_id order by ts, event_id) over_ from events)
select request, coalesce(string_agg(event_id::varchar, '' order by ts, event_id) filter (k = 'view' and over_ = 0), '') audio, (count(*) filter (k = 'view' and over_ = 0))::int chunks,
  round((epoch_us(min(ts) filter (k = 'view' and over_ = 0)) - epoch_us(min(ts))) / 1e6, 6) first_chunk,
  arg_max(event_id, (ts, event_id)) filter (k = 'signup' and over_ = 0) usage, max(over_) = 1 ended from e group by 1""")
def chunk_answers(t: Tables) -> DataFrame:
    """Answers joined from a stream of chunks that is stopped and goes on; each is closed by its end mark or by time."""
    source, out, progress = (fresh_path(t.spark, x) for x in ("chunks", "answers", "progress"))
    kind = F.when(F.col("event_type") == "view", "audio").when(F.col("event_type") == "error", "done").otherwise("other")
    body = F.when(F.col("event_type") == "view", F.col("event_id").cast("string").cast("binary"))
    usage = F.when(F.col("event_type") == "signup", F.create_map(F.lit("n"), F.col("event_id").cast("long")))
    rows = t.events.select(F.col("user_id").cast("string").alias("request"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").cast("long").alias("seq"), kind.alias("kind"), body.alias("audio"), usage.alias("usage"), F.lit("pcm").alias("mime"))
    # a chunk of another request moves the time on, past all patience
    last = rows.agg(F.max("at").alias("at")).select(F.lit("").alias("request"), *(c.alias(n) for n, c in {"at": F.col("at") + F.expr("interval 400 days"), "seq": F.lit(0).cast("long"), "kind": F.lit("other"), "audio": F.lit(None).cast("binary"), "usage": F.lit(None).cast("map<string,bigint>"), "mime": F.lit(None).cast("string")}.items()))
    for part in (rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1"), last):
        part.write.mode("append").parquet(source)
        stream = t.spark.readStream.schema(rows.schema).parquet(source)
        stateful.answers_stream(stream, "365 days", 86_400.0).writeStream.format("parquet").option("checkpointLocation", progress).trigger(availableNow=True).start(out).awaitTermination()
    found = t.spark.read.parquet(out).where("request <> ''")
    return found.select("request", F.col("audio").cast("string").alias("audio"), "chunks", F.round("first_chunk", 6).alias("first_chunk"), F.try_element_at("usage", F.lit("n")).alias("usage"), "ended")


@query("""
with x as (select user_id::varchar k, list({'r': event_id, 's': value} order by event_id) xs from events where value is not null group by 1), y as (select k, list_reduce(xs, lambda a, b: case when b.s > a.s + 5 then b else a end) b from x)
select k as key, b.r::int round, 'f' || b.r form, b.s score from y""")
def best_over_restarts(t: Tables) -> DataFrame:
    """The best trial of each key of a stream that is stopped and goes on; a better one must gain enough."""
    source, table, progress = (fresh_path(t.spark, x) for x in ("trials", "best", "progress"))
    rows = t.events.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").cast("int").alias("round"), F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("form"), F.col("value").alias("score"))
    half = rows.agg(F.expr("percentile_approx(round, 0.5)").alias("m")).first()["m"] or 0
    for part in (rows.where(F.col("round") <= half), rows.where(F.col("round") > half)):
        part.write.mode("append").parquet(source)
        stateful.keep_best(t.spark.readStream.schema(rows.schema).parquet(source), table, progress, 5.0).awaitTermination()
    last = F.max(F.struct("batch", F.struct("round", "form", "score").alias("x"))).alias("l")
    return t.spark.read.parquet(table).groupBy("key").agg(last).select("key", "l.x.*")
