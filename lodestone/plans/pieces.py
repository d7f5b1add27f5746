"""Queries of single parts: documents as maps, labels, configurations, mock judges, references, rates of sound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import sounds as so
from lodestone.functions import stats as s
from lodestone.functions import text as x
from lodestone.operators import evidence as e
from lodestone.operators import resolve, runs, sampling
from lodestone.sources import files
from lodestone.sources.tables import fresh_path

from .registry import Tables, query


@query("select p_name as key, min(p_size)::int least, count(*) n from part group by 1")
def json_maps(t: Tables) -> DataFrame:
    """Documents that map a name to its fields, one file a brand, read as rows and summed over the files."""
    path = fresh_path(t.spark, "maps")
    one = t.part.groupBy("p_brand", "p_name").agg(F.min("p_size").alias("size"), F.count(F.lit(1)).alias("n"))
    maps = one.groupBy("p_brand").agg(F.map_from_entries(F.collect_list(F.struct("p_name", F.struct("size", "n")))).alias("m"))
    maps.select("p_brand", F.to_json("m").alias("value")).write.partitionBy("p_brand").text(path)
    rows = files.read_json_map(t.spark, path, "size int, n long")
    return rows.groupBy("key").agg(F.min("size").alias("least"), F.sum("n").alias("n"))


@query("select l_linestatus, case l_linenumber when 1 then 'one' when 2 then 'two' else l_linenumber::varchar end label, count(*) n from lineitem group by 1, 2")
def labelled_rows(t: Tables) -> DataFrame:
    """Codes with the names that the column's own metadata gives; codes without a name stay."""
    path = fresh_path(t.spark, "labelled")
    names = {"names": ["zero", "one", "two"]}
    t.lineitem.select("l_linestatus", F.col("l_linenumber").cast("int").alias("label", metadata=names)).write.parquet(path)
    rows = files.decode_labels(t.spark.read.parquet(path), "label", files.parquet_labels(t.spark, path, "label"))
    return rows.groupBy("l_linestatus", "label").agg(F.count(F.lit(1)).alias("n"))


@query("""
select n_name system_id, case when n_nationkey % 3 = 0 then 'active' else 'planned' end status, 24000 + case when n_nationkey % 2 = 0 then n_nationkey else 0 end rate, 'wav' container from nation""")
def system_configs(t: Tables) -> DataFrame:
    """Systems over defaults, nested parts merged key by key (a dimension of the driver's own configuration files)."""
    systems = [
        {"system_id": r.n_name} | ({"status": "active"} if r.n_nationkey % 3 == 0 else {}) | ({"audio": {"rate": 24000 + r.n_nationkey}} if r.n_nationkey % 2 == 0 else {})
        for r in t.nation.select("n_name", "n_nationkey").collect()
    ]
    frame = files.config_frame(t.spark, files.layered_config({"audio": {"rate": 24000, "container": "wav"}}, systems))
    read = F.from_json("config", "audio struct<rate:int, container:string>")["audio"]
    return frame.select("system_id", "status", read["rate"].alias("rate"), read["container"].alias("container"))


_NUMBER = "('0x' || left(sha256('mock:' || o_orderkey::varchar), 8))::bigint"


@query(f"""
with x as (select o_orderkey, {_NUMBER} n from orders), y as (select *, (n % 6)::int score from x),
z as (select *, case when (n >> 10) & 1 = 1 then greatest(0, least(5, score + case when n % 2 = 0 then 1 else -1 end)) else score end other from y)
select score, other::int other, count(*) c from z group by 1, 2""")
def mock_judges(t: Tables) -> DataFrame:
    """Two judges made of digests, and how often each pair of their scores occurs."""
    key = F.col("o_orderkey")
    rows = t.orders.select("o_orderkey", sampling.mock_score(key, "mock").alias("score"))
    return rows.select("score", sampling.jittered(F.col("score"), key, "mock").alias("other")).groupBy("score", "other").agg(F.count(F.lit(1)).alias("c"))


@query("select o_orderkey, o_totalprice from orders where o_custkey in (select c_custkey from customer where c_nationkey = 3) order by o_totalprice desc, o_orderkey limit 25")
def asked_orders(t: Tables) -> DataFrame:
    """The 25 largest orders of the customers that were asked for (a user's filter and limit)."""
    ids = t.customer.where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return sampling.with_ids(t.orders, "o_custkey", [F.desc("o_totalprice"), "o_orderkey"], ids, 25).select("o_orderkey", "o_totalprice")


@query("""
with w as (select user_id::varchar item_id, max(event_type = 'purchase') done from events group by 1)
select item_id from w where not done""")
def items_not_done(t: Tables) -> DataFrame:
    """Items of a log that no successful record names."""
    log = t.events.select(F.col("user_id").cast("string").alias("item_id"), F.when(F.col("event_type") == "purchase", "ok").otherwise("error").alias("status"))
    return runs.not_started(log.select("item_id").distinct(), log)


@query(r"""
with t as (select conv_id, turn, regexp_split_to_array(trim(text), '\s+') a from conversations), z as (select conv_id, turn, a, list_filter(a, lambda w: length(w) > 3) b from t)
select conv_id, turn, i::int as position, a[i + 1] a, b[i + 1] b from (select *, unnest(range(0, least(len(a), len(b)))) i from z)""")
def zipped_words(t: Tables) -> DataFrame:
    """Words of a turn beside its longer words, place by place, up to the shorter list."""
    words = F.split(F.trim("text"), r"\s+")
    rows = t.conversations.select("conv_id", "turn", words.alias("a")).withColumn("b", F.filter("a", lambda w: F.length(w) > 3))
    return resolve.zip_members(rows, ["conv_id", "turn"], "a", "b")


_RATES = "case n_nationkey % 3 when 0 then 'audio/l16;rate=' || (8000 + n_nationkey) when 1 then 'audio/wav' end"


@query(rf"select n_name, coalesce(nullif(regexp_extract({_RATES}, 'rate=(\d+)', 1), '')::int, 24000) rate from nation")
def declared_rates(t: Tables) -> DataFrame:
    """The rate that a type of sound declares, else the configured one."""
    k = F.col("n_nationkey")
    mime = F.when(k % 3 == 0, F.concat(F.lit("audio/l16;rate="), (8000 + k).cast("string"))).when(k % 3 == 1, "audio/wav")
    return t.nation.select("n_name", x.declared_rate(mime, 24000).alias("rate"))


@query("""
with p as (select p_name, min(p_partkey) k from part group by 1)
select lower(p_name) p_name, case when k % 3 = 0 then '' else 'S ' || k end best, case when k % 3 = 0 then 'low' when k % 2 = 0 then 'high' else 'medium' end tier from p""")
def reference_maps(t: Tables) -> DataFrame:
    """Best variant and tier of every name, '' without a variant."""
    names = t.part.groupBy("p_name").agg(F.min("p_partkey").alias("k"))
    variant = lambda c: F.struct(F.concat(F.lit("S "), c.cast("string")).alias("symbols"), F.lit("s").alias("shown"))
    none = F.array().cast("array<struct<symbols:string,shown:string>>")
    variants = F.when(F.col("k") % 3 == 0, none).otherwise(F.array(variant(F.col("k")), variant(F.col("k") + 1)))
    tier = F.when(F.col("k") % 3 == 0, "low").when(F.col("k") % 2 == 0, "high").otherwise("medium")
    return e.reference_maps(names.select("p_name", variants.alias("variants"), tier.alias("tier")), "p_name")


@query("""
with w as (select distinct unnest(string_split(p_name, ' ')) part from part)
select part, case when length(part) % 2 = 0 then 'ˈɪs' || replace(part, 'e', 'ɛ') || '|' else '' end || 'ˈəs' || replace(part, 'e', 'ɛ') options from w""")
def variant_options(t: Tables) -> DataFrame:
    """Published variants of the words whose page is about them, then the seed's, each once."""
    words = t.part.select(F.explode(F.split("p_name", " ")).alias("part")).distinct()
    sound = lambda mark: F.concat(F.lit(mark), F.replace("part", F.lit("e"), F.lit("ɛ")))
    url = F.when(F.length("part") % 2 == 0, F.concat(F.lit("https://en.wikipedia.org/wiki/"), F.initcap("part"))).otherwise("https://en.wikipedia.org/wiki/Other_page")
    cache = words.select("part", url.alias("url"), F.array(F.concat(F.lit("/"), sound("ˈɪs"), F.lit("/")), sound("ˈɪs"), F.lit("plain")).alias("variants"))
    found = e.variant_options(words, cache, words.select("part", sound("ˈəs").alias("option")), ["part"])
    return found.select("part", F.array_join("options", "|").alias("options"))


@query("""
with w as (select distinct unnest(string_split(p_name, ' ')) word from part), k as (select word, length(word) % 2 = 0 even from w)
select word, case when even then 'kˈæt|kˈætˈdɒɡ' else 'kˈæt' end shown, case when even then 2 else 1 end n from k""")
def listed_variants(t: Tables) -> DataFrame:
    """Alternates of phonetic text by commas, shortened ones left out, "_" for a blank."""
    words = t.part.select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    raw = F.when(F.length("word") % 2 == 0, "kæt, -dɒɡ, kæt_ˈdɒɡ").otherwise("kæt, -dɒɡ")
    found = words.select("word", so.listed_variants(raw).alias("v"))
    return found.select("word", F.array_join(F.transform("v", lambda v: F.replace(v["shown"], F.lit(" "), F.lit(""))), "|").alias("shown"), F.size("v").alias("n"))


def _horner(of: str, powers: tuple[float, ...]) -> str:
    out = repr(powers[0])
    for c in powers[1:]:
        out = f"({out} * {of} + {c!r})"
    return out


def _quantile(p: str) -> str:
    tail = lambda q: f"({_horner(f'sqrt(-2 * ln({q}))', s.TAIL[0])} / {_horner(f'sqrt(-2 * ln({q}))', s.TAIL[1])})"
    square = f"(({p} - 0.5) * ({p} - 0.5))"
    middle = f"({_horner(square, s.MIDDLE[0])} * ({p} - 0.5) / {_horner(square, s.MIDDLE[1])})"
    return f"(case when {p} < {s.TAIL_ENDS} then {tail(p)} when {p} <= {1 - s.TAIL_ENDS} then {middle} else -{tail(f'(1 - {p})')} end)"


@query(f"""
with g as (select source, count(*) n, (avg(quality) * count(*) + 0.5) / (count(*) + 1) p from documents join labels using (doc_id) group by 1)
select source, n, round(p, 9) p, round({_quantile('p')}, 9) probit, round({_quantile('(1 - p / 40)')}, 9) z from g""")
def rate_quantiles(t: Tables) -> DataFrame:
    """Pass rates of sources as probits, and the limit for a confidence that depends on the rate."""
    g = t.documents.join(t.labels, "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("k"))
    rows = g.select("source", "n", ((F.col("k") + 0.5) / (F.col("n") + 1)).alias("p"))
    return rows.select("source", "n", F.round("p", 9).alias("p"), F.round(s.normal_quantile(F.col("p")), 9).alias("probit"), F.round(s.normal_quantile(1 - F.col("p") / 40), 9).alias("z"))
