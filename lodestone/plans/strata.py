"""Joins, resolution, strata, comparisons, samples and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import aggregates as a
from lodestone.operators import resolve as r
from lodestone.operators import sampling as sm
from lodestone.operators import windows as w

from .registry import Tables, query

PRIORITY = ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"]
RANK_SQL = "coalesce(list_position(['1-URGENT','2-HIGH','3-MEDIUM','5-LOW'], o_orderpriority), 5)"


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def customers_without_orders(t: Tables) -> DataFrame:
    return r.pending(t.customer.select("c_custkey"), t.orders.select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')")
def pending_orders(t: Tables) -> DataFrame:
    done = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return r.pending(t.orders.select("o_orderkey"), done, ["o_orderkey"])


@query("select s_suppkey, n_name, r_name from supplier join nation on s_nationkey = n_nationkey left join (select * from region where r_regionkey < 3) r on n_regionkey = r_regionkey")
def supplier_reference(t: Tables) -> DataFrame:
    """Case-folded lookup of a nation's region; a missing region stays null."""
    rows = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).withColumn("rk", F.concat(F.lit("R"), F.col("n_regionkey")))
    refs = t.region.where("r_regionkey < 3").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("ref"), "r_name")
    return r.lookup(rows, refs, "rk", "ref").select("s_suppkey", "n_name", "r_name")


@query("select distinct lower(n_name) n_name from nation where n_nationkey not in (select s_nationkey from supplier)")
def nations_without_suppliers(t: Tables) -> DataFrame:
    have = t.nation.join(t.supplier, F.col("n_nationkey") == F.col("s_nationkey"), "left_semi")
    return r.missing_keys(t.nation, have, "n_name", "n_name")


@query("""
select c_custkey, n_name, coalesce(sum(o_totalprice), 0) > 0 scored from customer join nation on c_nationkey = n_nationkey
left join orders on o_custkey = c_custkey group by 1, 2""")
def spans_with_skips(t: Tables) -> DataFrame:
    """Rows matched on both sides, and those skipped for want of one."""
    rows = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    spent = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("spent"))
    return rows.join(spent, "c_custkey", "left").select("c_custkey", "n_name", (F.coalesce("spent", F.lit(0.0)) > 0).alias("scored"))


@query("""
with m as (select o_custkey c_custkey, max(o_orderkey) k from orders group by 1), l as (select c_custkey, o_orderstatus from m join orders on o_orderkey = k)
select c_custkey, coalesce(o_orderstatus = 'F' and c_custkey % 7 <> 0, false) eligible from customer left join l using (c_custkey)""")
def resume_eligible(t: Tables) -> DataFrame:
    """Resumed only if the last record is ok and was for the same text."""
    status = F.when(F.col("o_orderstatus") == "F", "ok").otherwise("error")
    body = F.concat(F.lit("text "), F.col("o_custkey"))
    text = F.when(F.col("o_custkey") % 7 == 0, F.concat(body, F.lit("!"))).otherwise(body)
    manifest = t.orders.select(F.col("o_custkey").alias("c_custkey"), status.alias("status"), F.sha2(text, 256).alias("text_sha256"), F.col("o_orderkey").alias("seq"))
    work = t.customer.select("c_custkey", F.concat(F.lit("text "), F.col("c_custkey")).alias("text"))
    return r.resumable(work, manifest, "c_custkey", "text").select("c_custkey", "eligible")


@query(f"select o_custkey, o_orderkey, o_orderpriority from (select *, row_number() over (partition by o_custkey order by {RANK_SQL}, o_orderkey) rn from orders) where rn = 1")
def priority_pick(t: Tables) -> DataFrame:
    """The record of the best source of each key; unlisted sources last."""
    return w.first_by_priority(t.orders, ["o_custkey"], F.col("o_orderpriority"), PRIORITY, ["o_orderkey"], ["o_orderkey", "o_orderpriority"])


@query(f"select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by {RANK_SQL}, o_orderkey) rn from orders where o_totalprice >= 100000) where rn = 1")
def first_usable(t: Tables) -> DataFrame:
    """As above, skipping records that can't be used."""
    return w.first_by_priority(t.orders, ["o_custkey"], F.col("o_orderpriority"), PRIORITY, ["o_orderkey"], ["o_orderkey"], F.col("o_totalprice") >= 100000)


@query("select user_id, count(distinct event_type) n_sources, case when count(distinct event_type) > 1 then 'high' else 'medium' end tier from events where value > 200 group by 1")
def source_agreement_tier(t: Tables) -> DataFrame:
    return r.source_tier(t.events.where("value > 200"), "user_id", "event_type")


@query("""
with p as (select regexp_extract(url, '^https?://([^/]+)', 1) host, regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) lang from pages)
select lang, count(distinct right(host, 3)) n_values, count(distinct host) n_domains, case when count(distinct right(host, 3)) = 1 and count(distinct host) > 1 then 'high' else 'medium' end tier from p group by 1""")
def claim_agreement_tier(t: Tables) -> DataFrame:
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    rows = t.pages.select(F.regexp_extract("url", "^https?://[^/]+/([a-z]+)/", 1).alias("lang"), host.alias("host"))
    return r.claim_tier(rows, "lang", F.right("host", F.lit(3)), F.col("host"))


@query("""
with e as (select user_id, event_type v, min(event_id) first_at from events group by 1, 2)
select user_id, array_to_string(list(v order by first_at), ',') seen from e group by 1""")
def first_seen_union(t: Tables) -> DataFrame:
    """Values in the order they were first seen."""
    rows = t.events.select("user_id", "event_id", F.array("event_type").alias("seen"))
    return r.variant_union(rows, "user_id", "seen", "event_id").select("user_id", F.array_join("seen", ",").alias("seen"))


@query("select o_orderkey, o_custkey, o_orderpriority, o_totalprice from orders where o_orderpriority <> '1-URGENT' union all select o_orderkey, o_custkey, '1-URGENT', o_totalprice * 2 from orders where o_orderstatus = 'P'")
def upsert_by_source(t: Tables) -> DataFrame:
    old = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")
    fresh = t.orders.where("o_orderstatus = 'P'").select("o_orderkey", "o_custkey", F.lit("1-URGENT").alias("o_orderpriority"), (F.col("o_totalprice") * 2).alias("o_totalprice"))
    return r.replace_source(old, fresh, "o_orderpriority", "1-URGENT")


@query("select o_orderkey, o_totalprice from orders where o_orderkey % 10 <> 0 union all select o_orderkey, o_totalprice + 1 from orders where o_orderkey % 10 = 0")
def upsert_by_key(t: Tables) -> DataFrame:
    old = t.orders.select("o_orderkey", "o_totalprice")
    return r.upsert(old, old.where("o_orderkey % 10 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1), ["o_orderkey"])


@query("""
with g as (select o_custkey, max(case when o_orderpriority <> '5-LOW' then o_orderdate end) latest, sum((o_orderpriority = '5-LOW')::int)::bigint unresolved, max((o_orderstatus = 'F')::int) hit from orders group by 1)
select o_custkey, latest, unresolved, case when latest < timestamp '2001-01-01' then 'established' else 'new' end era,
 case when latest is null then 'low' when hit = 1 and unresolved = 0 then 'high' else 'medium' end era_confidence from g""")
def era_by_customer(t: Tables) -> DataFrame:
    date = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderdate"))
    return sm.era(t.orders, "o_custkey", date, "2001-01-01", F.col("o_orderstatus") == "F")


@query("""
select cutoff, sum(coalesce(o_orderdate < cutoff::timestamp, false)::int)::bigint established, sum((not coalesce(o_orderdate < cutoff::timestamp, false))::int)::bigint as new
from orders, (values ('1996-01-01'), ('1998-01-01'), ('2000-01-01'), ('2001-06-01')) v(cutoff) group by 1""")
def era_cutoff_sweep(t: Tables) -> DataFrame:
    return sm.cutoff_sweep(t.orders, F.col("o_orderdate"), ["1996-01-01", "1998-01-01", "2000-01-01", "2001-06-01"])


@query("""
with x as (select o_custkey, o_orderdate d, o_orderkey n, o_orderpriority = '1-URGENT' orig, o_orderstatus = 'F' ok from orders),
g as (select o_custkey, min(case when orig and ok then struct_pack(d := d, n := n) end) a, min(case when ok and not orig then struct_pack(d := d, n := n) end) b from x group by 1)
select o_custkey, coalesce(a, b).d as date, coalesce(a, b).n as number from g""")
def earliest_approved(t: Tables) -> DataFrame:
    return r.earliest_approved(t.orders, "o_custkey", "o_orderdate", "o_orderkey", F.col("o_orderpriority") == "1-URGENT", F.col("o_orderstatus") == "F")


@query("select l_orderkey, case min(case l_returnflag when 'R' then 1 when 'A' then 2 else 3 end) when 1 then 'R' when 2 then 'A' else 'N' end weakest from lineitem group by 1")
def weakest_tier(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(a.weakest(F.col("l_returnflag"), ["R", "A", "N"]).alias("weakest"))


DIFFICULTY_SQL = "len(string_split(p_name, ' ')) * 3.0e0 + length(p_brand) * 0.5e0"


@query(f"select p_partkey, round({DIFFICULTY_SQL} + 0.02e0 * length(p_name) + 2e0 * regexp_matches(p_name, '(ring|bolt|gear)$')::int, 6) score, case when {DIFFICULTY_SQL} + 0.02e0 * length(p_name) + 2e0 * regexp_matches(p_name, '(ring|bolt|gear)$')::int <= 6.16 then 'easy' when {DIFFICULTY_SQL} + 0.02e0 * length(p_name) + 2e0 * regexp_matches(p_name, '(ring|bolt|gear)$')::int <= 10.18 then 'medium' else 'hard' end tier from part")
def difficulty_tiers(t: Tables) -> DataFrame:
    units = F.size(F.split("p_name", " ")) * 3.0 + F.length("p_brand") * 0.5
    score = sm.difficulty(units, F.length("p_name"), F.col("p_name").rlike("(ring|bolt|gear)$"))
    return t.part.select("p_partkey", F.round(score, 6).alias("score"), sm.difficulty_tier(score).alias("tier"))


@query(f"""
with s as (select a per_char, b bonus, {DIFFICULTY_SQL} + a * length(p_name) + b * regexp_matches(p_name, '(ring|bolt|gear)$')::int x from part, (values (0.0e0), (0.02e0), (0.04e0), (0.08e0)) v(a), (values (1e0), (2e0), (3e0)) u(b))
select per_char, bonus, sum((x <= 6.16)::int)::bigint easy, sum((x > 6.16 and x <= 10.18)::int)::bigint as medium, sum((x > 10.18)::int)::bigint hard from s group by 1, 2""")
def difficulty_grid(t: Tables) -> DataFrame:
    units = F.size(F.split("p_name", " ")) * 3.0 + F.length("p_brand") * 0.5
    return sm.difficulty_grid(t.part, units, F.length("p_name"), F.col("p_name").rlike("(ring|bolt|gear)$"), [0.0, 0.02, 0.04, 0.08], [1.0, 2.0, 3.0])


ARMS_SQL = """a as (select l_partkey, avg(case when l_returnflag = 'A' then l_quantity end) base, avg(case when l_returnflag = 'R' then l_quantity end) arm from lineitem group by 1),
p as (select *, arm - base delta from a where base is not null and arm is not null)"""


def arms(t: Tables) -> DataFrame:
    x = t.lineitem.where("l_returnflag in ('A', 'R')").groupBy("l_partkey", "l_returnflag").agg(F.avg("l_quantity").alias("score"))
    return r.pair_arms(x.where("l_returnflag = 'A'"), x.where("l_returnflag = 'R'"), ["l_partkey"], "score")


@query(f"with {ARMS_SQL} select l_partkey % 10 bucket, count(*) n, round(avg(base), 6) mean_base, round(avg(arm), 6) mean_arm, round(avg(delta), 6) mean_delta, sum((delta > 1e-6)::int)::bigint n_up, sum((delta < -1e-6)::int)::bigint n_down from p group by 1")
def paired_compare(t: Tables) -> DataFrame:
    return r.paired_summary(arms(t).withColumn("bucket", F.col("l_partkey") % 10), ["bucket"])


@query(f"with {ARMS_SQL} select count(*) n, sum((delta > 0)::int)::bigint improved, round(avg((delta > 0)::int), 6) share, round(avg(delta), 6) mean_delta, avg((delta > 0)::int) > 0.2 flagged from p")
def tripwire(t: Tables) -> DataFrame:
    return r.tripwire(arms(t))


@query(f"with {ARMS_SQL} select case when arm >= base + 2 then 'win' when base >= arm + 2 then 'loss' else 'tie' end outcome, count(*) n, round(avg((abs(delta) < 5)::int), 9) close_share from p group by 1")
def win_tie_loss(t: Tables) -> DataFrame:
    return arms(t).groupBy(r.outcome(F.col("arm"), F.col("base"), 2.0).alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.abs("delta") < 5).cast("int")), 9).alias("close_share"))


@query(f"with {ARMS_SQL} select base >= 25 agree, count(*) n, round(avg((arm >= base + 2)::int), 9) win, round(avg((base >= arm + 2)::int), 9) loss from p group by 1")
def conditional_wins(t: Tables) -> DataFrame:
    x = arms(t).withColumn("o", r.outcome(F.col("arm"), F.col("base"), 2.0))
    mean = lambda v: F.round(F.avg((F.col("o") == v).cast("int")), 9)
    return x.groupBy((F.col("base") >= 25).alias("agree")).agg(F.count(F.lit(1)).alias("n"), mean("win").alias("win"), mean("loss").alias("loss"))


@query("select o_orderpriority recipe, count(*) n, round(avg(o_totalprice), 4) mean, row_number() over (order by avg(o_totalprice) desc, o_orderpriority) place from orders group by 1")
def arm_ranking(t: Tables) -> DataFrame:
    """Few arms, ordered by their mean."""
    from pyspark.sql import Window

    g = t.orders.groupBy(F.col("o_orderpriority").alias("recipe")).agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("m"))
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last("m"), "recipe"))
    return g.select("recipe", "n", F.round("m", 4).alias("mean"), place.cast("long").alias("place"))


@query(f"""with {ARMS_SQL},
o as (select 'always' policy, arm y, true applied from p union all select 'never', base, false from p union all select 'oracle', greatest(arm, base), arm > base from p union all select 'low base', case when base < 25 then arm else base end, base < 25 from p)
select policy, count(*) n, round(avg(y), 6) mean, sum(applied::int)::bigint n_applied from o group by 1""")
def policy_table(t: Tables) -> DataFrame:
    """Mean outcome of policies that switch to the arm on a condition, in one pass."""
    base, arm = F.col("base"), F.col("arm")
    rules = {"always": F.lit(True), "never": F.lit(False), "oracle": arm > base, "low base": base < 25}
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("policy"), F.when(c, arm).otherwise(base).alias("y"), c.cast("int").alias("applied")) for k, c in rules.items())))
    return arms(t).select(each.alias("x")).groupBy("x.policy").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x.y"), 6).alias("mean"), F.sum("x.applied").alias("n_applied"))


@query("""
with s as (select label, vec_id % 4 source, avg(embedding[1]) score, min(vec_id) first_at from embeddings group by 1, 2)
select label, round(max(score), 9) best, arg_min(source, struct_pack(s := -score, f := first_at)) as by, count(*) n from s group by 1""")
def best_of_n(t: Tables) -> DataFrame:
    """The best reference of each key and how many there are."""
    s = t.embeddings.groupBy("label", (F.col("vec_id") % 4).alias("source")).agg(F.avg(F.get("embedding", F.lit(0)).cast("double")).alias("score"), F.min("vec_id").alias("at"))
    return r.best_reference(s, ["label"], "source", "score", "at").withColumn("best", F.round("best", 9))


SOURCES = ["click", "view", "purchase", "signup", "error"]


@query("""
with k as (select user_id, max((event_type='click')::int) c, max((event_type='view')::int) v, max((event_type='purchase')::int) p, max((event_type='signup')::int) s, max((event_type='error')::int) e from events where value > 150 group by 1),
n as (select *, c+v+p+s+e n from k), m as (select * from n)
select 'has_click' measure, sum(c)::bigint n from m union all select 'has_view', sum(v)::bigint from m union all select 'has_purchase', sum(p)::bigint from m union all select 'has_signup', sum(s)::bigint from m union all select 'has_error', sum(e)::bigint from m
union all select 'any', sum((n >= 1)::int)::bigint from m union all select 'two_or_more', sum((n >= 2)::int)::bigint from m union all select 'all', sum((n = 5)::int)::bigint from m union all select 'none', sum((n = 0)::int)::bigint from m
union all select 'only_click', sum((n = 1 and c = 1)::int)::bigint from m union all select 'only_view', sum((n = 1 and v = 1)::int)::bigint from m union all select 'only_purchase', sum((n = 1 and p = 1)::int)::bigint from m union all select 'only_signup', sum((n = 1 and s = 1)::int)::bigint from m union all select 'only_error', sum((n = 1 and e = 1)::int)::bigint from m""")
def coverage_matrix(t: Tables) -> DataFrame:
    return a.coverage_matrix(t.events.where("value > 150"), "user_id", "event_type", SOURCES)


@query("select lang, sum((quality = 1)::int)::bigint good, sum((quality = 0)::int)::bigint bad, sum((quality is null)::int)::bigint unlabelled from documents left join labels using (doc_id) group by 1")
def tier_coverage(t: Tables) -> DataFrame:
    """Crosstab of a tier with what covers it."""
    q = F.col("quality")
    return t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left").groupBy("lang").agg(F.count_if(q == 1).alias("good"), F.count_if(q == 0).alias("bad"), F.count_if(q.isNull()).alias("unlabelled"))


@query("with d as (select distinct sha256(text) digest, doc_id from documents), g as (select digest, count(*) n from d group by 1 having count(*) > 1) select digest, n, doc_id as member from d join g using (digest)")
def duplicate_hash_groups(t: Tables) -> DataFrame:
    """Members of every group of equal texts, as rows."""
    return a.duplicate_groups(t.documents, F.col("text"), "doc_id")


@query("""
with x as (select doc_id, source, n_chars / greatest(len(string_split(text, ' ')), 1) rate from documents), m as (select source, median(rate) median from x group by 1)
select doc_id, source, round(rate, 6) rate, round(median, 6) median from x join m using (source) where rate < 0.8 * median or rate > 1.25 * median""")
def rate_outliers(t: Tables) -> DataFrame:
    rate = F.col("n_chars") / F.greatest(F.size(F.split("text", " ")), F.lit(1))
    rows = t.documents.select("doc_id", "source", "n_chars", "text")
    return a.rate_outliers(rows, "source", rate, 0.8, 1.25).select("doc_id", "source", F.round("rate", 6).alias("rate"), F.round("median", 6).alias("median"))


@query("""
select 'duplicate id' problem, count(*) n from (select doc_id from documents group by 1 having count(*) > 1) union all select 'null text', count(*) from documents where text is null
union all select 'length differs', count(*) from documents where n_chars <> length(text) union all select 'label without document', count(*) from labels where doc_id not in (select doc_id from documents)
union all select 'unknown language', count(*) from documents where lang not in ('en', 'de', 'fr', 'es') union all select 'bad label', count(*) from labels where quality not in (0, 1) or toxic not in (0, 1)""")
def validation_report(t: Tables) -> DataFrame:
    """One row for each rule with the number of rows that break it."""
    d, l = t.documents, t.labels  # noqa: E741
    count = lambda f, name: f.agg(F.lit(name).alias("problem"), F.count(F.lit(1)).alias("n"))
    flat = d.agg(
        F.count_if(F.col("text").isNull()).alias("null text"), F.count_if(F.col("n_chars") != F.length("text")).alias("length differs"), F.count_if(~F.col("lang").isin("en", "de", "fr", "es")).alias("unknown language")
    )
    flat = flat.select(F.explode(F.create_map(*[x for c in flat.columns for x in (F.lit(c), F.col(f"`{c}`"))])).alias("problem", "n"))
    out = flat.unionAll(count(d.groupBy("doc_id").count().where("count > 1"), "duplicate id"))
    out = out.unionAll(count(l.join(d.select("doc_id"), "doc_id", "left_anti"), "label without document"))
    return out.unionAll(count(l.where("quality not in (0, 1) or toxic not in (0, 1)"), "bad label"))


@query("""
with c as (select lang, count(*) n from documents group by 1), b as (select *, least(n, 3) base, n - least(n, 3) spare, 60 - sum(least(n, 3)) over () remaining from c),
x as (select *, least(case when sum(spare) over () > 0 then spare * remaining / sum(spare) over () else 0 end, spare) exact from b), y as (select *, remaining - sum(floor(exact)) over () more, row_number() over (order by exact - floor(exact) desc, lang) turn from x),
q as (select lang, least(n, base + floor(exact) + (turn <= more)::int) quota from y),
r as (select doc_id, lang, sha256('7:' || doc_id) h, row_number() over (partition by lang order by sha256('7:' || doc_id), doc_id) place from documents),
k as (select doc_id, r.lang, h, doc_id % 50 = 0 f from r join q on r.lang = q.lang where place <= quota), need as (select greatest(8 - count(*) filter (f), 0) m from k),
come as (select doc_id, lang from (select doc_id, lang, row_number() over (order by h, doc_id) p from r where doc_id % 50 = 0 and doc_id not in (select doc_id from k)) where p <= (select m from need)),
stay as (select *, row_number() over (order by f, lang desc, h desc, doc_id desc) p from k)
select doc_id, lang from stay where f or p > (select count(*) from come) union all select * from come""")
def stratified_sample(t: Tables) -> DataFrame:
    """Sixty documents over the languages, in proportion with a floor, eight of them of a rare kind."""
    rows = t.documents.select("doc_id", "lang")
    return sm.stratified_sample(rows, "lang", "doc_id", 60, "7", 3, F.col("doc_id") % 50 == 0, 8).select("doc_id", "lang")


@query("select doc_id from documents order by sha256('7:' || doc_id), doc_id limit 50")
def hash_shuffle_head(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").orderBy(sm.hash_order(F.col("doc_id"), "7"), "doc_id").limit(50)


@query("select event_id from events where event_id % 101 = 3 union select event_id from (select event_id from events where value <= 20 order by value, event_id limit 25)")
def holdout_and_worst(t: Tables) -> DataFrame:
    worst = t.events.where("value <= 20").orderBy("value", "event_id").limit(25).select("event_id")
    return t.events.where("event_id % 101 = 3").select("event_id").union(worst).distinct()


@query("(select 'low' side, event_id, value from events order by value, event_id limit 15) union all (select 'high', event_id, value from events order by value desc, event_id limit 15)")
def extremes(t: Tables) -> DataFrame:
    """The lowest and the highest 15."""
    e = t.events.select("event_id", "value").where("value is not null")
    side = lambda d, s: d.limit(15).select(F.lit(s).alias("side"), "event_id", "value")
    return side(e.orderBy("value", "event_id"), "low").unionAll(side(e.orderBy(F.desc("value"), "event_id"), "high"))


@query("""
with a as (select distinct user_id from events where event_type = 'click' and value > 150), b as (select distinct user_id from events where event_type = 'view' and value > 150)
select 'union' op, user_id from (select * from a union select * from b) union all select 'intersect', user_id from (select * from a intersect select * from b) union all select 'except', user_id from (select * from a except select * from b)""")
def set_operations(t: Tables) -> DataFrame:
    of = lambda kind: t.events.where((F.col("event_type") == kind) & (F.col("value") > 150)).select("user_id")
    x, y = of("click"), of("view")
    tag = lambda d, name: d.select(F.lit(name).alias("op"), "user_id")
    return tag(x.union(y).distinct(), "union").unionAll(tag(x.intersect(y), "intersect")).unionAll(tag(x.subtract(y), "except"))


@query("select lower(p_name) folded, arg_min(p_name, p_partkey) as spelling, count(*) n from part group by 1")
def distinct_names(t: Tables) -> DataFrame:
    """Names that differ only in case count once, under the first spelling."""
    return t.part.groupBy(F.lower("p_name").alias("folded")).agg(F.min_by("p_name", "p_partkey").alias("spelling"), F.count(F.lit(1)).alias("n"))


@query("select o_orderkey, case when not exists (select 1 from lineitem where l_orderkey = o_orderkey) then 'no lines' when not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'N') then 'no open line' else 'no large line' end reason from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'N' and l_quantity > 40)")
def miss_reasons(t: Tables) -> DataFrame:
    """The first stage that lost each key."""
    lines = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")
    stages = [("no lines", lines), ("no open line", lines.where("l_returnflag = 'N'")), ("no large line", lines.where("l_returnflag = 'N' and l_quantity > 40"))]
    return r.miss_reasons(t.orders, stages, "o_orderkey")


@query("select conv_id, arg_min(text, turn) as first_text, min(turn) first_turn from conversations where role = 'user' group by 1")
def first_turns(t: Tables) -> DataFrame:
    """The first member of each key, as setdefault would keep it."""
    return t.conversations.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("first_text"), F.min("turn").alias("first_turn"))


@query("""
with w as (select doc_id, generate_subscripts(ws, 1) - 1 place, unnest(ws) word from (select doc_id, string_split(text, ' ') ws from documents)), x as (select word, min(doc_id) v from w group by 1 having count(*) >= 3)
select doc_id, count(*) n_words, case when count(v) = count(*) then array_to_string(list(v order by place), ' ') end resolved from w left join x using (word) group by 1""")
def word_resolution(t: Tables) -> DataFrame:
    """Texts whose every word is in a lexicon, and its values in order; all or nothing."""
    d = t.spread("documents").select("doc_id", "text")
    words = d.select("doc_id", F.explode(F.split("text", " ")).alias("word"))
    lexicon = words.groupBy("word").agg(F.count(F.lit(1)).alias("c"), F.min("doc_id").cast("string").alias("v")).where("c >= 3")
    return r.resolve_words(d, "doc_id", F.split("text", " "), lexicon, "word", "v")


@query("""
with a as (select doc_id, i * 40 as start, i * 40 + 25 as "end" from documents, unnest(range(0, n_chars // 40 + 1)) r(i) where n_chars > i * 40), b as (select doc_id, i * 70 + 10 as start, i * 70 + 40 as "end" from documents, unnest(range(0, n_chars // 70 + 1)) r(i) where n_chars > i * 70)
select a.doc_id, a.start a_start, b.start b_start from a join b on a.doc_id = b.doc_id and a.start < b."end" and a."end" > b.start""")
def range_overlap(t: Tables) -> DataFrame:
    """Overlapping ranges of the same text."""
    i = F.col("i")
    each = lambda step, at, width: t.documents.select("doc_id", "n_chars", F.explode(F.sequence(F.lit(0), F.floor(F.col("n_chars") / step).cast("int"))).alias("i")).where(F.col("n_chars") > i * step).select("doc_id", (i * step + at).cast("long").alias("start"), (i * step + at + width).cast("long").alias("end"))
    return r.overlap_join(each(40, 0, 25), each(70, 10, 30), ["doc_id"]).select("doc_id", "a_start", "b_start")


@query("""
with s as (select distinct string_split(p_name, ' ')[1] short from part), l as (select p_partkey, p_name from part)
select p_partkey, short from l join s on lower(p_name) = lower(short) or lower(p_name) like lower(short) || ' %'""")
def prefix_join(t: Tables) -> DataFrame:
    short = t.part.select(F.split("p_name", " ")[0].alias("short")).distinct()
    return r.prefix_join(t.part.select("p_partkey", "p_name"), short, "p_name", "short").select("p_partkey", "short")


@query("select n_name, i copy from nation, range(1, 4) r(i)")
def replicate_rows(t: Tables) -> DataFrame:
    return t.nation.select("n_name", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long"))).alias("copy"))


@query("select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderkey) rn, count(*) over (partition by o_custkey) n from orders) where rn = 1 or rn = n // 2 + 1 or rn = n")
def checkpoint_rows(t: Tables) -> DataFrame:
    return w.checkpoints(t.orders.select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey")


@query("select l_orderkey, sum(p_size)::bigint units, bool_or(regexp_matches(p_name, '(ring|bolt)$')) hard, max(length(p_name)) longest from lineitem join part on l_partkey = p_partkey group by 1")
def features_per_row(t: Tables) -> DataFrame:
    """Members' features summed and or-ed into their row."""
    rows = t.lineitem.select("l_orderkey", "l_partkey").join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy("l_orderkey").agg(F.sum("p_size").alias("units"), F.bool_or(F.col("p_name").rlike("(ring|bolt)$")).alias("hard"), F.max(F.length("p_name")).alias("longest"))
