"""Queries of statistics, agreement, replays and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions.text import GROUNDING_STOPWORDS
from marlstone.operators import agreement as A
from marlstone.operators import filters as P
from marlstone.operators import grounding as G
from marlstone.operators import records as N
from marlstone.operators import statistics as S
from marlstone.operators import workflow as W
from marlstone.operators.joins import against_all
from marlstone.plans.text_queries import sql_words
from marlstone.session import cut
from marlstone.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
DRAWS = S.DRAWS


def query(sql: str | None = None):  # noqa: ANN201
    def register(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


_WEIGHT = " + ".join(f"(y >= {t})::int" for t in S.STEPS)
_DRAWN = f"""s as (select * from base),
k as (select arm, value, cast('0x' || substr(md5('1234|key|' || key), 1, 8) as bigint) % {S.PRIME} as a from base where value is not null),
b as (select draw, cast('0x' || substr(md5('1234|draw|' || draw), 1, 8) as bigint) % {S.PRIME} as b from (select unnest(range(0, {DRAWS})) as draw)),
x as (select arm, draw, value, a, (a * b) % {S.PRIME} as x from k, b),
y as (select arm, draw, value, (((x * x) % {S.PRIME}) * xor(x, 1) + a) % {S.PRIME} as y from x),
m as (select arm, draw, round(sum(w * value) / sum(w), 12) as m from (select arm, draw, value, {_WEIGHT} as w from y) group by all having sum(w) > 0)"""


def _arms(spark: SparkSession, d: str) -> DataFrame:
    """Account balances by market segment and their nations' mean, as two arms of scores."""
    c = table(spark, d, "customer")
    return c.select(F.col("c_mktsegment").alias("arm"), F.col("c_custkey").alias("key"), F.round(F.col("c_acctbal") / 10000, 4).alias("value"))


@query(f"with base as (select c_mktsegment as arm, c_custkey as key, round(c_acctbal / 10000, 4) as value from customer), {_DRAWN} select arm, count(*) as n, round(avg(value), 6) as mean, (select round(quantile_cont(m, 0.025), 6) from m where m.arm = s.arm) as low, (select round(quantile_cont(m, 0.975), 6) from m where m.arm = s.arm) as high from s group by arm")
def sta1_bootstrap_interval(spark: SparkSession, d: str) -> DataFrame:
    out = S.interval(_arms(spark, d), ["arm"], draws=DRAWS)
    return out.select("arm", "n", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return _arms(spark, d).select("arm", "key", F.col("value").alias("a"), (F.col("value") * 0.9 + (F.col("key") % 7) * 0.01).alias("b"))


_PAIRED = f"with base as (select c_mktsegment as arm, c_custkey as key, round(c_acctbal / 10000, 4) - (round(c_acctbal / 10000, 4) * 0.9 + (c_custkey % 7) * 0.01) as value from customer), {_DRAWN}, d as (select arm, count(*) as n, avg(value) as delta from s group by 1)"


@query(_PAIRED + " select d.arm, any_value(d.n) as n, round(any_value(delta), 6) as delta, round(quantile_cont(m, 0.025), 6) as low, round(quantile_cont(m, 0.975), 6) as high from d join m using (arm) group by 1")
def sta2_paired_interval(spark: SparkSession, d: str) -> DataFrame:
    out = S.paired_test(_pairs(spark, d), ["arm"], draws=DRAWS)
    return out.select("arm", "n", *[F.round(c, 6).alias(c) for c in ("delta", "low", "high")])


@query(_PAIRED + " select d.arm, round(any_value(delta), 6) as delta, round(least(1.0, 2 * avg(case when (delta > 0 and m <= 0) or (delta < 0 and m >= 0) or delta = 0 then 1.0 else 0.0 end)), 6) as p from d join m using (arm) group by 1")
def sta3_paired_test(spark: SparkSession, d: str) -> DataFrame:
    out = S.paired_test(_pairs(spark, d), ["arm"], draws=DRAWS)
    return out.select("arm", F.round("delta", 6).alias("delta"), F.round("p", 6).alias("p"))


@query()
def sta1_numpy_interval(spark: SparkSession, d: str) -> DataFrame:
    return S.interval_numpy(_arms(spark, d), "arm", draws=DRAWS)


_RATED = """live as (select result_id, domain_code, rater_id, score from (select *, row_number() over (partition by result_id, domain_code, rater_id order by rated_at desc nulls last, rating_id desc, score desc) as rn
  from rubric_rating where result_id is not null and rater_id is not null and domain_code is not null) where rn = 1 and score between 1 and 5)"""


def _alpha(by: str) -> str:
    on = lambda a, b: " and ".join(f"{a}.{c} = {b}.{c}" for c in by.split(", "))
    return f"""m as (select {by}, result_id, count(*) as m from s group by all),
o as (select {', '.join('a.' + c for c in by.split(', '))}, a.score as c, b.score as k, sum(1.0 / (m.m - 1)) as o from s a join s b on {on('a', 'b')} and a.result_id = b.result_id and a.rater_id <> b.rater_id join m on {on('m', 'a')} and m.result_id = a.result_id group by all),
grid as (select {by}, x.c as c, y.c as k from (select distinct {by} from s), (select unnest([1,2,3,4,5]) as c) x, (select unnest([1,2,3,4,5]) as c) y),
g as (select grid.*, coalesce(o.o, 0) as o from grid left join o using ({by}, c, k)), n as (select {by}, c, sum(o) as n from g group by all),
dd as (select {', '.join('g.' + c for c in by.split(', '))}, g.o, nc.n as nc, nk.n as nk, power((select sum(x.n) from n x where {on('x', 'g')} and x.c between g.c and g.k) - (nc.n + nk.n) / 2, 2) as d
  from g join n nc on {on('nc', 'g')} and nc.c = g.c join n nk on {on('nk', 'g')} and nk.c = g.k where g.c < g.k),
al as (select {by}, sum(o * d) as seen, sum(nc * nk * d) as expected from dd group by all), tot as (select {by}, sum(n) as total from n group by all),
cnt as (select {by}, count(*) filter (where m > 1) as n_items from m group by all)
select {by}, round(case when n_items = 0 then 0.0 when expected = 0 then 1.0 else 1 - (total - 1) * seen / expected end, 6) as alpha, n_items from al join tot using ({by}) join cnt using ({by})"""


def _live(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "rubric_rating").where("result_id is not null and rater_id is not null and domain_code is not null")
    rows = r.select("result_id", "domain_code", "rater_id", "rated_at", "rating_id", "score")
    last = N.latest_per_key(rows, ["result_id", "domain_code", "rater_id"], [F.col("rated_at").isNotNull(), F.col("rated_at"), F.col("rating_id"), F.col("score")])
    return last.where(F.col("score").between(1, 5)).select("result_id", "domain_code", "rater_id", "score")


@query(f"with {_RATED}, s as (select * from live), {_alpha('domain_code')}")
def sta4_alpha(spark: SparkSession, d: str) -> DataFrame:
    return A.alpha(_live(spark, d), ["domain_code"]).select("domain_code", F.round("alpha", 6).alias("alpha"), "n_items")


@query(f"with {_RATED}, s as (select q.provenance, live.* from live join (select result_id, max(provenance) as provenance from result_rating_summary where archived group by 1) q using (result_id) where q.provenance is not null), {_alpha('provenance, domain_code')}")
def sta5_slice_alpha(spark: SparkSession, d: str) -> DataFrame:
    """Agreement over the archived results of each provenance; slices are never pooled."""
    archived = table(spark, d, "result_rating_summary").where("archived").groupBy("result_id").agg(F.max("provenance").alias("provenance")).where("provenance is not null")
    return A.alpha(_live(spark, d).join(archived, "result_id"), ["provenance", "domain_code"]).select("provenance", "domain_code", F.round("alpha", 6).alias("alpha"), "n_items")


_PAYLOAD = "event_id || '|' || user_id || '|' || event_type"


def _chain(spark: SparkSession, d: str) -> DataFrame:
    return W.chained(table(spark, d, "events"), "event_id", F.concat_ws("|", "event_id", "user_id", "event_type"))


@query(f"""with recursive e as (select event_id, {_PAYLOAD} as p, row_number() over (order by event_id) as i from events), c as (select i, event_id, repeat('0', 64) as prev_hash, sha256(repeat('0', 64) || p) as row_hash from e where i = 1
union all select e.i, e.event_id, c.row_hash, sha256(c.row_hash || e.p) from c join e on e.i = c.i + 1) select event_id as seq, prev_hash, row_hash from c""")
def stf1_chain(spark: SparkSession, d: str) -> DataFrame:
    return _chain(spark, d).select("seq", "prev_hash", "row_hash")


@query("select event_id as seq from events where event_id % 1000 = 7 union select event_id + 1 from events where event_id % 1000 = 7 and event_id + 1 in (select event_id from events)")
def stf1_verify_chain(spark: SparkSession, d: str) -> DataFrame:
    """Rows spoiled by rule, and their successors, come out of the check."""
    bad = F.when(F.col("seq") % 1000 == 7, F.sha2(F.concat("row_hash", F.lit("x")), 256)).otherwise(F.col("row_hash"))
    return W.broken(cut(_chain(spark, d).withColumn("row_hash", bad)))


@query("""with recursive f as (select user_id, ts, event_type = 'error' as fail, row_number() over (partition by user_id order by ts, event_type = 'error') as i from events where event_type in ('error', 'signup')),
r as (select user_id, ts, fail, i, case when fail then 1 else 0 end as n, case when fail then ts + interval 6 hour end as until from f where i = 1
union all select f.user_id, f.ts, f.fail, f.i, case when not f.fail then 0 when r.until is null or f.ts >= r.until then 1 else r.n + 1 end, case when not f.fail then null when r.until is null or f.ts >= r.until then f.ts + interval 6 hour else r.until end from r join f on f.user_id = r.user_id and f.i = r.i + 1)
select user_id, ts, n as count, n > 2 as blocked from r where fail""")
def stf2_anchored_window(spark: SparkSession, d: str) -> DataFrame:
    """More than two errors of a user within six hours of the first; a signup clears the user."""
    e = table(spark, d, "events").where("event_type in ('error', 'signup')").withColumn("fail", F.col("event_type") == "error")
    return W.anchored_windows(e, "user_id", "ts", "fail", 2, 6 * 3600)


@query("""select document_version_id as version_id, row_number() over (partition by document_id order by effective_date desc nulls last, version_label desc nulls last, document_version_id desc) = 1 as current
from (select document_version_id, max(document_id) as document_id, max(version_label) as version_label, max(effective_date) as effective_date from document_version group by 1)""")
def stf3_supersession(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "document_version").groupBy(F.col("document_version_id").alias("version_id")).agg(F.max("document_id").alias("document_id"), F.max("version_label").alias("label"), F.max("effective_date").alias("effective_date"))
    return W.superseded(v).select("version_id", "current")


_ROUNDS = "rounds as (select result_id, rater_id, min(rated_at) as rt from rubric_rating where result_id is not null and rater_id is not null and rated_at is not null group by all)"


def _rounds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "rubric_rating").where("result_id is not null and rater_id is not null and rated_at is not null").select("result_id", "rater_id", F.col("rated_at").alias("at"))


@query(f"with {_ROUNDS}, p as (select *, row_number() over (partition by result_id order by rt, rater_id) as nth from rounds) select result_id, least(count(*), 3) as n_raters, min(case when nth = 3 then rt end) as archived_at from p group by 1")
def stf4_rating_replay(spark: SparkSession, d: str) -> DataFrame:
    return W.archived(_rounds(spark, d))


@query("""with v as (select document_version_id, max(status) as status, max(case when ascii(right(document_version_id, 1)) % 5 = 0 then 1 else 0 end) as gone from document_version group by 1), c as (select chunk_id, max(document_version_id) as document_version_id, max(ordinal) as o from chunk group by 1),
s as (select chunk_id, case when gone = 1 then 'withdrawn' else coalesce(status, 'unknown') end as status, case when o % 4 = 0 then 'rejected' when o % 4 = 1 then 'confirmed' end as review from c left join v using (document_version_id))
select chunk_id, status, status = 'active' and coalesce(review not in ('pending', 'rejected', 'excluded'), true) as retrievable from s""")
def stf7_status_sync(spark: SparkSession, d: str) -> DataFrame:
    """Chunks after their versions, a fifth of which is withdrawn."""
    v = table(spark, d, "document_version").groupBy("document_version_id").agg(F.max("status").alias("status"))
    c = table(spark, d, "chunk").groupBy("chunk_id").agg(F.max("document_version_id").alias("document_version_id"), F.max("ordinal").alias("o"))
    c = c.select("chunk_id", "document_version_id", F.when(F.col("o") % 4 == 0, "rejected").when(F.col("o") % 4 == 1, "confirmed").alias("review_status"))
    gone = v.where(F.ascii(F.right("document_version_id", F.lit(1))) % 5 == 0).select("document_version_id")
    return W.synced(c, v, gone).select("chunk_id", "status", "retrievable")


@query("select o_orderkey, case when o_orderstatus = 'F' then 'finalise' when o_totalprice > 300000 then 'escalate' when o_orderpriority like '1-%' then 'lookup' else 'synthesize' end as route from orders")
def stf9_routing(spark: SparkSession, d: str) -> DataFrame:
    s, p, q = F.col("o_orderstatus"), F.col("o_totalprice"), F.col("o_orderpriority")
    return table(spark, d, "orders").select("o_orderkey", P.first_rule([(s == "F", "finalise"), (p > 300000, "escalate"), (q.startswith("1-"), "lookup")], "synthesize").alias("route"))


@query("""with ref as (select p_brand as area, p_partkey as item from part where p_size < 10), n as (select area, count(distinct item) as k from ref group by 1),
r as (select l_orderkey as q, p_brand as area, l_partkey as item from lineitem join part on p_partkey = l_partkey), h as (select q, area, count(distinct case when p_size < 10 then item end) as hits from r join part on p_partkey = item group by all)
select area, count(*) as n, round(avg(hits / k), 6) as recall from h join n using (area) group by 1""")
def agg12_reference_rescoring(spark: SparkSession, d: str) -> DataFrame:
    """Orders' parts of a brand against the brand's small parts, over distinct hits."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("area"), "p_size")
    k = part.where("p_size < 10").groupBy("area").agg(F.count("*").alias("k"))
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("q"), F.col("l_partkey").alias("item")).join(part, "item")
    hits = rows.groupBy("q", "area").agg(F.count_distinct(F.when(F.col("p_size") < 10, F.col("item"))).alias("hits"))
    return hits.join(k, "area").groupBy("area").agg(F.count("*").alias("n"), F.round(F.avg(F.col("hits") / F.col("k")), 6).alias("recall"))


@query("select rater_id, count(distinct result_id) as n, count(distinct result_id) >= 5 as reached from rubric_rating where rater_id is not null group by 1")
def agg14_progress(spark: SparkSession, d: str) -> DataFrame:
    n = F.count_distinct("result_id")
    return table(spark, d, "rubric_rating").where("rater_id is not null").groupBy("rater_id").agg(n.alias("n"), (n >= 5).alias("reached"))


@query("select area, count(*) filter (where coalesce(len(ids), 0) > 0) as usable, count(*) as n from (select area, question_id, list(distinct source_record_id) filter (where source_record_id is not null) as ids from eval_question group by all) group by 1")
def agg15_usable_by_area(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "eval_question").groupBy("area", "question_id").agg(F.collect_set("source_record_id").alias("ids"))
    return q.groupBy("area").agg(F.count_if(F.coalesce(F.size("ids"), F.lit(0)) > 0).alias("usable"), F.count("*").alias("n"))


@query("select s.result_id, count(distinct rater_id) as n from (select distinct result_id from result_rating_summary) s left join rubric_rating r using (result_id) group by 1")
def agg16_assignment_counts(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "result_rating_summary").select("result_id").distinct()
    return s.join(table(spark, d, "rubric_rating").select("result_id", "rater_id"), "result_id", "left").groupBy("result_id").agg(F.count_distinct("rater_id").alias("n"))


@query("""select count(*) as n, cast(sum(cast(cast('0x' || substr(md5(concat_ws('|', event_id, user_id, event_type)), 1, 15) as bigint) as hugeint)) as varchar) as digest from events""")
def agg17_table_digest(spark: SparkSession, d: str) -> DataFrame:
    return W.table_digest(table(spark, d, "events"), ["event_id", "user_id", "event_type"])


@query("select o_orderkey, cast(round_even(o_orderkey * 0.6, 0) as bigint) as easy, cast(round_even(o_orderkey * 0.2, 0) as bigint) as medium, cast(round_even(o_orderkey * 0.2, 0) as bigint) as hard from orders")
def agg20_allocation(spark: SparkSession, d: str) -> DataFrame:
    """Totals split 60 / 20 / 20 with halves to even."""
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", *[F.bround(k * share).cast("bigint").alias(n) for n, share in (("easy", 0.6), ("medium", 0.2), ("hard", 0.2))])


@query(f"""with {_RATED} select result_id, count(distinct rater_id) as n_raters, string_agg(domain_code || ':' || score, ',' order by domain_code, rater_id) as ratings from live group by 1""")
def agg22_archive_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """The ratings of a result in one row: as many as it has raters and domains."""
    rows = F.array_sort(F.collect_list(F.struct("domain_code", "rater_id", "score")))
    text = F.array_join(F.transform(rows, lambda r: F.concat_ws(":", r["domain_code"], r["score"])), ",")
    return _live(spark, d).groupBy("result_id").agg(F.count_distinct("rater_id").alias("n_raters"), text.alias("ratings"))


@query("select record_key, arg_max(record_id, struct_pack(a := ingested_at, b := record_id)) as record_id from patient_record group by 1")
def win10_latest_record(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "patient_record").select("record_key", "ingested_at", "record_id")
    return N.latest_per_key(r, ["record_key"], [F.col("ingested_at"), F.col("record_id")]).select("record_key", "record_id")


@query("""with i as (select o_custkey, l_returnflag as name, l_shipdate as ship, l_quantity as v, row_number() over (partition by o_custkey order by l_orderkey, l_linenumber, l_partkey, l_suppkey) as pos from lineitem join orders on o_orderkey = l_orderkey)
select o_custkey, (select v from i j where j.o_custkey = i.o_custkey order by ship desc nulls last, pos limit 1) as latest, count(distinct name) as n_names from i group by 1""")
def win11_latest_entry(spark: SparkSession, d: str) -> DataFrame:
    """The latest of a customer's lines, and how many flags have a latest one."""
    li = table(spark, d, "lineitem").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    items = F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_shipdate").alias("at"), F.col("l_returnflag").alias("name"), F.col("l_quantity").alias("v"))))
    per = li.groupBy("o_custkey").agg(items.alias("items"))
    return per.select("o_custkey", N.latest_timed(F.col("items"), "at")["v"].alias("latest"), F.size(N.latest_by_name(F.col("items"), "name", "at")).cast("bigint").alias("n_names"))


@query("""select title, document_version_id from (select distinct title, document_version_id, status, ingested_at from document_version where title is not null)
qualify row_number() over (partition by title order by (status = 'active')::int desc, ingested_at desc nulls last, document_version_id) = 1""")
def win12_version_choice(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "document_version").where("title is not null").select("title", "document_version_id", "status", "ingested_at").distinct()
    active = F.coalesce((F.col("status") == "active").cast("int"), F.lit(-1))
    order = Window.partitionBy("title").orderBy(active.desc(), F.col("ingested_at").desc_nulls_last(), "document_version_id")
    return v.withColumn("rn", F.row_number().over(order)).where("rn = 1").select("title", "document_version_id")


_QUEUE = f"""{_ROUNDS}, n as (select result_id, count(*) as n from rounds group by 1), open_r as (select s.result_id, s.upd, coalesce(n, 0) as n from (select result_id, min(last_updated) as upd from result_rating_summary where result_id is not null group by 1) s left join n using (result_id) where coalesce(n, 0) <= 4),
left_r as (select r.rater_id, o.result_id, o.n, o.upd from (select distinct rater_id from rounds) r, open_r o where not exists (select 1 from rounds x where x.rater_id = r.rater_id and x.result_id = o.result_id)),
queue as (select * from left_r qualify max((n between 1 and 4)::int) over (partition by rater_id) = 0 or n between 1 and 4)"""


def _queue(spark: SparkSession, d: str) -> DataFrame:
    r = _rounds(spark, d)
    results = table(spark, d, "result_rating_summary").where("result_id is not null").groupBy("result_id").agg(F.min("last_updated").alias("created_at"))
    return W.queue(results, r, r.select("rater_id").distinct(), started=(1, 4))


@query(f"with {_QUEUE} select rater_id, result_id, n as n_raters from queue")
def win13_queue(spark: SparkSession, d: str) -> DataFrame:
    return _queue(spark, d).select("rater_id", "result_id", "n_raters")


#: Results rated by more raters than this are archived; the test table has up to nine raters a result.
OPEN_BELOW = 6
_PLAN = f"""{_ROUNDS}, n as (select result_id, count(*) as n from rounds group by 1),
res as (select result_id, min(last_updated) as c from result_rating_summary where result_id is not null group by 1), rt as (select distinct rater_id from rounds),
b as (select rater_id, result_id, row_number() over (partition by rater_id order by md5(rater_id || result_id)) as position from rt, res qualify position <= 8), bb as (select *, case when position <= 3 then 1 else 2 end as batch_no from b),
asg as (select result_id, count(distinct rater_id) as k from bb group by 1), op as (select res.*, coalesce(n, 0) as n, coalesce(k, 0) as k from res left join n using (result_id) left join asg using (result_id) where coalesce(n, 0) < {OPEN_BELOW}),
beg as (select rt.rater_id, op.result_id, c from rt, op where op.n > 0 and not exists (select 1 from rounds x where x.rater_id = rt.rater_id and x.result_id = op.result_id)),
fr as (select rt.rater_id, op.result_id, c, row_number() over (partition by rt.rater_id order by k, c nulls last, op.result_id) as nth from rt, op where op.n = 0 and rt.rater_id not in (select rater_id from beg) and not exists (select 1 from bb where bb.rater_id = rt.rater_id and bb.result_id = op.result_id)),
it as (select bb.rater_id, bb.result_id, position, op.result_id is not null as open from bb left join op using (result_id) where batch_no = 2 and rater_id not in (select rater_id from beg) and not exists (select 1 from rounds x where x.rater_id = bb.rater_id and x.result_id = bb.result_id)),
dr as (select rater_id, count(*) as d from it where not open group by 1),
off as (select rater_id, result_id, 0 as part, position::bigint as pos from it where open union all select fr.rater_id, result_id, 1, nth from fr join dr using (rater_id) where nth <= d)"""


@query(f"""with {_PLAN} select rater_id, 'in_progress' as mode, row_number() over (partition by rater_id order by c nulls last, result_id)::int as place, result_id from beg
union all select rater_id, 'batch', row_number() over (partition by rater_id order by part, pos, result_id), result_id from off
union all select rater_id, 'new', row_number() over (partition by rater_id order by c nulls last, result_id), result_id from fr where nth <= 12 and rater_id not in (select rater_id from off)""")
def win14_batches(spark: SparkSession, d: str) -> DataFrame:
    """What each rater is offered next; earlier batches are dealt by a hash."""
    r = _rounds(spark, d)
    results = table(spark, d, "result_rating_summary").where("result_id is not null").groupBy("result_id").agg(F.min("last_updated").alias("created_at"))
    raters = cut(r.select("rater_id").distinct())
    dealt = against_all(raters, results.select("result_id"))
    position = F.row_number().over(Window.partitionBy("rater_id").orderBy(F.md5(F.concat("rater_id", "result_id"))))
    batches = cut(dealt.withColumn("position", position).where("position <= 8").withColumn("batch_no", F.when(F.col("position") <= 3, 1).otherwise(2)))
    return W.batch_plan(results, r, batches, raters, needed=OPEN_BELOW)


@query("select area, n from (select area, count(distinct question_id) as n from eval_question where area is not null group by 1) where n < 1000000 qualify row_number() over (order by n, area) = 1")
def win15_neediest_area(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "eval_question").where("area is not null").groupBy("area").agg(F.count_distinct("question_id").alias("n"))
    return n.where("n < 1000000").agg(F.min(F.struct("n", "area")).alias("b")).select("b.area", "b.n")


@query("select distinct question_id, case when cast('0x' || right(sha256(question_id), 1) as int) % 2 = 0 then 'tune' else 'heldout' end as split from eval_question where question_id is not null")
def win19_hash_split(spark: SparkSession, d: str) -> DataFrame:
    digit = F.conv(F.right(F.sha2("question_id", 256), F.lit(1)), 16, 10).cast("int")
    return table(spark, d, "eval_question").where("question_id is not null").select("question_id", F.when(digit % 2 == 0, "tune").otherwise("heldout").alias("split")).distinct()


_SENT = "string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"


def _answers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """An answer per chunk: its second sentence claimed by itself, by another quote, and without a chunk; and a framing."""
    c = table(spark, d, "chunk").where("text is not null").dropDuplicates(["chunk_id"]).withColumn("s", F.split("text", r"(?<=[.!?])\s+"))
    c = c.select("chunk_id", "text", "ordinal", "chunk_type", F.get("s", F.lit(0)).alias("s1"), F.coalesce(F.get("s", F.lit(1)), F.get("s", F.lit(0))).alias("s2"))
    parts = F.array(
        F.struct(F.lit(0).alias("segment_no"), F.lit("claim").alias("type"), F.col("s2").alias("t"), F.col("s2").alias("quote")),
        F.struct(F.lit(1).alias("segment_no"), F.lit("claim").alias("type"), F.col("s2").alias("t"), F.col("s1").alias("quote")),
        F.struct(F.lit(2).alias("segment_no"), F.lit("framing").alias("type"), F.when(F.col("ordinal") % 3 == 0, "You should ask.").otherwise("In short:").alias("t"), F.lit(None).cast("string").alias("quote")),
    )
    segments = c.select(F.col("chunk_id").alias("answer_id"), F.inline(parts)).withColumnRenamed("t", "text")
    cites = c.select(
        F.col("chunk_id").alias("answer_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("segment_no"), F.lit("c1").alias("label"),
        F.when((F.col("ordinal") % 4 != 1), F.col("chunk_id")).alias("chunk_id"), F.col("text").alias("chunk_text"),
        F.when(F.col("ordinal") % 5 == 2, "pending").alias("review_status"), (F.col("chunk_type") == "table").alias("weak"),
    )
    return segments, cites


_SQ = "lower(regexp_replace({0}, '[\\s\\x0b\\x{{a0}}\\x{{2009}}\\x{{202f}}]+', '', 'g'))"
from marlstone.functions.text import DOSE  # noqa: E402

_JUDGED = f"""c as (select chunk_id, any_value(text) as text, any_value(ordinal) as ordinal, any_value(chunk_type) as chunk_type from chunk where text is not null group by 1),
p as (select chunk_id as answer_id, ordinal, chunk_type, {_SENT}[1] as s1, coalesce({_SENT}[2], {_SENT}[1]) as s2 from c),
w as (select *, {sql_words('s2', GROUNDING_STOPWORDS)} as w2, {sql_words('s1', GROUNDING_STOPWORDS)} as w1, list_distinct(list_transform(regexp_extract_all(s2, '{DOSE}'), lambda x: {_SQ.format('x')})) as doses from p),
seg as (select answer_id, 0 as segment_no, ordinal, chunk_type, case when len(w2) = 0 then 0.0 else 1.0 end as share, len(list_filter(doses, lambda x: not contains({_SQ.format('s2')}, x))) > 0 as breach from w
 union all select answer_id, 1, ordinal, chunk_type, case when len(w2) = 0 then 0.0 else len(list_intersect(w2, w1)) / len(w2) end, len(list_filter(doses, lambda x: not contains({_SQ.format('s1')}, x))) > 0 from w),
r as (select *, case when ordinal % 4 = 1 then 'citation_not_retrieved' when ordinal % 5 = 2 then 'chunk_under_review' when breach then 'scope_violation' when share < 0.3 then 'not_entailed' end as reason from seg),
judged as (select answer_id, segment_no, 'claim' as type, case when reason is not null then 'unsupported' when share >= 0.6 and chunk_type is distinct from 'table' then 'supported' else 'weak' end as verdict, reason from r
 union all select answer_id, 2, 'framing', case when ordinal % 3 = 0 then 'unsupported' else 'supported' end, case when ordinal % 3 = 0 then 'scope_violation' end from w)"""


@query(f"with {_JUDGED} select * from judged")
def sco6_grounding(spark: SparkSession, d: str) -> DataFrame:
    return G.verdicts(*_answers(spark, d))


@query(f"""with {_JUDGED}, a as (select answer_id, bool_or(coalesce(reason = 'scope_violation', false)) as breach, count(*) filter (where type = 'claim' and verdict = 'unsupported' and reason <> 'scope_violation') as n_failed,
 bool_or(type = 'claim' and verdict in ('supported', 'weak')) as some_ok, bool_or(verdict = 'weak') as weak from judged group by 1)
select answer_id, case when breach then 'escalate' when n_failed = 0 then case when weak then 'release_marked' else 'release' end when some_ok then 'partial_strip' else 'escalate' end as action from a""")
def sco6_actions(spark: SparkSession, d: str) -> DataFrame:
    return G.actions(G.verdicts(*_answers(spark, d))).select("answer_id", "action")


@query(f"""with c as (select chunk_id, any_value(text) as text, any_value(char_start) as char_start from chunk where text is not null group by 1), q as (select *, coalesce({_SENT}[2], '') as quote from c)
select chunk_id, case when quote <> '' then (char_start + strpos(text, quote) - 1)::bigint end as span_start, case when quote <> '' then (char_start + strpos(text, quote) - 1 + len(quote))::bigint end as span_end from q""")
def sco7_citation_spans(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunk").where("text is not null").dropDuplicates(["chunk_id"])
    quote = F.coalesce(F.get(F.split("text", r"(?<=[.!?])\s+"), F.lit(1)), F.lit(""))
    span = G.cited_span(F.col("char_start"), F.col("text"), quote)
    return c.select("chunk_id", span["start"].cast("bigint").alias("span_start"), span["end"].cast("bigint").alias("span_end"))


@query(f"""with c as (select chunk_id, any_value(text) as text, any_value(char_start) as cs, any_value(ordinal) as o from chunk where text is not null group by 1), q as (select *, coalesce({_SENT}[2], '') as quote from c),
p as (select *, cs + strpos(text, quote) - 1 + case when o % 3 = 0 then 1 when o % 3 = 1 then 0 else -1000000 end as a from q where quote <> ''), e as (select *, a + len(quote) as b, substr(quote, 5, 10) as fixed from p),
t as (select *, trim(regexp_replace(substr(text, (a - cs + 1)::bigint, (b - a)::bigint), '\\s+', ' ', 'g')) = trim(regexp_replace(quote, '\\s+', ' ', 'g')) as same, strpos(text, fixed) as f, strpos(text, quote) as qa from e)
select chunk_id, coalesce(a >= 0 and a - cs >= 0 and b - cs <= len(text) and same, false) as holds, (fixed <> '' and f > 0 and f < qa + len(quote) and qa < f + len(fixed))::int as n_corrections from t""")
def sco7_reverified(spark: SparkSession, d: str) -> DataFrame:
    """Stored spans of quotes, some moved by one and some out of the chunk, looked up again; and corrections that lie on the quote."""
    c = table(spark, d, "chunk").where("text is not null").dropDuplicates(["chunk_id"])
    q = c.withColumn("quote", F.coalesce(F.get(F.split("text", r"(?<=[.!?])\s+"), F.lit(1)), F.lit(""))).where("quote <> ''")
    o = F.col("ordinal") % 3
    start = F.col("char_start") + F.instr("text", F.col("quote")) - 1 + F.when(o == 0, 1).when(o == 1, 0).otherwise(-1_000_000)
    q = q.withColumn("a", start).withColumn("b", start + F.length("quote"))
    fixes = F.array(F.struct(F.lit("f").alias("correction_id"), F.substr("quote", F.lit(5), F.lit(10)).alias("corrected")))
    holds = G.verified_span(F.col("a"), F.col("b"), F.col("char_start"), F.col("text"), F.col("quote"))
    return q.select("chunk_id", holds.alias("holds"), F.size(G.corrections_on(fixes, F.col("text"), F.col("quote"))).alias("n_corrections"))


@query("select o_orderkey, o_orderstatus = 'F' and o_orderkey % 10 <> 0 as passes from orders")
def sco8_outcome_rule(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", G.passes(F.lit("F"), F.col("o_orderstatus"), F.col("o_orderkey") % 10 == 0).alias("passes"))
