"""Queries of scoring, fusion, selection and metrics.

Every document whose id is divisible by 100 asks with its text against all other documents; vectors likewise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions.text import query_terms
from marlstone.operators import metrics as M
from marlstone.operators import retrieval as R
from marlstone.plans.text_queries import sql_tokens
from marlstone.session import cut, on_release
from marlstone.tables import state, table

QUERIES: dict = {}
SQL: dict[str, str] = {}

WEIGHTS = [0.0, 0.25, 0.5, 0.75, 1.0]
KS = [5, 8, 24]
#: The grid of the sweep: texts x scorers x fusions x weights x ks.
GRID_WEIGHTS = [round(0.1 * i, 1) for i in range(11)]
GRID_KS = [1, 2, 3, 5, 8, 10, 12, 16, 20, 24]
ARM = ["fusion", "words", "scorer", "weight"]
DEPTH = 100


def query(sql: str | None = None):  # noqa: ANN201
    def register(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", "source", "doc_type", "text")


def postings(spark: SparkSession, d: str) -> DataFrame:
    return cut(R.terms(documents(spark, d), "doc_id", "text"))


def asked(held: DataFrame) -> DataFrame:
    """Query terms from the postings of the asking documents."""
    return held.where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), "term", F.lit(1.0).alias("weight"))


def bags(spark: SparkSession, d: str) -> DataFrame:
    return cut(R.bags(documents(spark, d), "doc_id", "text"))


def asking(held: DataFrame) -> DataFrame:
    """asked() from bags."""
    return R.terms_of(held.where("item_id % 100 = 0"))


def lexical(spark: SparkSession, d: str, depth: int | None = None) -> DataFrame:
    """Scores of the other documents; with a depth those from which its first depth items a query can be ranked."""
    held = bags(spark, d)
    return R.scored(asking(held), held, depth=depth).where("query_id <> item_id")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label").withColumn("vector", F.col("embedding").cast("array<double>"))


def dense(spark: SparkSession, d: str, depth: int = DEPTH) -> DataFrame:
    held = vectors(spark, d)
    return R.cosine(held.where("id % 100 = 0").select("id", "vector"), held.select("id", "vector"), depth)


def pool(spark: SparkSession, d: str) -> DataFrame:
    """Both channels' first DEPTH items."""
    return cut(R.channels(R.top(lexical(spark, d, DEPTH), DEPTH), dense(spark, d)))


def gold(spark: SparkSession, d: str) -> DataFrame:
    """Documents of the asking document's source and kind."""
    docs = documents(spark, d).select("doc_id", "source", "doc_type")
    q = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "source", "doc_type")
    return q.join(docs, ["source", "doc_type"]).where("doc_id <> query_id").select("query_id", F.col("doc_id").alias("item_id"))


_BASE = f"""docs as (select doc_id, source, doc_type, text from documents where text is not null),
post as (select doc_id, term, count(*)::double as tf from (select doc_id, unnest({sql_tokens('text')}) as term from docs) group by all),
len as (select doc_id, sum(tf) as dl from post group by 1),
size as (select count(*) as n, avg(dl) as mean from len),
freq as (select term, count(*) as df from post group by 1),
q as (select doc_id as query_id, term from post where doc_id % 100 = 0),
okapi as (select query_id, doc_id as item_id,
    round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) as score
  from q join freq using (term) join post using (term) join len using (doc_id), size where query_id <> doc_id group by all),
e as (select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings),
cosine as (select a.vec_id as query_id, b.vec_id as item_id,
    round(list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))), 6) as score
  from e a join e b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
lex as (select *, row_number() over (partition by query_id order by score desc, item_id) as rank from okapi),
den as (select *, row_number() over (partition by query_id order by score desc, item_id) as rank from cosine),
pool as (select coalesce(l.query_id, d.query_id) as query_id, coalesce(l.item_id, d.item_id) as item_id, l.score as lexical, d.score as dense
  from (select * from lex where rank <= {DEPTH}) l full join (select * from den where rank <= {DEPTH}) d on l.query_id = d.query_id and l.item_id = d.item_id),
gold as (select a.doc_id as query_id, b.doc_id as item_id from docs a join docs b
  on a.source = b.source and a.doc_type = b.doc_type and a.doc_id <> b.doc_id where a.doc_id % 100 = 0)"""
_W = ", ".join(f"({w})" for w in WEIGHTS)
_SCALED = """scaled as (select query_id, item_id,
  case when max(l) over p = min(l) over p then 1.0 else (l - min(l) over p) / (max(l) over p - min(l) over p) end as l,
  case when max(d) over p = min(d) over p then 1.0 else (d - min(d) over p) / (max(d) over p - min(d) over p) end as d
  from (select query_id, item_id, coalesce(lexical, 0) as l, coalesce(dense, 0) as d from pool) window p as (partition by query_id))"""
_BLEND = f"""{_SCALED},
blend as (select query_id, item_id, w::double as weight, round(w * l + (1 - w) * d, 6) as score from scaled, (values {_W}) v(w))"""
_RRF = f"""placed as (select *, case when lexical is not null then row_number() over (partition by query_id order by lexical desc nulls last, item_id) end as rl,
  case when dense is not null then row_number() over (partition by query_id order by dense desc nulls last, item_id) end as rd from pool),
rrf as (select query_id, item_id, w::double as weight, round(coalesce(w / (60 + rl), 0) + coalesce((1 - w) / (60 + rd), 0), 9) as score from placed, (values {_W}) v(w))"""
_KS = ", ".join(f"({k})" for k in KS)


def _metrics_sql(runs: str, arm: str = "", gold_name: str = "gold") -> str:
    by = f"{arm}, " if arm else ""
    return f"""marked as (select r.*, g.item_id is not null as is_gold from {runs} r left join {gold_name} g on r.query_id = g.query_id and r.item_id = g.item_id),
sizes as (select query_id, count(*) as n_gold from {gold_name} group by 1),
per as (select {by}query_id, k, count(*) filter (where is_gold and rank <= k) as hits, count(*) filter (where rank <= k) as n_returned,
  min(case when is_gold and rank <= k then rank end) as first_rank from marked, (values {_KS}) v(k) group by all),
measured as (select {by}query_id, k, hits, n_returned, n_gold, round(case when n_returned = 0 then 0.0 else hits / n_returned end, 6) as precision,
  round(hits / n_gold, 6) as recall, (hits > 0)::int::double as hit, first_rank, round(coalesce(1 / first_rank, 0.0), 6) as reciprocal_rank
  from per join sizes using (query_id))"""


@query(f"with {_BASE} select (select n from size) as n_items, (select round(mean, 6) from size) as mean_length, count(*) as n_terms, sum(df)::bigint as n_postings from freq")
def agg1_corpus_statistics(spark: SparkSession, d: str) -> DataFrame:
    held = postings(spark, d)
    size = R.lengths(held).agg(F.count("*").alias("n_items"), F.round(F.avg("n_terms"), 6).alias("mean_length"))
    freq = R.document_frequency(held).agg(F.count("*").alias("n_terms"), F.sum("df").alias("n_postings"))
    n = freq.first()  # two numbers
    return size.select("*", F.lit(n.n_terms).alias("n_terms"), F.lit(n.n_postings).cast("bigint").alias("n_postings"))


@query(f"with {_BASE} select query_id, doc_id as item_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf), 6) as score from q join freq using (term) join post using (term), size where query_id <> doc_id group by all")
def sco1_tf_idf(spark: SparkSession, d: str) -> DataFrame:
    held = postings(spark, d)
    return R.tf_idf(asked(held), held).where("query_id <> item_id")


@query(f"with {_BASE} select * from okapi")
def sco2_okapi_bm25(spark: SparkSession, d: str) -> DataFrame:
    return lexical(spark, d)


@query(f"with {_BASE} select query_id, item_id, score from den where rank <= {DEPTH}")
def sco3_cosine(spark: SparkSession, d: str) -> DataFrame:
    return dense(spark, d)


@query(f"""with {_BASE}, w as (select doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) as w from docs)
select query_id, item_id, round(len(list_intersect(a.w, b.w)) / nullif(len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)), 0), 6) as score
from lex join w a on a.doc_id = query_id join w b on b.doc_id = item_id where rank <= 24""")
def sco4_overlap_rerank(spark: SparkSession, d: str) -> DataFrame:
    """The first 24 lexical items scored again by overlap of words."""
    docs = documents(spark, d)
    first = R.top(lexical(spark, d, 24), 24).select("query_id", "item_id")
    both = first.join(docs.select(F.col("doc_id").alias("query_id"), F.col("text").alias("a")), "query_id").join(
        docs.select(F.col("doc_id").alias("item_id"), F.col("text").alias("b")), "item_id"
    )
    return both.select("query_id", "item_id", F.round(R.token_jaccard(F.col("a"), F.col("b")), 6).alias("score"))


@query()
def sco4_stub_vector(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunk").where("text is not null").select("chunk_id", "text").distinct().select("chunk_id", R.stub_vector(F.col("text"), 64).alias("vector"))


@query(f"with {_BASE} select query_id, count(*) as n_candidates, count(distinct item_id) as n_items, round(max(score), 6) as best from okapi group by 1")
def joi1_lexical_candidates(spark: SparkSession, d: str) -> DataFrame:
    return lexical(spark, d).groupBy("query_id").agg(F.count("*").alias("n_candidates"), F.count_distinct("item_id").alias("n_items"), F.round(F.max("score"), 6).alias("best"))


@query(f"with {_BASE} select query_id, count(*) as n, round(avg(score), 5) as mean from den where rank <= {DEPTH} group by 1")
def joi2_dense_candidates(spark: SparkSession, d: str) -> DataFrame:
    return dense(spark, d).groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.avg("score"), 5).alias("mean"))


@query(f"with {_BASE} select * from pool")
def joi3_channel_union(spark: SparkSession, d: str) -> DataFrame:
    return pool(spark, d)


@query(f"with {_BASE}, {_SCALED} select query_id, item_id, round(l, 6) as lexical, round(d, 6) as dense from scaled")
def agg2_min_max(spark: SparkSession, d: str) -> DataFrame:
    filled = pool(spark, d).fillna(0.0, ["lexical", "dense"])
    scaled = R.min_max(R.min_max(filled, "lexical"), "dense")
    return scaled.select("query_id", "item_id", F.round("lexical", 6).alias("lexical"), F.round("dense", 6).alias("dense"))


@query(f"with {_BASE}, {_BLEND} select query_id, weight, item_id, row_number() over (partition by query_id, weight order by score desc, item_id) as rank from blend qualify rank <= 24")
def win1_weighted_rank(spark: SparkSession, d: str) -> DataFrame:
    scores = R.blended(pool(spark, d), WEIGHTS)
    return R.top(scores, 24, ["query_id", "weight"]).select("query_id", "weight", "item_id", "rank")


@query(f"""with {_BASE}, r as (select query_id, item_id, rank from lex where rank <= {DEPTH} union all select query_id, item_id, rank from den where rank <= {DEPTH})
select query_id, item_id, round(sum(1 / (60.0 + rank)), 9) as score from r group by all""")
def win2_reciprocal_rank(spark: SparkSession, d: str) -> DataFrame:
    return R.reciprocal([R.top(lexical(spark, d, DEPTH), DEPTH), R.ranked(dense(spark, d))])


@query(f"with {_BASE}, {_RRF} select * from rrf")
def win3_weighted_reciprocal(spark: SparkSession, d: str) -> DataFrame:
    return R.weighted_reciprocal(pool(spark, d), WEIGHTS)


@query(f"""with {_BASE}, r as (select query_id, item_id, rank from lex where rank <= 40 union all select query_id, item_id, rank from den where rank <= 40),
f as (select query_id, item_id, round(sum(1 / (60.0 + rank)), 9) as score from r group by all)
select *, row_number() over (partition by query_id order by score desc, item_id) as rank from f qualify rank <= 24""")
def win4_hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    return R.hybrid(lexical(spark, d, R.CANDIDATES), dense(spark, d))


@query(f"with {_BASE} select * from lex where rank <= 24")
def win5_top_n(spark: SparkSession, d: str) -> DataFrame:
    return R.top(lexical(spark, d, 24), 24)


@query(f"""with {_BASE} select q.query_id, docs.doc_id as item_id, row_number() over (partition by q.query_id order by score desc nulls last, docs.doc_id) as rank
from (select distinct query_id from q) q, docs left join okapi o on o.query_id = q.query_id and o.item_id = docs.doc_id qualify rank <= {DEPTH}""")
def win6_unscored_behind(spark: SparkSession, d: str) -> DataFrame:
    held = postings(spark, d)
    scores = R.okapi(asked(held), held).where("query_id <> item_id")
    return R.with_rest(scores, asked(held).select("query_id"), documents(spark, d).select(F.col("doc_id").alias("item_id")), DEPTH)


# Sources that come first, in this order; the others follow together.
PRIORITIES = [("velnor_guideline_office", 2), ("kestrel_newborn_network", 1)]
_PRIO = ", ".join(f"('{s}', {p})" for s, p in PRIORITIES)


def _by_group(spark: SparkSession, d: str, scores: DataFrame | None = None) -> DataFrame:
    titles = documents(spark, d).select(F.col("doc_id").alias("document"), "source")
    named = titles.join(spark.createDataFrame(PRIORITIES, "source string, priority int"), "source", "left")
    scores = (lexical(spark, d) if scores is None else scores).withColumn("document", F.col("item_id"))
    group = F.coalesce("priority", F.lit(max(p for _, p in PRIORITIES) + 1)).alias("group")
    return scores.join(named, "document").select("query_id", "item_id", "score", group, F.coalesce("source", F.lit("")).alias("document"))


_GROUPED = f"""grouped as (select query_id, item_id, score, coalesce(source, '') as document, coalesce(p.priority, 3) as "group"
 from okapi join docs on doc_id = item_id left join (values {_PRIO}) p(source, priority) using (source))"""


@query(f"""with {_BASE}, {_GROUPED} select query_id, "group", item_id, row_number() over (partition by query_id, "group" order by score desc, item_id) as rank from grouped qualify rank <= 10""")
def win7_groups(spark: SparkSession, d: str) -> DataFrame:
    return R.top(_by_group(spark, d), 10, ["query_id", "group"]).select("query_id", "group", "item_id", "rank")


@query(f"""with {_BASE}, {_GROUPED},
s as (select *, case when item_id % 3 = 0 then document || '-' || (item_id % 4) end as split_id from grouped where score >= 2),
p as (select *, case when split_id is null then 0 else row_number() over (partition by query_id, "group", split_id order by score desc, item_id) end as part from s qualify part <= 2)
select query_id, "group", document, item_id, score from p qualify row_number() over (partition by query_id, "group", document order by score desc, item_id) <= 3""")
def win8_select_per_guideline(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("item_id")
    split = F.when(k % 3 == 0, F.concat("document", F.lit("-"), k % 4))
    held = cut(R.bags(documents(spark, d).withColumn("document", F.coalesce("source", F.lit(""))), "doc_id", "text", ["document"]))
    # No more than the cap of a document's whole items and of each of its split tables can be taken.
    first = R.scored(asking(held), held, depth=3, label=F.when(F.col("document").isNotNull(), F.concat_ws("/", "document", split)), least=2.0).where("query_id <> item_id")
    return R.capped(_by_group(spark, d, first).withColumn("split_id", split), cap=3, least=2.0, parts=2).select("query_id", "group", "document", "item_id", "score")


@query(f"""with {_BASE}, r as (select query_id, item_id, rank from lex where rank <= 40 union all select query_id, item_id, rank from den where rank <= 40),
f as (select query_id, item_id, round(sum(1 / (60.0 + rank)), 9) as score from r group by all),
t as (select *, row_number() over (partition by query_id order by score desc, item_id) as fused from f qualify fused <= 24),
s as (select t.*, round(coalesce(c.score, 0), 6) as rerank from t left join cosine c using (query_id, item_id))
select query_id, item_id, fused, rerank, row_number() over (partition by query_id order by rerank desc, fused) as rank from s qualify rank <= 8""")
def win9_rerank_top(spark: SparkSession, d: str) -> DataFrame:
    """The fused list ordered again by the vectors' similarity; equal scores keep the fused order."""
    fused = R.hybrid(lexical(spark, d, R.CANDIDATES), dense(spark, d)).select("query_id", "item_id", F.col("rank").alias("fused"))
    held = vectors(spark, d)
    scored = R.pair_cosine(fused, held, held).withColumn("rerank", F.coalesce("score", F.lit(0.0)))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("rerank").desc(), "fused"))
    return scored.select("query_id", "item_id", "fused", "rerank", rank.alias("rank")).where("rank <= 8")


@query(f"""with {_BASE}, t as (select * from den where rank <= 24)
select query_id, max(score) as top_score, count(*) filter (where score >= 0.20) as supporting, max(score) < 0.20 as essentially_empty,
 max(score) < 0.30 or count(*) filter (where score >= 0.20) < 2 as low_confidence from t group by 1""")
def agg19_confidence(spark: SparkSession, d: str) -> DataFrame:
    return R.confidence(dense(spark, d, 24))


@query(f"""with {_BASE}, t as (select query_id, item_id, score, coalesce(source, '') as document, greatest(1, cast(ceil(len(text) / 3.2) as int)) as tokens from lex join docs on doc_id = item_id where rank <= 24),
k as (select *, row_number() over (partition by query_id, document order by score desc, item_id desc) = 1 as keeps from t),
s as (select *, sum(tokens) over (partition by query_id order by keeps desc, score desc, item_id desc rows unbounded preceding) as upto from k)
select query_id, document, item_id, score, tokens from s where upto <= 4000""")
def win17_budget(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d).select(F.col("doc_id").alias("item_id"), F.coalesce("source", F.lit("")).alias("document"), F.greatest(F.lit(1), F.ceil(F.length("text") / 3.2).cast("int")).alias("tokens"))
    return R.budgeted(R.top(lexical(spark, d, 24), 24).join(docs, "item_id").select("query_id", "document", "item_id", "score", "tokens"), 4000)


@query(f"with {_BASE}, {_metrics_sql('lex')} select query_id, k, hits, n_returned, n_gold, precision, recall from measured")
def agg3_precision_recall(spark: SparkSession, d: str) -> DataFrame:
    runs = R.top(lexical(spark, d, max(KS)), max(KS))
    return M.at_k(runs, gold(spark, d), KS).select("query_id", "k", "hits", "n_returned", "n_gold", "precision", "recall")


@query(f"with {_BASE}, {_metrics_sql('lex')} select query_id, k, hit, first_rank, reciprocal_rank from measured")
def agg4_reciprocal_rank(spark: SparkSession, d: str) -> DataFrame:
    runs = R.top(lexical(spark, d, max(KS)), max(KS))
    return M.at_k(runs, gold(spark, d), KS).select("query_id", "k", "hit", "first_rank", "reciprocal_rank")


def asked_enriched(spark: SparkSession, d: str, asks: DataFrame) -> DataFrame:
    """The asking documents' terms with the words of their kind, for every other one of them; the others ask as they are."""
    kind = documents(spark, d).where("doc_id % 200 = 0").select(F.col("doc_id").alias("query_id"), F.explode(F.split("doc_type", "_")).alias("term"))
    return asks.select("query_id", "term").unionByName(kind).distinct().withColumn("weight", F.lit(1.0))


_stored: dict[tuple, DataFrame] = {}
on_release.append(_stored.clear)


def sweep(spark: SparkSession, d: str) -> DataFrame:
    """fusion, words, scorer, weight, query_id, k and the metrics: every cell of the grid for every query.

    The rows are written once per session and state of the tables and read by every summary; each text and scorer is scored
    once, a ranking serves all ks.
    """
    key = (spark.sparkContext.applicationId, d, state(spark, d, "documents", "embeddings"))
    if key in _stored:
        return _stored[key]
    held = bags(spark, d)
    by = ["words", "scorer", "query_id"]
    plain = cut(asking(held))
    enriched = asked_enriched(spark, d, plain)
    # Queries that get no further word have the plain scores.
    changed = cut(enriched.join(plain, ["query_id", "term"], "left_anti").select("query_id").distinct())
    query = plain.select(F.struct(F.lit("plain").alias("words"), "query_id").alias("query_id"), "term", "weight")
    more = enriched.join(changed, "query_id", "left_semi").select(F.struct(F.lit("enriched").alias("words"), "query_id").alias("query_id"), "term", "weight")
    scorer = F.when(F.col("norm"), "okapi").otherwise("tf_idf").alias("scorer")
    scored = R.scored_by(query.unionByName(more), held, [True, False], DEPTH).where("query_id.query_id <> item_id")
    first = cut(R.top(scored.select("query_id.words", scorer, "query_id.query_id", "item_id", "score"), DEPTH, by).drop("rank"))
    same = first.where("words = 'plain'").join(changed, "query_id", "left_anti").withColumn("words", F.lit("enriched"))
    arms = F.explode(F.array(*[F.struct(F.lit(w).alias("words"), F.lit(c).alias("scorer")) for w in ("plain", "enriched") for c in ("okapi", "tf_idf")])).alias("arm")
    vector = dense(spark, d).select("*", arms).select("arm.words", "arm.scorer", "query_id", "item_id", "score")
    both = cut(R.channels(first.unionByName(same), vector, by))
    lin = R.top(R.blended(both, GRID_WEIGHTS, by), max(GRID_KS), [*by, "weight"]).withColumn("fusion", F.lit("min_max"))
    rrf = R.top(R.weighted_reciprocal(both, GRID_WEIGHTS, by=by), max(GRID_KS), [*by, "weight"]).withColumn("fusion", F.lit("rrf"))
    _stored[key] = cut(M.at_k(lin.unionByName(rrf), gold(spark, d), GRID_KS, ARM))
    return _stored[key]


_GW = ", ".join(f"({w})" for w in GRID_WEIGHTS)
_GK = ", ".join(f"({k})" for k in GRID_KS)
_SWEEP = f"""{_BASE},
kind as (select doc_id as query_id, unnest(string_split(doc_type, '_')) as term from docs where doc_id % 200 = 0),
qt as (select 'plain' as words, query_id, term from q union all select 'enriched', query_id, term from (select query_id, term from q union select query_id, term from kind)),
sc as (select words, 'okapi' as scorer, query_id, doc_id as item_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) as score
  from qt join freq using (term) join post using (term) join len using (doc_id), size where query_id <> doc_id group by all
 union all select words, 'tf_idf', query_id, doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf), 6) from qt join freq using (term) join post using (term), size where query_id <> doc_id group by all),
lx as (select *, row_number() over (partition by words, scorer, query_id order by score desc, item_id) as rank from sc),
dn as (select words, scorer, den.* from den, (values ('plain', 'okapi'), ('plain', 'tf_idf'), ('enriched', 'okapi'), ('enriched', 'tf_idf')) a(words, scorer) where rank <= {DEPTH}),
gp as (select coalesce(l.words, x.words) as words, coalesce(l.scorer, x.scorer) as scorer, coalesce(l.query_id, x.query_id) as query_id, coalesce(l.item_id, x.item_id) as item_id, l.score as lexical, x.score as dense
  from (select * from lx where rank <= {DEPTH}) l full join dn x on l.words = x.words and l.scorer = x.scorer and l.query_id = x.query_id and l.item_id = x.item_id),
gs as (select words, scorer, query_id, item_id, case when max(l) over p = min(l) over p then 1.0 else (l - min(l) over p) / (max(l) over p - min(l) over p) end as l,
  case when max(d) over p = min(d) over p then 1.0 else (d - min(d) over p) / (max(d) over p - min(d) over p) end as d
  from (select words, scorer, query_id, item_id, coalesce(lexical, 0) as l, coalesce(dense, 0) as d from gp) window p as (partition by words, scorer, query_id)),
gb as (select words, scorer, query_id, item_id, w::double as weight, round(w * l + (1 - w) * d, 6) as score from gs, (values {_GW}) v(w)),
gr as (select *, case when lexical is not null then row_number() over (partition by words, scorer, query_id order by lexical desc nulls last, item_id) end as rl,
  case when dense is not null then row_number() over (partition by words, scorer, query_id order by dense desc nulls last, item_id) end as rd from gp),
gf as (select words, scorer, query_id, item_id, w::double as weight, round(coalesce(w / (60 + rl), 0) + coalesce((1 - w) / (60 + rd), 0), 9) as score from gr, (values {_GW}) v(w)),
runs as (select 'min_max' as fusion, words, scorer, weight, query_id, item_id, row_number() over (partition by words, scorer, query_id, weight order by score desc, item_id) as rank from gb
 union all select 'rrf', words, scorer, weight, query_id, item_id, row_number() over (partition by words, scorer, query_id, weight order by score desc, item_id) from gf),
{_metrics_sql('runs', 'fusion, words, scorer, weight').replace(_KS, _GK)}"""


@query(f"with {_SWEEP} select fusion, words, scorer, weight, query_id, k, precision, recall, hit, first_rank, reciprocal_rank from measured")
def abl3_full_sweep(spark: SparkSession, d: str) -> DataFrame:
    return sweep(spark, d).select(*ARM, "query_id", "k", "precision", "recall", "hit", "first_rank", "reciprocal_rank")


@query(f"with {_SWEEP} select fusion, words, scorer, weight, k, count(*) as n, (floor(sum(cast(round(recall * 1000000) as bigint))::double / count(recall) + 0.5) / 1000000) as recall, (floor(sum(cast(round(reciprocal_rank * 1000000) as bigint))::double / count(reciprocal_rank) + 0.5) / 1000000) as reciprocal_rank from measured group by all")
def agg6_sweep_summary(spark: SparkSession, d: str) -> DataFrame:
    return M.summary(sweep(spark, d), [*ARM, "k"], ["recall", "reciprocal_rank"])


@query(f"with {_SWEEP}, p as (select fusion, k, query_id, (floor(sum(cast(round(recall * 1000000) as bigint))::double / count(recall) + 0.5) / 1000000) as v from measured group by all) select fusion, k, count(*) as n, (floor(sum(cast(round(v * 1000000) as bigint))::double / count(v) + 0.5) / 1000000) as value from p group by all")
def agg7_marginal(spark: SparkSession, d: str) -> DataFrame:
    return M.marginal(sweep(spark, d), ["fusion", "k"], "recall")


@query(f"""with {_SWEEP}, p as (select fusion, words, scorer, weight, k, (floor(sum(cast(round(recall * 1000000) as bigint))::double / count(recall) + 0.5) / 1000000) as recall from measured group by all)
select fusion, words, scorer, k, weight, recall from p qualify row_number() over (partition by fusion, words, scorer, k order by recall desc, weight) = 1""")
def agg8_best_weight(spark: SparkSession, d: str) -> DataFrame:
    means = M.summary(sweep(spark, d), [*ARM, "k"], ["recall"])
    return M.best(means, ["fusion", "words", "scorer", "k"], "weight", "recall")


@query(f"""with {_SWEEP}, p as (select words, k, query_id, (floor(sum(cast(round(recall * 1000000) as bigint))::double / count(recall) + 0.5) / 1000000) as v from measured where scorer = 'tf_idf' group by all) select words, k, count(*) as n, (floor(sum(cast(round(v * 1000000) as bigint))::double / count(v) + 0.5) / 1000000) as value from p group by all""")
def agg8_level_summary(spark: SparkSession, d: str) -> DataFrame:
    """Means by text over one scorer's rows; the fusions and weights are free dimensions."""
    return M.marginal(M.core_rows(sweep(spark, d)), ["words", "k"], "recall")


@query(f"""with {_SWEEP} select scorer, count(*) as n from measured where scorer = case when (select count(distinct scorer) from measured) = 1 then (select max(scorer) from measured) else 'tf_idf' end group by 1""")
def flt11_core_rows(spark: SparkSession, d: str) -> DataFrame:
    """Of a run with two scorers the rows of the plainer one."""
    return M.core_rows(sweep(spark, d)).groupBy("scorer").agg(F.count("*").alias("n"))


@query(f"""with {_SWEEP}, a as (select query_id, (floor(sum(cast(round(recall * 1000000) as bigint))::double / count(recall) + 0.5) / 1000000) as a from measured where fusion = 'min_max' and k = 8 group by 1), b as (select query_id, (floor(sum(cast(round(recall * 1000000) as bigint))::double / count(recall) + 0.5) / 1000000) as b from measured where fusion = 'rrf' and k = 8 group by 1)
select query_id, round(a, 6) as a, round(b, 6) as b, round(a - b, 6) as delta from a join b using (query_id)""")
def set2_paired_queries(spark: SparkSession, d: str) -> DataFrame:
    rows = M.paired(sweep(spark, d).where("k = 8"), "fusion", "min_max", "rrf", "recall")
    return rows.withColumn("a", F.round("a", 6)).withColumn("b", F.round("b", 6))


@query(f"""with {_SWEEP}, arms as (select fusion, words, scorer, weight, query_id, k, recall from measured where k in (5, 8)),
base as (select query_id, k, recall as base from arms where fusion = 'rrf' and words = 'plain' and scorer = 'okapi' and weight = 0.5)
select fusion, words, scorer, weight, k, count(*) as n, (floor(sum(cast(round((recall - base) * 1000000) as bigint))::double / count((recall - base)) + 0.5) / 1000000) as delta from arms join base using (query_id, k) group by all""")
def agg9_added_arms(spark: SparkSession, d: str) -> DataFrame:
    arms = sweep(spark, d).where("k in (5, 8)").select(*ARM, "query_id", "k", "recall")
    base = arms.where("fusion = 'rrf' and words = 'plain' and scorer = 'okapi' and weight = 0.5").select("query_id", "k", F.col("recall").alias("base"))
    return arms.join(base, ["query_id", "k"]).withColumn("delta", F.col("recall") - F.col("base")).groupBy(*ARM, "k").agg(F.count("*").alias("n"), M.mean("delta").alias("delta"))


_SPLIT = "case when cast('0x' || right(sha256(query_id::varchar), 1) as int) % 2 = 0 then 'tune' else 'heldout' end"


@query(f"""with {_SWEEP}, m as (select query_id, weight, (floor(sum(cast(round(reciprocal_rank * 1000000) as bigint))::double / count(reciprocal_rank) + 0.5) / 1000000) as v, {_SPLIT} as split from measured where fusion = 'min_max' and k = 8 group by query_id, weight),
t as (select weight, (floor(sum(cast(round(v * 1000000) as bigint))::double / count(v) + 0.5) / 1000000) as score from m where split = 'tune' group by 1), best as (select weight, score from t qualify row_number() over (order by score desc, weight) = 1)
select best.weight, score, h.n, h.delta from best, (select count(*) as n, round(avg(a.v - b.v), 6) as delta from m a join best on a.weight = best.weight join m b on a.query_id = b.query_id and b.weight = 0.5 where a.split = 'heldout') h""")
def agg21_tuned_choice(spark: SparkSession, d: str) -> DataFrame:
    """The weight that is best on the tuning half, and its gain over 0.5 on the other half; agg21_heldout_test adds its test."""
    return _tuned(spark, d).select("weight", "score", "n", "delta")


def _tuned(spark: SparkSession, d: str) -> DataFrame:
    rows = sweep(spark, d).where("fusion = 'min_max' and k = 8")
    digit = F.conv(F.right(F.sha2(F.col("query_id").cast("string"), 256), F.lit(1)), 16, 10).cast("int")
    return M.tuned(rows, "weight", "reciprocal_rank", F.when(digit % 2 == 0, "tune").otherwise("heldout"), 0.5)


@query()
def agg21_heldout_test(spark: SparkSession, d: str) -> DataFrame:
    return _tuned(spark, d)


@query("""with g as (select distinct a.doc_id as query_id, b.doc_id as item_id from documents a join documents b on a.source = b.source and a.doc_type = b.doc_type and a.doc_id <> b.doc_id
  where a.doc_id % 100 = 0 and a.text is not null and b.text is not null),
n as (select item_id, count(*) as n from g group by 1),
s as (select q.query_id, n.item_id, n - (g.item_id is not null)::int as left from (select distinct query_id from g) q, n left join g on g.query_id = q.query_id and g.item_id = n.item_id)
select query_id, item_id, row_number() over (partition by query_id order by "left" desc, item_id) as rank from s where "left" > 0 qualify rank <= 24""".replace("as left from", 'as "left" from'))
def agg10_popularity(spark: SparkSession, d: str) -> DataFrame:
    return M.popularity(gold(spark, d), 24)


@query("""with g as (select distinct a.doc_id as query_id, b.doc_id as item_id from documents a join documents b on a.source = b.source and a.doc_type = b.doc_type and a.doc_id <> b.doc_id
  where a.doc_id % 100 = 0 and a.text is not null and b.text is not null),
n as (select item_id, count(*) as n, row_number() over (order by count(*) desc, item_id) as overall from g group by 1), s as (select query_id, count(*) as k from g group by 1)
select query_id, item_id, n, overall from s join n on overall <= k + 24""")
def win18_popularity_cut(spark: SparkSession, d: str) -> DataFrame:
    """Of each query the head of depth and gold size within which its own ranking must lie."""
    return M.popular_heads(gold(spark, d), 24)


_FOUR = f"""e2 as (select vec_id, list_slice(v, 1, 32) as v from e), cos2 as (select a.vec_id as query_id, b.vec_id as item_id,
    round(list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))), 6) as score from e2 a join e2 b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
den2 as (select *, row_number() over (partition by query_id order by score desc, item_id) as rank from cos2),
every as (select 'one' as arm, query_id, item_id, rank from lex where rank <= {DEPTH} union all select 'one', query_id, item_id, rank from den where rank <= {DEPTH}
 union all select 'two', query_id, item_id, rank from lex where rank <= {DEPTH} union all select 'two', query_id, item_id, rank from den2 where rank <= {DEPTH}
 union all select 'both', query_id, item_id, rank from lex where rank <= {DEPTH} union all select 'both', query_id, item_id, rank from den where rank <= {DEPTH} union all select 'both', query_id, item_id, rank from den2 where rank <= {DEPTH}
 union all select 'reference', query_id, item_id, rank from lex where rank <= 40 union all select 'reference', query_id, item_id, rank from den where rank <= 40),
fused as (select arm, query_id, item_id, round(sum(1 / (60.0 + rank)), 9) as score from every group by all),
armed as (select arm, query_id, item_id, row_number() over (partition by arm, query_id order by score desc, item_id) as rank from fused qualify rank <= 24)"""


@query(f"with {_BASE}, {_FOUR}, {_metrics_sql('armed', 'arm')} select arm, k, count(*) as n, (floor(sum(cast(round(recall * 1000000) as bigint))::double / count(recall) + 0.5) / 1000000) as recall, (floor(sum(cast(round(reciprocal_rank * 1000000) as bigint))::double / count(reciprocal_rank) + 0.5) / 1000000) as reciprocal_rank from measured group by all")
def abl5_encoder_arms(spark: SparkSession, d: str) -> DataFrame:
    """Three arms of encoders fused with the lexical channel, and the hybrid search as reference."""
    return M.summary(_encoder_arms(spark, d), ["arm", "k"], ["recall", "reciprocal_rank"])


def _encoder_arms(spark: SparkSession, d: str) -> DataFrame:
    """The vectors' first half stands for a second encoder."""
    words = cut(R.top(lexical(spark, d, DEPTH), DEPTH))
    held = vectors(spark, d).select("id", "vector")
    half = held.withColumn("vector", F.slice("vector", 1, 32))
    one, two = (cut(R.ranked(R.cosine(v.where("id % 100 = 0"), v, DEPTH))) for v in (held, half))
    fused = {"one": R.reciprocal([words, one]), "two": R.reciprocal([words, two]), "both": R.reciprocal([words, one, two]), "reference": R.reciprocal([words.where("rank <= 40"), one.where("rank <= 40")])}
    runs = None
    for arm, scores in fused.items():
        part = R.top(scores, R.FUSED).select(F.lit(arm).alias("arm"), "query_id", "item_id", "rank")
        runs = part if runs is None else runs.unionByName(part)
    return M.at_k(runs, gold(spark, d), KS, ["arm"])


@query(f"with {_BASE}, {_FOUR}, {_metrics_sql('armed', 'arm')} select arm, count(*) as n, (floor(sum(cast(round(recall * 1000000) as bigint))::double / count(recall) + 0.5) / 1000000) as recall, (floor(sum(cast(round(reciprocal_rank * 1000000) as bigint))::double / count(reciprocal_rank) + 0.5) / 1000000) as mrr from measured where k = 24 group by all")
def agg11_encoder_summary(spark: SparkSession, d: str) -> DataFrame:
    """Recall and mean reciprocal rank of each arm at 24; agg11_intervals adds the interval of the latter."""
    return M.arm_summary(_encoder_arms(spark, d).where("k = 24"), ["arm"]).select("arm", "n", "recall", "mrr")


@query()
def agg11_intervals(spark: SparkSession, d: str) -> DataFrame:
    return M.arm_summary(_encoder_arms(spark, d).where("k = 24"), ["arm"])


@query(f"""with {_BASE}, qq as (select doc_id as query_id, unnest(list_distinct({sql_tokens("substr(text, 1, 80)")})) as term from docs where doc_id % 100 = 0),
wt as (select q.query_id, q.term, case when qq.term is not null then 3.0 else 1.0 end as w from q left join qq using (query_id, term))
select query_id, doc_id as item_id, round(sum(w * ln((n - df + 0.5) / (df + 0.5) + 1) * tf), 6) as score from wt join freq using (term) join post using (term), size where query_id <> doc_id group by all""")
def rec11_emphasis(spark: SparkSession, d: str) -> DataFrame:
    """Terms of a query's first 80 characters weigh three times."""
    held = bags(spark, d)
    first = documents(spark, d).where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.explode(query_terms(F.substring("text", 1, 80))).alias("term"))
    return R.scored(R.emphasised(asking(held), first, 3.0), held, norm=False).where("query_id <> item_id")


@query("""with l as (select unnest(['plain', 'enriched', 'area_question']) as level1), b as (select unnest(['as_is', 'enriched']) as level2), c as (select unnest(['min_max', 'rrf']) as level3)
select level1, level2, level3 from l, b, c where not (level1 = 'area_question' and level2 = 'enriched')""")
def abl1_arms(spark: SparkSession, d: str) -> DataFrame:
    """Conditions of three levels without the pair that makes no sense."""
    one = spark.range(1)
    levels = {"level1": ["plain", "enriched", "area_question"], "level2": ["as_is", "enriched"], "level3": ["min_max", "rrf"]}
    for name, values in levels.items():
        one = one.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return one.where("not (level1 = 'area_question' and level2 = 'enriched')").drop("id")


@query("""with q as (select distinct question_id, text, area from eval_question where text is not null)
select question_id, 'plain' as arm, len(text) as n from q union all select question_id, 'area', len(text) + 1 + len(area) from q where area is not null
union all select question_id, 'area_twice', len(text) + 2 * (1 + len(area)) from q where area is not null""")
def abl2_query_texts(spark: SparkSession, d: str) -> DataFrame:
    """The texts that a question asks with, one row each."""
    q = table(spark, d, "eval_question").where("text is not null").select("question_id", "text", "area").distinct()
    arms = F.array(
        F.struct(F.lit("plain").alias("arm"), F.col("text").alias("asks")),
        F.struct(F.lit("area").alias("arm"), F.concat_ws(" ", "text", "area").alias("asks")),
        F.struct(F.lit("area_twice").alias("arm"), F.concat_ws(" ", "text", "area", "area").alias("asks")),
    )
    rows = q.select("question_id", "area", F.inline(arms)).where("arm = 'plain' or area is not null")
    return rows.select("question_id", "arm", F.length("asks").cast("bigint").alias("n"))
