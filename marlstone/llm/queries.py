"""Queries of the training-data operators over the tables of a directory, and the SQL that some of them can be held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import consensus, language, mixing, near_duplicates, packing, repeated_lines, scanned, splitting, tokens
from marlstone.operators.joins import salted
from marlstone.session import cut
from marlstone.tables import table


def _scan(spark: SparkSession, d: str) -> scanned.Scan:
    return scanned.Scan(table(spark, d, "text_line"), table(spark, d, "document_version"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _scan(spark, d).found().select("line_id", "kind")


def p1_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return _scan(spark, d).paragraphs()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized(table(spark, d, "chunk"), table(spark, d, "chunk_limit"))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.pieces(table(spark, d, "chunk"), table(spark, d, "chunk_limit"))


def _question_sets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return near_duplicates.token_sets(table(spark, d, "eval_question"), "question_id", near_duplicates.word_set(F.col("text")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    members, sets = _question_sets(spark, d)
    pairs = near_duplicates.record_pairs(members, near_duplicates.similar_sets(sets))
    return pairs.select(F.col("id_a").alias("question_id_a"), F.col("id_b").alias("question_id_b"))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    members, sets = _question_sets(spark, d)
    records = table(spark, d, "eval_question").select(F.col("question_id").alias("id"))
    found = near_duplicates.groups(members, near_duplicates.similar_sets(sets), records)
    return found.withColumnRenamed("id", "question_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return consensus.found(table(spark, d, "rubric_rating"), table(spark, d, "result_rating_summary"))


def p4_consensus(spark: SparkSession, d: str) -> DataFrame:
    return consensus.consensus(table(spark, d, "rubric_rating"))[0]


def p4_raters(spark: SparkSession, d: str) -> DataFrame:
    items, raters, live = consensus.consensus(table(spark, d, "rubric_rating"))
    return raters.join(consensus.reliability(items, live), "rater_id", "left")


def p4_agreement(spark: SparkSession, d: str) -> DataFrame:
    live = cut(consensus.live_scores(table(spark, d, "rubric_rating")))
    out = consensus.slice_agreement(live, table(spark, d, "irr_domain_score"))
    return out.withColumn("alpha", F.round("alpha", 6))


def p4_rater_counts(spark: SparkSession, d: str) -> DataFrame:
    live = consensus.live_scores(table(spark, d, "rubric_rating"))
    return consensus.rater_counts(live, table(spark, d, "result_rating_summary"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    keyed = repeated_lines.prepared(table(spark, d, "documents"))
    flagged = cut(repeated_lines.repeated_in_documents(keyed).select("source", "key"))
    in_documents = repeated_lines.positions(keyed, flagged).select(
        F.lit("documents").alias("place"), F.col("doc_id").alias("record_id"), "line_no"
    )
    pages = cut(scanned.page_lines(table(spark, d, "text_line"), table(spark, d, "document_version")))
    site = scanned.site_lines(pages).select("source", F.col("key").alias("norm_key"))
    in_pages = (
        salted(pages.where("kind is null and counts and line_id is not null"), site, ["source", "norm_key"], ["line_id"])
        .select(F.lit("text_line").alias("place"), F.col("line_id").alias("record_id"), F.lit(0).alias("line_no"))
    )
    return in_documents.unionByName(in_pages)


def p5_lines(spark: SparkSession, d: str) -> DataFrame:
    found = repeated_lines.repeated_in_documents(repeated_lines.prepared(table(spark, d, "documents")))
    return found.groupBy("source").agg(
        F.count("*").alias("n_lines"), F.sum("n_documents").alias("n_documents"), F.sum("n_days").alias("n_days"),
        F.round(F.min("share"), 6).alias("least_share"),
    )


def _clean_documents(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    keyed = repeated_lines.prepared(documents)
    flagged = cut(repeated_lines.repeated_in_documents(keyed).select("source", "key"))
    return repeated_lines.without_repeated(documents, flagged)


def _known_lines(spark: SparkSession, d: str) -> tuple[DataFrame, dict[str, list[str]]]:
    report = repeated_lines.reported(table(spark, d, "boilerplate_report"), table(spark, d, "document_version"))
    return cut(report), repeated_lines.patterns_of(table(spark, d, "assembly_options"))


def p5_decided(spark: SparkSession, d: str) -> DataFrame:
    known, patterns = _known_lines(spark, d)
    versions = table(spark, d, "document_version")
    pages = cut(scanned.page_lines(table(spark, d, "text_line"), versions))
    in_documents = repeated_lines.decided_in_documents(table(spark, d, "documents"), known, patterns)
    in_pages = repeated_lines.decided_in_pages(pages, versions, known, patterns)
    both = in_documents.withColumn("place", F.lit("documents")).unionByName(in_pages.withColumn("place", F.lit("text_line")))
    return both.select("place", "source", "line", "n_documents", "n_clusters", "n_days", F.round("share", 6).alias("share"), "known", "boilerplate")


def p5_documents(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    found = repeated_lines.decided_in_documents(documents, *_known_lines(spark, d))
    flagged = cut(found.where("boilerplate").select("source", "key"))
    return repeated_lines.without_repeated(documents, flagged).select("doc_id", "source", "text", "n_removed")


def _sized(spark: SparkSession, d: str) -> DataFrame:
    return cut(tokens.sized(table(spark, d, "documents"), F.col("text")))


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(_sized(spark, d), table(spark, d, "container_spec"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p7_packed(spark, d))


def p7_texts(spark: SparkSession, d: str) -> DataFrame:
    return packing.with_text(p7_packed(spark, d), table(spark, d, "documents"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed(_sized(spark, d), table(spark, d, "mix_target"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_target")
    return mixing.shares(mixing.mixed(_sized(spark, d), targets), targets)


def _segments(spark: SparkSession, d: str) -> DataFrame:
    clean = cut(_clean_documents(spark, d).select("doc_id", "lang", "text"))
    ranks = language.train(language.labelled_sample(clean))
    return language.segments(clean.select("doc_id", "text"), ranks)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return language.found(table(spark, d, "documents"), language.languages(_segments(spark, d))).select("doc_id", "kind", "lang")


def p9_documents(spark: SparkSession, d: str) -> DataFrame:
    return language.languages(_segments(spark, d), table(spark, d, "documents"))


def p9_segments(spark: SparkSession, d: str) -> DataFrame:
    return language.chosen(_segments(spark, d))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_paragraphs, p2_found, p2_pieces, p3_found, p3_groups, p4_found, p4_consensus, p4_raters, p4_agreement,
        p4_rater_counts, p5_found, p5_lines, p5_decided, p5_documents, p7_packed, p7_fill, p7_texts, p8_mix, p8_shares, p9_found, p9_documents,
        p9_segments,
    )
}

_BLANK = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"

# The key of a line (@) and whether it counts, in SQL.
_KEY = f"regexp_replace(trim(regexp_replace(lower(@), '{_BLANK}', ' ', 'g')), '[0-9]+', '0', 'g')"
_COUNTS = "len(string_split(k, ' ')) >= 4 and regexp_matches(k, '\\pL')"

_LIVE = """
live as (
  select result_id, domain_code, rater_id, score from (
    select result_id, replace(trim(lower(domain_code)), '-', '_') as domain_code, rater_id, score,
      row_number() over (partition by result_id, replace(trim(lower(domain_code)), '-', '_'), rater_id
                         order by rated_at desc nulls last, rating_id desc, score desc) as rn
    from rubric_rating where result_id is not null and rater_id is not null and domain_code is not null)
  where rn = 1 and score between 1 and 5)
"""

SQL = {
    "p2_found": f"""
select distinct chunk_id from chunk
join (select chunk_type, min(max_tokens) as most from chunk_limit group by 1) using (chunk_type)
where most >= 1 and chunk_id is not null
  and len(list_filter(regexp_split_to_array(text, '{_BLANK}'), lambda w: w <> '')) > most
""",
    "p3_found": """
with q as (
  select distinct question_id as id, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) as w
  from eval_question where question_id is not null and text is not null)
select distinct a.id as question_id_a, b.id as question_id_b from q a join q b on a.id < b.id
where len(a.w) > 0 and len(b.w) > 0
  and len(list_intersect(a.w, b.w)) >= 0.75 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))
""",
    "p3_groups": """
with recursive q as (
  select distinct question_id as id, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) as w
  from eval_question where question_id is not null and text is not null),
m as (select distinct id, md5(array_to_string(w, ' ')) as s, w from q where len(w) > 0), sets as (select distinct s, w from m),
l as (select a.s as a, b.s as b from sets a join sets b on a.s <> b.s
  where len(list_intersect(a.w, b.w)) >= 0.75 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))),
reach as (select s, s as t from sets union select reach.s, l.b from reach join l on l.a = reach.t),
g as (select s, min(t) as group_id from reach group by 1), k as (select a as s, count(*) as n_links from l group by 1), c as (select s, count(*) as n_copies from m group by 1)
select m.id as question_id, group_id, coalesce(n_links, 0) as n_links, n_copies from m join g using (s) join c using (s) left join k using (s)
union all select id, null, 0, 1 from (select distinct question_id as id from eval_question where question_id is not null) x where id not in (select id from m)
""",
    "p4_agreement": f"""
with {_LIVE},
wanted as (select distinct slice_id, replace(trim(lower(domain_code)), '-', '_') as domain_code, unnest(result_ids) as result_id from irr_domain_score),
s as (select slice_id, domain_code, result_id, rater_id, score from wanted join live using (result_id, domain_code)),
m as (select slice_id, domain_code, result_id, count(*) as m from s group by all),
o as (select a.slice_id, a.domain_code, a.score as c, b.score as k, sum(1.0 / (m.m - 1)) as o
      from s a join s b on a.slice_id = b.slice_id and a.domain_code = b.domain_code and a.result_id = b.result_id and a.rater_id <> b.rater_id
      join m on m.slice_id = a.slice_id and m.domain_code = a.domain_code and m.result_id = a.result_id group by all),
grid as (select slice_id, domain_code, c.c as c, c2.c as k
         from (select distinct slice_id, domain_code from s), (select unnest([1,2,3,4,5]) as c) c, (select unnest([1,2,3,4,5]) as c) c2),
g as (select grid.*, coalesce(o.o, 0) as o from grid left join o using (slice_id, domain_code, c, k)),
n as (select slice_id, domain_code, c, sum(o) as n from g group by all),
dd as (select g.slice_id, g.domain_code, g.o, nc.n as nc, nk.n as nk,
         power((select sum(x.n) from n x where x.slice_id = g.slice_id and x.domain_code = g.domain_code and x.c between g.c and g.k) - (nc.n + nk.n) / 2, 2) as d
       from g join n nc on nc.slice_id = g.slice_id and nc.domain_code = g.domain_code and nc.c = g.c
              join n nk on nk.slice_id = g.slice_id and nk.domain_code = g.domain_code and nk.c = g.k where g.c < g.k),
al as (select slice_id, domain_code, sum(o * d) as seen, sum(nc * nk * d) as expected from dd group by all),
tot as (select slice_id, domain_code, sum(n) as total from n group by all),
base as (select slice_id, domain_code, count(*) filter (where m > 1) as n_items from m group by all),
r as (select slice_id, domain_code, count(distinct rater_id) as n_raters from s group by all),
v as (select slice_id, replace(trim(lower(domain_code)), '-', '_') as domain_code, arg_max(value, computed_at) as value from irr_domain_score group by all),
f as (select slice_id, domain_code, case when n_items = 0 then 0.0 when expected = 0 then 1.0 else 1 - (total - 1) * seen / expected end as alpha, n_items, n_raters
      from al join tot using (slice_id, domain_code) join base using (slice_id, domain_code) join r using (slice_id, domain_code))
select slice_id, domain_code, value, round(alpha, 6) as alpha, n_items, n_raters, coalesce(abs(value - alpha) < 0.001, false) as matches
from v left join f using (slice_id, domain_code)
""",
    "p4_rater_counts": f"""
with {_LIVE}
select given.result_id, given, coalesce(counted, 0) as counted, coalesce(given = coalesce(counted, 0), false) as correct
from (select distinct result_id, distinct_rater_count as given from result_rating_summary where result_id is not null) given
left join (select result_id, count(distinct rater_id) as counted from live group by 1) using (result_id)
""",
    "p5_lines": f"""
with docs as (
  select doc_id, source, ingested_at, text,
    list_transform(string_split(text, chr(10)), lambda l: regexp_replace(trim(regexp_replace(lower(l), '{_BLANK}', ' ', 'g')), '[0-9]+', '0', 'g')) as keys
  from documents where source is not null and text is not null and trim(regexp_replace(text, '{_BLANK}', ' ', 'g')) <> ''),
clusters as (select source, keys, count(*) as n_docs, min(cast(ingested_at as date)) as day from docs group by all),
totals as (select source, count(*) as total from docs group by 1),
lines as (select source, n_docs, day, unnest(list_distinct(list_filter(keys, lambda k: len(string_split(k, ' ')) >= 4 and regexp_matches(k, '\\pL')))) as key from clusters),
counted as (select source, key, sum(n_docs)::bigint as n_documents, count(distinct coalesce(day, date '0001-01-01')) as n_days from lines group by all)
select source, count(*) as n_lines, sum(n_documents)::bigint as n_documents, sum(n_days)::bigint as n_days, round(min(n_documents / total), 6) as least_share
from counted join totals using (source) where n_documents >= 3 and n_documents / total >= 0.25 group by source
""",
    "p5_found": f"""
with docs as (select doc_id, source, string_split(text, chr(10)) as ls from documents where source is not null and text is not null and trim(regexp_replace(text, '{_BLANK}', ' ', 'g')) <> ''),
dl as (select doc_id, source, unnest(ls) as line, unnest(range(len(ls))) as line_no from docs),
dk as (select *, {_KEY.replace('@', 'line')} as k from dl), dn as (select source, count(distinct doc_id) as total from docs group by 1),
dh as (select source, k from dk join dn using (source) where {_COUNTS} group by source, k, total having count(distinct doc_id) >= 3 and count(distinct doc_id) >= 0.25 * total),
tk as (select line_id, source, document_version_id as v, text, {_KEY.replace('@', 'text')} as k, bbox_bottom - bbox_top > 8.5 as body from (select distinct * from text_line) where source is not null),
tn as (select source, count(distinct v) as total from tk group by 1),
th as (select source, k from tk join tn using (source) where {_COUNTS} and body group by source, k, total having count(distinct v) >= 3 and count(distinct v) >= 0.25 * total)
select distinct 'documents' as place, doc_id as record_id, line_no::int as line_no from dk join dh using (source, k)
union all select distinct 'text_line', line_id, 0 from tk join th using (source, k) where body
""",
    "p4_found": f"""
with {_LIVE},
n as (select result_id, domain_code, score, count(*) as n from live group by all), i as (select result_id, domain_code, sum(n) as m, sum(n * score) / sum(n) as mean from n group by all),
best as (select result_id, domain_code, score from n join i using (result_id, domain_code) where m >= 3 qualify row_number() over (partition by result_id, domain_code order by n desc, round(abs(score - mean), 6), score) = 1),
r as (select rater_id, count(*) filter (where live.score = best.score) / count(*) as share from live join best using (result_id, domain_code) group by 1),
c as (select result_id, count(distinct rater_id) as k from live group by 1)
select 'rater' as kind, rater_id as case_id from r where share < 0.6
union select 'summary', s.result_id from result_rating_summary s left join c using (result_id) where s.result_id is not null and (distinct_rater_count is null or distinct_rater_count <> coalesce(k, 0))
""",
}
