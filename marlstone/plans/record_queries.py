"""Queries of sources, filters, joins, records and sets."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import text as X
from marlstone.functions.text import words_of
from marlstone.operators import eav
from marlstone.operators import filters as P
from marlstone.operators import records as N
from marlstone.operators import selection as Z
from marlstone.operators import workflow as W
from marlstone.plans.eav_queries import _CELLS
from marlstone.session import cut, shared_folder, small_rows
from marlstone.sources import readers
from marlstone.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def register(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _scratch(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/scratch-{os.urandom(8).hex()}"


@query("select key, field_name, arg_max(field_value, row_id) as field_value from (select distinct row_id, key, field_name, field_value from newborn_nbu_2021) group by all")
def src1_eav_csv(spark: SparkSession, d: str) -> DataFrame:
    """The attribute rows written as CSV, read back and taken to one value per key and field (the last row's)."""
    path = _scratch(spark)
    table(spark, d, "newborn_nbu_2021").select("row_id", "key", "field_name", "field_value").write.option("header", True).option("emptyValue", "\x02").option("nullValue", "\x01").option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    rows = readers.eav_csv(spark, path, extra="row_id bigint")
    return N.latest_per_key(rows.select("key", "field_name", "row_id", "field_value"), ["key", "field_name"], [F.col("row_id")]).select("key", "field_name", "field_value")


@query("select record_id, max(mrn) as mrn, max(schema_version) as schema_version, max(dataset_id) as dataset_id from patient_record group by 1")
def src2_wide_upload(spark: SparkSession, d: str) -> DataFrame:
    """Records written as a CSV with dotted headers, read back as structs."""
    path = _scratch(spark)
    rows = table(spark, d, "patient_record").groupBy("record_id").agg(F.max("mrn").alias("mrn"), F.max("schema_version").alias("v"), F.max("dataset_id").alias("s"))
    rows.select("record_id", "mrn", F.col("v").alias("meta.schema_version"), F.col("s").alias("meta.dataset_id")).write.option("header", True).csv(path)
    wide = readers.wide_csv(spark, path)
    return wide.select("record_id", "mrn", "meta.schema_version", "meta.dataset_id")


@query("select record_key, count(*) as n from patient_record group by 1")
def src3_patient_source(spark: SparkSession, d: str) -> DataFrame:
    """Records through the connector's interface."""
    source = readers.TableSource(table(spark, d, "patient_record"))
    return source.records().groupBy("record_key").agg(F.count("*").alias("n"))


@query("""with p as (select doc_id, text, unnest(range(0, ceil(len(text) / 3000)::bigint)) as i from documents where text <> '')
select doc_id, (i + 1)::int as page_no, sha256(substr(text, i * 3000 + 1, 3000)) as digest from p""")
def src4_text_pages(spark: SparkSession, d: str) -> DataFrame:
    """Every page of every text."""
    from marlstone.operators.chunking import synthetic_pages

    docs = table(spark, d, "documents").where("text <> ''").select("doc_id", F.posexplode(synthetic_pages(F.col("text"))).alias("i", "page"))
    return docs.select("doc_id", (F.col("i") + 1).alias("page_no"), F.sha2("page", 256).alias("digest"))


@query("select title, min(priority) as priority from (select title, 1 + (len(title) % 3) as priority from document_version where title is not null) group by 1 order by 2, 1")
def src7_priorities(spark: SparkSession, d: str) -> DataFrame:
    entries = table(spark, d, "document_version").select("title", (1 + F.length("title") % 3).cast("bigint").alias("priority"))
    return readers.priorities(entries)


@query("select document_version_id, count(*) as n_lines, count(distinct page_no) as n_pages from text_line group by 1")
def src8_corpus_scan(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "text_line").select("document_version_id", "page_no")
    return lines.groupBy("document_version_id").agg(F.count("*").alias("n_lines"), F.count_distinct("page_no").alias("n_pages"))


@query("select distinct chunk_id, ordinal from chunk where chunk_id in (select parent_chunk_id from chunk where parent_chunk_id is not null)")
def src9_by_id(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunk")
    wanted = chunks.where("parent_chunk_id is not null").select(F.col("parent_chunk_id").alias("chunk_id")).distinct()
    return chunks.join(wanted, "chunk_id", "left_semi").select("chunk_id", "ordinal").distinct()


@query("select event_id, ts, user_id, event_type from events where event_type = 'error' order by ts desc, event_id desc limit 200")
def src10_newest_events(spark: SparkSession, d: str) -> DataFrame:
    return readers.newest(table(spark, d, "events"), {"event_type": "error"}, ["ts", "event_id"], 500).select("event_id", "ts", "user_id", "event_type")


@query("""select document_id, document_version_id, row_number() over (partition by document_id order by ingested_at desc nulls last, document_version_id) as nth
from (select distinct document_id, document_version_id, ingested_at from document_version)""")
def src11_versions(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "document_version").select("document_id", "document_version_id", "ingested_at").distinct()
    order = Window.partitionBy("document_id").orderBy(F.col("ingested_at").desc_nulls_last(), "document_version_id")
    return v.select("document_id", "document_version_id", F.row_number().over(order).alias("nth"))


@query("select event_id, user_id, value from events")
def src12_jsonl(spark: SparkSession, d: str) -> DataFrame:
    path = _scratch(spark)
    rows = table(spark, d, "events").select("event_id", "user_id", "value")
    readers.write_jsonl(rows, path)
    return readers.read_jsonl(spark, path, rows.schema)


@query("""with c as (select * from chunk qualify row_number() over (partition by chunk_id) = 1)
select a.chunk_id, b.ordinal as parent_ordinal, a.ordinal from c a left join c b on a.parent_chunk_id = b.chunk_id""")
def snk1_chunk_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Chunks written and overwritten by key, parents resolved by ordinal; also joi16."""
    path = _scratch(spark)
    chunks = table(spark, d, "chunk").dropDuplicates(["chunk_id"])
    parent = chunks.select(F.col("chunk_id").alias("parent_chunk_id"), F.col("ordinal").alias("parent_ordinal"))
    readers.upsert(spark, path, chunks.where("ordinal < 3").select("chunk_id", "parent_chunk_id", "ordinal"), ["chunk_id"])
    readers.upsert(spark, path, chunks.select("chunk_id", "parent_chunk_id", "ordinal"), ["chunk_id"])
    return spark.read.parquet(readers.current(path)).join(parent, "parent_chunk_id", "left").select("chunk_id", "parent_ordinal", "ordinal")


@query("""with c as (select chunk_id, max(document_version_id) as v, max(ordinal) as ordinal from chunk group by 1)
select chunk_id, case when ordinal % 5 = 0 then 'pending' when ordinal % 2 = 0 then 'confirmed' end as review_status from c""")
def snk2_payload_patch(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "chunk").groupBy("chunk_id").agg(F.max("ordinal").alias("ordinal"))
    base = base.withColumn("review_status", F.when(F.col("ordinal") % 2 == 0, "confirmed"))
    patch = base.where("ordinal % 5 = 0").select("chunk_id", F.lit("pending").alias("review_status"))
    return readers.patched(base, patch, ["chunk_id"]).select("chunk_id", "review_status")


@query("select source, count(*) as n, count(distinct doc_type) as n_types from documents where source is not null group by 1")
def snk3_csv_report(spark: SparkSession, d: str) -> DataFrame:
    path = _scratch(spark)
    report = table(spark, d, "documents").where("source is not null").groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("doc_type").alias("n_types"))
    report.repartition(1).write.option("header", True).csv(path)
    return spark.read.schema("source string, n bigint, n_types bigint").option("header", True).csv(path)


_ITEMS = """items as (select c.chunk_id, v.status, v.title as document_title, v.document_id, case when c.ordinal % 7 = 0 then 'pending' when c.ordinal % 5 = 0 then 'rejected' when c.ordinal % 3 = 0 then 'confirmed' end as review_status,
  [c.chunk_type] as topic_tags from (select chunk_id, max(document_version_id) as document_version_id, max(ordinal) as ordinal, max(chunk_type) as chunk_type from chunk group by 1) c
  join (select document_version_id, max(status) as status, max(title) as title, max(document_id) as document_id from document_version group by 1) v using (document_version_id))"""


def _items(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunk").groupBy("chunk_id").agg(F.max("document_version_id").alias("document_version_id"), F.max("ordinal").alias("ordinal"), F.max("chunk_type").alias("chunk_type"))
    v = table(spark, d, "document_version").groupBy("document_version_id").agg(F.max("status").alias("status"), F.max("title").alias("document_title"), F.max("document_id").alias("document_id"))
    o = F.col("ordinal")
    review = F.when(o % 7 == 0, "pending").when(o % 5 == 0, "rejected").when(o % 3 == 0, "confirmed")
    return c.join(v, "document_version_id").select("chunk_id", "status", "document_title", "document_id", review.alias("review_status"), F.array("chunk_type").alias("topic_tags"), "ordinal")


@query(f"with {_ITEMS} select chunk_id from items where status in ('active', 'superseded') and list_has_any(topic_tags, ['prose', 'list']) and (document_title is null or document_title not in ('x')) and (review_status is null or review_status not in ('rejected'))")
def flt1_payload_filter(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d).where(P.payload(statuses=["active", "superseded"], any_tags=["prose", "list"], not_titles=["x"], not_review=["rejected"])).select("chunk_id")


@query(f"with {_ITEMS} select chunk_id, review_status from items where status = 'active' and (review_status is null or review_status not in ('pending', 'rejected', 'excluded'))")
def flt2_retrievable(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d).where(P.retrievable()).select("chunk_id", "review_status")


@query("select distinct question_id from eval_question where expected_outcome = 'well_supported' and provenance = 'auto_generated' and source_record_id is not null")
def flt3_calibration_pool(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_question").where("expected_outcome = 'well_supported' and provenance = 'auto_generated' and source_record_id is not null").select("question_id").distinct()


@query("""select event_id, ('0' || regexp_extract(props, '"k": ([0-9]+)', 1))::bigint as k from events where ('0' || regexp_extract(props, '"k": ([0-9]+)', 1))::bigint > 50""")
def flt4_json_filter(spark: SparkSession, d: str) -> DataFrame:
    k = F.coalesce(F.get_json_object("props", "$.k").cast("bigint"), F.lit(0))
    return table(spark, d, "events").select("event_id", k.alias("k")).where("k > 50")


POLICY = [("nurse", "care", "name", "allow"), ("nurse", "care", "*", "mask"), ("clerk", "billing", "balance", "allow"), ("nurse", "audit", "name", "deny")]
_POLICY = ", ".join(str(p) for p in POLICY)


@query(f"""with policy(role, purpose, field_path, effect) as (values {_POLICY}), r as (select role, purpose, f as field_path from (values ('nurse'), ('clerk')) a(role), (values ('care'), ('billing'), ('audit')) b(purpose), (values ('name'), ('balance'), ('segment')) c(f))
select role, purpose, r.field_path, coalesce(x.effect, w.effect, 'deny') as effect from r left join policy x using (role, purpose, field_path) left join (select role, purpose, effect from policy where field_path = '*') w using (role, purpose)""")
def flt5_field_policy(spark: SparkSession, d: str) -> DataFrame:
    policy = spark.createDataFrame(POLICY, "role string, purpose string, field_path string, effect string")
    asks = spark.createDataFrame([(r, p, f) for r in ("nurse", "clerk") for p in ("care", "billing", "audit") for f in ("name", "balance", "segment")], "role string, purpose string, field_path string")
    return P.effects(asks, policy)


@query("select c_custkey, case when c_name is not null then '***' end as c_name, c_acctbal from customer")
def flt5_masked_projection(spark: SparkSession, d: str) -> DataFrame:
    return P.masked(table(spark, d, "customer"), {"c_custkey": "allow", "c_acctbal": "allow", "c_name": "mask"}, never=["c_mktsegment"])


@query("select o_orderkey, o_orderstatus from orders where o_custkey = 7")
def flt6_row_scope(spark: SparkSession, d: str) -> DataFrame:
    return readers.scoped(table(spark, d, "orders"), "o_custkey", 7).select("o_orderkey", "o_orderstatus")


_STATED = {0: "known", 1: "known", 2: "TODO_CONFIRM", 3: " "}


@query("""with r as (select distinct record_id, record_key, ascii(right(record_key, 1)) % 7 as b, dataset_provenance from patient_record), x as (select record_id, 'batch-' || b as dataset_id, case when b = 5 then 'synthetic' when b = 6 and record_id < '8' then null else dataset_provenance end as p, b from r),
g as (select dataset_id, count(*) as n_records, bool_and(coalesce(p = 'synthetic', false)) as s, bool_and(coalesce(p = 'deidentified-anonymised', false)) as d, min(b) as b from x group by 1)
select dataset_id, n_records, s or (d and b in (0, 1)) as accepted, case when s then 'synthetic' when d and b in (0, 1) then 'attested' when d then 'attestation_missing' else 'provenance_unknown' end as reason from g""")
def flt7_batch_guard(spark: SparkSession, d: str) -> DataFrame:
    """Seven batches of the records: two attested, two with a gap, one without an attestation, one synthetic, one of unknown origin."""
    b = F.ascii(F.right("record_key", F.lit(1))) % 7
    r = table(spark, d, "patient_record").select("record_id", "record_key", "dataset_provenance").distinct()
    p = F.when(b == 5, "synthetic").when((b == 6) & (F.col("record_id") < "8"), F.lit(None)).otherwise(F.col("dataset_provenance"))
    records = r.select("record_id", F.concat(F.lit("batch-"), b).alias("dataset_id"), p.alias("dataset_provenance"))
    told = spark.createDataFrame([(f"batch-{k}", *["known"] * (len(P.ATTESTED) - 1), v) for k, v in _STATED.items()], ", ".join(f"{c} string" for c in ("dataset_id", *P.ATTESTED)))
    return P.guarded(records, told, "synthetic", "deidentified-anonymised")[1]


@query("""with c as (select distinct on (chunk_id) * from chunk where text is not null order by chunk_id), v as (select document_version_id, max(document_id) as document_id, max(title) as document_title, max(version_label) as version_label, max(effective_date) as effective_date, max(status) as status from document_version group by 1)
select chunk_id, 0.5::double as score, section_path, section_number, page_start, page_end, char_start, char_end, document_id, document_title, c.document_version_id, version_label, effective_date, coalesce(status, 'active') as version_status,
 coalesce(chunk_type, 'prose') as chunk_type, text, null::varchar as heading, 'kept|' || coalesce(case when ordinal % 3 = 0 then 'confirmed' end, 'none') as meta from c join v using (document_version_id)""")
def flt8_item_projection(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunk").where("text is not null").dropDuplicates(["chunk_id"])
    v = table(spark, d, "document_version").groupBy("document_version_id").agg(*[F.max(a).alias(b) for a, b in (("document_id", "document_id"), ("title", "document_title"), ("version_label", "version_label"), ("effective_date", "effective_date"), ("status", "status"))])
    meta = F.create_map(F.lit("note"), F.lit("kept"), F.lit("review_status"), F.lit("stale"))
    found = c.join(v, "document_version_id").withColumns({"score": F.lit(0.5), "heading": F.lit(None).cast("string"), "meta": meta, "review_status": F.when(F.col("ordinal") % 3 == 0, "confirmed")})
    item = P.retrieval_item(found)
    return item.withColumn("meta", F.concat_ws("|", F.col("meta")["note"], F.coalesce(F.col("meta")["review_status"], F.lit("none"))))


@query("select field_name, target from eav_field_spec where target in ('sex') or starts_with(target, 'encounter.') or starts_with(target, 'vitals.')")
def flt9_scoped_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    spec = table(spark, d, "eav_field_spec").withColumn("field", F.col("target"))
    return P.in_scope_fields(spec, ["sex", "encounter.", "vitals."]).select("field_name", "target")


@query("select distinct record_id from patient_record p where not exists (select 1 from eval_question q where q.source_record_id = p.record_id)")
def flt10_unused_records(spark: SparkSession, d: str) -> DataFrame:
    used = table(spark, d, "eval_question").select(F.col("source_record_id").alias("record_id")).distinct()
    return table(spark, d, "patient_record").select("record_id").distinct().join(used, "record_id", "left_anti")


@query("""with r as (select distinct result_id, rater_id from rubric_rating where result_id is not null and rater_id is not null), n as (select result_id, count(*) as n from r group by 1),
s as (select distinct result_id from result_rating_summary where result_id is not null), me as (select min(rater_id) as rater_id from r)
select s.result_id, coalesce(n, 0) as n_raters from s left join n using (result_id) where not exists (select 1 from r join me using (rater_id) where r.result_id = s.result_id)""")
def joi4_queue_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Results that the first rater by id hasn't rated, with their number of raters."""
    r = table(spark, d, "rubric_rating").where("result_id is not null and rater_id is not null").select("result_id", "rater_id").distinct()
    me = r.agg(F.min("rater_id").alias("rater_id"))
    counts = r.groupBy("result_id").agg(F.count("*").alias("n_raters"))
    s = table(spark, d, "result_rating_summary").where("result_id is not null").select("result_id").distinct()
    return s.join(counts, "result_id", "left").fillna(0, ["n_raters"]).join(r.join(me, "rater_id"), "result_id", "left_anti")


@query("select area, count(distinct s.result_id) as n from eval_question q join result_rating_summary s using (question_id) group by 1")
def joi5_questions_with_results(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_question").select("question_id", "area").join(table(spark, d, "result_rating_summary"), "question_id").groupBy("area").agg(F.count_distinct("result_id").alias("n"))


@query("""with a as (select record_id, max(patient_id) as patient_id from patient_record where patient_id is not null group by 1), b as (select record_id, max(mrn) as mrn from patient_record group by 1)
select distinct question_id, coalesce(a.patient_id, b.mrn) as resolved from eval_question q left join a on a.record_id = q.source_record_id left join b on b.record_id = q.source_record_id where a.record_id is not null or b.record_id is not null""")
def joi6_resolve_source(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "patient_record")
    a = records.where("patient_id is not null").groupBy("record_id").agg(F.max("patient_id").alias("a"))
    b = records.groupBy("record_id").agg(F.max("mrn").alias("b"))
    q = table(spark, d, "eval_question").select("question_id", F.col("source_record_id").alias("record_id"))
    # b holds every record, so a question with neither has no row in b.
    return q.join(b, "record_id").join(a, "record_id", "left").select("question_id", F.coalesce("a", "b").alias("resolved")).distinct()


@query("""with v as (select distinct document_version_id, document_id from document_version), c as (select distinct chunk_id, document_version_id, ordinal from chunk)
select a.chunk_id as chunk_a, b.chunk_id as chunk_b from c a join v va on va.document_version_id = a.document_version_id join c b on a.ordinal = b.ordinal join v vb on vb.document_version_id = b.document_version_id and va.document_id = vb.document_id where a.document_version_id < b.document_version_id""")
def joi7_version_pairs(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "document_version").select("document_version_id", "document_id").distinct()
    at = table(spark, d, "chunk").select("chunk_id", "document_version_id", "ordinal").distinct().join(v, "document_version_id")
    other = at.select("document_id", "ordinal", F.col("chunk_id").alias("chunk_b"), F.col("document_version_id").alias("v_b"))
    return at.join(other, ["document_id", "ordinal"]).where("document_version_id < v_b").select(F.col("chunk_id").alias("chunk_a"), "chunk_b")


TOLERANCES = {"heart_rate": 15.0, "temparature": 0.5}


def _wide(spark: SparkSession, d: str) -> DataFrame:
    listed = eav.fields(table(spark, d, "eav_field_spec"))
    rows = table(spark, d, "newborn_nbu_2021")
    return cut(eav.wide(rows, eav.compacted_cells(rows, listed), table(spark, d, "patient_record"), listed))


_FINDINGS = ["apnoea", "bulging_fontanelle", "central_cyanosis", "convulsions", "crackles", "difficulty_breathing", "difficulty_feeding", "floppy", "grunting", "indrawing", "irritable"]
_FLAGS = _CELLS + """,
f as (select record_key as id, list_sort(list(field_name) filter (where field_name in ({})  and reading = 'true')) as findings,
  max(case when field_name = 'heart_rate' and reading <> chr(0) then reading end)::double as heart_rate, max(case when field_name = 'temparature' and reading <> chr(0) then reading end)::double as temparature
  from cell group by 1)""".format(", ".join(f"'{x}'" for x in _FINDINGS))


def _findings(spark: SparkSession, d: str) -> DataFrame:
    present = F.array_compact(F.array(*[F.when(F.col(x), F.lit(x)) for x in _FINDINGS]))
    return _wide(spark, d).select(F.col("record_key").alias("id"), present.alias("findings"), "heart_rate", "temparature")


@query(_FLAGS + """, pairs as (select a.id as id_a, b.id as id_b, round(len(list_intersect(a.findings, b.findings)) / (len(a.findings) + len(b.findings) - len(list_intersect(a.findings, b.findings))), 6) as similarity
from f a join f b on a.id < b.id where len(a.findings) > 0 and len(b.findings) > 0
 and len(list_intersect(a.findings, b.findings)) >= 0.8 * (len(a.findings) + len(b.findings) - len(list_intersect(a.findings, b.findings)))
 and coalesce(abs(a.heart_rate - b.heart_rate) <= 15, true) and coalesce(abs(a.temparature - b.temparature) <= 0.5, true))
select id, count(*) as n_links, max(similarity) as closest from (select id_a as id, similarity from pairs union all select id_b, similarity from pairs) group by 1""")
def joi8_similar_records(spark: SparkSession, d: str) -> DataFrame:
    """Records that resemble others, with the number of their links: one row a record, not a row a pair."""
    return N.similar_links(_findings(spark, d), 0.8, TOLERANCES)


@query("""with c as (select distinct chunk_id, sha256(chunk_id) as h from chunk), s as (select substr(md5(chunk_id), 1, 1) as name, case when ordinal = 1 then 'gone' else sha256(chunk_id) end as h from (select distinct chunk_id, ordinal from chunk))
select name, count(c.chunk_id) as n, count(*) as wanted from s left join c using (h) group by 1""")
def joi11_reference_sets(spark: SparkSession, d: str) -> DataFrame:
    """Sets of digests resolved to the chunks that have them; some are gone."""
    rows = table(spark, d, "chunk").select("chunk_id", "ordinal").distinct()
    c = rows.select("chunk_id", F.sha2("chunk_id", 256).alias("h")).distinct()
    h = F.when(F.col("ordinal") == 1, "gone").otherwise(F.sha2("chunk_id", 256))
    sets = rows.select(F.substring(F.md5("chunk_id"), 1, 1).alias("name"), h.alias("h"))
    return sets.join(c, "h", "left").groupBy("name").agg(F.count("chunk_id").alias("n"), F.count("*").alias("wanted"))


@query("""select 'question_record' as link, count(*) as n from (select distinct source_record_id from eval_question where source_record_id is not null) q where not exists (select 1 from patient_record p where p.record_id = q.source_record_id)
union all select 'result_question', count(*) from (select distinct question_id from result_rating_summary where question_id is not null) s where not exists (select 1 from eval_question q where q.question_id = s.question_id)
union all select 'version_supersedes', count(*) from (select distinct supersedes_id from document_version where supersedes_id is not null) s where not exists (select 1 from document_version v where v.document_version_id = s.supersedes_id)
union all select 'chunk_active_version', count(*) from (select distinct document_version_id from chunk where document_version_id is not null) c where not exists (select 1 from document_version v where v.document_version_id = c.document_version_id and v.status = 'active')
union all select 'rating_result', count(*) from (select distinct result_id from rubric_rating where result_id is not null) r where not exists (select 1 from result_rating_summary s where s.result_id = r.result_id)
union all select 'slice_result', count(*) from (select distinct unnest(result_ids) as result_id from irr_domain_score) s where result_id is not null and not exists (select 1 from result_rating_summary r where r.result_id = s.result_id)""")
def joi12_broken_links(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    links = [
        ("question_record", t("eval_question").select(F.col("source_record_id").alias("k")), t("patient_record").select(F.col("record_id").alias("k"))),
        ("result_question", t("result_rating_summary").select(F.col("question_id").alias("k")), t("eval_question").select(F.col("question_id").alias("k"))),
        ("version_supersedes", t("document_version").select(F.col("supersedes_id").alias("k")), t("document_version").select(F.col("document_version_id").alias("k"))),
        ("chunk_active_version", t("chunk").select(F.col("document_version_id").alias("k")), t("document_version").where("status = 'active'").select(F.col("document_version_id").alias("k"))),
        ("rating_result", t("rubric_rating").select(F.col("result_id").alias("k")), t("result_rating_summary").select(F.col("result_id").alias("k"))),
        ("slice_result", t("irr_domain_score").select(F.explode("result_ids").alias("k")), t("result_rating_summary").select(F.col("result_id").alias("k"))),
    ]
    out = None
    for name, have, of in links:
        n = have.where("k is not null").distinct().join(of, "k", "left_anti").agg(F.count("*").alias("n")).select(F.lit(name).alias("link"), "n")
        out = n if out is None else out.unionByName(n)
    return out


PINNED = {"chunk_active_version": 100_000, "question_record": 1, "rating_result": 0}
_PINNED = " ".join(f"when '{k}' then {v}" for k, v in PINNED.items())


@query(SQL["joi12_broken_links"].join(["select link as name, n as now, pinned, case when n > pinned then 'fail' when n > 0 then 'warn' else 'ok' end as level from (select *, (case link " + _PINNED + " else 0 end)::bigint as pinned from (", "))"]))
def agg18_known_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Counts of broken links against what is pinned for them."""
    return W.compared_gaps(PINNED, joi12_broken_links(spark, d).withColumnRenamed("link", "name"))


@query("""with s as (select document_version_id, chunk_id, row_number() over (partition by document_version_id order by ordinal, chunk_id) as i from (select distinct document_version_id, chunk_id, ordinal from chunk)),
q as (select document_version_id, case when i % 2 = 0 then 'c' || i else chunk_id end as label from s union all select document_version_id, 'c999' from s)
select q.document_version_id, q.label, coalesce(a.chunk_id, b.chunk_id) as chunk_id from (select distinct * from q) q left join s a on a.document_version_id = q.document_version_id and q.label = 'c' || a.i left join s b on b.document_version_id = q.document_version_id and q.label = b.chunk_id""")
def joi13_citation_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels by position or by id, resolved within each version."""
    i = F.row_number().over(Window.partitionBy("document_version_id").orderBy("ordinal", "chunk_id"))
    s = table(spark, d, "chunk").select("document_version_id", "chunk_id", "ordinal").distinct().withColumn("i", i)
    labels = s.select("document_version_id", F.when(F.col("i") % 2 == 0, F.concat(F.lit("c"), "i")).otherwise(F.col("chunk_id")).alias("label"))
    labels = labels.unionByName(s.select("document_version_id", F.lit("c999").alias("label"))).distinct()
    by_place = s.select("document_version_id", F.concat(F.lit("c"), "i").alias("label"), F.col("chunk_id").alias("a"))
    by_id = s.select("document_version_id", F.col("chunk_id").alias("label"), F.col("chunk_id").alias("b"))
    on = ["document_version_id", "label"]
    return labels.join(by_place, on, "left").join(by_id, on, "left").select(*on, F.coalesce("a", "b").alias("chunk_id"))


@query("""with g as (select distinct l_orderkey as query_id, l_partkey::varchar as chunk_id, l_linenumber as page from lineitem), p as (select l_orderkey as query_id, l_partkey::varchar as chunk_id, l_linenumber + (l_partkey % 2) as page, l_linenumber as position, l_suppkey from lineitem where l_suppkey % 3 <> 0),
f as (select query_id, chunk_id, arg_min(page, position) as predicted_page from p group by all)
select g.query_id, g.chunk_id, g.page, f.predicted_page, coalesce(abs(g.page - f.predicted_page) <= 0, false) as fits from g left join f using (query_id, chunk_id)""")
def joi14_loci(spark: SparkSession, d: str) -> DataFrame:
    from marlstone.operators.metrics import loci

    li = table(spark, d, "lineitem")
    base = li.select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").cast("string").alias("chunk_id"), F.col("l_linenumber").alias("page"), "l_partkey", "l_suppkey")
    gold = base.select("query_id", "chunk_id", "page").distinct()
    predicted = base.where("l_suppkey % 3 <> 0").select("query_id", "chunk_id", (F.col("page") + F.col("l_partkey") % 2).alias("page"), F.col("page").alias("position"))
    return loci(gold, predicted)


SYNONYMS = [("size", "part.size"), ("ring size", "part.ring_size"), ("widget", "part.widget"), ("small", "part.small"), ("red", "part.colour")]
_SYN = ", ".join(str(s) for s in SYNONYMS)


@query(f"""with s(synonym, path) as (values {_SYN}), f as (select distinct p_name as field from part), h as (select field, arg_max(path, struct_pack(n := len(synonym), s := synonym)) as path from f join s on contains(lower(trim(field)), synonym) group by 1)
select p_partkey, p_name as field, path from part left join h on h.field = p_name""")
def joi15_mapped_fields(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("field"))
    return N.mapped_fields(rows, spark.createDataFrame(SYNONYMS, "synonym string, path string")).select("p_partkey", "field", "path")


@query("with c as (select * from chunk qualify row_number() over (partition by chunk_id) = 1) select b.chunk_id as parent, count(*) as n_children from c a join c b on a.parent_chunk_id = b.chunk_id group by 1")
def joi16_parents(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunk").dropDuplicates(["chunk_id"])
    return c.where("parent_chunk_id is not null").join(c.select(F.col("chunk_id").alias("parent_chunk_id")), "parent_chunk_id").groupBy(F.col("parent_chunk_id").alias("parent")).agg(F.count("*").alias("n_children"))


@query("select p_type, list_aggregate(list_sort(list_distinct(list(p_brand))), 'string_agg', ',') as brands, len(list_intersect(list_distinct(list(p_size)), [1, 5, 10, 20])) as shared from part group by 1")
def set1_array_sets(spark: SparkSession, d: str) -> DataFrame:
    sizes = F.array_intersect(F.collect_set(F.col("p_size").cast("int")), F.array(*[F.lit(x) for x in (1, 5, 10, 20)]))
    return table(spark, d, "part").groupBy("p_type").agg(F.array_join(F.array_sort(F.collect_set("p_brand")), ",").alias("brands"), F.size(sizes).cast("bigint").alias("shared"))


@query("""with a as (select doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) as w from documents), ca as (select doc_id, w, count(*) as n from a group by all),
cb as (select doc_id + 1 as doc_id, w, n from ca)
select doc_id, sum(greatest(ca.n - coalesce(cb.n, 0), 0))::bigint as more from ca left join cb using (doc_id, w) group by 1""")
def set3_multiset_difference(spark: SparkSession, d: str) -> DataFrame:
    """How many words a document has more often than the one before it."""
    words = table(spark, d, "documents").select("doc_id", F.explode(words_of(F.col("text"))).alias("w")).groupBy("doc_id", "w").agg(F.count("*").alias("n"))
    before = words.select((F.col("doc_id") + 1).alias("doc_id"), "w", F.col("n").alias("b"))
    return words.join(before, ["doc_id", "w"], "left").groupBy("doc_id").agg(F.sum(F.greatest(F.col("n") - F.coalesce("b", F.lit(0)), F.lit(0))).alias("more"))


@query("""with w as (select distinct question_id, list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z]+'), lambda x: lower(x))) as w, area from eval_question where text is not null)
select question_id, len(list_filter(w, lambda x: not list_contains(list_transform(regexp_extract_all(coalesce(area, ''), '[A-Za-z]+'), lambda y: lower(y)), x) and x not in ('the', 'a', 'is', 'of', 'and'))) as n_foreign from w""")
def set4_vocabulary_check(spark: SparkSession, d: str) -> DataFrame:
    allowed = F.array_union(words_of(F.coalesce("area", F.lit(""))), F.array(*[F.lit(x) for x in ("the", "a", "is", "of", "and")]))
    q = table(spark, d, "eval_question").where("text is not null").select("question_id", "text", "area").distinct()
    return q.select("question_id", F.size(F.array_except(words_of(F.col("text")), allowed)).cast("bigint").alias("n_foreign")).distinct()


@query("select question_id from eval_question where question_id is not null except select question_id from eval_question where in_fixed_testset")
def set5_pool_difference(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "eval_question")
    return q.where("question_id is not null").select("question_id").distinct().join(q.where("in_fixed_testset").select("question_id"), "question_id", "left_anti")


@query("select user_id, string_agg(event_type, ',' order by first) as kinds from (select user_id, event_type, min(event_id) as first from events group by all) group by 1")
def set6_ordered_distinct(spark: SparkSession, d: str) -> DataFrame:
    first = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    ordered = F.array_sort(F.collect_list(F.struct("first", "event_type")))
    return first.groupBy("user_id").agg(F.array_join(F.transform(ordered, lambda x: x["event_type"]), ",").alias("kinds"))


_NESTED = _CELLS + """, w as (select record_key, max(case when field_name = 'age_days' and reading <> chr(0) then reading end)::int as dol, max(case when field_name = 'admission_date_time' and reading <> chr(0) then reading end)::timestamp as adm,
  max(case when field_name = 'sex' and reading <> chr(0) then reading end) as sex, round(max(case when field_name = 'birth_weight' and reading <> chr(0) then reading end)::double * 1000, 1) as bw,
  max(case when field_name = 'heart_rate' and reading <> chr(0) then reading end)::double as hr, bool_or(field_name in ('weight_now', 'heart_rate', 'respiratory_rate', 'oxygen_saturation', 'temparature', 'capillary_refill') and reading <> chr(0)) as vit,
  list_aggregate(list_sort(list(field_name || ':' || reading) filter (where field_name in ('antibiotics', 'cpap', 'feeds', 'fluids', 'oxygen') and reading <> chr(0))), 'string_agg', ',') as interventions,
  list_aggregate(list_sort(list(field_name || ':' || reading) filter (where field_name in ('maternal_infection', 'prom') and reading <> chr(0))), 'string_agg', ',') as risk from cell group by 1)"""


@query(_NESTED + """ select k.record_key, 'newborn-' || k.record_key as record_id, 'DEID-' || k.record_key as mrn, '1.4.0' as schema_version, sex, dol as day_of_life, bw as birth_weight_g, coalesce(vit, false)::int as n_vitals, case when vit then hr end as heart_rate_bpm, case when vit then adm end as recorded_at,
 coalesce(interventions, '') as interventions, coalesce(risk, '') as maternal_risk_factors, (adm::date - dol)::date as date_of_birth
from (select distinct trim(key) as record_key from newborn_nbu_2021 where trim(key) <> '') k left join w using (record_key)""")
def rec1_mapped_records(spark: SparkSession, d: str) -> DataFrame:
    """The nested records, looked into: single values, the entry of vitals, what was assessed, the derived day of birth."""
    identity = {"record_id": "newborn-{key}", "mrn": "DEID-{key}", "schema_version": "1.4.0", "dataset_provenance": "deidentified-anonymised"}
    r = eav.nested(_wide(spark, d), table(spark, d, "eav_field_spec"), identity, {"feeding_plan": "none"})
    told = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["name"], x["present"].cast("string"))), ",").alias(c)
    vital = F.get("vitals", F.lit(0))
    return r.select(
        "record_key", "record_id", "mrn", "schema_version", "sex", "encounter.day_of_life", "encounter.birth_weight_g", F.size("vitals").alias("n_vitals"),
        vital["heart_rate_bpm"].alias("heart_rate_bpm"), vital["recorded_at"].alias("recorded_at"), told("interventions"), told("maternal_risk_factors"), "date_of_birth",
    )


_NUMBERS = ["heart_rate", "temparature", "respiratory_rate", "age_days"]
_KNOWN = _CELLS + """,
known as (select record_key as key, field_name as path, case when value_type in ('int', 'double') then reading::double end as num, case when value_type = 'boolean' then reading = 'true' end as flag
  from cell join (select distinct field_name, value_type from eav_field_spec) using (field_name) where reading <> chr(0) and (field_name in ({}) or field_name in ('apnoea', 'convulsions', 'grunting')))""".format(", ".join(f"'{x}'" for x in _NUMBERS))


def _known(spark: SparkSession, d: str) -> DataFrame:
    return N.features(_wide(spark, d), "record_key", {n: F.col(n) for n in _NUMBERS}, {n: F.col(n) for n in ("apnoea", "convulsions", "grunting")}).withColumnRenamed("record_key", "key")


@query(_KNOWN + " select * from known")
def rec2_features(spark: SparkSession, d: str) -> DataFrame:
    return _known(spark, d)


@query("""select o_orderkey, o_orderkey % 3 = 0 as direct, (o_orderkey % 3 = 0) or (o_orderkey % 2 = 0) as grouped from orders""")
def rec3_presence_lookup(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    index = F.create_map(F.lit("sex"), k % 3 == 0, F.lit("vitals.0.hr"), k % 3 == 0, F.lit("vitals.1.hr"), k % 2 == 0)
    return table(spark, d, "orders").select("o_orderkey", N.present(index, F.lit("sex"), ["vitals"]).alias("direct"), N.present(index, F.lit("vitals.hr"), ["vitals"]).alias("grouped"))


CRITERIA = [(1, "heart_rate", ">", 160.0), (2, "temparature", "<", 36.5), (3, "age_days", "<=", 2.0), (4, "unknown", ">", 1.0), (5, "respiratory_rate", ">=", 60.0)]
_CRIT = ", ".join(str(c) for c in CRITERIA)


@query(_KNOWN + f""", crit(criterion_id, path, operator, value) as (values {_CRIT})
select k.key, criterion_id, case operator when '>' then num > value when '<' then num < value when '>=' then num >= value when '<=' then num <= value when '=' then num = value end as matched
from (select k.key, crit.* from (select distinct key from known) k, crit) k left join known using (key, path)""")
def rec4_criteria(spark: SparkSession, d: str) -> DataFrame:
    return N.evaluated(spark.createDataFrame(CRITERIA, "criterion_id int, path string, operator string, value double"), _known(spark, d))


CONCEPTS = [("fast heart", "heart_rate", ">", 160.0, None), ("normal heat", "temparature", "between", 36.5, 37.5), ("apnoea seen", "apnoea", "present", None, None), ("aged", "age_days", "value", None, None)]
_CONC = ", ".join("(" + ", ".join("null" if x is None else repr(x) for x in c) + ")" for c in CONCEPTS)
_FIRED = _KNOWN + f""", v(concept, field, operator, low, high) as (values {_CONC}),
fired as (select key, concept from known join v on path = field where case operator when 'present' then flag when 'value' then num is not null when '>' then num > low when 'between' then num between low and high end)"""


def _fired(spark: SparkSession, d: str) -> DataFrame:
    return N.concepts_of(_known(spark, d), spark.createDataFrame(CONCEPTS, "concept string, field string, operator string, low double, high double"))


@query(_FIRED + " select * from fired")
def rec5_concepts(spark: SparkSession, d: str) -> DataFrame:
    return _fired(spark, d)


@query(_FIRED + """, q as (select distinct question_id as query_id, record_key as key, q.text from eval_question q join patient_record p on p.record_id = q.source_record_id where q.text is not null),
per_key as (select key, list_aggregate(list_sort(list_distinct(list(concept))), 'string_agg', '; ') as terms from fired group by 1)
select query_id, sha256(text || coalesce('; ' || terms, '')) as digest, terms is not null as fired from q left join per_key using (key)""")
def rec6_augmented(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "patient_record").select(F.col("record_id").alias("source_record_id"), F.col("record_key").alias("key"))
    q = table(spark, d, "eval_question").where("text is not null").join(records, "source_record_id").select(F.col("question_id").alias("query_id"), "key", "text").distinct()
    return N.augmented(q, _fired(spark, d)).select("query_id", F.sha2("text", 256).alias("digest"), "fired")


_HEADINGS = {1: "severe", 2: "cold", 3: "severe", 5: "cold"}


@query(_KNOWN + f""", crit(criterion_id, path, operator, value, heading) as (values {", ".join(str((*c, _HEADINGS[c[0]])) for c in CRITERIA if c[0] in _HEADINGS)}),
m as (select key, heading, case operator when '>' then num > value when '<' then num < value when '>=' then num >= value when '<=' then num <= value end as matched from (select k.key, crit.* from (select distinct key from known) k, crit) k left join known using (key, path)),
j as (select key, heading, bool_and(matched) as ok from m where matched is not null group by all), w as (select key, count(*) as n, min(heading) as heading from j where ok group by 1)
select key, case when n = 1 then heading else 'uncertain' end as stage from (select distinct key from m) left join w using (key)""")
def rec7_stages(spark: SparkSession, d: str) -> DataFrame:
    criteria = spark.createDataFrame([c for c in CRITERIA if c[0] in _HEADINGS], "criterion_id int, path string, operator string, value double")
    heads = spark.createDataFrame(list(_HEADINGS.items()), "criterion_id int, heading string")
    return N.stages(N.evaluated(criteria, _known(spark, d)).join(heads, "criterion_id"))


@query(_KNOWN + """, req as (select key, path, pos from (select distinct key from known), (values ('heart_rate', 1), ('apnoea', 2), ('heart_rate', 3), ('weight', 4)) v(path, pos))
select key, path, min(pos) as position from req where not exists (select 1 from known k where k.key = req.key and k.path = req.path) group by all""")
def rec8_missing_paths(spark: SparkSession, d: str) -> DataFrame:
    known = _known(spark, d)
    need = F.array(*[F.struct(F.lit(p).alias("path"), F.lit(i).alias("position")) for p, i in (("heart_rate", 1), ("apnoea", 2), ("heart_rate", 3), ("weight", 4))])
    required = known.select("key").distinct().select("key", F.inline(need))
    return N.missing_paths(required, known)


KEY = b"an example key"
_PADS = [p.hex() for p in X.key_pads(KEY)]


@query(f"""with r as (select distinct record_id, mrn, ingested_at from patient_record), h as (select *, sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || encode(mrn)))) as mrn_hash from r)
select mrn_hash, row_number() over (partition by mrn_hash order by ingested_at nulls first, record_id)::int as snapshot_no, record_id from h""")
def rec9_patient_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Patients by a keyed digest of their number, their records as snapshots in order."""
    return N.snapshots(table(spark, d, "patient_record"), X.keyed_digest(F.col("mrn"), KEY))


BANDS = [("newborn", None, 7.0), ("late newborn", 7.0, 28.0), ("infant", 28.0, None)]
_BANDS = ", ".join("(" + ", ".join("null" if x is None else repr(x) for x in b) + ")" for b in BANDS)


OPENINGS = {"feeding": "starting feeds", "antibiotics": "the course of antibiotics"}
FACTS = {"feeding": ["age_band", "gestation", "weight", "factors", "vitals"], "antibiotics": ["age", "setting", "weight"]}
_KG = "regexp_replace(printf('%.3f', {0} / 1000), '\\.?0+$', '')"


@query(_CELLS + f""", a as (select record_key, max(case when field_name = 'age_days' and reading <> chr(0) then reading end)::int as age, max(case when field_name = 'gestational_age' and reading <> chr(0) then reading end)::double as ga,
  max(case when field_name = 'care_setting' and reading <> chr(0) then reading end) as setting, round(max(case when field_name = 'weight_now' and reading <> chr(0) then reading end)::double * 1000, 1) as wn,
  round(max(case when field_name = 'birth_weight' and reading <> chr(0) then reading end)::double * 1000, 1) as wb, max(case when field_name = 'heart_rate' and reading <> chr(0) then reading end)::double as hr,
  max(case when field_name = 'maternal_infection' and reading <> chr(0) then reading end) as mi, max(case when field_name = 'prom' and reading <> chr(0) then reading end) as pr from cell group by 1),
b(band, low, high) as (values {_BANDS}), k as (select * from (select distinct trim(key) as record_key from newborn_nbu_2021 where trim(key) <> '') left join a using (record_key)),
bd as (select k.*, case when age is not null then (select band from b where (low is null or age >= low) and (high is null or age < high)) end as band from k),
w as (select *, case when coalesce(wn, wb) is not null then 'Weight (kg): ' || {_KG.format('coalesce(wn, wb)')} || ' (' || case when wn is null then 'birth weight' when wb is not null then 'current weight; birth weight ' || {_KG.format('wb')} || ' kg' else 'current weight' end || ')' end as weight,
  concat_ws('; ', case when mi is not null then 'maternal_infection: ' || case mi when 'true' then 'present' else 'absent' end end, case when pr is not null then 'prom: ' || case pr when 'true' then 'present' else 'absent' end end) as factors from bd),
q as (select record_key as key, 'feeding' as area, concat_ws(chr(10), 'About starting feeds?' || chr(10), 'About starting feeds?' || chr(10), 'The newborn patient ' || nullif(concat_ws(', ', 'is aged ' || age || ' days' || coalesce(' (' || band || ')', ''), 'born at ' || ga || ' weeks gestation'), '') || '.', weight,
   'Maternal risk factors: ' || nullif(factors, ''), 'Vitals: heart_rate ' || hr) as text from w
 union all select record_key, 'antibiotics', concat_ws(chr(10), 'About the course of antibiotics?' || chr(10), 'About the course of antibiotics?' || chr(10), 'The newborn patient ' || nullif(concat_ws(', ', 'is ' || age || ' days old', 'currently in ' || nullif(setting, '')), '') || '.', weight) from w)
select key, area, sha256(text) as digest from q""")
def rec10_area_question(spark: SparkSession, d: str) -> DataFrame:
    """Two areas' questions about every record, the opening twice."""
    return _questions(spark, d, 2).select("key", "area", F.sha2("text", 256).alias("digest"))


def _questions(spark: SparkSession, d: str, repeats: int) -> DataFrame:
    w = _wide(spark, d)
    vitals = F.map_filter(F.create_map(F.lit("heart_rate"), F.col("heart_rate")), lambda _, v: v.isNotNull())
    records = w.select(
        F.col("record_key").alias("key"), "age_days", F.col("gestational_age").alias("gestation"), F.col("care_setting").alias("setting"), F.col("weight_now"), F.col("birth_weight").alias("weight_birth"),
        F.col("maternal_risk_factors").alias("factors"), vitals.alias("vitals"),
    )
    bands = spark.createDataFrame(BANDS, "band string, low double, high double")
    known = N.area_question(records.where("age_days is not null"), OPENINGS, FACTS, bands, repeats, "About ", "?")
    return known.unionByName(N.area_question(records.where("age_days is null"), OPENINGS, FACTS, None, repeats, "About ", "?"))


@query("select user_id, string_agg(event_type, ' ' order by ts, event_id) as transcript, count(*) as turns from events group by 1")
def rec13_transcript(spark: SparkSession, d: str) -> DataFrame:
    """A user's events in order; a user's own history is the row's natural bound."""
    turns = F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type")))
    return table(spark, d, "events").groupBy("user_id").agg(F.array_join(F.transform(turns, lambda x: x["event_type"]), " ").alias("transcript"), F.count("*").alias("turns"))


#: An order of events as a log of decisions on provisional rows: what each event asks for, and where it may lead.
DECISIONS = [("provisional", "view", "provisional"), ("provisional", "purchase", "accepted"), ("provisional", "click", "edited"), ("edited", "purchase", "accepted"), ("provisional", "error", "expired"), ("edited", "error", "expired")]
_WALK = """e as (select user_id, event_id, ts, event_type, row_number() over (partition by user_id order by ts, event_id) as i from events),
t(s, a, n) as (values {0}),
w as (select user_id, event_id, ts, i, event_type, '{1}' as before, coalesce((select n from t where s = '{1}' and a = event_type), '{1}') as after, exists(select 1 from t where s = '{1}' and a = event_type) as accepted from e where i = 1
 union all select e.user_id, e.event_id, e.ts, e.i, e.event_type, w.after, coalesce(t.n, w.after), t.n is not null from w join e on e.user_id = w.user_id and e.i = w.i + 1 left join t on t.s = w.after and t.a = e.event_type)"""


def _walk(transitions: list, start: str) -> str:
    return "with recursive " + _WALK.format(", ".join(str(t) for t in transitions), start)


def _replay(spark: SparkSession, d: str, transitions: list, start: str) -> DataFrame:
    log = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type")
    return W.replayed(log, transitions, start, "user_id", ["ts", "event_id"], "event_type")


@query(_walk(DECISIONS, "provisional") + """, l as (select user_id, arg_max(after, i) as state, count(*) filter (where accepted) as n_accepted, count(*) filter (where not accepted) as n_refused, max(ts) filter (where accepted and after in ('accepted', 'expired')) as ended from w group by 1)
select user_id, state, n_accepted, n_refused, case when state in ('accepted', 'expired') then ended end as valid_to from l""")
def rec14_validity(spark: SparkSession, d: str) -> DataFrame:
    """Where each user's log of decisions ended, and since when it is closed."""
    return W.validity(_replay(spark, d, DECISIONS, "provisional"), "user_id", "ts", ["ts", "event_id"], ["accepted", "expired"])


REVIEWS = [("pending", "view", "in_review"), ("in_review", "purchase", "confirmed"), ("in_review", "error", "rejected"), ("confirmed", "click", "pending"), ("rejected", "click", "pending")]


@query(_walk(REVIEWS, "pending") + " select user_id, event_id, before, after, accepted from w")
def stf8_transitions(spark: SparkSession, d: str) -> DataFrame:
    """Review decisions replayed, each with the state it met and whether that allowed it."""
    return _replay(spark, d, REVIEWS, "pending").select("user_id", "event_id", "before", "after", "accepted")


DRAFTS = [("none", "signup", "draft"), ("none", "view", "draft"), ("draft", "click", "draft"), ("draft", "purchase", "submitted"), ("draft", "error", "none"), ("submitted", "signup", "none")]


@query(_walk(DRAFTS, "none") + " select user_id, arg_max(after, i) as state, count(*) filter (where before <> 'draft' and after = 'draft') as n_drafts, count(*) filter (where before = 'draft' and after = 'none') as n_dropped from w group by 1")
def stf5_drafts(spark: SparkSession, d: str) -> DataFrame:
    """One draft at a time: begun, saved, submitted or dropped."""
    r = _replay(spark, d, DRAFTS, "none")
    n = lambda a, b: F.count_if((F.col("before") == a) & (F.col("after") == b))
    begun = F.count_if((F.col("before") != "draft") & (F.col("after") == "draft"))
    return r.groupBy("user_id").agg(F.max_by("after", F.struct("ts", "event_id")).alias("state"), begun.alias("n_drafts"), n("draft", "none").alias("n_dropped"))


HELD = [("pending", "view", "pending"), ("pending", "purchase", "accepted"), ("pending", "click", "edited"), ("pending", "error", "rejected"), ("pending", "signup", "regenerated")]
_EFFECT = {"accepted": "commit", "edited": "replace", "rejected": "drop", "regenerated": "drop"}


@query(_walk(HELD, "pending") + f" select user_id, event_id, after as resolution, case after {' '.join(f'when {a!r} then {b!r}' for a, b in _EFFECT.items())} end as effect from w where accepted and before <> after")
def stf6_decisions(spark: SparkSession, d: str) -> DataFrame:
    """The first decision on each held answer, and what it does to the answer's context; later ones are refused."""
    r = _replay(spark, d, HELD, "pending").where("accepted and before <> after")
    effect = F.lit(None).cast("string")
    for state, name in _EFFECT.items():
        effect = F.when(F.col("after") == state, name).otherwise(effect)
    return r.select("user_id", "event_id", F.col("after").alias("resolution"), effect.alias("effect"))


_PICKS = _FLAGS + """,
cat as (select record_key as id, max(case when field_name = 'triage_category' and reading <> chr(0) then reading end) as category from cell group by 1),
k as (select distinct trim(key) as id from newborn_nbu_2021 where trim(key) <> ''),
cd as (select k.id, category, coalesce(findings, []) as findings, heart_rate, temparature, md5('7|' || k.id) as o from k left join f using (id) left join cat using (id) where category is not null),
loops(loop, pos, target) as (values @LOOPS@),
steps as (select loop, target, category, id, findings, heart_rate, temparature, row_number() over (order by pos, category, o, id) as i from loops, cd),
walk as (select 0::bigint as i, ''::varchar as loop, ''::varchar as category, ''::varchar as id, 0 as have, false as take, []::struct(id varchar, f varchar[], h double, t double)[] as acc
 union all select s.i, s.loop, s.category, s.id, case when s.loop = w.loop and s.category = w.category then w.have else 0 end + ok::int, ok, case when ok then list_append(w.acc, struct_pack(id := s.id, f := s.findings, h := s.heart_rate, t := s.temparature)) else w.acc end
 from walk w join lateral (select s.*, (case when s.loop = w.loop and s.category = w.category then w.have else 0 end) < s.target and len(list_filter(w.acc, lambda a: a.id = s.id or (len(a.f) > 0 and len(s.findings) > 0 and len(list_intersect(a.f, s.findings)) >= 0.8 * (len(a.f) + len(s.findings) - len(list_intersect(a.f, s.findings)))
   and coalesce(abs(a.h - s.heart_rate) <= 15, true) and coalesce(abs(a.t - s.temparature) <= 0.5, true)))) = 0 as ok from steps s where s.i = w.i + 1) s on true),
picks as (select loop, category, have as pick, id from walk where take)"""


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    present = F.array_compact(F.array(*[F.when(F.col(x), F.lit(x)) for x in _FINDINGS]))
    return _wide(spark, d).select(F.col("record_key").alias("id"), F.col("triage_category").alias("category"), present.alias("findings"), "heart_rate", "temparature")


def _plan(spark: SparkSession, d: str, loops: list[tuple[str, int]]) -> tuple[DataFrame, DataFrame]:
    held = cut(_candidates(spark, d))
    names = sorted(r.category for r in small_rows(held.where("category is not null").select("category").distinct(), 1000))
    return Z.picked(held, [Z.Loop(name, dict.fromkeys(names, n)) for name, n in loops], F.md5(F.concat(F.lit("7|"), "id")), 0.8, TOLERANCES)


_recursive = lambda sql: "with recursive" + sql.strip().removeprefix("with")


@query(_recursive(_PICKS.replace("@LOOPS@", "('triage', 1, 12)")) + """, want as (select distinct category from cd)
select category, coalesce(max(pick), 0)::int as picked, 12 - coalesce(max(pick), 0)::int as missing, list_aggregate(list_sort(list(pick || ':' || id) filter (where id is not null)), 'string_agg', ' ') as ids from want left join picks using (category) group by 1""")
def win16_stratified_picks(spark: SparkSession, d: str) -> DataFrame:
    """Twelve records of each triage category in the order of a hash, none like an earlier pick, with the shortfall."""
    picks, short = _plan(spark, d, [("triage", 12)])
    listed = picks.groupBy("category").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "pick", "id"))), " ").alias("ids"))
    return short.join(listed, "category", "left").select("category", (F.col("target") - F.col("missing")).alias("picked"), "missing", "ids")


LOOPS = [("fixed", 2), ("review", 3), ("holdout", 3), ("four_area", 2), ("triage", 2)]
_LOOPS = ", ".join(f"('{n}', {i}, {k})" for i, (n, k) in enumerate(LOOPS))


@query(_recursive(_PICKS.replace("@LOOPS@", _LOOPS)) + " select loop, category, pick::int as pick, id, area from picks, (values ('feeding'), ('antibiotics')) a(area) where loop = 'four_area' or area = 'feeding'")
def abl7_questions(spark: SparkSession, d: str) -> DataFrame:
    """The plan of question loops: each takes records that no earlier one has, none like another; one of them asks every area."""
    picks = _plan(spark, d, LOOPS)[0]
    asks = _questions(spark, d, 1).select(F.col("key").alias("id"), "area", "text")
    return picks.join(asks, "id").where("loop = 'four_area' or area = 'feeding'").where("text <> ''").select("loop", "category", "pick", "id", "area")


@query("""select event_id, regexp_matches(props, '"k"') as forbidden from events""")
def rec15_forbidden_keys(spark: SparkSession, d: str) -> DataFrame:
    keys = F.coalesce(F.json_object_keys("props"), F.array().cast("array<string>"))
    return table(spark, d, "events").select("event_id", F.arrays_overlap(keys, F.array(F.lit("k"), F.lit("dose"))).alias("forbidden"))


@query("select record_id, max(patient_id) is not null as has_patient, max(mrn) is not null as has_mrn, 5 as n_paths from patient_record group by 1")
def agg23_presence_index(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "patient_record").groupBy("record_id").agg(F.max("patient_id").alias("p"), F.max("mrn").alias("mrn"), F.collect_set("dataset_id").alias("sets"))
    nested = r.select("record_id", F.struct(F.col("p").alias("id"), "mrn").alias("patient"), "sets", F.lit(1).alias("a"), F.lit(None).cast("string").alias("b"))
    index = N.presence_index(nested, "record_id")
    return index.select("record_id", F.element_at("field_index", "patient.id").alias("has_patient"), F.element_at("field_index", "patient.mrn").alias("has_mrn"), F.size("field_index").alias("n_paths"))
