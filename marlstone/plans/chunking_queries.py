"""Queries of document structure, chunking, tables and lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.text import GROUNDING_STOPWORDS, content_words
from marlstone.operators import chunking as C
from marlstone.operators.joins import against_all
from marlstone.plans.text_queries import sql_words
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


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunk").where("text is not null").dropDuplicates(["chunk_id"])


_CHUNKS = "c as (select * from chunk where text is not null qualify row_number() over (partition by chunk_id) = 1)"
_HEADS = f"""l as (select doc_id, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents where text is not null),
o as (select *, coalesce(sum(len(line) + 1) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as start from l),
h as (select doc_id, i, len(text) as n, start::int as char_start, regexp_extract(trim(line), '{C.HEADING}', 1) as number, trim(regexp_extract(trim(line), '{C.HEADING}', 2)) as heading
  from o where regexp_matches(trim(line), '{C.HEADING}')),
hd as (select *, len(number) - len(replace(number, '.', '')) + 1 as depth, row_number() over (partition by doc_id order by i) - 1 as section_no from h)"""


@query(f"""with {_HEADS},
anc as (select h.doc_id, h.section_no, a.section_no as s, a.heading from hd h join hd a on a.doc_id = h.doc_id and (a.section_no = h.section_no or (a.section_no < h.section_no and a.depth <
   (select min(b.depth) from hd b where b.doc_id = h.doc_id and b.section_no > a.section_no and b.section_no <= h.section_no)))),
p as (select doc_id, section_no, string_agg(heading, ' › ' order by s) as path from anc group by all)
select doc_id, section_no, number, heading, depth, path, char_start, coalesce(lead(char_start) over (partition by doc_id order by section_no), n) as char_end from hd join p using (doc_id, section_no)""")
def chk1_sections(spark: SparkSession, d: str) -> DataFrame:
    return C.sections(table(spark, d, "documents"), "doc_id", "text")


@query(f"with {_HEADS} select doc_id, section_no, least(ceil(n / 300), 1 + char_start // 300)::int as page from hd")
def chk2_page_of_offset(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    starts = docs.where("text <> ''").select("doc_id", F.transform(F.sequence(F.lit(0), F.ceil(F.length("text") / 300).cast("int") - 1), lambda i: i * 300).alias("starts"))
    at = C.sections(docs, "doc_id", "text").join(starts, "doc_id")
    return at.select("doc_id", "section_no", C.page_of(F.col("starts"), F.col("char_start")).alias("page"))


@query("""with p as (select distinct document_version_id as doc_id, page_no from text_line),
need as (select doc_id, max(page_no) as n_pages from p group by 1),
s as (select document_version_id as doc_id, max(page_count) as k from document_version group by 1)
select doc_id, page_no, coalesce(k = n_pages, false) as valid, case when k = n_pages then 10 + page_no end as source_page from p join need using (doc_id) left join s using (doc_id)""")
def chk3_source_pages(spark: SparkSession, d: str) -> DataFrame:
    """Source pages 11, 12, ... as many as the version says it has."""
    pages = table(spark, d, "text_line").select(F.col("document_version_id").alias("doc_id"), "page_no").distinct()
    said = table(spark, d, "document_version").groupBy(F.col("document_version_id").alias("doc_id")).agg(F.max("page_count").alias("k"))
    listed = said.select("doc_id", F.when(F.col("k") > 0, F.sequence(F.lit(11), F.col("k") + 10)).alias("source_pages"))
    return C.remap_pages(pages, listed)


@query("""with t as (select distinct * from text_line),
a as (select document_version_id as doc_id, sum(len(regexp_replace(text, '\\s+', '', 'g'))) as n_chars, max(page_no) as pages, bool_or(is_bold) as sectioned,
  avg(case when from_ocr and len(trim(text)) > 1 then confidence end) as conf, count(distinct page_no) as filled from t group by 1)
select doc_id, round(least(1.0, least(1.0, n_chars / (pages * 500)) + case when sectioned then 0.1 else 0.0 end), 3) as plain,
 round(greatest(0.0, least(1.0, 0.6 + 0.4 * coalesce(round(conf, 6), 1.0) - 0.3 * (pages - filled) / pages)), 3) as layout from a""")
def chk4_parse_quality(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "text_line").distinct()
    ocr = F.when(F.col("from_ocr") & (F.length(F.trim("text")) > 1), F.col("confidence"))
    a = lines.groupBy(F.col("document_version_id").alias("doc_id")).agg(
        F.sum(F.length(F.regexp_replace("text", r"\s+", ""))).alias("n_chars"), F.max("page_no").alias("pages"), F.bool_or("is_bold").alias("sectioned"),
        F.round(F.avg(ocr), 6).alias("conf"), F.count_distinct("page_no").alias("filled"),
    )
    pages = F.col("pages")
    return a.select(
        "doc_id", C.parse_quality(F.col("n_chars"), pages, F.col("sectioned")).alias("plain"),
        C.layout_quality(F.col("conf"), pages - F.col("filled"), pages, F.lit(0)).alias("layout"),
    )


_GRID = "'| a | ' || n_name || ' |' || chr(10) || case when n_nationkey % 3 = 0 then '|---|---|' else '| x | y |' end || chr(10) || case when n_nationkey % 2 = 0 then '| 1 | 2 |' else 'plain' end"


@query(f"""select n_nationkey, len(list_filter(string_split({_GRID}, chr(10)), lambda r: regexp_matches(r, '{C.TABLE_ROW}'))) >= 2
 and len(list_filter(string_split({_GRID}, chr(10)), lambda r: regexp_matches(r, '{C.TABLE_RULE}') and not regexp_matches(r, '[A-Za-z0-9]'))) > 0 as is_table from nation""")
def chk5_is_table(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    rule = F.when(k % 3 == 0, "|---|---|").otherwise("| x | y |")
    text = F.concat(F.lit("| a | "), "n_name", F.lit(" |\n"), rule, F.lit("\n"), F.when(k % 2 == 0, "| 1 | 2 |").otherwise("plain"))
    return table(spark, d, "nation").select("n_nationkey", C.is_table(text).alias("is_table"))


_RULES = "p_name || ' >= ' || p_size || ' mm; retail price<' || p_retailprice || ' | mass = ' || (p_partkey % 7) || '.5kg'"


@query(f"""with t as (select p_partkey, {_RULES} as t from part),
m as (select p_partkey, unnest(regexp_extract_all(t, '{C.CRITERION}', 1)) as f, unnest(regexp_extract_all(t, '{C.CRITERION}', 2)) as o, unnest(regexp_extract_all(t, '{C.CRITERION}', 3)) as v, unnest(regexp_extract_all(t, '{C.CRITERION}', 4)) as u from t)
select p_partkey, trim(regexp_replace(f, '^[ |]+|[ |]+$', '', 'g')) as field, o as operator, try_cast(v as double) as value, nullif(u, '') as unit from m""")
def chk6_criteria(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat("p_name", F.lit(" >= "), "p_size", F.lit(" mm; retail price<"), "p_retailprice", F.lit(" | mass = "), F.col("p_partkey") % 7, F.lit(".5kg"))
    return table(spark, d, "part").select("p_partkey", F.inline(C.criteria(text)))


@query(f"""with {_CHUNKS}, v as (select document_version_id, max(format_profile) as profile from document_version group by 1),
t as (select chunk_id, coalesce(section_number || ' ', '') || text || case when ordinal % 2 = 0 then ' Strong recommendation.' else '' end as b, profile from c left join v using (document_version_id))
select chunk_id, case when regexp_matches(b, '{C.NUMBERED}') then case when profile = 'grade_recommendations' and regexp_matches(b, '{C.GRADE}') then 'recommendation' when profile = 'clinical_protocol' then 'protocol_step' end end as kind from t""")
def chk7_clause_type(spark: SparkSession, d: str) -> DataFrame:
    versions = table(spark, d, "document_version").groupBy("document_version_id").agg(F.max("format_profile").alias("profile"))
    number = F.coalesce(F.concat("section_number", F.lit(" ")), F.lit(""))
    text = F.concat(number, "text", F.when(F.col("ordinal") % 2 == 0, " Strong recommendation.").otherwise(""))
    return chunks(spark, d).join(versions, "document_version_id", "left").select("chunk_id", C.clause_type(text, F.col("profile")).alias("kind"))


def _greedy(source: str, most: int) -> str:
    """source: (id, i from 1, n). Group numbers of greedy packing."""
    return f"""recursive_pack as (
  select id, i, n, n as run, 0 as g from {source} where i = 1
  union all select s.id, s.i, s.n, case when p.run + s.n > {most} then s.n else p.run + s.n end, case when p.run + s.n > {most} then p.g + 1 else p.g end
  from recursive_pack p join {source} s on s.id = p.id and s.i = p.i + 1)"""


_COUNT = "greatest(1, len(list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> '')))"


@query(f"""with recursive {_CHUNKS},
s as (select chunk_id as id, unnest(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) as t,
  generate_subscripts(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), 1) as i from c where {_COUNT.format('text')} > 120),
sn as (select id, i, {_COUNT.format('t')} as n from s), {_greedy('sn', 120)}
select id as chunk_id, g::int as piece_no, sum(n)::bigint as n_words, case when max(g) over (partition by id) > 0 then left(sha256(text), 16) end as split_group_id from recursive_pack join c on c.chunk_id = id group by id, g, text
union all select chunk_id, 0, {_COUNT.format('text')}, null from c where {_COUNT.format('text')} <= 120""")
def chk8_split_at_sentences(spark: SparkSession, d: str) -> DataFrame:
    cut = chunks(spark, d).withColumn("pieces", C.split_at_sentences(F.col("text"), 120))
    group = F.when(F.size("pieces") > 1, F.substring(F.sha2("text", 256), 1, 16)).alias("split_group_id")
    pieces = cut.select("chunk_id", group, F.posexplode("pieces").alias("piece_no", "piece"))
    return pieces.select("chunk_id", "piece_no", C.approx_tokens(F.col("piece")).cast("bigint").alias("n_words"), "split_group_id")


@query(f"""with recursive l as (select doc_id as id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(replace(x, chr(13), ''))), lambda x: x <> '') as ps from documents where text is not null),
s as (select id, unnest(ps) as t, generate_subscripts(ps, 1) as i from l), sn as (select id, i, {_COUNT.format('t')} as n from s), {_greedy('sn', 60)},
w as (select id as doc_id, g::int as window_no, sum(n)::bigint as n_words from recursive_pack group by all)
select doc_id, window_no, n_words, case when window_no > 0 then greatest(1, cast(round_even(0.15 * lag(n_words) over (partition by doc_id order by window_no), 0) as int)) else 0 end as n_overlap from w""")
def chk9_prose_windows(spark: SparkSession, d: str) -> DataFrame:
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(F.replace(x, F.lit("\r"), F.lit("")))), lambda x: x != "")
    docs = table(spark, d, "documents").where("text is not null").withColumn("ps", lines).where(F.size("ps") > 0)
    return C.prose_windows(docs, "doc_id", F.col("ps"), 60).select("doc_id", "window_no", F.col("n_words").cast("bigint").alias("n_words"), "n_overlap")


@query(f"""with {_CHUNKS}, p as (select chunk_id, ordinal, chunk_type, first_value(ordinal) over w as f,
  last_value(case when chunk_type = 'protocol_step' then ordinal end ignore nulls) over (partition by document_version_id, section_path order by ordinal rows between unbounded preceding and 1 preceding) as s
  from c window w as (partition by document_version_id, section_path order by ordinal)),
q as (select *, case when chunk_type in ('table', 'criteria') then coalesce(s, f) else f end as parent from p)
select chunk_id, case when parent <> ordinal then parent end as parent_ordinal from q""")
def chk10_parents(spark: SparkSession, d: str) -> DataFrame:
    at = chunks(spark, d).select("chunk_id", F.col("document_version_id").alias("document"), F.col("section_path").alias("section"), "ordinal", "chunk_type")
    return C.with_parents(at).select("chunk_id", "parent_ordinal")


# Rules tried on the chunks: number and path prefix.
GATES = [(1, "Training for anaemia of prematurity in the district hospital"), (2, ""), (3, "Management of family counselling")]
_GATES = ", ".join(f"({n}, '{p}')" for n, p in GATES)


@query(f"""with {_CHUNKS}, v as (select document_version_id, max(parse_quality) as q from document_version group by 1), r(rule_no, prefix) as (values {_GATES}),
h as (select chunk_id, min(rule_no) as rule_no from c, r where case when prefix = '' then coalesce(section_path, '') = '' else coalesce(section_path, '') = prefix or starts_with(coalesce(section_path, ''), prefix || ' ›') end group by 1)
select chunk_id, rule_no, case when rule_no is not null then 'excluded' when q < 0.5 then 'pending' end as review_status from c left join v using (document_version_id) left join h using (chunk_id)""")
def chk13_gates(spark: SparkSession, d: str) -> DataFrame:
    versions = table(spark, d, "document_version").groupBy("document_version_id").agg(F.max("parse_quality").alias("parse_quality"))
    at = chunks(spark, d).join(versions, "document_version_id", "left").select("chunk_id", "section_path", "parse_quality")
    return C.gates(at, spark.createDataFrame(GATES, "rule_no int, prefix string")).select("chunk_id", "rule_no", "review_status")


_BLOCKS = "list_filter(list_transform(regexp_split_to_array({0}, '\\n\\s*\\n'), lambda b: trim(regexp_replace(b, '^\\s+|\\s+$', '', 'g'))), lambda b: b <> '')"


@query(f"""with {_CHUNKS}, link as (select distinct document_version_id, supersedes_id from document_version where supersedes_id is not null and supersedes_id <> document_version_id),
n as (select supersedes_id, chunk_id, {_BLOCKS.format('text')} as b from c join link using (document_version_id)), k as (select document_version_id, chunk_id as confirmed_id, {_BLOCKS.format('text')} as cb from c)
select n.chunk_id, supersedes_id as superseded_id, min(confirmed_id) as confirmed_id from n left join k on n.supersedes_id = k.document_version_id and len(n.b) > 0 and len(list_filter(n.b, lambda x: not list_contains(k.cb, x))) = 0 group by all""")
def chk14_carried_over(spark: SparkSession, d: str) -> DataFrame:
    """All blocks of chunks against the whole chunks of the version that theirs supersedes."""
    at = chunks(spark, d).select(F.col("document_version_id").alias("document"), "chunk_id", "text", F.lit(None).cast("string").alias("source"))
    versions = table(spark, d, "document_version").where("supersedes_id is not null and supersedes_id <> document_version_id")
    before = versions.select(F.col("document_version_id").alias("document"), F.col("supersedes_id").alias("former")).distinct()
    new = at.join(before, "document").select(F.col("former").alias("document"), "chunk_id", "text", "source")
    return C.carried_over(new, at).select("chunk_id", F.col("document").alias("superseded_id"), "confirmed_id")


_UNITS = "select distinct document_version_id as document, page_no * 1000 + line_no as unit_no, text, page_no, case when bbox_bottom - bbox_top > 11 then 'heading' when bbox_bottom - bbox_top <= 8.5 then 'page_header' else 'text' end as kind from text_line"


@query(f"""with u as (select document || '#' || page_no as document, unit_no, text, kind from ({_UNITS})), w as (select *, row_number() over (partition by document order by unit_no) as n from u where kind <> 'page_header')
select document, unit_no, kind, text from w where n = 1 and kind <> 'heading' and regexp_matches(text, '^[a-z)\\],;:.–-]')""")
def chk17_leading_fragment(spark: SparkSession, d: str) -> DataFrame:
    """Every page taken as an excerpt of its version."""
    excerpts = _units(spark, d).withColumn("document", F.concat_ws("#", "document", "page_no")).drop("page_no")
    return C.leading_fragment(excerpts).select("document", "unit_no", "kind", "text")


def _units(spark: SparkSession, d: str) -> DataFrame:
    height = F.col("bbox_bottom") - F.col("bbox_top")
    lines = table(spark, d, "text_line")
    kind = F.when(height > 11, "heading").when(height <= 8.5, "page_header").otherwise("text")
    return lines.select(F.col("document_version_id").alias("document"), (F.col("page_no") * 1000 + F.col("line_no")).alias("unit_no"), "text", "page_no", kind.alias("kind")).distinct()


@query("""with e as (select n_regionkey as g, n_nationkey as s, lead(n_nationkey) over (partition by n_regionkey order by n_nationkey) as t from nation),
a as (select e.g, e.s, '-> ' || n.n_name || case when e.s % 2 = 0 then ' [Yes]' else '' end as arrow from e join nation n on n.n_nationkey = e.t)
select n_regionkey as graph_id, string_agg(n_name || coalesce(' ' || arrow, ''), chr(10) order by n_nationkey) as text from nation left join a on s = n_nationkey group by 1""")
def chk21_flow_paths(spark: SparkSession, d: str) -> DataFrame:
    """A chain of the nations of each region."""
    from pyspark.sql import Window

    n = table(spark, d, "nation")
    nodes = n.select(F.col("n_regionkey").alias("graph_id"), F.col("n_nationkey").alias("node_id"), F.col("n_name").alias("label"))
    following = F.lead("node_id").over(Window.partitionBy("graph_id").orderBy("node_id"))
    edges = nodes.select("graph_id", F.col("node_id").alias("source"), following.alias("target")).where("target is not null")
    return C.flow_paths(nodes, edges.withColumn("edge_label", F.when(F.col("source") % 2 == 0, "Yes")))


@query(f"""with u as ({_UNITS}) select document, unit_no, coalesce(sum(len(text) + 2) over (partition by document order by unit_no rows between unbounded preceding and 1 preceding), 0)::bigint as char_start from u""")
def chk22_assembled(spark: SparkSession, d: str) -> DataFrame:
    return C.assembled(_units(spark, d)).select("document", "unit_no", F.col("char_start").cast("bigint").alias("char_start"))


@query(f"""with u as ({_UNITS}), p as (select *, coalesce(sum(len(text) + 2) over (partition by document order by unit_no rows between unbounded preceding and 1 preceding), 0)::bigint as s from u)
select document, page_no, min(s) as char_start, max(s + len(text)) as char_end, count(*) as n_units from p group by all""")
def chk22_page_runs(spark: SparkSession, d: str) -> DataFrame:
    return C.page_runs(C.assembled(_units(spark, d))).withColumns({c: F.col(c).cast("bigint") for c in ("char_start", "char_end")})


@query("""with a as (select o_custkey as table_id, o_orderkey as row, 0 as col, case when o_orderkey % 5 = 0 then '' else o_orderstatus || o_orderkey end as text from orders where o_orderkey % 7 <> 0),
b as (select o_custkey as table_id, o_orderkey as row, 0 as col, case when o_orderkey % 4 = 0 then 'X' || o_orderkey else o_orderstatus || (o_orderkey + (o_orderkey % 3 = 0)::int) end as text from orders where o_orderkey % 11 <> 0)
select coalesce(a.table_id, b.table_id) as table_id, coalesce(a.row, b.row) as row, 0 as col, case when coalesce(a.text, '') = '' then b.text else a.text end as text,
 case when a.text is not distinct from b.text then 'agreed' when coalesce(a.text, '') = '' then 'second_only' else 'first_only' end as state,
 regexp_replace(coalesce(a.text, ''), '\\D', '', 'g') <> regexp_replace(coalesce(b.text, ''), '\\D', '', 'g') as numeric
from a full join b on a.table_id = b.table_id and a.row = b.row""")
def chk23_merged_cells(spark: SparkSession, d: str) -> DataFrame:
    """Two readings of a cell made of each order."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    base = [F.col("o_custkey").alias("table_id"), k.alias("row"), F.lit(0).alias("col")]
    first = F.when(k % 5 == 0, "").otherwise(F.concat("o_orderstatus", k))
    second = F.when(k % 4 == 0, F.concat(F.lit("X"), k)).otherwise(F.concat("o_orderstatus", k + (k % 3 == 0).cast("int")))
    return C.merged_cells(o.where(k % 7 != 0).select(*base, first.alias("text")), o.where(k % 11 != 0).select(*base, second.alias("text")))


@query()
def txt18_apply_corrections(spark: SparkSession, d: str) -> DataFrame:
    """Two corrections on every chunk: one of all places of a word, one that must fit once."""
    at = chunks(spark, d).select(F.col("chunk_id").alias("doc_id"), "text")
    fixes = spark.createDataFrame([("a", "newborn", "infant", True), ("b", "serum level of", "serum value of", False)], "correction_id string, original string, corrected string, every boolean")
    return C.apply_corrections(at, against_all(fixes, at.select("doc_id")))


def _versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Chunks of superseded versions and of the versions that supersede them, under the newer version's id."""
    links = table(spark, d, "document_version").where("supersedes_id is not null").select("document_version_id", "supersedes_id").distinct()
    at = chunks(spark, d).select("document_version_id", "chunk_id", "ordinal", "text")
    new = links.join(at, "document_version_id").select(F.col("document_version_id").alias("document"), "chunk_id", "ordinal", "text")
    old = links.join(at.withColumnRenamed("document_version_id", "supersedes_id"), "supersedes_id").select(F.col("document_version_id").alias("document"), "chunk_id", "ordinal", "text")
    return old, new


_WORDS = sql_words("text", GROUNDING_STOPWORDS)
_LINEAGE = f"""{_CHUNKS}, v as (select distinct document_version_id as document, supersedes_id from document_version where supersedes_id is not null),
old as (select document, chunk_id as old_id, text, {_WORDS} as w, trim(regexp_replace(text, '\\s+', ' ', 'g')) as tight from v join c on c.document_version_id = v.supersedes_id),
new as (select document, chunk_id as new_id, ordinal, text, {_WORDS} as w, trim(regexp_replace(text, '\\s+', ' ', 'g')) as tight from v join c on c.document_version_id = v.document),
firsts as (select document, tight, arg_min(new_id, struct_pack(o := ordinal, i := new_id)) as new_id from new group by all),
exact as (select old_id, firsts.new_id, 1.0 as score from old join firsts using (document, tight)),
p as (select old_id, new_id, ordinal, len(o.w) as no, len(n.w) as nn, len(list_intersect(o.w, n.w)) as k from old o join new n using (document) where old_id not in (select old_id from exact) and len(o.w) > 0),
s as (select *, k / no as score, k / (no + nn - k) as j, k / nn as reverse, row_number() over (partition by old_id order by k / no desc, k / (no + nn - k) desc, ordinal, new_id) as place, max(k / no) over (partition by old_id) as top from p where k > 0),
links as (select * from exact union all select old_id, new_id, round(score, 4) from s where top >= 0.3 and (place = 1 or (no >= 8 and score >= 0.2 and reverse >= 0.6)))"""


def _links(spark: SparkSession, d: str) -> DataFrame:
    old, new = _versions(spark, d)
    return C.lineage(old, new, content_words(F.col("text")))


@query(f"with {_LINEAGE} select * from links")
def joi9_lineage(spark: SparkSession, d: str) -> DataFrame:
    return _links(spark, d)


@query(f"""with {_LINEAGE}, g as (select document_version_id as query_id, unnest(list(chunk_id)) as chunk_id from c group by 1),
m as (select query_id, coalesce(l.new_id, case when o.old_id is null then g.chunk_id end) as now from g left join links l on l.old_id = g.chunk_id left join (select distinct old_id from old) o on o.old_id = g.chunk_id)
select query_id, coalesce(list_aggregate(list_sort(list_distinct(list(now) filter (where now is not null))), 'string_agg', ','), '') as gold from m group by 1""")
def joi10_remap_gold(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of each version taken as a gold set."""
    gold = chunks(spark, d).groupBy(F.col("document_version_id").alias("query_id")).agg(F.collect_list("chunk_id").alias("gold"))
    old, _ = _versions(spark, d)
    return C.remapped(gold, _links(spark, d), old.select("chunk_id")).select("query_id", F.array_join("gold", ",").alias("gold"))
