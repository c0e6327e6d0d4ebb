"""Queries of whole documents: chunked texts and layouts, rendered tables, page furniture, levels of headings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.lines import valid_patterns
from marlstone.operators import chunking as C
from marlstone.operators import documents as D
from marlstone.plans.chunking_queries import _COUNT, _HEADS
from marlstone.session import small_rows
from marlstone.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: Words of a window in these queries: small enough that sections of the test tables have several.
MOST = 60


def query(sql: str | None = None):  # noqa: ANN201
    def register(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _clause(text: str, profile: str) -> str:
    return f"case when regexp_matches({text}, '{C.NUMBERED}') then case when {profile} = 'grade_recommendations' and regexp_matches({text}, '{C.GRADE}') then 'recommendation' when {profile} = 'clinical_protocol' then 'protocol_step' end end"


#: para (id, sec, k from 1, t, kind, st, en) to units in windows; the fold is a recursive walk over a section's paragraphs.
_WINDOWED = f"""sized as (select *, {_COUNT.format('t')} as w from para),
walk as (select id, sec, k, kind, w as run, 0 as unit, false as follows from sized where k = 1
 union all select s.id, s.sec, s.k, s.kind, case when s.kind = 'prose' and p.kind = 'prose' and p.run + s.w <= {MOST} then p.run + s.w else s.w end,
  case when s.kind = 'prose' and p.kind = 'prose' and p.run + s.w <= {MOST} then p.unit else p.unit + 1 end,
  case when s.kind = 'prose' and p.kind = 'prose' then case when p.run + s.w <= {MOST} then p.follows else true end else false end
 from walk p join sized s on s.id = p.id and s.sec = p.sec and s.k = p.k + 1),
units as (select id, sec, unit, any_value(walk.kind) as kind, bool_or(follows) as follows, string_agg(t, chr(10) || chr(10) order by k) as body, min(st) as st, max(en) as en
  from walk join para using (id, sec, k) group by all),
tails as (select *, list_filter(regexp_split_to_array(lag(body) over (partition by id, sec order by unit), '\\s+'), lambda x: x <> '') as before from units),
texts as (select *, case when follows then array_to_string(list_slice(before, len(before) - greatest(1, cast(round_even(0.15 * len(before), 0) as int)) + 1, len(before)), ' ') end as tail from tails),
placed as (select *, (row_number() over (partition by id order by sec, unit) - 1)::int as ordinal, concat_ws(chr(10) || chr(10), tail, body) as text,
  case when follows then greatest(0, st - len(tail) - 2) else st end::int as char_start, en::int as char_end from texts),
chunks as (select *, case when min(ordinal) over (partition by id, sec) <> ordinal then min(ordinal) over (partition by id, sec) end as parent_ordinal from placed)"""


@query(f"""with recursive {_HEADS},
anc as (select h.doc_id, h.section_no, a.section_no as s, a.heading from hd h join hd a on a.doc_id = h.doc_id and (a.section_no = h.section_no or (a.section_no < h.section_no and a.depth <
   (select min(b.depth) from hd b where b.doc_id = h.doc_id and b.section_no > a.section_no and b.section_no <= h.section_no)))),
p as (select doc_id, section_no, string_agg(heading, ' › ' order by s) as path from anc group by all),
secs as (select doc_id, section_no, path, char_start as s, coalesce(lead(char_start) over (partition by doc_id order by section_no), n) as e, true as headed from hd join p using (doc_id, section_no)
 union all select doc_id, 0, null, 0, len(text), false from documents where text is not null and doc_id not in (select doc_id from hd)),
ln as (select o.doc_id as id, section_no as sec, path, regexp_replace(line, '^\\s+|\\s+$', '', 'g') as t, (o.start + len(line) - len(regexp_replace(line, '^\\s+', '')))::int as st, o.i,
  case o.doc_id % 3 when 0 then 'grade_recommendations' when 1 then 'clinical_protocol' else 'narrative' end as profile
  from secs join o on o.doc_id = secs.doc_id and o.start >= s and o.start < e and not (headed and o.start = s)),
para as (select id, sec, path, t, st, st + len(t) as en, coalesce({_clause('t', 'profile')}, 'prose') as kind, row_number() over (partition by id, sec order by i) as k from ln where t <> ''),
{_WINDOWED}
select chunks.id as document, ordinal, path as section_path, kind as chunk_type, char_start, char_end, {_COUNT.format('text')}::int as token_count, parent_ordinal, sha256(concat_ws(chr(10) || chr(10), path, text)) as digest,
 (char_start // 3000 + 1)::int as page_start, (greatest(char_end - 1, char_start) // 3000 + 1)::int as page_end from chunks left join (select distinct doc_id as id, section_no as sec, path from secs) using (id, sec)""")
def chk12_chunk_document(spark: SparkSession, d: str) -> DataFrame:
    """Documents from text to chunks: sections, clauses by the document's profile, windows of lines, parents, pages."""
    k = F.col("doc_id")
    profile = F.when(k % 3 == 0, "grade_recommendations").when(k % 3 == 1, "clinical_protocol").otherwise("narrative")
    out = D.chunked(table(spark, d, "documents"), "doc_id", "text", profile, most=MOST, split="\n")
    return out.select("document", "ordinal", "section_path", "chunk_type", "char_start", "char_end", "token_count", "parent_ordinal", F.sha2("embedding_text", 256).alias("digest"), "page_start", "page_end")


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    """Printed lines as blocks: high ones are headings, places are those of the text that joins a version's lines."""
    profiles = table(spark, d, "document_version").groupBy(F.col("document_version_id").alias("document")).agg(F.max("format_profile").alias("profile"))
    height = F.col("bbox_bottom") - F.col("bbox_top")
    lines = table(spark, d, "text_line").distinct().where("text is not null").select(
        F.col("document_version_id").alias("document"), (F.col("page_no") * 100000 + F.col("line_no")).alias("unit_no"), "text", "page_no",
        F.when(height > 11, "heading").otherwise("text").alias("kind"), F.lit(1).alias("level"), F.when(F.col("from_ocr"), "ocr").otherwise("text_layer").alias("origin"), "confidence",
    )
    return C.assembled(lines).withColumnRenamed("unit_no", "block_no").join(profiles, "document", "left")


@query(f"""with recursive v as (select document_version_id as id, max(format_profile) as profile from document_version group by 1),
l as (select document_version_id as id, page_no * 100000 + line_no as u, text, page_no, bbox_bottom - bbox_top > 11 as head, case when from_ocr then 'ocr' else 'text_layer' end as origin, confidence from (select distinct * from text_line) where text is not null),
b as (select *, coalesce(sum(len(text) + 2) over (partition by id order by u rows between unbounded preceding and 1 preceding), 0)::int as st, sum(head::int) over (partition by id order by u) as sec from l),
para as (select id, sec, text as t, st, st + len(text) as en, coalesce({_clause('text', 'profile')}, 'prose') as kind, row_number() over (partition by id, sec order by u) as k from b left join v using (id) where not head and trim(text) <> ''),
{_WINDOWED},
met as (select chunks.id, ordinal, min(page_no) as page_start, max(page_no) as page_end, list_aggregate(list_sort(list_distinct(list(origin))), 'string_agg', ',') as origins, min(case when origin = 'ocr' then confidence end) as min_confidence,
  bool_or(origin = 'ocr' and regexp_matches(b.text, '[0-9]')) as has_digits from chunks join b on b.id = chunks.id and b.sec = chunks.sec and not head and b.st < char_end and char_start < b.st + len(b.text) group by all)
select chunks.id as document, ordinal, h.text as section_path, kind as chunk_type, char_start, char_end, parent_ordinal, sha256(chunks.text) as digest, page_start, page_end, origins, min_confidence, case when has_digits then 'pending' end as review_status
from chunks left join met using (id, ordinal) left join (select id, sec, text from b where head) h on h.id = chunks.id and h.sec = chunks.sec""")
def chk11_layout_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Versions from printed lines to chunks, with the provenance of the lines that each chunk covers."""
    out = D.chunked_blocks(_blocks(spark, d), most=MOST)
    return out.select("document", "ordinal", "section_path", "chunk_type", "char_start", "char_end", "parent_ordinal", F.sha2("text", 256).alias("digest"), "page_start", "page_end", F.array_join("origins", ",").alias("origins"), "min_confidence", "review_status")


def _cells(spark: SparkSession, d: str) -> DataFrame:
    """A table per order: a title over all columns, a row of headings of which one spans two, a row per line."""
    li = table(spark, d, "lineitem")
    heads = li.select(F.col("l_orderkey").alias("table_id")).distinct()

    def cell(row, col, rs: int, cs: int, text, header: bool):  # noqa: ANN001, ANN202
        at = [F.lit(v).cast("int").alias(n) for v, n in ((col, "col"), (rs, "row_span"), (cs, "col_span"))]
        return F.struct(row.cast("int").alias("row"), *at, text.alias("text"), F.lit(header).alias("is_header"))

    top = F.array(
        cell(F.lit(0), 0, 1, 4, F.concat(F.lit("Order | "), "table_id"), True), cell(F.lit(1), 0, 2, 1, F.lit("Line"), True), cell(F.lit(1), 1, 1, 2, F.lit("Price"), True),
        cell(F.lit(1), 3, 2, 1, F.lit("Flag"), True), cell(F.lit(2), 1, 1, 1, F.lit("full"), True), cell(F.lit(2), 2, 1, 1, F.lit("less  tax"), True),
    )
    r = F.col("l_linenumber") + 2
    row = F.array(
        cell(r, 0, 1, 1, F.col("l_linenumber").cast("string"), False), cell(r, 1, 1, 1, F.concat(F.lit("p"), F.col("l_partkey")), False),
        cell(r, 2, 1, 1, F.when(F.col("l_suppkey") % 3 == 0, "").otherwise(F.concat(F.lit("s"), "l_suppkey")), False), cell(r, 3, 1, 1, F.col("l_returnflag"), False),
    )
    one = li.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_returnflag")).alias("v")).select("l_orderkey", "l_linenumber", "v.*")
    return heads.select("table_id", F.inline(top)).unionByName(one.select(F.col("l_orderkey").alias("table_id"), F.inline(row)))


@query("""with recursive o as (select l_orderkey as id, l_linenumber as n, min({'p': l_partkey, 's': l_suppkey, 'f': l_returnflag}) as v from lineitem group by all),
b as (select id, 'Line: ' || n || chr(10) || '  Price · full: p' || v.p || case when v.s % 3 = 0 then '' else chr(10) || '  Price · less tax: s' || v.s end || chr(10) || '  Flag: ' || v.f as t, 2 + 4 + case when v.s % 3 = 0 then 0 else 5 end + 2 as w, row_number() over (partition by id order by n) as k from o),
whole as (select id, sum(w) <= 21 or count(*) < 2 as whole from b group by 1),
g as (select id, k, w as run, 0 as part from b where k = 1 union all select b.id, b.k, case when not whole and g.run + b.w > 21 then b.w else g.run + b.w end, case when not whole and g.run + b.w > 21 then part + 1 else part end from g join b on b.id = g.id and b.k = g.k + 1 join whole on whole.id = b.id)
select id as table_id, part as part_no, 'Order / ' || id || chr(10) || chr(10) || string_agg(t, chr(10) || chr(10) order by k) as text from g join b using (id, k) group by id, part""")
def chk15_table_parts(spark: SparkSession, d: str) -> DataFrame:
    """Tables of 24 words a part, of which the title takes three."""
    return C.rendered_tables(_cells(spark, d), 24)


def _lines(spark: SparkSession, d: str) -> DataFrame:
    height = F.col("bbox_bottom") - F.col("bbox_top")
    return table(spark, d, "text_line").distinct().select(
        F.col("document_version_id").alias("document"), "source", "page_no", "line_id", "line_no", "text", F.col("bbox_top").alias("top"), F.col("bbox_bottom").alias("bottom"),
        (height > 8.5).alias("is_heading"), height.alias("height"),
    )


_MASK = "trim(regexp_replace(regexp_replace(lower(text), '\\d', '#', 'g'), '\\s+', ' ', 'g'))"


@query(f"""with t as (select distinct * from text_line), o as (select source, any_value(margin_zone) as z, any_value(repeat_ratio) as r, any_value(boilerplate_min_pages) as n, flatten(list(coalesce(boilerplate_patterns, []))) as ps from assembly_options group by 1),
m as (select t.document_version_id as document, page_no, line_id, bbox_top as top, bbox_bottom - bbox_top > 8.5 as head, t.text, {_MASK} as masked, coalesce(r, 0.5) as r, coalesce(n, 3) as n, coalesce(ps, []) as ps from t left join o using (source)
  where bbox_bottom <= 842 * coalesce(z, 0.08) or bbox_top >= 842 * (1 - coalesce(z, 0.08))),
mm as (select * from m where masked <> ''), p as (select document_version_id as document, count(distinct page_no) as n_pages from t group by 1), s as (select document, masked, count(distinct page_no) as on_pages from mm group by all),
a as (select document, masked, list_sort(list(top))[len(list(top)) // 2 + 1] as anchor from mm where head group by all),
run as (select document, masked, count(distinct page_no) as aligned from mm join a using (document, masked) where head and abs(top - anchor) <= 2 group by all),
j as (select mm.*, n_pages, on_pages, anchor, aligned from mm join s using (document, masked) join p using (document) left join a using (document, masked) left join run using (document, masked)),
k as (select *, case when head and abs(top - anchor) <= 2 and aligned >= n then 'running_header' when not head and n_pages >= n and on_pages / n_pages >= r then 'repeated'
  when not head and regexp_matches(masked, '{C.PAGE_NUMBER}') then 'page_number' when not head and len(list_filter(ps, lambda x: regexp_matches(text, '(?i)' || x))) > 0 then 'pattern' end as reason from j)
select document, page_no, line_id, masked, reason from k where reason is not null and not regexp_matches(text, '{C.LINE_DOSE}')""")
def chk16_margin_boilerplate(spark: SparkSession, d: str) -> DataFrame:
    """Page furniture by the options and patterns of each source; lines above 8.5 points high stand for headings."""
    options = table(spark, d, "assembly_options").withColumnRenamed("boilerplate_min_pages", "min_pages")
    patterns = valid_patterns(spark, ((r.source, r.boilerplate_patterns) for r in small_rows(options.select("source", "boilerplate_patterns"), 10_000)))
    return C.margin_boilerplate(_lines(spark, d), options, patterns)


@query("""with t as (select distinct * from text_line where text is not null),
e as (select document_version_id as document, (page_no * 100000 + line_no)::bigint as element_no, text, bbox_bottom - bbox_top as size, case when bbox_bottom - bbox_top > 11 then 'heading' else 'text' end as kind from t),
n as (select *, case when kind = 'heading' then nullif(regexp_extract(trim(text), '(?s)^(\\d+(?:\\.\\d+){0,4})\\.?\\s+\\S.*$', 1), '') end as number, lead(case when kind = 'text' then text end) over w as nt from e window w as (partition by document order by element_no)),
d as (select *, len(number) - len(replace(number, '.', '')) + 1 as depth, kind = 'heading' and number is null and trim(text) <> '' and not regexp_matches(rtrim(text), '[.:?!)]$') and coalesce(regexp_matches(nt, '^\\p{Ll}'), false) as joins from n),
u as (select document, quantile_cont(size, 0.5) as usual from e where kind = 'text' group by 1),
l as (select d.*, usual, kind = 'heading' and number is null and not joins and coalesce(size < usual - 0.25, false) as small, coalesce(depth, coalesce(last_value(depth ignore nulls) over (partition by document order by element_no rows between unbounded preceding and current row), 0) + 1) as lev,
  lag(case when joins then rtrim(text) end) over (partition by document order by element_no) as led from d left join u using (document)),
f as (select document, element_no, case when small then 'text' else kind end as kind, case when led is not null then led || ' ' || text else text end as text, size, lev from l where not joins),
r as (select document, round(size, 3) as size, count(*) as k from f where kind = 'heading' group by all), tiers as (select document, list(size) as ts from r where k >= 2 group by 1 having count(*) >= 2)
select f.document, element_no, kind, sha256(text) as digest, case when kind = 'heading' then coalesce(1 + len(list_filter(ts, lambda x: x > f.size + 0.25)), lev) end::int as level from f left join tiers on tiers.document = f.document""")
def chk18_heading_levels(spark: SparkSession, d: str) -> DataFrame:
    """Levels of the headings of printed lines; a line's height stands for its size."""
    at = _lines(spark, d).where("text is not null").select(
        "document", (F.col("page_no") * 100000 + F.col("line_no")).cast("bigint").alias("element_no"), "text", F.col("height").alias("font_size"), F.lit(False).alias("is_bold"),
        F.when(F.col("height") > 11, "heading").otherwise("text").alias("kind"),
    )
    out = C.heading_levels(at)
    return out.select("document", "element_no", "kind", F.sha2("text", 256).alias("digest"), "level")
