"""Queries of the scalar text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import text as X
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


def _list(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def sql_tokens(text: str) -> str:
    return (
        f"list_filter(regexp_extract_all(lower({text}), '{X.TOKEN}'), "
        f"lambda t: t not in {_list(X.STOPWORDS)} and (len(t) > 1 or regexp_full_match(t, '[0-9]')))"
    )


def sql_words(text: str, stop: list[str]) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({text}), '[a-z0-9]+'), lambda w: len(w) >= 3 and w not in {_list(stop)}))"


@query(f"select doc_id, len({sql_tokens('text')}) as n_tokens, list_aggregate({sql_tokens('text')}, 'string_agg', ' ') as tokens from documents where text is not null and text <> ''")
def txt1_analyze(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text <> ''").withColumn("t", X.analyze(F.col("text")))
    joined = F.when(F.size("t") > 0, F.array_join("t", " "))
    return docs.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), joined.alias("tokens"))


@query(f"select doc_id, term, count(*) as tf from (select doc_id, unnest({sql_tokens('text')}) as term from documents) group by all")
def txt2_term_frequency(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.explode(X.analyze(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


@query(f"select distinct question_id, list_aggregate(list_sort(list_distinct({sql_tokens('text')})), 'string_agg', ' ') as terms from eval_question where text is not null")
def txt2_query_terms(spark: SparkSession, d: str) -> DataFrame:
    terms = X.query_terms(F.col("text"))
    joined = F.when(F.size(terms) > 0, F.array_join(terms, " "))
    return table(spark, d, "eval_question").where("text is not null").select("question_id", joined.alias("terms")).distinct()


@query("select doc_id, cast(('0x' || substr(md5(term), 1, 6)) as bigint) as slot, count(*) as n from (select doc_id, unnest(" + sql_tokens("text") + ") as term from documents) group by all")
def txt3_term_slot(spark: SparkSession, d: str) -> DataFrame:
    """Terms on 2 ** 24 slots by a hash that both engines have."""
    docs = table(spark, d, "documents").select("doc_id", F.explode(X.analyze(F.col("text"))).alias("term"))
    slot = F.conv(F.substring(F.md5("term"), 1, 6), 16, 10).cast("bigint")
    return docs.groupBy("doc_id", slot.alias("slot")).agg(F.count("*").alias("n"))


def _sql_expand(text: str) -> str:
    for short, full in X.ABBREVIATIONS.items():
        text = f"regexp_replace({text}, '(?i)\\b({short})\\b', '\\1 ({full})', 'g')"
    return text


@query(f"select doc_id, sha256({_sql_expand('text')}) as digest, len({_sql_expand('text')}) as n from documents where text is not null")
def txt4_expand_abbreviations(spark: SparkSession, d: str) -> DataFrame:
    out = X.expand_abbreviations(F.col("text"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2(out, 256).alias("digest"), F.length(out).cast("bigint").alias("n"))


@query(f"""select doc_id, len({sql_words('text', X.GROUNDING_STOPWORDS)}) as grounding, len({sql_words('text', X.TOPIC_STOPWORDS)}) as topic,
 len({sql_words('text', X.STOPWORDS)}) as lineage from documents where text is not null""")
def txt5_content_words(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    sizes = [("grounding", X.GROUNDING_STOPWORDS), ("topic", X.TOPIC_STOPWORDS), ("lineage", X.STOPWORDS)]
    return table(spark, d, "documents").where("text is not null").select(
        "doc_id", *[F.size(X.content_words(t, stop)).cast("bigint").alias(name) for name, stop in sizes]
    )


# Topic tags tried on every text; any list serves.
TAGS = ["oxygen therapy in newborns", "seizure control", "kangaroo care", "fluid management and feeding", "infection surveillance", "discharge planning"]
_TAG_ROWS = ", ".join(f"('{t}')" for t in TAGS)


@query(f"""with tags as (select t as tag, {sql_words('t', X.TOPIC_STOPWORDS)} as w from (values {_TAG_ROWS}) v(t)),
d as (select doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) as w from documents where text is not null)
select doc_id, tag from d, tags where len(list_intersect(tags.w, d.w)) >= greatest(1, cast(round_even(len(tags.w) * 0.5, 0) as int))""")
def txt6_topic_tags(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), 0))
    found = F.filter(X.strings(*TAGS), lambda tag: X.topic_applies(tag, words))
    return docs.select("doc_id", F.explode(found).alias("tag"))


_TIGHT = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"


@query(f"""with q as (select distinct chunk_id, document_version_id, regexp_extract({_TIGHT.format('text')}, '^(?:\\S+ ){{3}}(\\S+(?: \\S+){{4}})', 1) as quote, text from chunk where text is not null)
select chunk_id, quote <> '' and contains({_TIGHT.format('text')}, {_TIGHT.format('quote')}) as own, contains({_TIGHT.format('text')}, 'serum level of') as phrase from q""")
def txt7_verbatim(spark: SparkSession, d: str) -> DataFrame:
    tight = X.one_blank(F.col("text"))
    chunks = table(spark, d, "chunk").where("text is not null").select("chunk_id", "document_version_id", "text").distinct()
    quote = F.regexp_extract(tight, r"^(?:\S+ ){3}(\S+(?: \S+){4})", 1)
    return chunks.select(
        "chunk_id", X.contains_verbatim(quote, F.col("text")).alias("own"), X.contains_verbatim(F.lit("serum  level of"), F.col("text")).alias("phrase")
    )


@query("""select chunk_id, greatest(1, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))) as words, cast(ceil(len(text) / 3.2) as bigint) as by_chars
from (select distinct chunk_id, text from chunk where text is not null)""")
def txt8_token_counts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    chunks = table(spark, d, "chunk").where("text is not null").select("chunk_id", "text").distinct()
    return chunks.select("chunk_id", X.approx_tokens(t).cast("bigint").alias("words"), X.char_tokens(t).cast("bigint").alias("by_chars"))


@query("""select chunk_id, len(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) as n_sentences,
len(list_filter(regexp_split_to_array(text, '\\n\\s*\\n'), lambda p: trim(p) <> '')) as n_paragraphs from (select distinct chunk_id, text from chunk where text is not null)""")
def txt9_sentences(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunk").where("text is not null").select("chunk_id", "text").distinct()
    paragraphs = F.filter(F.split("text", r"\n\s*\n"), lambda p: F.trim(p) != "")
    return chunks.select("chunk_id", F.size(X.sentences(F.col("text"))).cast("bigint").alias("n_sentences"), F.size(paragraphs).cast("bigint").alias("n_paragraphs"))


_SENT = "string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"


@query(f"""with c as (select distinct chunk_id, text from chunk where text is not null), s as (select chunk_id, {_SENT}[1] as claim, text from c),
w as (select chunk_id, {sql_words('claim', X.GROUNDING_STOPWORDS)} as a, {sql_words('substr(text, len(text) // 2)', X.GROUNDING_STOPWORDS)} as b from s)
select chunk_id, round(case when len(a) = 0 then 0.0 else len(list_intersect(a, b)) / len(a) end, 6) as overlap from w""")
def txt10_overlap(spark: SparkSession, d: str) -> DataFrame:
    """The first sentence of each chunk against the chunk's second half."""
    chunks = table(spark, d, "chunk").where("text is not null").select("chunk_id", "text").distinct()
    half = F.substring(F.col("text"), F.greatest(F.lit(0), F.floor(F.length("text") / 2).cast("int")), F.length("text"))
    return chunks.select("chunk_id", F.round(X.overlap(F.element_at(X.sentences(F.col("text")), 1), half), 6).alias("overlap"))


_DIRECTIVE_SQL = " or ".join(f"regexp_matches(text, '(?i){p}')" for p in X.DIRECTIVES)
_SQUASH = "lower(regexp_replace({0}, '[\\s\\x0b\\x{{a0}}\\x{{2009}}\\x{{202f}}]+', '', 'g'))"


@query(f"""with c as (select distinct chunk_id, document_version_id, ordinal, text from chunk where text is not null),
q as (select *, lag(text) over (partition by document_version_id order by ordinal, chunk_id) as quote from c),
p as (select chunk_id, text, list_distinct(list_transform(regexp_extract_all(text, '{X.DOSE}'), lambda x: {_SQUASH.format('x')})) as doses, {_SQUASH.format("coalesce(quote, '')")} as source from q)
select chunk_id, {_DIRECTIVE_SQL} as directive, len(doses) as n_doses, len(list_filter(doses, lambda x: not contains(source, x))) > 0 as beyond from p""")
def txt11_directives_and_doses(spark: SparkSession, d: str) -> DataFrame:
    """Doses of every text against the whole text before it in its version, taken as the quote."""
    chunks = table(spark, d, "chunk").where("text is not null").select("chunk_id", "document_version_id", "ordinal", "text").distinct()
    t, quote = F.col("text"), F.coalesce(F.lag("text").over(Window.partitionBy("document_version_id").orderBy("ordinal", "chunk_id")), F.lit(""))
    return chunks.withColumn("quote", quote).select(
        "chunk_id", X.is_directive(t).alias("directive"), F.size(X.doses(t)).cast("bigint").alias("n_doses"), X.dose_beyond(t, F.array("quote")).alias("beyond")
    )


def _version_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of one document and place in different versions, two texts a row."""
    versions = table(spark, d, "document_version").select("document_version_id", "document_id").distinct()
    chunks = table(spark, d, "chunk").where("text is not null").select("chunk_id", "document_version_id", "ordinal", "text").distinct()
    at = chunks.join(versions, "document_version_id")
    b = at.select("document_id", "ordinal", *[F.col(c).alias(f"{c}_b") for c in ("chunk_id", "document_version_id", "text")])
    return at.join(b, ["document_id", "ordinal"]).where("document_version_id < document_version_id_b")


@query()
def txt12_materially_different(spark: SparkSession, d: str) -> DataFrame:
    pairs = _version_pairs(spark, d)
    return pairs.select("chunk_id", "chunk_id_b", X.materially_different(F.col("text"), F.col("text_b")).alias("different"))


_PAIRS_SQL = """with v as (select distinct document_version_id, document_id from document_version),
c as (select distinct chunk_id, document_version_id, ordinal, text from chunk where text is not null),
placed as (select * from c join v using (document_version_id)),
pairs as (select a.chunk_id, b.chunk_id as chunk_id_b, a.text, b.text as text_b from placed a join placed b
  on a.document_id = b.document_id and a.ordinal = b.ordinal and a.document_version_id < b.document_version_id)
"""


@query(_PAIRS_SQL + f"""select chunk_id, chunk_id_b, len(list_intersect({sql_tokens('text')}, {sql_tokens('text_b')})) >= 3
 and regexp_matches(text, '{X.NEGATION}') <> regexp_matches(text_b, '{X.NEGATION}') as contradicts from pairs""")
def txt13_contradicts(spark: SparkSession, d: str) -> DataFrame:
    pairs = _version_pairs(spark, d)
    return pairs.select("chunk_id", "chunk_id_b", X.contradicts(F.col("text"), F.col("text_b")).alias("contradicts"))


_NUMS = "regexp_extract_all({0}, '\\d+(?:[.,]\\d+)*')"
_MORE = "list_sort(flatten(list_transform(list_distinct({0}), lambda x: list_transform(range(greatest(len(list_filter({0}, lambda y: y = x)) - len(list_filter({1}, lambda y: y = x)), 0)), lambda i: x))))"


@query(_PAIRS_SQL + f""", n as (select chunk_id, chunk_id_b, {_NUMS.format('text')} as a, {_NUMS.format('text_b')} as b from pairs), m as (select *, {_MORE.format('a', 'b')} as l, {_MORE.format('b', 'a')} as r from n)
select chunk_id, chunk_id_b, (len(l) + len(r))::int as numeric_disagreements, array_to_string(l, ' ') as first_only, array_to_string(r, ' ') as second_only from m""")
def chk23_compared_prose(spark: SparkSession, d: str) -> DataFrame:
    """The numbers that one version of a text has and another lacks."""
    from marlstone.operators.chunking import compared_prose

    both = _version_pairs(spark, d).withColumn("c", compared_prose(F.col("text"), F.col("text_b")))
    joined = [F.array_join(f"c.{name}", " ").alias(name) for name in ("first_only", "second_only")]
    return both.select("chunk_id", "chunk_id_b", "c.numeric_disagreements", *joined)


@query("select line_id, trim(regexp_replace(regexp_replace(lower(text), '\\d', '#', 'g'), '\\s+', ' ', 'g')) as masked from (select distinct line_id, text from text_line)")
def txt14_mask_digits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "text_line").select("line_id", X.mask_digits(F.col("text")).alias("masked")).distinct()


# Marker rules tried on the questions; any list of labels and markers serves.
MARKERS = [("feeding", ["feed", "breast"]), ("breathing", ["respiratory", "oxygen", "breath"]), ("infection", ["infection", "sepsis", "culture"])]
_MARKER_SQL = " ".join(f"when {' or '.join(f'contains(lower(text), {m!r})' for m in markers)} then '{label}'" for label, markers in MARKERS)


@query(f"select distinct question_id, case {_MARKER_SQL} else 'other' end as label from eval_question where text is not null")
def txt15_first_marker(spark: SparkSession, d: str) -> DataFrame:
    questions = table(spark, d, "eval_question").where("text is not null")
    return questions.select("question_id", X.first_marker(F.col("text"), MARKERS, "other").alias("label")).distinct()


@query("""select doc_id, len(regexp_extract_all(text, '\\d+(?:[.,]\\d+)*')) as n_numbers, len(regexp_extract_all(text, '[A-Za-z]+')) as n_words,
len(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z]+'), lambda x: lower(x)))) as n_distinct,
list_aggregate(list_sort(regexp_extract_all(text, '\\d+(?:[.,]\\d+)*')), 'string_agg', ' ') as numbers from documents where text is not null""")
def txt16_multisets(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    numbers, words = X.numbers_of(t), X.words_of(t)
    return table(spark, d, "documents").where("text is not null").select(
        "doc_id", F.size(numbers).cast("bigint").alias("n_numbers"), F.size(words).cast("bigint").alias("n_words"),
        F.size(F.array_distinct(words)).cast("bigint").alias("n_distinct"), F.when(F.size(numbers) > 0, F.array_join(numbers, " ")).alias("numbers"),
    )


_REL = "[" + ", ".join(f"'{w}'" for w in X.RELATIONAL) + "]"
_W = "list_distinct(list_transform(regexp_extract_all({0}, '[A-Za-z]+'), lambda x: lower(x)))"
_BARE = "list_sort(regexp_extract_all(regexp_replace({0}, '\\d+(?:[.,]\\d+)*', ' ', 'g'), '[^\\w\\s]'))"
_NUM = "list_sort(regexp_extract_all({0}, '\\d+(?:[.,]\\d+)*'))"
_SHAPE = "translate(regexp_replace({0}, '\\s+', '', 'g'), '1l|0', 'IIIO')"
_FIX = "replace(replace(text, ' below ', ' less than '), 'infant', 'newborn')"
_EDIT = "replace(text, ' below ', ' under ')"


def _scoped(rows: DataFrame) -> DataFrame:
    t = F.col("text")
    lines = rows.select("line_id", "text").distinct()
    fixed = F.replace(F.replace(t, F.lit(" below "), F.lit(" less than ")), F.lit("infant"), F.lit("newborn"))
    edited = F.replace(t, F.lit(" below "), F.lit(" under "))
    spoiled = F.replace(t, F.lit("I"), F.lit("l"))
    return lines.select("line_id", X.in_scope(t, fixed).alias("broad"), X.in_scope(t, edited).alias("narrow"), X.ocr_alike(spoiled, t).alias("alike"))


@query(f"""with t as (select distinct line_id, text, {_FIX} as fixed, {_EDIT} as edited, replace(text, 'I', 'l') as spoiled from text_line where text is not null)
select line_id, {_NUM.format('text')} = {_NUM.format('fixed')} and {_BARE.format('text')} = {_BARE.format('fixed')}
  and len(list_filter(list_concat(list_filter({_W.format('text')}, lambda w: not list_contains({_W.format('fixed')}, w)), list_filter({_W.format('fixed')}, lambda w: not list_contains({_W.format('text')}, w))), lambda w: not list_contains({_REL}, w))) = 0 as broad,
 len(list_filter(list_concat(list_filter({_W.format('text')}, lambda w: not list_contains({_W.format('edited')}, w)), list_filter({_W.format('edited')}, lambda w: not list_contains({_W.format('text')}, w))), lambda w: not list_contains({_REL}, w))) = 0 as narrow,
 {_SHAPE.format('spoiled')} = {_SHAPE.format('text')} as alike from t""")
def txt17_correction_scope(spark: SparkSession, d: str) -> DataFrame:
    """Two edits and one spoiled reading of every line, judged as corrections."""
    return _scoped(table(spark, d, "text_line").where("text is not null"))


@query("""select o_orderkey, printf('%.2f', cast(floor(cast(o_totalprice as decimal(20,6)) * 0.001 / 0.25 + 0.5) as decimal(20,6)) * 0.25) as stepped,
cast(cast(round(cast(o_totalprice as decimal(20,6)), 1) as decimal(20,1)) as varchar) || ' USD' as fixed from orders""")
def txt19_render(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("o_totalprice")
    return table(spark, d, "orders").select(
        "o_orderkey", X.render(v, scale=0.001, step=0.25, decimals=2).alias("stepped"), X.render(v, decimals=1, unit="USD").alias("fixed")
    )


_AGED = "'The baby is aged ' || (o_orderkey % 40) || ' days (early, band ' || (o_orderkey % 3) || ').' || chr(10) || 'Weight (kg): ' || (o_orderkey % 5) || '.5, 2.50, 2.5 (now)'"


@query(f"""select o_orderkey, regexp_replace(regexp_replace({_AGED}, '(is aged \\d+ days) \\([^()\\n]*\\)', '\\1', 'g'), '(?m)^(Weight \\(kg\\): [^,\\n]+?)(?:, [^,\\n]+?)+( \\()', '\\1\\2', 'g') as cleaned from orders""")
def txt20_reviewer_text(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.concat(
        F.lit("The baby is aged "), k % 40, F.lit(" days (early, band "), k % 3, F.lit(").\nWeight (kg): "), k % 5, F.lit(".5, 2.50, 2.5 (now)")
    )
    return table(spark, d, "orders").select("o_orderkey", X.reviewer_text(text).alias("cleaned"))


@query(f"""with q as (select distinct question_id, area, case when area is null then text else '{X.TOPIC_PREFIX}' || area || '{X.TOPIC_SUFFIX}' || chr(10) || text end as text from eval_question),
f as (select question_id, string_split(text, chr(10))[1] as l from q)
select distinct question_id, case when starts_with(l, '{X.TOPIC_PREFIX}') and ends_with(l, '{X.TOPIC_SUFFIX}') then nullif(substr(l, {len(X.TOPIC_PREFIX) + 1}, len(l) - {len(X.TOPIC_PREFIX) + len(X.TOPIC_SUFFIX)}), '') end as topic from f""")
def txt21_topic(spark: SparkSession, d: str) -> DataFrame:
    stated = F.concat(F.lit(X.TOPIC_PREFIX), "area", F.lit(X.TOPIC_SUFFIX + "\n"), "text")
    text = F.when(F.col("area").isNull(), F.col("text")).otherwise(stated)
    return table(spark, d, "eval_question").select("question_id", X.topic_of(text).alias("topic")).distinct()


@query("""with a as (select n_regionkey, list_sort(list(n_name)) as l from nation group by 1)
select n_regionkey, case when len(l) = 1 then l[1] else list_aggregate(l[1:-2], 'string_agg', ', ') || ' and ' || l[-1] end as names from a""")
def txt22_natural_list(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("l")).select("n_regionkey", X.join_natural(F.col("l")).alias("names"))


@query("""select o_orderkey, 1 as n, 'status ' || o_orderstatus as first_text, 1 as n_ids from orders where o_orderkey % 3 < 2
union all select o_orderkey, null, null, null from orders where o_orderkey % 3 = 2""")
def txt23_segments(spark: SparkSession, d: str) -> DataFrame:
    """A JSON answer made of each order: bare, in a fence, or broken."""
    body = F.concat(
        F.lit('[{"type":"claim","text":"status '), "o_orderstatus", F.lit('","citation_ids":["c'), "o_orderkey", F.lit('"],"quote":"q"},{"type":"note","text":"x"}]')
    )
    raw = F.when(F.col("o_orderkey") % 3 == 0, body).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(F.lit("no json"))
    out = table(spark, d, "orders").withColumn("s", X.parse_segments(raw))
    known = F.when(F.size("s") > 0, F.size("s").cast("bigint"))
    first = F.get("s", F.lit(0))
    return out.select("o_orderkey", known.alias("n"), first["text"].alias("first_text"), F.when(first["citation_ids"].isNotNull(), F.size(first["citation_ids"]).cast("bigint")).alias("n_ids"))


_NUMERIC = "regexp_full_match(trim(field_value), '[+-]?[0-9]+([.][0-9]+)?')"


@query(f"""select distinct row_id, case when regexp_full_match(trim(field_value), '[+-]?[0-9]+') then try_cast(trim(field_value) as int) end as as_int,
case when {_NUMERIC} then try_cast(trim(field_value) as double) end as as_float, case when {_NUMERIC} then round(try_cast(trim(field_value) as double) * 1000, 1) end as grams,
case when lower(trim(field_value)) in ('m', 'male') then 'male' when lower(trim(field_value)) in ('f', 'female') then 'female' end as sex,
case when lower(trim(field_value)) in ('true', '1', 'yes', 'y', 't') then true when lower(trim(field_value)) in ('false', '0', 'no', 'n', 'f') then false end as flag,
case when lower(trim(field_value)) in ('', 'none', 'null', 'na', 'n/a', 'nan') then null else trim(field_value) end as filled from newborn_nbu_2021""")
def txt24_transforms(spark: SparkSession, d: str) -> DataFrame:
    from marlstone.operators import eav

    v = F.col("field_value")
    plain = F.when(~F.contains(v, F.lit(",")), v)
    number = eav.as_number(plain, None, whole=False)
    return table(spark, d, "newborn_nbu_2021").select(
        "row_id", eav.as_number(v, None, whole=True).alias("as_int"), number.alias("as_float"), F.round(number * 1000, 1).alias("grams"),
        eav.as_sex(v).alias("sex"), eav.as_boolean(v).alias("flag"), F.when(~eav.is_null_mark(v), eav.stripped(v)).alias("filled"),
    ).distinct()


@query("select chunk_id, sha256(text) as digest from (select distinct chunk_id, text from chunk where text is not null)")
def txt25_digest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunk").where("text is not null").select("chunk_id", "text").distinct().select("chunk_id", X.sha256(F.col("text")).alias("digest"))


_PADS = [p.hex() for p in X.key_pads(b"example")]


@query(f"select distinct record_id, sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || encode(mrn)))) as mrn_hash from patient_record")
def txt26_keyed_digest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "patient_record").select("record_id", X.keyed_digest(F.col("mrn"), b"example").alias("mrn_hash")).distinct()


@query()
def txt7_spans(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunk").where("text is not null").select("chunk_id", "text").distinct()
    return chunks.select("chunk_id", X.find_spans(F.lit("serum level of"), F.col("text")).alias("span")).select("chunk_id", "span.start", "span.end")


@query("select distinct record_id, mrn, true as sealed from patient_record")
def txt26_sealed(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers sealed with AES-GCM under a key and bound to their record, then opened again."""
    key = F.lit("0123456789abcdef").cast("binary")
    box = F.aes_encrypt(F.col("mrn").cast("binary"), key, F.lit("GCM"), F.lit("DEFAULT"), F.unhex(F.substring(F.sha2("record_id", 256), 1, 24)), F.col("record_id").cast("binary"))
    rows = table(spark, d, "patient_record").select("record_id", "mrn").distinct().withColumn("box", box)
    opened = F.aes_decrypt("box", key, F.lit("GCM"), F.lit("DEFAULT"), F.col("record_id").cast("binary")).cast("string")
    return rows.select("record_id", opened.alias("mrn"), (F.col("box") != F.col("mrn").cast("binary")).alias("sealed"))
