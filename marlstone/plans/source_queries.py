"""Queries of scans with a parser from outside, model hooks, settings, charts and generated records, each with a stub."""

from __future__ import annotations

import base64
import json
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.plans import record_queries as Q
from marlstone.plans import retrieval_queries as T
from marlstone.session import shared_folder
from marlstone.sources import charts, documents, generated
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


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files-{os.urandom(8).hex()}"


def _pages(content: bytes) -> list[str]:
    """A stub parser: a page a line, in base 64."""
    return [base64.b64decode(line).decode() for line in content.splitlines()]


@query("select source, count(*) as n_pages, sum(len(text))::bigint as n_chars, count(distinct md5(text)) as n_texts from documents where source is not null and text <> '' group by 1")
def src5_parsed_files(spark: SparkSession, d: str) -> DataFrame:
    """The texts written to files of encoded pages and read back through a parser."""
    path = _folder(spark)
    docs = table(spark, d, "documents").where("source is not null and text <> ''")
    docs.select("source", F.replace(F.base64(F.encode("text", "UTF-8")), F.lit("\r\n"), F.lit("")).alias("value")).write.partitionBy("source").text(path)
    pages = documents.parsed_files(spark, f"{path}/*", _pages, "*.txt").where("error is null")
    source = F.regexp_extract("path", "source=([^/]+)", 1)
    return pages.groupBy(source.alias("source")).agg(F.count("*").alias("n_pages"), F.sum(F.length("text")).alias("n_chars"), F.count_distinct(F.md5("text")).alias("n_texts"))


def _lines(content: bytes):  # noqa: ANN202
    """A stub layout parser: a line of JSON a printed line."""
    for raw in content.splitlines():
        r = json.loads(raw)
        yield tuple(r.get(k) for k in ("document_version_id", "page_no", "line_no", "text", "bbox_x0", "bbox_top", "bbox_x1", "bbox_bottom", "from_ocr", "confidence"))


@query("select document_version_id as document, page_no, count(*) as n_lines, round(min(bbox_top), 3) as top, count(*) filter (where from_ocr) as n_scanned from (select distinct * from text_line) group by all")
def src6_layout_files(spark: SparkSession, d: str) -> DataFrame:
    """Printed lines written to files of a layout parser's output and read back through it."""
    path = _folder(spark)
    table(spark, d, "text_line").distinct().write.json(path)
    lines = documents.laid_out_files(spark, path, _lines, "*.json")
    return lines.groupBy("document", "page_no").agg(F.count("*").alias("n_lines"), F.round(F.min("top"), 3).alias("top"), F.count_if("from_ocr").alias("n_scanned"))


def _overlap():  # noqa: ANN202
    """A stub cross-encoder: the share of distinct words that both sides have."""
    words = lambda t: {w for w in re.split(r"[ \t\n\r\f\v]+", t.lower()) if w}

    def score(pairs: list[tuple[str, str]]) -> list[float]:
        out = []
        for a, b in pairs:
            x, y = words(a), words(b)
            out.append(len(x & y) / len(x | y) if x | y else 0.0)
        return out

    return score


@query("""with c as (select distinct on (chunk_id) chunk_id, section_path, text from chunk where text is not null order by chunk_id),
w as (select chunk_id, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(section_path, '')), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '')) as a, list_distinct(list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '')) as b from c)
select chunk_id, case when len(a) + len(b) = 0 then 0.0 else len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) end as score from w""")
def sco5_reranked(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk scored against its heading by a model from outside."""
    c = table(spark, d, "chunk").where("text is not null").dropDuplicates(["chunk_id"])
    return c.select("chunk_id", documents.reranker(_overlap)(F.col("section_path"), F.col("text")).alias("score"))


def _lengths():  # noqa: ANN202
    return lambda texts: [[float(len(t)), float(t.count(" "))] for t in texts]


@query("select distinct on (chunk_id) chunk_id, len(text)::double as v0, (len(text) - len(replace(text, ' ', '')))::double as v1 from chunk where text is not null order by chunk_id")
def sco5_encoded(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk as a vector of a model from outside: here its length and its blanks."""
    c = table(spark, d, "chunk").where("text is not null").dropDuplicates(["chunk_id"])
    v = c.select("chunk_id", documents.encoder(_lengths)(F.col("text")).alias("v"))
    return v.select("chunk_id", F.get("v", F.lit(0)).alias("v0"), F.get("v", F.lit(1)).alias("v1"))


_CONCEPT_FIELDS = ["concept", "field", "operator"]


@query(f"with v(concept, field, operator, low, high) as (values {Q._CONC}) select concept, field, operator from v")
def rec12_attested_settings(spark: SparkSession, d: str) -> DataFrame:  # noqa: ARG001
    """A settings list that is complete; one with a gap raises instead (see the tests)."""
    entries = [dict(zip(_CONCEPT_FIELDS, c, strict=False)) for c in Q.CONCEPTS]
    rows = documents.attested(entries, _CONCEPT_FIELDS, "concept")
    return spark.createDataFrame([tuple(r[f] for f in _CONCEPT_FIELDS) for r in rows], ", ".join(f"{f} string" for f in _CONCEPT_FIELDS))


@query(T.SQL["agg6_sweep_summary"].join(["select fusion || ' ' || words || ' ' || scorer as series, weight as x, recall as y from (", ") where k = 8"]))
def snk4_chart(spark: SparkSession, d: str) -> DataFrame:
    """Recall at 8 over the weights as a chart of lines, written as a specification with its data and read back."""
    rows = T.agg6_sweep_summary(spark, d).where("k = 8").select(F.concat_ws(" ", "fusion", "words", "scorer").alias("series"), F.col("weight").alias("x"), F.col("recall").alias("y"))
    path = f"{_folder(spark)}"
    charts.write_lines(rows, path, "Recall at 8 by weight", "weight of the lexical channel", "recall")
    return charts.read_lines(spark, path)


@query(f"""with r as (select unnest(range(0, 500)) as id), f as (select id, field, low, high, cast('0x' || substr(md5('42|' || id || '|' || field), 1, 8) as bigint) as h, cast('0x' || substr(md5('42|' || id || '|' || field || '|gap'), 1, 8) as bigint) as g
 from r, (values {", ".join(str(x) for x in generated.FIELDS)}) v(field, low, high))
select 'synthetic-' || id as key, field as field_name, (low + h % (high - low + 1))::varchar as field_value from f where g % 1000 >= 200""")
def abl8_generated_records(spark: SparkSession, d: str) -> DataFrame:  # noqa: ARG001
    """Five hundred invented records as attribute rows, a fifth of the cells missing."""
    return generated.records(spark, 500, seed=42, sparse=0.2)
