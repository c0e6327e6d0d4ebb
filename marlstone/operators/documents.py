"""From documents to chunks: sections, paragraphs or layout blocks, atomic clauses and tables, prose windows, parents.

A section is the unit of work: its paragraphs or blocks are one array that is folded into chunks within its row. A
document's chunks meet only for their numbers and parents, in windows over one document.

Defined cases: a null or blank text has no chunk; a text without a heading is one section without a path; text before the
first heading belongs to no section; a section of its heading alone has no chunk; equal texts under one document count as
often as they stand there; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import approx_tokens
from marlstone.operators import chunking as C

BLANK_LINES = r"\n\s*\n"
#: Kinds of block that are a chunk of their own.
ATOMIC = ["table", "criteria", "recommendation", "protocol_step", "flowchart", "figure"]
#: Characters of a text that share a bin while blocks are looked up by place.
BIN = 4096
PART = "struct<text:string,kind:string,start:int,end:int>"
UNIT = "struct<kind:string,parts:array<string>,start:int,end:int,words:int,follows:boolean>"


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def paragraphs(body: Column, offset: Column, split: str = BLANK_LINES) -> Column:
    """array<struct<text, start, end>> of a text's paragraphs without outer blanks, none empty, by their places."""
    parts, seps = F.split(body, split), F.regexp_extract_all(body, F.lit(f"({split})"), 1)
    kind = "array<struct<text:string,start:int,end:int>>"
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.array().cast(kind).alias("out"))

    def step(acc: Column, part: Column) -> Column:
        text = _stripped(part)
        start = offset + acc["at"] + F.length(part) - F.length(F.regexp_replace(part, r"^\s+", ""))
        entry = F.struct(text.alias("text"), start.cast("int").alias("start"), (start + F.length(text)).cast("int").alias("end"))
        after = acc["at"] + F.length(part) + F.coalesce(F.length(F.get(seps, acc["i"])), F.lit(0))
        out = F.when(text != "", F.concat(acc["out"], F.array(entry))).otherwise(acc["out"])
        return F.struct(after.cast("int").alias("at"), (acc["i"] + 1).alias("i"), out.alias("out"))

    return F.aggregate(parts, zero, step, lambda acc: acc["out"])


def sectioned(documents: DataFrame, doc_id: str, text: str, markdown: bool = False) -> DataFrame:
    """document, section_no, number, heading, path, body, offset: the text of every section without its heading line, and its
    place; a document without headings is one section."""
    docs = documents.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("document"), F.col(text).alias("_text"))
    heads = C.sections(docs, "document", "_text", markdown)
    lists = heads.groupBy("document").agg(F.array_sort(F.collect_list(F.struct("section_no", "number", "heading", "path", "char_start", "char_end"))).alias("_s"))
    none = F.lit(None).cast("string")
    whole = F.array(F.struct(F.lit(0).alias("section_no"), none.alias("number"), none.alias("heading"), none.alias("path"), F.lit(0).alias("char_start"), F.length("_text").alias("char_end")))
    rows = docs.join(lists, "document", "left").select("document", "_text", F.inline(F.coalesce("_s", whole)))
    span = F.substr("_text", F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    line = F.when(F.col("heading").isNotNull(), F.when(F.instr(span, "\n") > 0, F.instr(span, "\n")).otherwise(F.length(span))).otherwise(0)
    return rows.select("document", "section_no", "number", "heading", "path", F.substr(span, line + 1).alias("body"), (F.col("char_start") + line).cast("int").alias("offset"))


def typed(parts: Column, profile: Column, heading: Column) -> Column:
    """Paragraphs with their kind: table (criteria under such a heading), a numbered clause by the profile, else prose."""
    table = F.when(F.contains(F.lower(heading), F.lit("criteria")), F.lit("criteria")).otherwise(F.lit("table"))
    return F.transform(
        parts,
        lambda p: F.struct(
            p["text"].alias("text"), F.when(C.is_table(p["text"]), table).otherwise(F.coalesce(C.clause_type(p["text"], profile), F.lit("prose"))).alias("kind"),
            p["start"].alias("start"), p["end"].alias("end"),
        ),
    )


def folded(parts: Column, most: int = C.WINDOW) -> Column:
    """Parts (PART) in order as units (UNIT): atomic ones alone, runs of prose in greedy windows of at most `most` words.

    follows: the window goes on with the run of prose of the unit before.
    """
    zero = F.array().cast(f"array<{UNIT}>")

    def step(acc: Column, p: Column) -> Column:
        words = approx_tokens(p["text"])
        last = F.get(acc, F.size(acc) - 1)
        prose = ~p["kind"].isin(ATOMIC)
        running = (F.size(acc) > 0) & prose & (last["kind"] == "prose")
        fits = running & (last["words"] + words <= most)
        kind = F.when(prose, F.lit("prose")).otherwise(p["kind"])
        own = F.struct(kind.alias("kind"), F.array(p["text"]).alias("parts"), p["start"].alias("start"), p["end"].alias("end"), words.cast("int").alias("words"), running.alias("follows"))
        grown = F.struct(
            last["kind"].alias("kind"), F.concat(last["parts"], F.array(p["text"])).alias("parts"), last["start"].alias("start"),
            p["end"].alias("end"), (last["words"] + words).cast("int").alias("words"), last["follows"].alias("follows"),
        )
        return F.when(fits, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown.cast(UNIT)))).otherwise(F.concat(acc, F.array(own.cast(UNIT))))

    return F.aggregate(parts, zero, step)


def _tail(body: Column, share: float) -> Column:
    """The last words of a window's body that the next one begins with."""
    words = F.filter(F.split(body, r"\s+"), lambda w: w != "")
    n = F.greatest(F.lit(1), F.bround(F.size(words) * share).cast("int"))
    return F.array_join(F.slice(words, F.size(words) - n + 1, n), " ")


def chunks_of(sections: DataFrame, most: int = C.WINDOW, overlap: float = C.OVERLAP, cap: int = C.SOFT_CAP) -> DataFrame:
    """Chunks of sections (document, section_no, number, heading, path, parts: array<PART>): document, ordinal, section_no,
    section_path, section_number, heading, chunk_type, text, char_start, char_end, token_count, parent_ordinal,
    split_group_id, criteria, embedding_text.

    A clause of more than `cap` words is cut between sentences, its pieces share split_group_id. A table carries its
    heading. A window of prose begins with the last words of the window before, for reading only. Parents: the open
    protocol step for tables and what else is atomic by itself, else the section's first chunk.
    """
    rows = sections.withColumn("_units", folded(F.col("parts"), most)).drop("parts")
    flat = rows.select(*[c for c in rows.columns if c != "_units"], F.posexplode("_units").alias("unit_no", "u"), "_units")
    body = F.array_join("u.parts", "\n\n")
    before = F.get("_units", F.col("unit_no") - 1)
    tail = F.when(F.col("u.follows"), _tail(F.array_join(before["parts"], "\n\n"), overlap))
    flat = flat.withColumn("body", body).withColumn("tail", tail).drop("_units")
    clause = F.col("u.kind").isin("recommendation", "protocol_step")
    tabled = F.col("u.kind").isin("table", "criteria") & F.col("heading").isNotNull() & F.col("titled")
    pieces = F.when(clause, C.split_at_sentences(F.col("body"), cap)).otherwise(
        F.array(F.when(F.col("tail").isNotNull(), F.concat_ws("\n\n", "tail", "body")).when(tabled, F.concat_ws("\n\n", "heading", "body")).otherwise(F.col("body")))
    )
    flat = flat.withColumn("_pieces", pieces)
    # A piece starts where it is found behind the pieces before it; their sentences may have stood further apart.
    flat = flat.select("*", F.posexplode("_pieces").alias("piece_no", "text"))
    least = F.aggregate(F.slice("_pieces", 1, F.col("piece_no")), F.lit(0), lambda n, p: n + F.length(p) + 1)
    found = F.expr("locate(text, body, _least + 1)")
    flat = flat.withColumn("_least", least.cast("int")).withColumn("_at", F.when(found > 0, found - 1).otherwise(F.col("_least")))
    start = F.when(clause, F.col("u.start") + F.col("_at")).otherwise(F.greatest(F.lit(0), F.col("u.start") - F.coalesce(F.length("tail") + 2, F.lit(0))))
    end = F.when(clause, F.col("u.start") + F.col("_at") + F.length("text")).otherwise(F.col("u.end"))
    split = F.when(F.size("_pieces") > 1, F.substring(F.sha2("body", 256), 1, 16))
    order = Window.partitionBy("document").orderBy("section_no", "unit_no", "piece_no")
    placed = flat.select(
        "document", (F.row_number().over(order) - 1).alias("ordinal"), "section_no", F.col("path").alias("section_path"), F.col("number").alias("section_number"), "heading",
        F.col("u.kind").alias("chunk_type"), "text", start.cast("int").alias("char_start"), end.cast("int").alias("char_end"),
        approx_tokens(F.col("text")).cast("int").alias("token_count"), split.alias("split_group_id"), "piece_no",
        F.when(F.col("u.kind") == "criteria", C.criteria(F.col("body"))).alias("criteria"),
        F.concat_ws("\n\n", "path", "text").alias("embedding_text"),
    )
    within = Window.partitionBy("document", "section_no").orderBy("ordinal")
    first = F.first("ordinal").over(within)
    step = F.last(F.when((F.col("chunk_type") == "protocol_step") & (F.col("piece_no") == 0), F.col("ordinal")), ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, -1))
    parent = F.when(F.col("chunk_type").isin("table", "criteria", "flowchart", "figure"), F.coalesce(step, first)).otherwise(first)
    return placed.withColumn("parent_ordinal", F.when(parent != F.col("ordinal"), parent)).drop("piece_no")


def chunked(
    documents: DataFrame, doc_id: str, text: str, profile: Column, most: int = C.WINDOW, overlap: float = C.OVERLAP, cap: int = C.SOFT_CAP,
    split: str = BLANK_LINES, markdown: bool = False, page_chars: int = C.PAGE_CHARS,
) -> DataFrame:
    """chunks_of() the sections of texts, with page_start and page_end on pages of so many characters.

    profile is a column of documents: grade_recommendations, clinical_protocol or narrative.
    """
    profiles = documents.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("document"), profile.alias("_profile"))
    sections = sectioned(documents, doc_id, text, markdown).join(profiles, "document")
    parts = typed(paragraphs(F.col("body"), F.col("offset"), split), F.col("_profile"), F.coalesce("heading", F.lit("")))
    chunks = chunks_of(sections.select("document", "section_no", "number", "heading", "path", parts.cast(f"array<{PART}>").alias("parts"), F.lit(True).alias("titled")), most, overlap, cap)
    page = lambda at: (F.floor(at / page_chars) + 1).cast("int")
    return chunks.withColumn("page_start", page(F.col("char_start"))).withColumn("page_end", page(F.greatest(F.col("char_end") - 1, F.col("char_start"))))


def chunked_blocks(blocks: DataFrame, most: int = C.WINDOW, overlap: float = C.OVERLAP, cap: int = C.SOFT_CAP) -> DataFrame:
    """chunks_of() laid-out blocks, with pages and the provenance of what each chunk covers.

    blocks: document, block_no, kind (heading, table, flowchart, figure, else text), level (of headings), text, page_no,
    char_start, char_end, origin, confidence, profile. A heading opens a section; headings of a deeper level stay below
    it. Added: page_start, page_end, origins (sorted), min_confidence and has_digits of scanned blocks, review_status
    (pending where a scanned block has figures) and its reasons. A chunk meets the blocks it covers by bins of their
    places, so no document is paired with itself.
    """
    along = Window.partitionBy("document").orderBy("block_no")
    marked = blocks.withColumn("section_no", F.coalesce(F.sum((F.col("kind") == "heading").cast("int")).over(along), F.lit(0)).cast("int"))
    heads = marked.where("kind = 'heading'").groupBy("document").agg(F.array_sort(F.collect_list(F.struct("block_no", "level", F.col("text").alias("title"), "section_no"))).alias("_h"))
    opened = "array<struct<level:int,title:string>>"
    out = "array<struct<section_no:int,heading:string,path:string>>"
    zero = F.struct(F.array().cast(opened).alias("open"), F.array().cast(out).alias("out"))

    def step(acc: Column, h: Column) -> Column:
        level = F.coalesce(h["level"], F.lit(1))
        stack = F.concat(F.filter(acc["open"], lambda o: o["level"] < level), F.array(F.struct(level.alias("level"), h["title"].alias("title"))))
        path = F.array_join(F.transform(stack, lambda o: o["title"]), C.SEPARATOR)
        entry = F.struct(h["section_no"].alias("section_no"), h["title"].alias("heading"), path.alias("path"))
        return F.struct(stack.cast(opened).alias("open"), F.concat(acc["out"], F.array(entry)).cast(out).alias("out"))

    sections = heads.select("document", F.inline(F.aggregate("_h", zero, step, lambda acc: acc["out"])))
    kind = F.when(F.col("kind").isin("table", "flowchart", "figure"), F.col("kind")).otherwise(F.coalesce(C.clause_type(F.col("text"), F.col("profile")), F.lit("prose")))
    body = marked.where("kind <> 'heading' and text is not null and trim(text) <> ''").withColumn("_kind", kind)
    part = F.struct("block_no", F.struct("text", F.col("_kind").alias("kind"), F.col("char_start").cast("int").alias("start"), F.col("char_end").cast("int").alias("end")).alias("p"))
    lists = body.groupBy("document", "section_no").agg(F.array_sort(F.collect_list(part)).alias("_p")).select("document", "section_no", F.transform("_p", lambda x: x["p"]).cast(f"array<{PART}>").alias("parts"))
    criteria = F.contains(F.lower(F.coalesce("heading", F.lit(""))), F.lit("criteria"))
    renamed = F.transform("parts", lambda p: F.struct(p["text"].alias("text"), F.when((p["kind"] == "table") & criteria, F.lit("criteria")).otherwise(p["kind"]).alias("kind"), p["start"].alias("start"), p["end"].alias("end")))
    rows = lists.join(sections, ["document", "section_no"], "left").select("document", "section_no", F.lit(None).cast("string").alias("number"), "heading", "path", renamed.cast(f"array<{PART}>").alias("parts"), F.lit(False).alias("titled"))
    chunks = chunks_of(rows, most, overlap, cap)
    scanned = F.col("origin") == "ocr"
    held = marked.where("kind <> 'heading'").select(
        "document", F.col("section_no").alias("_s"), "page_no", F.col("char_start").alias("b_start"), F.col("char_end").alias("b_end"), "origin",
        F.when(scanned, F.col("confidence")).alias("_c"), (scanned & F.col("text").rlike("[0-9]")).alias("_d"),
    )
    places = chunks.select("document", "ordinal", F.col("section_no").alias("_s"), F.col("char_start").alias("w_start"), F.col("char_end").alias("w_end"))
    met = C.covered(places, held, BIN, ["_s"]).groupBy("document", "ordinal").agg(
        F.min("page_no").alias("page_start"), F.max("page_no").alias("page_end"), F.array_sort(F.collect_set("origin")).alias("origins"),
        F.min("_c").alias("min_confidence"), F.bool_or("_d").alias("has_digits"),
    )
    joined = chunks.join(met, ["document", "ordinal"], "left")
    pending = F.coalesce("has_digits", F.lit(False))
    return joined.withColumn("review_status", F.when(pending, "pending")).withColumn("review_reasons", F.when(pending, F.array(F.lit("ocr_numeric"))))
