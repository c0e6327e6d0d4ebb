"""Document structure: sections, blocks, chunks, tables, assembly.

Texts are split into lines or blocks inside their row and handled by array functions, so a document is the unit of work
and nothing is shuffled but where documents meet. Defined cases: null or blank texts have no section, block or chunk.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import approx_tokens, sentences

# Limits of chunks in words, share of overlap, and the forms of headings, clauses and tables.
SOFT_CAP = 1024
WINDOW = 600
OVERLAP = 0.15
HEADING = r"^([0-9]+(?:\.[0-9]+){0,4})\.?\s+([A-Z][^\n]{0,90})$"
MARKDOWN = r"^(#{1,6})\s+(.+?)\s*$"
NUMBERED = r"(?s)^(\d+(?:\.\d+){1,4})\.?\s+(.*)$"
GRADE = r"(?i)\b(strong|weak|conditional)\s+recommendation\b|\b(certainty|quality)\s+of\s+evidence\b"
TABLE_ROW = r"^\s*\|.*\|\s*$"
TABLE_RULE = r"^\s*\|?[\s:|-]+\|[\s:|-]*\|?\s*$"
CRITERION = r"([A-Za-z_ ]+?)\s*(>=|<=|>|<|=)\s*([\d.]+)\s*([A-Za-z%/]*)"
SEPARATOR = " › "
PAGE_CHARS = 3000
LINEAGE = {"primary": 0.3, "secondary": 0.2, "reverse": 0.6, "words": 8}
#: The dose that keeps a margin line, plainer than the one of answers (functions.text.DOSE).
LINE_DOSE = r"(?i)\d+(?:\.\d+)?\s*(?:mg|g|kg|ml|mcg|µg|iu|i\.u|units?|%|mmol)\b"


def lines_with_offsets(text: Column) -> Column:
    """array<struct<line, start>>: the lines of a text with the place of their first character."""
    lines = F.split(text, "\n")
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<line:string,start:int>>").alias("out"))

    def step(acc: Column, line: Column) -> Column:
        entry = F.struct(line.alias("line"), acc["at"].alias("start"))
        return F.struct((acc["at"] + F.length(line) + 1).alias("at"), F.concat(acc["out"], F.array(entry)).alias("out"))

    return F.aggregate(lines, zero, step, lambda acc: acc["out"])


def sections(documents: DataFrame, doc_id: str, text: str, markdown: bool = False) -> DataFrame:
    """doc_id, section_no, number, heading, depth, path, char_start, char_end: one row per heading line.

    The open headings are an array folded over a document's headings: deeper ones go when a heading of their depth or
    less comes.
    """
    pattern = MARKDOWN if markdown else HEADING
    at = lines_with_offsets(F.col(text))
    heads = F.filter(at, lambda x: F.trim(x["line"]).rlike(pattern) if not markdown else x["line"].rlike(pattern))

    def parsed(x: Column) -> Column:
        line = x["line"] if markdown else F.trim(x["line"])
        first, rest = F.regexp_extract(line, pattern, 1), F.trim(F.regexp_extract(line, pattern, 2))
        if markdown:
            lead = r"^(\d+(?:\.\d+){0,4})\.?\s+(.*)$"
            number = F.nullif(F.regexp_extract(rest, lead, 1), F.lit(""))
            title = F.when(number.isNotNull(), F.trim(F.regexp_extract(rest, lead, 2))).otherwise(rest)
            depth = F.length(first)
        else:
            number, title = first, rest
            depth = F.length(first) - F.length(F.replace(first, F.lit("."), F.lit(""))) + 1
        return F.struct(number.alias("number"), title.alias("heading"), depth.alias("depth"), x["start"].alias("char_start"))

    kind = "array<struct<number:string,heading:string,depth:int,char_start:int>>"
    open_kind = "array<struct<heading:string,depth:int>>"
    out_kind = "array<struct<number:string,heading:string,depth:int,path:string,char_start:int>>"
    zero = F.struct(F.array().cast(open_kind).alias("open"), F.array().cast(out_kind).alias("out"))

    def step(acc: Column, h: Column) -> Column:
        above = F.filter(acc["open"], lambda o: o["depth"] < h["depth"])
        own = F.struct(h["heading"].alias("heading"), h["depth"].alias("depth"))
        opened = F.concat(above, F.array(own))
        path = F.array_join(F.transform(opened, lambda o: o["heading"]), SEPARATOR)
        entry = F.struct(h["number"].alias("number"), h["heading"].alias("heading"), h["depth"].alias("depth"), path.alias("path"), h["char_start"].alias("char_start"))
        return F.struct(opened.alias("open"), F.concat(acc["out"], F.array(entry)).alias("out"))

    rows = documents.where(F.col(text).isNotNull()).select(F.col(doc_id), F.length(text).alias("_n"), F.transform(heads, parsed).cast(kind).alias("_heads"))
    rows = rows.withColumn("_s", F.aggregate("_heads", zero, step, lambda acc: acc["out"]))
    flat = rows.select(doc_id, "_n", "_s", F.posexplode("_s").alias("section_no", "s"))
    following = F.get("_s", F.col("section_no") + 1)["char_start"]
    return flat.select(doc_id, "section_no", "s.number", "s.heading", "s.depth", "s.path", "s.char_start", F.coalesce(following, F.col("_n")).alias("char_end"))


def page_of(starts: Column, offset: Column) -> Column:
    """Number of the last page that starts at or before an offset; starts is ascending."""
    return F.greatest(F.lit(1), F.size(F.filter(starts, lambda s: s <= offset)))


def synthetic_pages(text: Column, size: int = PAGE_CHARS) -> Column:
    """A text in pages of so many characters."""
    n = F.greatest(F.lit(1), F.ceil(F.length(text) / size).cast("int"))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr(text, i * size + 1, F.lit(size)))


def remap_pages(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """pages (doc_id, page_no) with the source page of each; sources: doc_id, source_pages (ascending, positive, one per page).

    Documents whose list is too short, not ascending or not positive get no source page and valid false.
    """
    need = pages.groupBy("doc_id").agg(F.max("page_no").alias("n_pages"))
    checked = need.join(sources, "doc_id", "left")
    s = F.col("source_pages")
    ok = (F.size(s) == F.col("n_pages")) & F.forall(s, lambda x: x > 0) & (F.array_sort(s) == s)
    checked = checked.withColumn("valid", F.coalesce(ok, F.lit(False)))
    joined = pages.join(checked, "doc_id")
    return joined.select("doc_id", "page_no", "valid", F.when(F.col("valid"), F.get("source_pages", F.col("page_no") - 1)).alias("source_page"))


def parse_quality(n_chars: Column, n_pages: Column, has_sections: Column) -> Column:
    """Share of 500 characters a page that a document has, with a bonus for sections."""
    base = F.least(F.lit(1.0), n_chars / F.greatest(n_pages * 500, F.lit(1)))
    return F.when(n_pages < 1, 0.0).otherwise(F.round(F.least(F.lit(1.0), base + F.when(has_sections, 0.1).otherwise(0.0)), 3))


def layout_quality(confidence: Column, empty_pages: Column, pages: Column, unverified: Column) -> Column:
    q = 0.6 + 0.4 * F.coalesce(confidence, F.lit(1.0)) - 0.3 * empty_pages / F.greatest(pages, F.lit(1)) - 0.1 * unverified
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), q)), 3)


def blocks(text: Column) -> Column:
    """Blocks between blank lines, trimmed, none empty."""
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda b: F.trim(F.regexp_replace(b, r"^\s+|\s+$", ""))), lambda b: b != "")


def is_table(block: Column) -> Column:
    """At least two lines, two of them rows, and a rule."""
    rows = F.split(block, "\n")
    return (
        (F.size(rows) >= 2)
        & (F.size(F.filter(rows, lambda r: r.rlike(TABLE_ROW))) >= 2)
        & F.exists(rows, lambda r: r.rlike(TABLE_RULE) & ~r.rlike(r"[A-Za-z0-9]"))
    )


def criteria(text: Column) -> Column:
    """array<struct<field, operator, value, unit>> found in a text; a value that is no number is null."""
    def group(i: int) -> Column:
        return F.regexp_extract_all(text, F.lit(CRITERION), i)

    zipped = F.arrays_zip(group(1).alias("f"), group(2).alias("o"), group(3).alias("v"), group(4).alias("u"))
    return F.transform(
        zipped,
        lambda z: F.struct(
            F.regexp_replace(z["f"], r"^[ |]+|[ |]+$", "").alias("field"), z["o"].alias("operator"),
            z["v"].try_cast("double").alias("value"), F.nullif(z["u"], F.lit("")).alias("unit"),
        ),
    )


def clause_type(block: Column, profile: Column) -> Column:
    """recommendation or protocol_step for a numbered clause by the document's profile; null for prose."""
    return F.when(
        block.rlike(NUMBERED),
        F.when((profile == "grade_recommendations") & block.rlike(GRADE), "recommendation").when(profile == "clinical_protocol", "protocol_step"),
    )


def packed(parts: Column, most: int | Column) -> Column:
    """array<array<string>>: parts in order, greedily together until the next would exceed `most` words."""
    kind = "array<array<string>>"
    zero = F.struct(F.array().cast(kind).alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("n"))

    def step(acc: Column, part: Column) -> Column:
        n = approx_tokens(part)
        full = (F.size(acc["open"]) > 0) & (acc["n"] + n > most)
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"),
            F.when(full, F.array(part)).otherwise(F.concat(acc["open"], F.array(part))).alias("open"),
            F.when(full, n).otherwise(acc["n"] + n).alias("n"),
        )

    return F.aggregate(parts, zero, step, lambda acc: F.when(F.size(acc["open"]) > 0, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]))


def split_at_sentences(text: Column, most: int = SOFT_CAP) -> Column:
    """Pieces of whole sentences of at most `most` words where sentences allow; the text itself if it is short enough."""
    whole = F.array(text)
    return F.when(approx_tokens(text) <= most, whole).otherwise(F.transform(packed(sentences(text), most), lambda p: F.array_join(p, " ")))


def prose_windows(documents: DataFrame, doc_id: str, paragraphs: Column, most: int = WINDOW, overlap: float = OVERLAP) -> DataFrame:
    """doc_id, window_no, n_words, n_overlap, text: greedy windows of paragraphs (array<string>); each later one begins with
    the last words of the one before.

    Bodies and their words are columns of their own, computed once a document before they are looked at per window.
    """
    rows = documents.select(doc_id, F.transform(packed(paragraphs, most), lambda p: F.array_join(p, "\n\n")).alias("_bodies"))
    rows = rows.withColumn("_words", F.transform("_bodies", lambda t: F.filter(F.split(t, r"\s+"), lambda w: w != "")))
    flat = rows.select(doc_id, "_words", F.posexplode("_bodies").alias("window_no", "_body"))
    before = F.get("_words", F.col("window_no") - 1)
    n = F.greatest(F.lit(1), F.bround(F.size(before) * overlap).cast("int"))
    later = F.col("window_no") > 0
    text = F.when(later, F.concat(F.array_join(F.slice(before, F.size(before) - n + 1, n), " "), F.lit("\n\n"), "_body")).otherwise(F.col("_body"))
    return flat.select(doc_id, "window_no", F.size(F.get("_words", F.col("window_no"))).alias("n_words"), F.when(later, n).otherwise(0).alias("n_overlap"), text.alias("text"))


def with_parents(chunks: DataFrame) -> DataFrame:
    """chunks (document, section, ordinal, chunk_type) with parent_ordinal: the last step of the section before a table or
    criteria chunk, else the section's first chunk; a section's first chunk has none."""
    order = Window.partitionBy("document", "section").orderBy("ordinal")
    first = F.first("ordinal").over(order)
    step = F.last(F.when(F.col("chunk_type") == "protocol_step", F.col("ordinal")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    parent = F.when(F.col("chunk_type").isin("table", "criteria"), F.coalesce(step, first)).otherwise(first)
    return chunks.withColumn("parent_ordinal", F.when(parent != F.col("ordinal"), parent))


def covered(windows: DataFrame, blocks_at: DataFrame, bin_size: int = 4096, also: Sequence[str] = ()) -> DataFrame:
    """windows joined with the blocks of their document that they overlap: (document, w_start, w_end) and (document, b_start,
    b_end), equal in the columns `also` too.

    Both are put into bins of so many characters and meet within a bin; a pair that shares several counts in the first
    that it shares, so a document's windows are never all paired with its blocks.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bin_size), F.floor(F.greatest(F.col(b) - 1, F.col(a)) / bin_size)))
    w = windows.withColumn("_bin", bins("w_start", "w_end"))
    b = blocks_at.withColumn("_bin", bins("b_start", "b_end"))
    overlaps = (F.col("b_start") < F.col("w_end")) & (F.col("w_start") < F.col("b_end"))
    first = F.floor(F.greatest("w_start", "b_start") / bin_size) == F.col("_bin")
    return w.join(b, ["document", "_bin", *also]).where(overlaps & first).drop("_bin")


def gates(chunks: DataFrame, rules: DataFrame, least_quality: float = 0.5) -> DataFrame:
    """chunks (chunk_id, section_path, parse_quality) with review_status: excluded by the first matching rule, pending
    below the quality, else null. rules: rule_no, prefix; a prefix fits the path itself or what stands below it, the
    empty prefix fits chunks without a section."""
    path = F.coalesce("section_path", F.lit(""))
    fits = F.when(F.col("prefix") == "", path == "").otherwise((path == F.col("prefix")) | path.startswith(F.concat("prefix", F.lit(" ›"))))
    hit = chunks.select("chunk_id", "section_path").join(rules, fits).groupBy("chunk_id").agg(F.min("rule_no").alias("rule_no"))
    joined = chunks.join(hit, "chunk_id", "left")
    status = F.when(F.col("rule_no").isNotNull(), "excluded").when(F.col("parse_quality") < least_quality, "pending")
    return joined.withColumn("review_status", status)


def carried_over(new: DataFrame, confirmed: DataFrame) -> DataFrame:
    """new chunks (document, chunk_id, text, source) with the first confirmed chunk that has all their blocks whole, and
    the same source. Candidates meet on document and first block, so nothing is compared with everything."""
    a = new.withColumn("b", blocks(F.col("text"))).where(F.size("b") > 0).withColumn("block", F.get("b", F.lit(0)))
    c = confirmed.select("document", F.col("chunk_id").alias("confirmed_id"), F.col("source").alias("confirmed_source"), blocks(F.col("text")).alias("cb"))
    c = c.withColumn("block", F.explode(F.array_distinct("cb")))
    met = a.join(c, ["document", "block"]).where((F.size(F.array_except("b", "cb")) == 0) & F.col("source").eqNullSafe(F.col("confirmed_source")))
    first = met.groupBy("document", "chunk_id").agg(F.min("confirmed_id").alias("confirmed_id"))
    return new.join(first, ["document", "chunk_id"], "left")


PAGE_NUMBER = r"^(page\s+)?#+(\s+of\s+#+)?$"
#: Points within which running headers share a vertical position.
ALIGNED = 2.0


def margin_boilerplate(lines: DataFrame, options: DataFrame, patterns: Mapping[str, Sequence[str]], height: float = 842.0) -> DataFrame:
    """document, page_no, line_id, masked, reason of the lines that are page furniture; never one with a dose.

    lines: document, source, page_no, line_id, text, top, bottom, is_heading. options: source, margin_zone, repeat_ratio,
    min_pages (a settings row per source; others take the defaults). In the margin goes a line whose masked text repeats
    on enough of the document's pages, a page number, and what fits a pattern of its source; a heading in the margin goes
    where its text stands at one height (the median, give or take ALIGNED) on min_pages pages.
    """
    from marlstone.functions.lines import fits_pattern
    from marlstone.functions.text import mask_digits

    known = options.groupBy("source").agg(F.first("margin_zone").alias("margin_zone"), F.first("repeat_ratio").alias("repeat_ratio"), F.first("min_pages").alias("min_pages"))
    zone, ratio, least = F.coalesce("margin_zone", F.lit(0.08)), F.coalesce("repeat_ratio", F.lit(0.5)), F.coalesce("min_pages", F.lit(3))
    pages = lines.groupBy("document").agg(F.count_distinct("page_no").alias("n_pages"))
    placed = lines.join(known, "source", "left").where((F.col("bottom") <= height * zone) | (F.col("top") >= height * (1 - zone)))
    margin = placed.withColumn("masked", mask_digits(F.col("text"))).where("masked <> ''")
    seen = margin.groupBy("document", "masked").agg(F.count_distinct("page_no").alias("on_pages"))
    # The middle one of a heading's heights: as many as the document has pages.
    tops = F.array_sort(F.collect_list("top"))
    anchors = margin.where("is_heading").groupBy("document", "masked").agg(F.get(tops, F.floor(F.count("top") / 2).cast("int")).alias("anchor"))
    at_anchor = F.abs(F.col("top") - F.col("anchor")) <= ALIGNED
    aligned = margin.where("is_heading").join(anchors, ["document", "masked"]).where(at_anchor)
    running = aligned.groupBy("document", "masked").agg(F.first("anchor").alias("anchor"), F.count_distinct("page_no").alias("aligned_pages"))
    judged = margin.join(seen, ["document", "masked"]).join(pages, "document").join(running, ["document", "masked"], "left")
    reason = (
        F.when(F.col("is_heading") & at_anchor & (F.col("aligned_pages") >= least), "running_header")
        .when(~F.col("is_heading") & (F.col("n_pages") >= least) & (F.col("on_pages") / F.col("n_pages") >= ratio), "repeated")
        .when(~F.col("is_heading") & F.col("masked").rlike(PAGE_NUMBER), "page_number")
        .when(~F.col("is_heading") & fits_pattern(F.col("source"), F.col("text"), patterns), "pattern")
    )
    return judged.withColumn("reason", reason).where(F.col("reason").isNotNull() & ~F.col("text").rlike(LINE_DOSE)).select("document", "page_no", "line_id", "masked", "reason")


#: Points within which font sizes are one tier; headings a tier needs, and tiers a document needs for its sizes to count.
TIER, TIER_HEADINGS, LEAST_TIERS = 0.25, 2, 2
LETTER_PART, TABLE_TITLE = r"^[A-Z]\.\s+\S", r"^Table\s+\d+(?:\.\d+)*\b"
TABLE_CONTINUED = r"(?i)^Table\s+\d+(?:\.\d+)*\s*\(?continued\)?\.?$"
_LEVELLED = "document string, element_no bigint, level int"


def size_tiers(sizes: Column) -> Column:
    """array<double>: the tiers of a document's heading sizes in reading order, largest first: sizes within TIER of an earlier
    one count as that; a tier has at least TIER_HEADINGS headings."""
    kind = "array<struct<size:double,n:int>>"

    def step(acc: Column, size: Column) -> Column:
        near = F.filter(acc, lambda t: F.abs(t["size"] - size) <= TIER)
        mine = F.get(near, F.lit(0))["size"]
        counted = F.transform(acc, lambda t: F.struct(t["size"].alias("size"), F.when(t["size"] == mine, t["n"] + 1).otherwise(t["n"]).alias("n")))
        return F.when(mine.isNotNull(), counted).otherwise(F.concat(acc, F.array(F.struct(size.alias("size"), F.lit(1).alias("n"))))).cast(kind)

    tiers = F.aggregate(F.filter(sizes, lambda x: x.isNotNull()), F.array().cast(kind), step)
    return F.reverse(F.array_sort(F.transform(F.filter(tiers, lambda t: t["n"] >= TIER_HEADINGS), lambda t: t["size"])))


def nested_levels(levels: list[int], parts: list[bool], titles: list[bool]) -> list[int]:
    """Levels of headings after letter parts and table titles took theirs under them.

    A part reaches to the next part, heading of a higher rank, or title at its own rank or above. What it reaches goes one
    level down if any of it has the part's level. A title holds the parts behind it up to the next plain heading outside
    of parts at its rank or above; a part that doesn't stand below its title is moved there, with what it reaches.
    """
    n = len(levels)

    def ends(p: int, j: int) -> bool:
        return parts[j] or levels[j] < levels[p] or (titles[j] and levels[j] <= levels[p])

    reach = {p: range(p + 1, next((j for j in range(p + 1, n) if ends(p, j)), n)) for p in range(n) if parts[p]}
    within = {j for span in reach.values() for j in span} | set(reach)
    holder: int | None = None
    out = list(levels)
    for j in range(n):
        if j in reach:
            down = max(0, levels[holder] + 1 - levels[j]) if holder is not None else 0
            out[j] += down
            deeper = int(any(levels[m] == levels[j] for m in reach[j]))
            for m in reach[j]:
                out[m] += down + deeper
        elif j not in within and (titles[j] or (holder is not None and levels[j] <= levels[holder])):
            holder = j if titles[j] else None
    return out


def _under_parts(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    rows = frame.sort_values("element_no")
    text = rows.text.fillna("").str.strip()
    is_title = text.str.match(TABLE_TITLE)
    level = nested_levels(rows.level.tolist(), (text.str.match(LETTER_PART) & ~is_title).tolist(), is_title.tolist())
    return pd.DataFrame({"document": key[0], "element_no": rows.element_no.to_numpy(), "level": level})


def heading_levels(elements: DataFrame) -> DataFrame:
    """document, element_no, kind, text, level: elements (document, element_no, kind, text, font_size, is_bold) after false
    headings have become text and the others have a level.

    A numbered heading has the depth of its number; another stands one below the last numbered one. A heading that runs on
    in the text behind it (no end mark, a small letter next) joins that text; one set smaller than the usual text and not
    bold is text. Where headings come in LEAST_TIERS sizes that recur, the size's rank is the level. Letter parts take the
    headings of their level under them, table titles their parts; continuations of table titles go. Windows and lists
    are over one document's headings.
    """
    rows = elements.where(~((F.col("kind").isin("heading", "text", "caption")) & F.coalesce(F.trim("text").rlike(TABLE_CONTINUED), F.lit(False))))
    along = Window.partitionBy("document").orderBy("element_no")
    titled = (F.col("kind") == "caption") & F.trim("text").rlike(TABLE_TITLE) & (F.lead("kind").over(along) == "heading")
    rows = rows.withColumn("kind", F.when(titled, "heading").otherwise(F.col("kind")))
    usual = rows.where("kind in ('text', 'list_item') and font_size is not null").groupBy("document").agg(F.percentile("font_size", F.lit(0.5)).alias("usual"))
    number = F.regexp_extract(F.trim("text"), r"(?s)^(\d+(?:\.\d+){0,4})\.?\s+\S.*$", 1)
    depth = F.when((F.col("kind") == "heading") & (number != ""), F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1)
    next_text = F.when(F.lead("kind").over(along).isin("text", "list_item"), F.lead("text").over(along))
    plain = (F.col("kind") == "heading") & depth.isNull()
    runs_on = plain & (F.trim("text") != "") & ~F.rtrim("text").rlike(r"[.:?!)]$") & F.coalesce(next_text.rlike(r"^\p{Ll}"), F.lit(False))
    rows = rows.join(usual, "document", "left").withColumns({"_depth": depth, "_joins": runs_on})
    small = plain & (F.col("font_size") < F.col("usual") - TIER) & ~F.coalesce("is_bold", F.lit(False))
    rows = rows.withColumn("_small", F.coalesce(small, F.lit(False)) & ~F.col("_joins"))
    before = F.coalesce(F.last("_depth", ignorenulls=True).over(along), F.lit(0))
    lead_in = F.lag(F.when(F.col("_joins"), F.rtrim("text"))).over(along)
    rows = rows.withColumns({"_level": F.coalesce("_depth", before + 1), "_lead": lead_in})
    rows = rows.where("not _joins").select(
        "document", "element_no", F.when(F.col("_small"), "text").otherwise(F.col("kind")).alias("kind"),
        F.when(F.col("_lead").isNotNull(), F.concat_ws(" ", "_lead", "text")).otherwise(F.col("text")).alias("text"), "font_size", "_level",
    )
    heads = rows.where("kind = 'heading'")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("element_no", "font_size"))), lambda x: x["font_size"].cast("double"))
    tiers = heads.groupBy("document").agg(listed.alias("_sizes")).select("document", size_tiers(F.col("_sizes")).alias("_tiers"))
    rank = 1 + F.size(F.filter("_tiers", lambda t: t > F.col("font_size") + TIER))
    ranked = (F.size("_tiers") >= LEAST_TIERS) & F.col("font_size").isNotNull()
    levelled = heads.join(tiers, "document").withColumn("level", F.when(ranked, rank).otherwise(F.col("_level")).cast("int"))
    final = levelled.select(F.col("document").cast("string").alias("document"), F.col("element_no").cast("bigint").alias("element_no"), "text", "level").groupBy("document").applyInPandas(_under_parts, _LEVELLED)
    return rows.join(final, ["document", "element_no"], "left").select("document", "element_no", "kind", "text", "level")


def assembled(units: DataFrame) -> DataFrame:
    """units (document, unit_no, text, page_no) with char_start and char_end in the text that joins them by blank lines."""
    order = Window.partitionBy("document").orderBy("unit_no")
    before = F.coalesce(F.sum(F.length("text") + 2).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return units.withColumn("char_start", before).withColumn("char_end", before + F.length("text"))


def page_runs(placed: DataFrame) -> DataFrame:
    """document, page_no, char_start, char_end, n_units: the stretch of the assembled text that each page fills; see assembled()."""
    return placed.groupBy("document", "page_no").agg(F.min("char_start").alias("char_start"), F.max("char_end").alias("char_end"), F.count("*").alias("n_units"))


def merged_cells(left: DataFrame, right: DataFrame) -> DataFrame:
    """Cells (table_id, row, col, text) of two readings: the first one's text unless it is empty, and what differs."""
    a = left.select("table_id", "row", "col", F.col("text").alias("a"))
    b = right.select("table_id", "row", "col", F.col("text").alias("b"))
    both = a.join(b, ["table_id", "row", "col"], "full")
    digits = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\D", "")
    kept = F.when(F.coalesce("a", F.lit("")) == "", F.col("b")).otherwise(F.col("a"))
    state = F.when(F.col("a").eqNullSafe(F.col("b")), "agreed").when(F.coalesce("a", F.lit("")) == "", "second_only").otherwise("first_only")
    return both.select("table_id", "row", "col", kept.alias("text"), state.alias("state"), (digits("a") != digits("b")).alias("numeric"))


def without(a: Column, b: Column) -> Column:
    """The entries of array a beyond those of b, counted, sorted."""
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    more = F.transform(F.array_distinct(a), lambda x: F.array_repeat(x, F.greatest(count(a, x) - count(b, x), F.lit(0))))
    return F.array_sort(F.flatten(more))


def compared_prose(first: Column, second: Column) -> Column:
    """struct<numeric_disagreements, first_only, second_only>: the numbers of two readings of one text that the other lacks; a
    bullet at the start of the second doesn't count."""
    from marlstone.functions.text import numbers_of
    from marlstone.operators.layout import BULLET

    a, b = numbers_of(first), numbers_of(F.regexp_replace(F.trim(F.regexp_replace(second, r"\s+", " ")), BULLET, ""))
    left, right = without(a, b), without(b, a)
    return F.struct((F.size(left) + F.size(right)).alias("numeric_disagreements"), left.alias("first_only"), right.alias("second_only"))


def expanded_cells(cells: DataFrame, also: Sequence[str | Column] = ()) -> DataFrame:
    """Cells (table_id, row, col, row_span, col_span, text, is_header) spread over the grid squares that they span."""
    rows = F.sequence(F.col("row"), F.col("row") + F.col("row_span") - 1)
    cols = F.sequence(F.col("col"), F.col("col") + F.col("col_span") - 1)
    clean = F.trim(F.regexp_replace(F.replace("text", F.lit("|"), F.lit("/")), r"\s+", " "))
    spread = cells.select("table_id", "row_span", "col_span", "is_header", *also, clean.alias("text"), F.explode(rows).alias("_r"), "col")
    names = [c for c in spread.columns if c not in ("row_span", "col_span", "_r", "col")]
    return spread.withColumn("_c", F.explode(cols)).select(*names, F.col("_r").alias("row"), F.col("_c").alias("col"))


#: Share of a table's columns that a title cell spans, two at least; rows from which on a table may be cut.
TITLE_SPAN, ROWS_TO_SPLIT = 0.6, 2


def rendered_tables(cells: DataFrame, most: int) -> DataFrame:
    """table_id, part_no, text: tables row by row, each value behind the path of its column's headings, in parts of at most
    `most` words where rows allow; titles stand above every part.

    cells: table_id, row, col, row_span, col_span, text, is_header. Header rows are the first ones that header cells
    reach; with several of them, a cell of the first row over most columns is a title. A table's cells are its natural
    unit: rows form by one aggregation, the table by a second.
    """
    shape = cells.groupBy("table_id").agg(
        F.max(F.col("col") + F.col("col_span")).alias("n_cols"),
        F.array_distinct(F.flatten(F.collect_list(F.when(F.col("is_header"), F.sequence(F.col("row"), F.col("row") + F.col("row_span") - 1))))).alias("_heads"),
    )
    top = F.size("_heads")
    n_header = F.aggregate(F.sequence(F.lit(0), top), F.lit(0), lambda n, i: F.when((n == i) & F.array_contains("_heads", i.cast("int")), n + 1).otherwise(n))
    held = cells.join(shape.withColumn("n_header", n_header).drop("_heads"), "table_id")
    title = (F.col("row") == 0) & (F.col("n_header") > 1) & (F.col("col_span") >= F.greatest(F.lit(2), F.col("n_cols") * TITLE_SPAN))
    held = held.withColumn("is_title", title)
    grid = expanded_cells(held, ["n_cols", "n_header", "is_title", F.col("row").alias("own_row"), F.col("col").alias("own_col")])
    titles = grid.where("is_title and text <> ''").groupBy("table_id").agg(F.array_sort(F.collect_set(F.struct("own_row", "own_col", "text"))).alias("_t"))
    titles = titles.select("table_id", F.array_distinct(F.transform("_t", lambda x: x["text"])).alias("titles"))
    heads = grid.where("row < n_header and not is_title and text <> ''").groupBy("table_id", "col").agg(F.array_sort(F.collect_set(F.struct("row", "text"))).alias("_p"))
    # Neighbouring rows that say the same are one step of the path.
    step = lambda acc, x: F.when((F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1) == x["text"]), acc).otherwise(F.concat(acc, F.array(x["text"])))
    paths = heads.select("table_id", "col", F.array_join(F.aggregate("_p", F.array().cast("array<string>"), step), " · ").alias("path"))
    body = grid.where("row >= n_header").join(paths, ["table_id", "col"], "left").withColumn("path", F.coalesce("path", F.concat(F.lit("Column "), F.col("col") + 1)))
    line = F.when(F.col("col") == 0, F.concat("path", F.lit(": "), "text")).when(F.col("text") != "", F.concat(F.lit("  "), "path", F.lit(": "), "text"))
    block = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", line.alias("line")))), lambda x: x["line"]), "\n")
    rows = body.groupBy("table_id", "row").agg(block.alias("block"), F.max(F.length("text")).alias("_n")).where("_n > 0")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("row", "block"))), lambda x: x["block"])
    tables = rows.groupBy("table_id").agg(listed.alias("blocks")).join(titles, "table_id", "left").withColumn("titles", F.coalesce("titles", F.array().cast("array<string>")))
    # Titles are in every part, so rows share what they leave.
    above = F.when(F.size("titles") > 0, approx_tokens(F.array_join("titles", " "))).otherwise(0)
    tables = tables.withColumn("_room", F.greatest(most - above, F.lit(1)))
    whole = (approx_tokens(F.array_join("blocks", " ")) <= F.col("_room")) | (F.size("blocks") < ROWS_TO_SPLIT)
    parts = F.when(whole, F.array("blocks")).otherwise(packed(F.col("blocks"), F.col("_room")))
    flat = tables.select("table_id", "titles", F.posexplode(parts).alias("part_no", "p"))
    return flat.select("table_id", "part_no", F.array_join(F.concat("titles", "p"), "\n\n").alias("text"))


def flow_paths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, text: nodes with their outgoing edges, one line a node, in order."""
    to = nodes.select("graph_id", F.col("node_id").alias("target"), F.col("label").alias("to_label"))
    out = edges.join(to, ["graph_id", "target"])
    arrow = F.concat(F.lit("-> "), "to_label", F.when(F.col("edge_label").isNotNull(), F.concat(F.lit(" ["), "edge_label", F.lit("]"))).otherwise(F.lit("")))
    per = out.groupBy("graph_id", F.col("source").alias("node_id")).agg(F.array_join(F.array_sort(F.collect_list(arrow)), "; ").alias("arrows"))
    line = F.concat_ws(" ", "label", "arrows")
    joined = nodes.join(per, ["graph_id", "node_id"], "left").withColumn("line", line)
    return joined.groupBy("graph_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "line"))), lambda x: x["line"]), "\n").alias("text"))


CORRECTED = "doc_id string, text string, applied array<string>, failed array<string>"


def apply_corrections(texts: DataFrame, corrections: DataFrame) -> DataFrame:
    """texts (doc_id, text) after their corrections (doc_id, correction_id, original, corrected, every), in order of id.

    A correction must fit exactly once (white space alike), or at least once if `every`; else it fails and changes
    nothing. The corrections of a document come to its row as one array.
    """
    listed = corrections.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("correction_id", "original", "corrected", "every"))).alias("fixes"))

    def go(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        for frame in frames:
            rows = []
            for row in frame.itertuples(index=False):
                text, applied, failed = row.text, [], []
                for fix in row.fixes if row.fixes is not None else []:
                    words = (fix["original"] or "").split()
                    pattern = r"\s+".join(map(re.escape, words))
                    n = len(re.findall(pattern, text)) if words and text else 0
                    if n == 1 or (fix["every"] and n > 1):
                        text = re.sub(pattern, lambda _, to=fix["corrected"]: to, text)
                        applied.append(fix["correction_id"])
                    else:
                        failed.append(fix["correction_id"])
                rows.append((row.doc_id, text, applied, failed))
            yield pd.DataFrame(rows, columns=["doc_id", "text", "applied", "failed"])

    return texts.join(listed, "doc_id", "left").select("doc_id", "text", "fixes").mapInPandas(go, CORRECTED)


def leading_fragment(units: DataFrame) -> DataFrame:
    """The first unit (document, unit_no, kind, text) of a document if it is no heading and begins in mid-sentence; page headers
    and footers don't count as units."""
    order = Window.partitionBy("document").orderBy("unit_no")
    body = units.where("kind not in ('page_header', 'page_footer')")
    starts = F.col("text").rlike(r"^[a-z)\],;:.–-]")
    return body.withColumn("_n", F.row_number().over(order)).where((F.col("_n") == 1) & (F.col("kind") != "heading") & starts).drop("_n")


def lineage(old: DataFrame, new: DataFrame, words: Column, limits: dict[str, float] = LINEAGE) -> DataFrame:
    """old_id, new_id, score: successors of chunks (document, chunk_id, ordinal, text) within a document.

    An identical text is the only successor. Else the best by containment of the old words (then similarity, then order),
    and further chunks that hold a piece of it. Pairs come from shared words, not from every pair.
    """
    tight = F.trim(F.regexp_replace("text", r"\s+", " "))
    o = old.select("document", F.col("chunk_id").alias("old_id"), tight.alias("tight"), words.alias("ow"))
    n = new.select("document", F.col("chunk_id").alias("new_id"), "ordinal", tight.alias("tight"), words.alias("nw"))
    first = n.groupBy("document", "tight").agg(F.min_by("new_id", F.struct("ordinal", "new_id")).alias("new_id"))
    exact = o.join(first, ["document", "tight"]).select("old_id", "new_id", F.lit(1.0).alias("score"))
    rest = o.join(exact.select("old_id"), "old_id", "left_anti").where(F.size("ow") > 0)
    shared = (
        rest.select("document", "old_id", F.size("ow").alias("no"), F.explode("ow").alias("w"))
        .join(n.select("document", "new_id", "ordinal", F.size("nw").alias("nn"), F.explode("nw").alias("w")), ["document", "w"])
        .groupBy("old_id", "new_id", "ordinal", "no", "nn")
        .agg(F.count("*").alias("k"))
    )
    shared = shared.withColumn("score", F.col("k") / F.col("no")).withColumn("j", F.col("k") / (F.col("no") + F.col("nn") - F.col("k"))).withColumn("reverse", F.col("k") / F.col("nn"))
    order = Window.partitionBy("old_id").orderBy(F.col("score").desc(), F.col("j").desc(), "ordinal", "new_id")
    placed = shared.withColumn("place", F.row_number().over(order)).withColumn("top", F.max("score").over(Window.partitionBy("old_id")))
    good = (F.col("place") == 1) | ((F.col("no") >= limits["words"]) & (F.col("score") >= limits["secondary"]) & (F.col("reverse") >= limits["reverse"]))
    linked = placed.where((F.col("top") >= limits["primary"]) & good).select("old_id", "new_id", F.round("score", 4).alias("score"))
    return exact.unionByName(linked)


def remapped(gold: DataFrame, links: DataFrame, reingested: DataFrame) -> DataFrame:
    """query_id, gold (sorted, distinct): old gold chunks replaced by what they map to; unmapped ones stay only if their
    document wasn't taken in again. gold: query_id, gold array; reingested: chunk_id."""
    one = gold.select("query_id", F.explode_outer("gold").alias("chunk_id"))
    mapped = one.join(links.select(F.col("old_id").alias("chunk_id"), "new_id"), "chunk_id", "left").join(
        reingested.select("chunk_id", F.lit(True).alias("again")).distinct(), "chunk_id", "left"
    )
    now = F.coalesce("new_id", F.when(F.col("again").isNull(), F.col("chunk_id")))
    return mapped.groupBy("query_id").agg(F.array_sort(F.collect_set(now)).alias("gold"))


