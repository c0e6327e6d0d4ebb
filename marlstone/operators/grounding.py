"""Claims against the chunks they cite: verdict per segment, action per answer, citations with offsets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.text import contains_verbatim, dose_beyond, is_directive, overlap
from marlstone.operators.filters import NOT_RETRIEVABLE

# Overlap from which a claim is supported, and partly supported.
YES, PARTLY = 0.6, 0.3


def verdicts(segments: DataFrame, citations: DataFrame, entails: Callable[[Column, Column], Column] = overlap) -> DataFrame:
    """answer_id, segment_no, type, verdict, reason for claims and framing.

    segments: answer_id, segment_no, type, text, quote. citations: answer_id, segment_no, label and, where the label
    resolves, chunk_id, chunk_text, review_status, weak (a figure without text, a flowchart not verified). In order: every
    label must resolve, some cited chunk must hold the quote and not be held for review, the wording must be clean, the
    quote must support the claim; support by weak chunks alone is at most weak. entails(claim, quote) says how far a quote
    supports a claim, from 0 to 1: by shared words, or by a model behind a pandas UDF.
    """
    cited = citations.join(segments.select("answer_id", "segment_no", "quote"), ["answer_id", "segment_no"])
    quoted = F.coalesce(contains_verbatim(F.col("quote"), F.col("chunk_text")), F.lit(False))
    held = F.coalesce(F.col("review_status").isin(NOT_RETRIEVABLE), F.lit(False))
    per = cited.groupBy("answer_id", "segment_no").agg(
        F.bool_and(F.col("chunk_id").isNotNull()).alias("resolved"), F.bool_or(quoted).alias("quoted"), F.bool_or(quoted & ~held).alias("usable"),
        F.bool_or(quoted & ~held & ~F.coalesce("weak", F.lit(False))).alias("strong"),
    )
    s = segments.join(per, ["answer_id", "segment_no"], "left")
    claim, text, quote = F.col("type") == "claim", F.col("text"), F.coalesce("quote", F.lit(""))
    wording = is_directive(text) | F.coalesce(dose_beyond(text, F.array(F.when(claim, quote).otherwise(F.lit("")))), F.lit(False))
    share = entails(text, quote)
    reason = (
        F.when(~claim, F.when(wording, "scope_violation"))
        .when(~F.coalesce("resolved", F.lit(False)), "citation_not_retrieved")
        .when(~F.col("quoted"), "quote_mismatch")
        .when(~F.col("usable"), "chunk_under_review")
        .when(wording, "scope_violation")
        .when(share < PARTLY, "not_entailed")
    )
    full = ~claim | ((share >= YES) & F.col("strong"))
    verdict = F.when(F.col("reason").isNotNull(), "unsupported").when(full, "supported").otherwise("weak")
    return s.withColumn("reason", reason).withColumn("verdict", verdict).select("answer_id", "segment_no", "type", "verdict", "reason")


def actions(judged: DataFrame) -> DataFrame:
    """answer_id, action, stripped: escalate on any wording breach or if no claim holds, strip what doesn't, mark what is weak."""
    claim = F.col("type") == "claim"
    breach = F.coalesce(F.col("reason") == "scope_violation", F.lit(False))
    failed = claim & (F.col("verdict") == "unsupported") & ~breach
    a = judged.groupBy("answer_id").agg(
        F.bool_or(breach).alias("breach"), F.count_if(failed).alias("n_failed"), F.bool_or(claim & F.col("verdict").isin("supported", "weak")).alias("some"),
        F.bool_or(F.col("verdict") == "weak").alias("weak"), F.array_sort(F.collect_list(F.when(failed, F.col("segment_no")))).alias("failed"),
    )
    action = (
        F.when(F.col("breach"), "escalate")
        .when(F.col("n_failed") == 0, F.when(F.col("weak"), "release_marked").otherwise("release"))
        .when(F.col("some"), "partial_strip")
        .otherwise("escalate")
    )
    return a.select("answer_id", action.alias("action"), F.when(action == "partial_strip", F.col("failed")).otherwise(F.array().cast("array<int>")).alias("stripped"))


def cited_span(chunk_start: Column, chunk_text: Column, quote: Column) -> Column:
    """struct<start, end> of a quote in the document, from its exact place in the chunk; null if it isn't there."""
    at = F.instr(chunk_text, quote)
    span = F.struct((chunk_start + at - 1).alias("start"), (chunk_start + at - 1 + F.length(quote)).alias("end"))
    return F.when((at > 0) & (quote != ""), span)


def verified_span(start: Column, end: Column, chunk_start: Column, chunk_text: Column, quote: Column) -> Column:
    """Whether a stored span still cuts the quote out of its chunk (white space alike); false where it lies outside or null."""
    a, b = start - chunk_start, end - chunk_start
    tight = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    inside = (start >= 0) & (start <= end) & (a >= 0) & (b <= F.length(chunk_text))
    return F.coalesce(inside & (tight(F.substr(chunk_text, a + 1, b - a)) == tight(quote)) & contains_verbatim(quote, chunk_text), F.lit(False))


def corrections_on(corrections: Column, chunk_text: Column, quote: Column) -> Column:
    """Of a chunk's corrections (array<struct<correction_id, corrected>>) those of which the corrected text overlaps the quote,
    both at their first exact place; an empty array for none."""
    q = F.instr(chunk_text, quote)

    def meets(c: Column) -> Column:
        at = F.instr(chunk_text, c["corrected"])
        return (q > 0) & (at > 0) & (c["corrected"] != "") & (at < q + F.length(quote)) & (q < at + F.length(c["corrected"]))

    return F.coalesce(F.filter(corrections, meets), F.array().cast("array<struct<correction_id:string,corrected:string>>"))


def passes(expected: Column, observed: Column, recommended: Column) -> Column:
    """Whether an outcome is as expected (missing_info_expected by missing_info, and so on); one with a recommendation never is."""
    return ~recommended & (F.regexp_replace(expected, "_expected$", "") == observed)
