"""Scalar text functions as Column builders: analysis, scans, comparisons, renderings.

Null text gives null or an empty list as stated; everything stays inside the JVM unless it says otherwise.
"""

from __future__ import annotations

import difflib
import hashlib
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that the analyzer drops, and the form of its tokens.
STOPWORDS = [
    "the", "a", "an", "of", "to", "in", "and", "or", "is", "are", "was", "were", "be", "been", "this", "that", "with",
    "for", "on", "at", "by", "from", "as", "it", "its", "which", "if", "not", "can", "may", "also", "will", "should",
]
TOKEN = "[a-z0-9]+(?:[-/][a-z0-9]+)*"
# Words without content for grounding, and for topics.
GROUNDING_STOPWORDS = [
    "the", "a", "an", "of", "to", "for", "in", "on", "and", "or", "is", "are", "with", "this", "that", "at", "by", "as",
    "be", "it", "was", "were",
]
TOPIC_STOPWORDS = ["and", "of", "the", "a", "an", "in", "for", "with", "or", "to", "on"]
LEAST_WORD = 3
# Abbreviations and what they stand for, in the order in which they expand.
ABBREVIATIONS = {
    "sbi": "serious bacterial infection",
    "lbw": "low birth weight",
    "kmc": "kangaroo mother care",
    "nbu": "newborn unit",
    "bp": "blood pressure",
    "hr": "heart rate",
    "rr": "respiratory rate",
    "spo2": "oxygen saturation",
    "iv": "intravenous",
    "im": "intramuscular",
}
# Phrases that direct, doses, and negations.
DIRECTIVES = [
    r"\byou should\b",
    r"\byou must\b",
    r"\bwe recommend (that )?you\b",
    r"\bi recommend\b",
    r"\bstart (the patient on|them on)\b",
    r"\badminister\b .*\bto (this|the) patient\b",
    r"\bthe next step (for (this|the) patient )?is\b",
    r"\bmy advice\b",
]
DOSE = (
    r"(?i)\b\d+(?:\.\d+)?\s?(?:mg|mcg|g|ml|l|units?|iu|mmol|mcg/kg|mg/kg|ml/kg)\b"
    r"(?:\s?(?:/\s?kg|/\s?day|/\s?dose))?"
)
NEGATION = r"(?i)\b(not|no longer|avoid|contraindicated|should not|must not|is not|are not|discontinued)\b"
MATERIAL_RATIO = 0.85
SHARED_TOKENS = 3
# Words that a correction may add or take away.
RELATIONAL = [
    "less", "more", "greater", "fewer", "than", "equal", "to", "or", "and", "not", "at", "least", "most", "above",
    "below", "under", "over", "is", "of", "the", "a", "an",
]
TOPIC_PREFIX = "What does the guideline recommend about "
TOPIC_SUFFIX = " based only on the content provided below:"


def strings(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values])


def analyze(text: Column) -> Column:
    """Analyzer tokens in order; single characters only if they are digits."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0)
    return F.filter(tokens, lambda t: ~t.isin(STOPWORDS) & ((F.length(t) > 1) | t.rlike("^[0-9]$")))


def query_terms(text: Column) -> Column:
    """Distinct analyzer tokens, each of weight one."""
    return F.array_sort(F.array_distinct(analyze(text)))


def expand_abbreviations(text: Column, abbreviations: Mapping[str, str] = ABBREVIATIONS) -> Column:
    """Puts what an abbreviation stands for in brackets behind it, one abbreviation after the other."""
    for short, full in abbreviations.items():
        text = F.regexp_replace(text, rf"(?i)\b({short})\b", f"$1 ({full})")
    return text


def content_words(text: Column, stopwords: Sequence[str] = GROUNDING_STOPWORDS, least: int = LEAST_WORD) -> Column:
    """Distinct words of a-z and 0-9 of some length that aren't stopwords."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(list(stopwords))))


def topic_applies(tag: Column, words: Column) -> Column:
    """Whether at least half of a tag's words, one at least, are among the words."""
    own = content_words(tag, TOPIC_STOPWORDS)
    needed = F.greatest(F.lit(1), F.bround(F.size(own) * 0.5).cast("int"))
    return (F.size(own) > 0) & (F.size(F.array_intersect(own, words)) >= needed)


def one_blank(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def contains_verbatim(quote: Column, text: Column) -> Column:
    """Whether the quote stands in the text, runs of white space being alike; a blank quote never does."""
    tight = one_blank(quote)
    return (tight != "") & (F.instr(one_blank(text), tight) > 0)


def approx_tokens(text: Column) -> Column:
    """Words by white space, one at least."""
    return F.greatest(F.lit(1), F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")))


def char_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 3.2).cast("int")


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])\s+")


def overlap(claim: Column, quote: Column) -> Column:
    """Share of the claim's content words that the quote has; 0 without content words."""
    own = content_words(claim)
    return F.when(F.size(own) == 0, 0.0).otherwise(F.size(F.array_intersect(own, content_words(quote))) / F.size(own))


def is_directive(text: Column) -> Column:
    out = F.lit(False)
    for pattern in DIRECTIVES:
        out = out | text.rlike(f"(?i){pattern}")
    return out


def squash(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"(?U)\s+", ""))


def doses(text: Column) -> Column:
    """Distinct dose tokens without white space, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(DOSE), 0), squash))


def dose_beyond(text: Column, quotes: Column) -> Column:
    """Whether some dose of the text is in none of the quotes (array<string>)."""
    source = squash(F.array_join(quotes, " "))
    return F.exists(doses(text), lambda d: F.instr(source, d) == 0)


def contradicts(a: Column, b: Column) -> Column:
    """Enough shared tokens, and exactly one side negates."""
    shared = F.size(F.array_intersect(query_terms(a), query_terms(b)))
    return (shared >= SHARED_TOKENS) & (a.rlike(NEGATION) != b.rlike(NEGATION))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Similarity of two texts by matching blocks (Ratcliff and Obershelp), trimmed and in lower case; null for null."""
    for left, right in pairs:
        yield pd.Series(
            [
                None if a is None or b is None else difflib.SequenceMatcher(None, a.strip().lower(), b.strip().lower()).ratio()
                for a, b in zip(left, right, strict=True)
            ],
            dtype="float64",
        )


def materially_different(a: Column, b: Column) -> Column:
    """Whether the similarity lies below MATERIAL_RATIO; texts that are equal, or too unlike in length to reach it, are told
    without matching blocks. Null for null."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    reach = 2 * F.least(F.length(x), F.length(y)) / F.greatest(F.length(x) + F.length(y), F.lit(1))
    open_ = (x != y) & (reach >= MATERIAL_RATIO)
    ratio = sequence_ratio(F.when(open_, a), F.when(open_, b))
    return F.when(x == y, False).when(reach < MATERIAL_RATIO, True).otherwise(ratio < MATERIAL_RATIO)


def mask_digits(text: Column) -> Column:
    """Lower case, each digit #, runs of white space one blank."""
    return one_blank(F.regexp_replace(F.lower(text), r"\d", "#"))


def first_marker(text: Column, rules: Sequence[tuple[str, Sequence[str]]], otherwise: str) -> Column:
    """Label of the first rule of which a marker stands in the text."""
    low = F.lower(text)
    out = None
    for label, markers in rules:
        hit = F.lit(False)
        for m in markers:
            hit = hit | F.contains(low, F.lit(m))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def numbers_of(text: Column) -> Column:
    return F.array_sort(F.regexp_extract_all(text, F.lit(r"\d+(?:[.,]\d+)*"), 0))


def symbols_of(text: Column) -> Column:
    return F.array_sort(F.regexp_extract_all(text, F.lit(r"[^\w\s]"), 0))


def words_of(text: Column) -> Column:
    return F.array_sort(F.transform(F.regexp_extract_all(text, F.lit(r"[A-Za-z]+"), 0), F.lower))


def in_scope(original: Column, corrected: Column) -> Column:
    """Whether a correction keeps numbers and symbols and changes relational words only (as sets of changed words)."""
    def bare(t: Column) -> Column:
        return F.array_sort(F.regexp_extract_all(F.regexp_replace(t, r"\d+(?:[.,]\d+)*", " "), F.lit(r"[^\w\s]"), 0))

    changed = F.array_union(F.array_except(words_of(original), words_of(corrected)), F.array_except(words_of(corrected), words_of(original)))
    return (
        (numbers_of(original) == numbers_of(corrected))
        & (bare(original) == bare(corrected))
        & (F.size(F.array_except(changed, strings(*RELATIONAL))) == 0)
    )


def ocr_alike(original: Column, corrected: Column) -> Column:
    """Whether two texts are the same once white space goes and 1, l, | are I and 0 is O; no number may be added."""
    def shape(t: Column) -> Column:
        return F.translate(F.regexp_replace(t, r"\s+", ""), "1l|0", "IIIO")

    added = F.size(F.array_except(numbers_of(corrected), numbers_of(original)))
    return (shape(original) == shape(corrected)) & (added == 0)


def render(value: Column, scale: float = 1.0, step: float | None = None, decimals: int | None = None, unit: str | None = None) -> Column:
    """A number as text: scaled, rounded half up to a step, with fixed decimals or trimmed to one at least."""
    v = value.cast("decimal(20,6)") * F.lit(str(scale)).cast("decimal(10,6)")
    if step is not None:
        s = F.lit(str(step)).cast("decimal(10,6)")
        v = F.round(v / s, 0) * s
    if decimals is None:
        text = F.regexp_replace(F.round(v, 6).cast("decimal(20,6)").cast("string"), r"0+$", "")
        text = F.when(text.endswith("."), F.concat(text, F.lit("0"))).otherwise(text)
    else:
        text = F.round(v, decimals).cast(f"decimal(20,{decimals})").cast("string")
    return F.concat(text, F.lit(f" {unit}")) if unit else text


def reviewer_text(text: Column) -> Column:
    """A question without age bands and further weight renderings."""
    text = F.regexp_replace(text, r"(is aged \d+ days) \([^()\n]*\)", "$1")
    return F.regexp_replace(text, r"(?m)^(Weight \(kg\): [^,\n]+?)(?:, [^,\n]+?)+( \()", "$1$2")


def topic_of(text: Column) -> Column:
    """The topic between the fixed start and end of the first line; null if it hasn't that form."""
    first = F.substring_index(text, "\n", 1)
    fits = first.startswith(TOPIC_PREFIX) & first.endswith(TOPIC_SUFFIX)
    inner = F.substring(first, F.lit(len(TOPIC_PREFIX) + 1), F.length(first) - len(TOPIC_PREFIX) - len(TOPIC_SUFFIX))
    return F.when(fits & (F.length(inner) > 0), inner)


def join_natural(items: Column) -> Column:
    """a; a and b; a, b and c. Empty for an empty list."""
    n = F.size(items)
    head = F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(0))), ", ")
    return F.when(n == 0, "").when(n == 1, F.get(items, F.lit(0))).otherwise(F.concat(head, F.lit(" and "), F.get(items, n - 1)))


SEGMENT_SCHEMA = "array<struct<type:string,text:string,citation_ids:array<string>,quote:string>>"


def parse_segments(raw: Column) -> Column:
    """Segments of a JSON text, bare or in a code fence; only claims and framing with text stay, null if it doesn't parse."""
    inner = F.regexp_extract(raw, r"(?s)^\s*```(?:json)?\s*(.*?)\s*```\s*$", 1)
    parsed = F.from_json(F.when(inner != "", inner).otherwise(raw), SEGMENT_SCHEMA)
    return F.filter(parsed, lambda s: s["type"].isin("claim", "framing") & (F.trim(s["text"]) != ""))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def key_pads(key: bytes) -> tuple[bytes, bytes]:
    """The inner and outer block of HMAC-SHA256 for a key."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)


def keyed_digest(text: Column, key: bytes) -> Column:
    """HMAC-SHA256 in hex of a text under a key, from built-in hashes; null for null."""
    inner, outer = (F.lit(bytearray(pad)) for pad in key_pads(key))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(text, "UTF-8")), 256))), 256)


def find_spans(quote: Column, text: Column) -> Column:
    """struct<start, end> of the quote's first place in the raw text, runs of white space being alike; null if none."""
    return _spans(quote, text)


@F.pandas_udf(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
def _spans(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    import re

    for quotes, texts in pairs:
        out = []
        for quote, text in zip(quotes, texts, strict=True):
            words = (quote or "").split()
            hit = re.search(r"\s+".join(map(re.escape, words)), text) if words and text is not None else None
            out.append((hit.start(), hit.end()) if hit else (None, None))
        yield pd.DataFrame(out, columns=["start", "end"]).astype("Int32")
