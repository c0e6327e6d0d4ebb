"""Column expressions on lines of text: splitting, keys that ignore digits, case and white space."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Any white space, U+00A0, U+0085 and U+2028 included.
BLANKS = r"(?U)\s+"


def squeeze(text: Column) -> Column:
    """Runs of white space of any kind become one blank; none remains outside."""
    return F.trim(F.regexp_replace(text, BLANKS, " "))


def line_key(line: Column) -> Column:
    """Lines that differ in case, in the digits of a run or in white space share this key."""
    return F.regexp_replace(squeeze(F.lower(line)), r"\p{Nd}+", "0")


def word_count(text: Column) -> Column:
    """Words parted by white space of any kind; 0 for null."""
    tight = squeeze(text)
    return F.when(F.coalesce(tight, F.lit("")) == "", 0).otherwise(F.size(F.split(tight, " ")))


def countable(key: Column, least_words: int = 4) -> Column:
    """Whether a line key has enough words and a letter."""
    return (F.size(F.split(key, " ")) >= least_words) & key.rlike(r"\p{L}")


def valid_patterns(spark: SparkSession, listed: Iterable[tuple[str | None, Sequence[str] | None]]) -> dict[str, list[str]]:
    """source -> those of its patterns that compile; from rows of a settings table."""
    out: dict[str, list[str]] = {}
    for source, patterns in listed:
        for pattern in patterns or []:
            try:
                spark._jvm.java.util.regex.Pattern.compile(f"(?i){pattern}")
            except Exception:  # noqa: BLE001 - a pattern by hand that is none
                continue
            if source is not None:
                out.setdefault(source, []).append(pattern)
    return out


def fits_pattern(source: Column, line: Column, patterns: Mapping[str, Sequence[str]]) -> Column:
    """Whether a line fits a pattern of its source, ignoring case; false for null."""
    hit = F.lit(False)
    for name, listed in patterns.items():
        own = F.rlike(line, F.lit("(?i)" + "|".join(f"(?:{p})" for p in listed)))
        hit = F.when(source == name, F.coalesce(own, F.lit(False))).otherwise(hit)
    return hit
