"""Document scans whose parser is given from outside, and settings that must be complete.

No parser or model is bundled: a scan takes a function from bytes to pages, an encoder takes a loader; both run in
Python workers over Arrow batches and load once per process.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The form in which the output of a layout parser is taken.
LAYOUT_LINES = "document string, page_no int, line_no int, text string, x0 double, top double, x1 double, bottom double, from_ocr boolean, confidence double"


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text of whole text files."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def parsed_files(spark: SparkSession, path: str, pages_of: Callable[[bytes], Sequence[str]], glob: str = "*") -> DataFrame:
    """path, page_no, text, error of binary files through a parser; a file it can't read gives one row with page 0, no text and
    what the parser said."""

    def go(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, content in zip(frame.path, frame.content, strict=True):
                try:
                    rows += [(name, n, text, None) for n, text in enumerate(pages_of(bytes(content)), 1)]
                except Exception as error:  # noqa: BLE001 - a parser's failure is that file's result
                    rows.append((name, 0, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["path", "page_no", "text", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")
    return files.mapInPandas(go, "path string, page_no int, text string, error string")


def laid_out_files(spark: SparkSession, path: str, lines_of: Callable[[bytes], Iterator[tuple]], glob: str = "*") -> DataFrame:
    """The lines (LAYOUT_LINES) that a layout parser finds in binary files; a file it can't read gives none."""
    names = [c.split()[0] for c in LAYOUT_LINES.split(", ")]

    def go(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame.content:
                try:
                    rows = list(lines_of(bytes(content)))
                except Exception:  # noqa: BLE001
                    rows = []
                yield pd.DataFrame(rows, columns=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("content")
    return files.mapInPandas(go, LAYOUT_LINES)


def encoder(load: Callable[[], Callable[[list[str]], list[list[float]]]]) -> Callable[[Column], Column]:
    """A column function text -> vector; the model loads once per worker."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            yield pd.Series(model([t or "" for t in batch]))

    return encode


def reranker(load: Callable[[], Callable[[list[tuple[str, str]]], list[float]]]) -> Callable[[Column, Column], Column]:
    """A column function (query, passage) -> score; the model loads once per worker and sees a batch of pairs at a time."""

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for queries, passages in batches:
            yield pd.Series(model([(q or "", p or "") for q, p in zip(queries, passages, strict=True)]), dtype="float64")

    return score


class Incomplete(ValueError):
    """A setting is missing, blank or a placeholder."""


def attested(entries: Sequence[Mapping[str, object]], required: Sequence[str], unique: str) -> list[dict[str, object]]:
    """Entries of a settings file if every one has all required fields, none blank or TODO, and the key is unique; else Incomplete."""
    seen = set()
    for n, entry in enumerate(entries):
        for name in required:
            value = entry.get(name)
            if value is None or not str(value).strip() or str(value).strip().upper().startswith("TODO"):
                raise Incomplete(f"entry {n}: {name}")
        if entry[unique] in seen:
            raise Incomplete(f"entry {n}: {unique} {entry[unique]!r} again")
        seen.add(entry[unique])
    return [dict(e) for e in entries]
