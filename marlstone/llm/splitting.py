"""Cutting oversized texts into pieces under a limit of words, at natural boundaries, with an exact overlap.

Content-defined chunking: a rolling hash over the last words gives every place in the text a value of its own; within
the allowed range the place of the least value is the landmark, and the cut snaps to the natural boundary nearest to
it. An edit moves only the cuts near it: later landmarks are the same places of the same text.

Defined cases: null or blank text gives no piece; a text within its limit is one piece, unchanged; a null or impossible
limit leaves the text whole; a null overlap is 0, one that leaves no room for new words is cut to limit - 1; repeated
rows give one set of pieces; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.lines import word_count

#: White space of any kind, as in marlstone.functions.lines.
_WORD = re.compile("[^\t-\r \x85\xa0  -     　]+")
_BLANK_LINE = re.compile(r"(?:\r\n|\r|\n)[ \t\xa0]*(?:\r\n|\r|\n)")
WINDOW = 8
#: Least share of the room for new words that a piece uses, the last piece aside.
LEAST_FILL = 0.5
PIECES = "chunk_id string, chunk_type string, piece_no int, n_pieces int, char_start int, char_end int, new_from int, boundary string, token_count int, text string"
# Kinds of boundary, best first.
KINDS = ["paragraph", "sentence", "line", "clause", "word"]


def boundaries(text: str, spans: list[tuple[int, int]]) -> list[int]:
    """For each word, the rank in KINDS of the boundary after it."""
    ranks = []
    for i, (start, end) in enumerate(spans):
        gap = text[end : spans[i + 1][0]] if i + 1 < len(spans) else "\n\n"
        last = text[start:end].rstrip("\"')]»”’")[-1:]
        if _BLANK_LINE.search(gap):
            ranks.append(0)
        elif last and last in ".!?…":
            ranks.append(1)
        elif "\n" in gap or "\r" in gap:
            ranks.append(2)
        elif last and last in ";:,":
            ranks.append(3)
        else:
            ranks.append(4)
    return ranks


def landmarks(words: list[str]) -> list[int]:
    """Rolling hash of the WINDOW words that end at each place."""
    base, mask = 0x9E3779B97F4A7C15, (1 << 64) - 1
    top = pow(base, WINDOW, 1 << 64)
    codes = [crc32(w.encode()) + 1 for w in words]
    out, h = [], 0
    for i, c in enumerate(codes):
        h = (h * base + c) & mask
        if i >= WINDOW:
            h = (h - codes[i - WINDOW] * top) & mask
        x = (h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 & mask
        out.append(x ^ (x >> 32))
    return out


def cuts(text: str, most: int, overlap: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
    """Spans of the words, and (first word, first new word, end word) of each piece."""
    spans = [m.span() for m in _WORD.finditer(text)]
    n = len(spans)
    if n <= most or most < 1:
        return spans, [(0, 0, n)] if n else []
    overlap = max(0, min(overlap, most - 1))
    ranks, marks = boundaries(text, spans), landmarks([text[a:b] for a, b in spans])
    pieces, at = [], 0
    while at < n:
        back = min(overlap, at)
        room = most - back
        if n - at <= room:
            pieces.append((at - back, at, n))
            break
        # The first piece is long enough to hold the next one's overlap.
        low, high = at + max(1, int(room * LEAST_FILL), overlap - at), at + room
        places = range(low, high + 1)  # a cut at p: words before p belong to this piece
        mark = min(places, key=lambda p: marks[p - 1])
        for rank in ([0, 1], [2], [3], [4]):
            fitting = [p for p in places if ranks[p - 1] in rank]
            if fitting:
                break
        end = min(fitting, key=lambda p: (abs(p - mark), p))
        pieces.append((at - back, at, end))
        at = end
    return spans, pieces


def _split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for row in frame.itertuples(index=False):
            spans, pieces = cuts(row.text, int(row.most), int(row.overlap))
            ranks = boundaries(row.text, spans)
            for k, (first, new, end) in enumerate(pieces):
                start, stop = spans[first][0], spans[end - 1][1]
                rows.append((row.chunk_id, row.chunk_type, k, len(pieces), start, stop, spans[new][0], KINDS[ranks[end - 1]], end - first, row.text[start:stop]))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")])


def pieces(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """chunk_id, chunk_type, piece_no, n_pieces, char_start, char_end, new_from, boundary, token_count, text.

    new_from is where the piece's new words begin; text from char_start to there repeats the end of the piece before.
    Only texts over their limit go through Python; the limit table is fixed and small, so the planner broadcasts it.
    """
    limits = limits.groupBy("chunk_type").agg(F.min("max_tokens").alias("most"), F.max("overlap_tokens").alias("overlap"))
    rows = (
        chunks.select("chunk_id", "chunk_type", "text")
        .dropDuplicates(["chunk_id", "chunk_type", "text"])
        .withColumn("n_words", word_count(F.col("text")))
        .where("n_words > 0")
        .join(limits, "chunk_type", "left")
    )
    over = F.coalesce((F.col("most") >= 1) & (F.col("n_words") > F.col("most")), F.lit(False))
    cut = (
        rows.where(over)
        .select("chunk_id", "chunk_type", "text", "most", F.coalesce("overlap", F.lit(0)).alias("overlap"))
        .mapInPandas(_split, PIECES)
    )
    n = F.length("text")
    whole = rows.where(~over).select(
        "chunk_id", "chunk_type", F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("char_start"),
        n.alias("char_end"), F.lit(0).alias("new_from"), F.lit("paragraph").alias("boundary"),
        F.col("n_words").alias("token_count"), "text",
    )
    return cut.unionByName(whole)


def oversized(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """chunk_id of each text that had to be cut."""
    return pieces(chunks, limits).where("n_pieces > 1 and chunk_id is not null").select("chunk_id").distinct()
