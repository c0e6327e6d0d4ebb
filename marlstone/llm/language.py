"""Languages of documents and of their segments by rank-order profiles of character n-grams.

A language's profile ranks its most frequent n-grams; a segment's n-grams, ranked by their own frequency, are compared
to it by the out-of-place distance: the sum of the differences of rank, a missing n-gram counting as the profile's
length. Profiles come from a bounded sample of labelled documents (SAMPLE per language) and are trained twice: labels
are partly wrong, so the second time only sentences that the first profiles give to their label count. Sentences of
one document are then read together: a change of language costs CHANGE, so a lone doubtful sentence stays with its
neighbours.

A run of FAR_WORDS words or more that is FAR or further from every profile is in none of the languages: UNKNOWN.

Accents are dropped on both sides, since some texts lost theirs. Defined cases: texts that are null, empty or without a
sentence (a line of at least LEAST_WORDS words of letters, or one that ends like a sentence) have no segment, and a null
language as documents; equal numbers of words go to the alphabetically first language; of several texts under one
doc_id the longest counts, then the one of the greatest digest.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Notations of the languages.
NOTATIONS = {
    "en": ["en", "eng", "english"],
    "fr": ["fr", "fra", "fre", "french"],
    "es": ["es", "spa", "spanish"],
    "pt": ["pt", "por", "portuguese"],
    "de": ["de", "deu", "ger", "german"],
    "sw": ["sw", "swa", "swh", "swahili"],
}
LANGUAGES = sorted(NOTATIONS)
UNLABELLED = ["", "und", "unknown"]
SAMPLE = 400
PROFILE = 1500
LONGEST = 4
LEAST_WORDS = 4
#: Words running in a second language that make a text mixed.
RUNNING = 15
#: Mean distance from which a run of so many words is in no known language: sentences of held-out documents (sf0.1) are at
#: 0.49 at most, half of those in a language without a profile beyond 0.4 to 0.63, by how near its kin are.
UNKNOWN, FAR, FAR_WORDS = "und", 0.55, 8
#: Cost of a change of language between sentences, in words of clear evidence.
CHANGE = 2.5

_BASE = 27
_OFFSETS = np.cumsum([0, *[_BASE**n for n in range(1, LONGEST)]])
_SIZE = int(sum(_BASE**n for n in range(1, LONGEST + 1)))
_SENTENCE = re.compile(r"[^.!?\n]*(?:[.!?]+(?=\s|$)|[.!?]|\n|$)")
_SPLIT = re.compile(r"(?<=[.!?])\s+|\n")
_OTHER = re.compile("[^a-z]+")
_WORD = re.compile(r"[^\W\d_]+")


def label_code(lang: Column) -> Column:
    """Code of the language that a label names; null if there is no label, `other` if it names none of these."""
    base = F.split(F.trim(F.lower(lang)), "[-_]")[0]
    code = F.when(lang.isNull() | F.trim(F.lower(lang)).isin(UNLABELLED), F.lit(None).cast("string"))
    for key, names in NOTATIONS.items():
        code = code.when(base.isin(names), key)
    return code.otherwise("other")


def plain(text: str) -> str:
    """Letters a to z in lower case with single blanks between words."""
    text = unicodedata.normalize("NFKD", text.lower().replace("ß", "ss").replace("œ", "oe").replace("æ", "ae"))
    text = "".join(c for c in text if not unicodedata.combining(c)) if not text.isascii() else text
    return _OTHER.sub(" ", text).strip()


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Segment number and n-gram code of every n-gram of plain texts; blanks stand only at either end of an n-gram."""
    joined = "".join(f" {t} " for t in texts)
    chars = np.frombuffer(joined.encode("ascii"), dtype=np.uint8).astype(np.int32)
    codes = np.where(chars == 32, 0, chars - 96)
    segment = np.repeat(np.arange(len(texts), dtype=np.int64), [len(t) + 2 for t in texts])
    owners, out = [], []
    for n in range(1, LONGEST + 1):
        m = len(codes) - n + 1
        if m <= 0:
            continue
        code = np.zeros(m, dtype=np.int64)
        for k in range(n):
            code = code * _BASE + codes[k : m + k]
        ok = segment[:m] == segment[n - 1 :]
        for k in range(1, n - 1):
            ok &= codes[k : m + k] > 0
        if n < 3:
            ok &= codes[:m] + codes[n - 1 :] > 0
        owners.append(segment[:m][ok])
        out.append(code[ok] + _OFFSETS[n - 1])
    return np.concatenate(owners), np.concatenate(out)


def distances(texts: list[str], ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean out-of-place distance of each plain text to each profile, from 0 to 1, and the number of its n-grams."""
    n = len(texts)
    total, kinds = np.zeros((n, ranks.shape[0])), np.zeros(n)
    if not n or not any(texts):
        return total, kinds
    owner, code = grams(texts)
    key, count = np.unique(owner * _SIZE + code, return_counts=True)
    seg, code = key // _SIZE, key % _SIZE
    order = np.lexsort((-count, seg))
    seg, code, count = seg[order], code[order], count[order]
    kinds = np.bincount(seg, minlength=n)
    place = np.arange(len(seg)) - (np.cumsum(kinds) - kinds)[seg]
    # Equal counts share the mean of their ranks.
    tie = np.concatenate([[True], (seg[1:] != seg[:-1]) | (count[1:] != count[:-1])])
    group = np.cumsum(tie) - 1
    rank = (np.bincount(group, place) / np.bincount(group))[group]
    for k in range(ranks.shape[0]):
        known = ranks[k, code]
        apart = np.where(known < PROFILE, np.minimum(np.abs(rank - known), PROFILE), PROFILE)
        total[:, k] = np.bincount(seg, apart, minlength=n)
    return total / np.maximum(kinds, 1)[:, None] / PROFILE, kinds


def profiles(texts: dict[str, list[str]]) -> np.ndarray:
    """Rank of every n-gram in each language's profile; PROFILE where it isn't among the first."""
    ranks = np.full((len(LANGUAGES), _SIZE), PROFILE, dtype=np.int16)
    for k, lang in enumerate(LANGUAGES):
        if texts.get(lang):
            count = np.zeros(_SIZE, dtype=np.int64)
            for at in range(0, len(texts[lang]), 500):
                count += np.bincount(grams(texts[lang][at : at + 500])[1], minlength=_SIZE)
            top = np.argsort(-count, kind="stable")[:PROFILE]
            top = top[count[top] > 0]
            ranks[k, top] = np.arange(len(top))
    return ranks


def sentences(text: str) -> list[str]:
    """Sentences and lines of a text, in order."""
    return [s for s in _SPLIT.split(text.replace("\r", "")) if s.strip()]


def train(sample: list[tuple[str, str]]) -> np.ndarray:
    """Profiles from (code, text) pairs whose labels are mostly right."""
    pairs = [(code, plain(s)) for code, text in sample for s in sentences(text)]
    pairs = [(c, s) for c, s in pairs if s.count(" ") + 1 >= LEAST_WORDS]
    by: dict[str, list[str]] = {lang: [s for c, s in pairs if c == lang] for lang in LANGUAGES}
    ranks = profiles(by)
    given = [k for at in range(0, len(pairs), 500) for k in distances([s for _, s in pairs[at : at + 500]], ranks)[0].argmin(axis=1)]
    by = {lang: [s for (c, s), g in zip(pairs, given, strict=True) if c == lang == LANGUAGES[g]] for lang in LANGUAGES}
    return profiles(by)


def read(text: str, spans: list[str], far: np.ndarray, sizes: np.ndarray) -> list[tuple[str, int, float, str]]:
    """Segments (language, words, confidence, text) of one document: the cheapest sequence of languages of its sentences.

    far: distance of each sentence to each profile. A sentence costs its distance above the best, scaled to words.
    """
    words = sizes
    margin = np.sort(far, axis=1)
    scale = np.maximum(margin[:, -1:] - margin[:, :1], 1e-6)
    cost = (far - margin[:, :1]) / np.maximum(scale, 0.05) * np.minimum(words, 30)[:, None] * 2
    n, k = cost.shape
    best = cost[0].copy()
    back = np.zeros((n, k), dtype=np.int64)
    for i in range(1, n):
        least = int(best.argmin())
        stay = best <= best[least] + CHANGE
        back[i] = np.where(stay, np.arange(k), least)
        best = np.where(stay, best, best[least] + CHANGE) + cost[i]
    path = [int(best.argmin())]
    for i in range(n - 1, 0, -1):
        path.append(int(back[i, path[-1]]))
    path.reverse()
    out: list[tuple[str, int, float, str]] = []
    i = 0
    while i < n:
        j = i
        while j < n and path[j] == path[i]:
            j += 1
        w = words[i:j].sum()
        mean = (far[i:j] * np.maximum(words[i:j], 1)[:, None]).sum(axis=0) / max(1, np.maximum(words[i:j], 1).sum())
        odds = np.exp(-40 * (mean - mean.min()))
        lang = UNKNOWN if w >= FAR_WORDS and mean.min() > FAR else LANGUAGES[path[i]]
        out.append((lang, int(w), float(round(odds[path[i]] / odds.sum(), 4)), "\n".join(spans[i:j])))
        i = j
    return out


SEGMENTS = "doc_id bigint, n_chars int, digest bigint, segment_no int, lang string, n_words int, confidence double, text string"


def _segments(ranks: np.ndarray):  # noqa: ANN202
    def go(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            # Batches of bounded text, so that the n-gram arrays stay small.
            lengths = frame.text.str.len().cumsum() // 400_000
            for _, part in frame.groupby(lengths.to_numpy()):
                rows = []
                texts = [sentences(t) for t in part.text]
                flat = [plain(s) for t in texts for s in t]
                far, _ = distances(flat, ranks)
                n_words = np.array([len(s.split()) for s in flat])
                at = 0
                for doc_id, n, h, text, spans in zip(part.doc_id, part.n_chars, part.digest, part.text, texts, strict=True):
                    here = slice(at, at + len(spans))
                    at += len(spans)
                    if not len(spans) or not _has_sentence(spans, n_words[here]):
                        continue
                    for k, (lang, words, sure, piece) in enumerate(read(text, spans, far[here], n_words[here])):
                        rows.append((doc_id, n, h, k, lang, words, sure, piece))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in SEGMENTS.split(", ")])

    return go


def _has_sentence(spans: list[str], n_words: np.ndarray) -> bool:
    return any(n >= LEAST_WORDS and s.rstrip()[-1:] in ".!?" for s, n in zip(spans, n_words, strict=True))


def labelled_sample(documents: DataFrame, per_language: int = SAMPLE) -> list[tuple[str, str]]:
    """At most per_language labelled texts of each language, those with the least hash of their id; the only thing collected.

    They are picked on ids and labels alone, each task keeping its own first ones, before their texts are read.
    """
    known = documents.where("doc_id is not null").select("doc_id", label_code(F.col("lang")).alias("code")).where(F.col("code").isin(LANGUAGES))
    order = Window.partitionBy("code").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = known.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language).select("doc_id", "code").distinct()
    return [(r.code, r.text) for r in documents.where("text is not null").select("doc_id", "text").join(picked, "doc_id").select("code", "text").collect()]


def segments(documents: DataFrame, ranks: np.ndarray) -> DataFrame:
    """doc_id, n_chars, digest, segment_no, lang, n_words, confidence, text: runs of sentences in one language, in order.

    n_chars and digest are of the document's whole text; see chosen().
    """
    rows = documents.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.length("text").alias("n_chars"), F.xxhash64("text").alias("digest"), "text")
    return rows.mapInPandas(_segments(ranks), SEGMENTS)


def chosen(segmented: DataFrame) -> DataFrame:
    """doc_id, segment_no, lang, n_words, confidence: the segments of one text per document, the longest one."""
    row = F.struct("segment_no", "lang", "n_words", "confidence")
    # Repeated rows of a text fall together here; its segments are at most one a sentence.
    texts = segmented.groupBy("doc_id", "n_chars", "digest").agg(F.array_sort(F.collect_set(row)).alias("rows"))
    return texts.groupBy("doc_id").agg(F.max_by("rows", F.struct("n_chars", "digest")).alias("rows")).select("doc_id", F.inline("rows"))


def languages(segmented: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """doc_id, lang, confidence, n_words, also: the language of most words, and the languages of at least RUNNING words in a run.

    documents: with it, documents without a sentence come too, with a null language, confidence 0 and no words.
    """
    per_lang = chosen(segmented).groupBy("doc_id", "lang").agg(
        F.sum("n_words").alias("n"), F.max("n_words").alias("run"), F.sum(F.col("n_words") * F.col("confidence")).alias("sure")
    )
    order = F.struct(F.col("n"), -F.ascii("lang"), -F.ascii(F.substr("lang", F.lit(2))))
    out = (
        per_lang.groupBy("doc_id")
        .agg(
            F.max_by("lang", order).alias("lang"),
            F.max_by("sure", order).alias("_sure"),
            F.sum("n").alias("n_words"),
            F.array_sort(F.collect_set(F.when(F.col("run") >= RUNNING, F.col("lang")))).alias("also"),
        )
        .select("doc_id", "lang", F.round(F.col("_sure") / F.greatest("n_words", F.lit(1)), 4).alias("confidence"), "n_words", "also")
    )
    if documents is None:
        return out
    ids = documents.where("doc_id is not null").select("doc_id").distinct()
    none = F.array().cast("array<string>")
    return ids.join(out, "doc_id", "left").select(
        "doc_id", "lang", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("n_words", F.lit(0)).alias("n_words"), F.coalesce("also", none).alias("also")
    )


def found(documents: DataFrame, detected: DataFrame) -> DataFrame:
    """doc_id, kind, lang: labels that are missing or wrong, and the languages of mixed texts; UNKNOWN ones make no case."""
    detected = detected.where(F.col("lang") != UNKNOWN).withColumn("also", F.array_remove("also", UNKNOWN))
    labels = documents.select("doc_id", label_code(F.col("lang")).alias("label")).distinct()
    judged = detected.join(labels, "doc_id")
    main = F.when(F.col("label").isNull(), "missing").when(F.col("label") != F.col("lang"), "wrong")
    one = judged.select("doc_id", main.alias("kind"), "lang").where("kind is not null")
    second = F.exists("also", lambda x: x != F.col("lang"))
    several = judged.where(second).select("doc_id", F.lit("mixed").alias("kind"), F.explode(F.array_union(F.array("lang"), "also")).alias("lang"))
    return one.unionByName(several).distinct()
