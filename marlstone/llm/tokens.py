"""Token counts by a public tokenizer, read from a path on every executor."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rank file of a byte-level BPE vocabulary; a parameter of every query that counts tokens.
VOCABULARY = os.environ.get("MARLSTONE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the public pattern that parts texts before byte pairs merge.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_loaded: dict = {}


def encoding(path: str = VOCABULARY):  # noqa: ANN201
    """The encoder of a rank file, loaded once per process."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def counter(path: str = VOCABULARY):  # noqa: ANN201
    """A column function: the number of tokens of a text, 0 for null."""

    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoding(path).encode_ordinary
        for batch in texts:
            yield batch.map(lambda t: len(encode(t)) if t else 0).astype("int32")

    return F.pandas_udf(count, T.IntegerType())


def one_text(documents: DataFrame) -> DataFrame:
    """documents, one row per doc_id: the longest text (then the greatest digest), null ids and texts left out.

    Rows meet by doc_id, the key that a later join by doc_id uses as well.
    """
    rows = documents.where("doc_id is not null and text is not null")
    marked = rows.withColumn("_v", F.struct(F.length("text").alias("n"), F.xxhash64("text").alias("h")))
    best = marked.groupBy("doc_id").agg(F.max("_v").alias("_best"))
    return marked.join(best, "doc_id").where(F.col("_v") == F.col("_best")).drop("_v", "_best").dropDuplicates(["doc_id"])


def sized(documents: DataFrame, text: Column, path: str = VOCABULARY) -> DataFrame:
    """doc_id, source, n_tokens, one row per doc_id with a text of at least one token; the largest of repeated rows."""
    counted = documents.where("doc_id is not null").select("doc_id", "source", counter(path)(text).alias("n_tokens"))
    best = F.max(F.struct("n_tokens", "source"))
    return counted.where("n_tokens > 0").groupBy("doc_id").agg(best.alias("b")).select("doc_id", "b.source", "b.n_tokens")
