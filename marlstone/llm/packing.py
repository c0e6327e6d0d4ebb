"""Filling sequences of fixed capacity with texts: cost-balanced packing.

A text costs linear plus quadratic attention: LINEAR * n + QUADRATIC * n ** 2. Texts go in descending size, those of one
size together, to the sequences of the lowest cost that have room for them, save that a text which fills a sequence
almost exactly goes there;
of several trials, with a few more sequences opened at the start or a wider meaning of almost, the fullest counts. Only a text larger than the capacity is cut: into full sequences, and a
rest that is packed like a text.

Items are dealt to shards of about SHARD items by a hash of their id, and each shard is packed by itself, so no task
sees more than that; a shard leaves at most about one sequence half full more than one packing of everything would.

Defined cases: null and empty texts have no tokens and no place; repeated rows of one doc_id count once; a null or
non-positive capacity packs nothing; equal sizes are taken by id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.tokens import VOCABULARY, encoding, one_text
from marlstone.session import small_rows

LINEAR, QUADRATIC = 1.0, 1.0 / 4096
SHARD = 20_000
#: Container sizes are a settings table; a larger one is an error.
MOST_CONTAINERS = 1000
#: Trials: sequences opened at the start over the least possible number, and the part of the capacity that counts as full.
OPENED = (1.0, 1.003, 1.01)
CLOSE = (256, 32)


def _bulk(room: np.ndarray, cost: np.ndarray, n: int, price: float, k: int) -> np.ndarray:
    """How many of k items of size n each sequence takes, lowest cost first; a taken item raises a sequence's cost by `price`.

    That order is the merge of one rising row of costs per sequence, so the k least of all rows are the picks.
    """
    fits = np.minimum(room // n, k)
    open_ones = np.flatnonzero(fits > 0)
    if len(open_ones) > k:
        # Only the k cheapest sequences can take one of k items.
        open_ones = np.sort(open_ones[np.argsort(cost[open_ones], kind="stable")[:k]])
    times = fits[open_ones]
    owner = np.repeat(open_ones, times)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(times) - times, times)
    picked = owner[np.argsort(cost[owner] + nth * price, kind="stable")[:k]]
    return np.bincount(picked, minlength=len(room))


def balanced(sizes: np.ndarray, capacity: int, opened: int, close: int) -> tuple[np.ndarray, int, float]:
    """Sequence of each size (given in descending order), the number of sequences in the end, and their spread of cost.

    Items of one size are placed together: first one each where they fill a sequence but for `close` tokens, cheapest
    sequences first, the others by lowest cost with room; what fits nowhere opens sequences.
    """
    room = np.full(len(sizes) + opened, -1, dtype=np.int64)
    room[:opened] = capacity
    cost = np.zeros(len(room))
    place = np.empty(len(sizes), dtype=np.int64)
    m, at = opened, 0
    distinct, counts = np.unique(-sizes, return_counts=True)
    for n, k in zip((-distinct).tolist(), counts.tolist()):
        price = LINEAR * n + QUADRATIC * float(n) * float(n)
        left = room[:m] - n
        exact = np.flatnonzero((left >= 0) & (left <= close))
        exact = exact[np.argsort(cost[exact], kind="stable")[:k]]
        room[exact] -= n
        cost[exact] += price
        place[at : at + len(exact)] = exact
        at, k = at + len(exact), k - len(exact)
        if k:
            took = _bulk(room[:m], cost[:m], n, price, k)
            rest = k - int(took.sum())
            if rest:
                more = -(-rest // (capacity // n))
                room[m : m + more] = capacity
                took = np.concatenate([took, np.diff(np.append(np.arange(more) * (capacity // n), rest))])
                m += more
            room[:m] -= took * n
            cost[:m] += took * price
            place[at : at + k] = np.repeat(np.arange(m), took)
            at += k
    return place, m, float(cost[:m].std() / max(cost[:m].mean(), 1e-9))


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Sequence of each size in descending order: of the trials the one with the fewest sequences, then the least spread."""
    low = max(1, math.ceil(sizes.sum() / capacity))
    trials = [balanced(sizes, capacity, math.ceil(low * more), capacity // part) for more in OPENED for part in CLOSE]
    return min(trials, key=lambda t: t[1:])[0]


PLACES = "container string, capacity int, sequence_id string, doc_id bigint, piece_no int, token_from int, n_tokens int"


def _pack_shard(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    container, capacity, shard = key
    frame = frame.sort_values(["n_tokens", "doc_id", "piece_no"], ascending=[False, True, True], kind="stable")
    place = pack(frame.n_tokens.to_numpy(), int(capacity))
    out = frame[["container", "capacity"]].copy()
    out["sequence_id"] = [f"{shard}-{p}" for p in place]
    for c in ("doc_id", "piece_no", "token_from", "n_tokens"):
        out[c] = frame[c]
    return out


def packed(sized: DataFrame, containers: DataFrame, shard: int = SHARD) -> DataFrame:
    """container, capacity, sequence_id, doc_id, piece_no, token_from, n_tokens: the place of every text or piece.

    sized: doc_id, n_tokens (written once; counted here to choose the number of shards).
    """
    shards = max(1, math.ceil(sized.count() / shard))
    specs = containers.where("capacity_tokens > 0 and container is not null").groupBy("container").agg(F.min("capacity_tokens").alias("capacity"))
    boxes = [F.struct(F.lit(r.container).alias("container"), F.lit(r.capacity).alias("capacity")) for r in sorted(small_rows(specs, MOST_CONTAINERS))]
    items = sized.select("doc_id", "n_tokens", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"))
    kind = "array<struct<container:string,capacity:int>>"
    crossed = items.select("*", F.inline(F.array(*boxes).cast(kind)))
    full = F.floor(F.col("n_tokens") / F.col("capacity")).cast("int")
    rest = (F.col("n_tokens") % F.col("capacity")).cast("int")
    whole = crossed.where(full > 0).select(
        "container", "capacity", "doc_id", F.explode(F.sequence(F.lit(0), full - 1)).alias("piece_no")
    )
    whole = whole.select(
        "container", "capacity", F.concat(F.lit("d"), "doc_id", F.lit("-"), "piece_no").alias("sequence_id"), "doc_id", "piece_no",
        (F.col("piece_no") * F.col("capacity")).cast("int").alias("token_from"), F.col("capacity").cast("int").alias("n_tokens"),
    )
    loose = crossed.where(rest > 0).select(
        "container", F.col("capacity").cast("int").alias("capacity"), "shard", "doc_id", full.alias("piece_no"),
        (full * F.col("capacity")).cast("int").alias("token_from"), rest.alias("n_tokens"),
    )
    fitted = loose.groupBy("container", "capacity", "shard").applyInPandas(_pack_shard, PLACES)
    return whole.select(fitted.columns).unionByName(fitted)


def fill(places: DataFrame) -> DataFrame:
    """container, capacity, n_sequences, n_items, n_tokens, filled, cost_spread: how full the sequences of each size are."""
    cost = F.col("n_tokens") * LINEAR + F.col("n_tokens") * F.col("n_tokens") * QUADRATIC
    per = places.groupBy("container", "capacity", "sequence_id").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("items"), F.sum(cost).alias("cost"))
    return per.groupBy("container", "capacity").agg(
        F.count("*").alias("n_sequences"), F.sum("items").alias("n_items"), F.sum("used").alias("n_tokens"),
        (F.sum("used") / (F.count("*") * F.first("capacity"))).alias("filled"), (F.stddev_pop("cost") / F.avg("cost")).alias("cost_spread"),
    )


def with_text(places: DataFrame, documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """places with the text of each piece; only cut texts are encoded again. Pieces that end within a character keep the
    replacement mark for its parts.

    Of several texts under one doc_id the longest counts.
    """

    def cut_out(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = encoding(path)
        for frame in frames:
            texts = []
            for row in frame.itertuples(index=False):
                ids = code.encode_ordinary(row.text)[row.token_from : row.token_from + row.n_tokens]
                texts.append(code.decode_bytes(ids).decode("utf-8", "replace"))
            yield frame.assign(text=texts)

    texts = one_text(documents).select("doc_id", "text")
    joined = places.join(texts, "doc_id").select(*places.columns, "text")
    is_part = (F.col("token_from") > 0) | (F.col("n_tokens") >= F.col("capacity"))
    schema = PLACES + ", text string"
    return joined.where(~is_part).unionByName(joined.where(is_part).mapInPandas(cut_out, schema))
