"""Replays of logs: supersession, ratings, queues, anchored windows, hash chains, digests."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.filters import retrievable
from marlstone.operators.joins import against_all
from marlstone.session import cut


def superseded(versions: DataFrame) -> DataFrame:
    """versions (document_id, version_id, label, effective_date) with current: the newest of a document.

    Dated beats undated, then the later date, then the greater label, then the greater id.
    """
    order = Window.partitionBy("document_id").orderBy(F.col("effective_date").desc_nulls_last(), F.col("label").desc_nulls_last(), F.col("version_id").desc())
    return versions.withColumn("current", F.row_number().over(order) == 1)


def archived(rounds: DataFrame, needed: int = 3) -> DataFrame:
    """result_id, n_raters, archived_at: the time of the needed-th rater's first round; null until then. rounds: result_id,
    rater_id, at. Raters after that come too late."""
    first = rounds.groupBy("result_id", "rater_id").agg(F.min("at").alias("at"))
    nth = F.row_number().over(Window.partitionBy("result_id").orderBy("at", "rater_id"))
    placed = first.withColumn("nth", nth)
    return placed.groupBy("result_id").agg(F.least(F.count("*"), F.lit(needed)).alias("n_raters"), F.min(F.when(F.col("nth") == needed, F.col("at"))).alias("archived_at"))


def queue(results: DataFrame, rounds: DataFrame, raters: DataFrame, started: tuple[int, int] = (1, 2)) -> DataFrame:
    """rater_id, result_id, n_raters of open results that a rater hasn't rated: started ones hide fresh ones.

    results: result_id, created_at; raters are a fixed list of people.
    """
    rated = rounds.select("rater_id", "result_id").distinct()
    counts = rated.groupBy("result_id").agg(F.count("*").alias("n_raters"))
    open_results = cut(results.join(counts, "result_id", "left").fillna(0, ["n_raters"]).where(F.col("n_raters") <= started[1]))
    begun = F.col("n_raters").between(*started)
    # A rater who has rated every begun result sees the fresh ones: that is told by counts, before anything is paired.
    n_begun = open_results.where(begun).count()
    own = rated.join(open_results.where(begun).select("result_id"), "result_id").groupBy("rater_id").agg(F.count("*").alias("n_own"))
    people = raters.select("rater_id").distinct().join(own, "rater_id", "left")
    people = people.select("rater_id", (F.coalesce("n_own", F.lit(0)) < n_begun).alias("_begun"))
    waiting = against_all(people.where("_begun").select("rater_id"), open_results.where(begun))
    fresh = against_all(people.where("not _begun").select("rater_id"), open_results.where(~begun))
    left = waiting.unionByName(fresh).join(rated, ["rater_id", "result_id"], "left_anti")
    return left.select("rater_id", "result_id", "n_raters", "created_at")


def batch_plan(results: DataFrame, rounds: DataFrame, batches: DataFrame, raters: DataFrame, size: int = 12, needed: int = 3) -> DataFrame:
    """rater_id, mode, place, result_id: what each rater is offered next.

    Results begun by others come first (in_progress, oldest first). Else the rater's current batch: its unrated open items,
    and for every item that others archived a fresh one behind them (batch). Else a new batch of fresh ones (new), picked by
    how few batches hold them, then age, and shown oldest first. Fresh are open results that nobody rated and that never
    were in the rater's batches. results: result_id, created_at; rounds: result_id, rater_id; batches: rater_id, batch_no,
    position, result_id. Only the head of the fresh ones meets the raters: as long as a batch and the longest list of items
    ever assigned to one rater.
    """
    rated = cut(rounds.select("rater_id", "result_id").distinct())
    counts = rated.groupBy("result_id").agg(F.count("*").alias("n_raters"))
    assigned = batches.groupBy("result_id").agg(F.count_distinct("rater_id").alias("n_batches"))
    every = results.join(counts, "result_id", "left").join(assigned, "result_id", "left").fillna(0, ["n_raters", "n_batches"])
    open_ = cut(every.where(F.col("n_raters") < needed))
    people = cut(raters.select("rater_id").distinct())

    def numbered(rows: DataFrame, mode: str, *order: Column | str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("rater_id").orderBy(*order))
        return rows.select("rater_id", F.lit(mode).alias("mode"), place.alias("place"), "result_id")

    begun = against_all(people, open_.where("n_raters > 0").select("result_id", "created_at")).join(rated, ["rater_id", "result_id"], "left_anti")
    first = cut(numbered(begun, "in_progress", F.col("created_at").asc_nulls_last(), "result_id"))
    people = cut(people.join(first.select("rater_id").distinct(), "rater_id", "left_anti"))

    ever = batches.select("rater_id", "result_id").distinct()
    longest = ever.groupBy("rater_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0  # one number
    order = [F.col("n_batches"), F.col("created_at").asc_nulls_last(), F.col("result_id")]
    head = open_.where("n_raters = 0").orderBy(*order).limit(size + longest)
    offered = against_all(people, head.select("result_id", "created_at", "n_batches")).join(ever, ["rater_id", "result_id"], "left_anti")
    fresh = cut(offered.withColumn("nth", F.row_number().over(Window.partitionBy("rater_id").orderBy(*order))))

    latest = batches.groupBy("rater_id").agg(F.max("batch_no").alias("batch_no"))
    items = people.join(batches, "rater_id").join(latest, ["rater_id", "batch_no"])
    items = items.join(rated.withColumn("_mine", F.lit(True)), ["rater_id", "result_id"], "left").join(open_.select("result_id", F.lit(True).alias("_open")), "result_id", "left")
    left = cut(items.where("_mine is null"))
    drops = left.where("_open is null").groupBy("rater_id").agg(F.count("*").alias("n_drop"))
    remaining = left.where("_open").select("rater_id", "result_id", F.lit(0).alias("part"), F.col("position").cast("bigint").alias("at"))
    added = fresh.join(drops, "rater_id").where("nth <= n_drop").select("rater_id", "result_id", F.lit(1).alias("part"), F.col("nth").cast("bigint").alias("at"))
    batch = cut(numbered(remaining.unionByName(added), "batch", "part", "at", "result_id"))
    picks = fresh.where(F.col("nth") <= size).join(batch.select("rater_id").distinct(), "rater_id", "left_anti")
    return first.unionByName(batch).unionByName(numbered(picks, "new", F.col("created_at").asc_nulls_last(), "result_id"))


def anchored_windows(events: DataFrame, key: str, at: str, failed: str, limit: int, seconds: float) -> DataFrame:
    """key, at, count, blocked of each failure: a window opens at a key's first failure and lasts so many seconds; a success
    closes it. Rows of a key are folded in order over sorted partitions, with three numbers of state."""
    kinds = dict(events.dtypes)

    def go(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, count, until = None, 0, None
        for frame in frames:
            out = []
            for k, t, fail in zip(frame["k"], frame["t"], frame["fail"], strict=True):
                if k != current:
                    current, count, until = k, 0, None
                if not fail:
                    count, until = 0, None
                    continue
                if until is None or t >= until:
                    count, until = 0, t + pd.Timedelta(seconds=seconds)
                count += 1
                out.append((k, t, count, count > limit))
            yield pd.DataFrame(out, columns=["k", "t", "count", "blocked"]).astype({"count": "int32", "blocked": "bool"})

    rows = events.select(F.col(key).alias("k"), F.col(at).alias("t"), F.col(failed).alias("fail")).where("k is not null and t is not null")
    ordered = rows.repartition("k").sortWithinPartitions("k", "t", "fail")
    return ordered.mapInPandas(go, f"k {kinds[key]}, t {kinds[at]}, count int, blocked boolean").select(F.col("k").alias(key), F.col("t").alias(at), "count", "blocked")


def replayed(log: DataFrame, transitions: Sequence[tuple[str, str, str]], start: str, entity: str, order: Sequence[str], action: str) -> DataFrame:
    """log with before, after, accepted: the actions of each entity replayed in order from the state `start`.

    transitions: (state, action, next state), a settings list. An action that the state doesn't allow is refused and changes
    nothing. The rows of an entity pass through one sorted task as a stream, with its state alone in memory.
    """
    table = {(state, name): after for state, name, after in transitions}
    columns = log.columns

    def go(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current: object = None
        seen = False
        state = start
        for frame in frames:
            before, after, accepted = [], [], []
            for key, name in zip(frame[entity], frame[action], strict=True):
                if not seen or key != current:
                    current, state, seen = key, start, True
                to = table.get((state, name))
                before.append(state)
                accepted.append(to is not None)
                state = state if to is None else to
                after.append(state)
            yield frame.assign(before=before, after=after, accepted=accepted)

    rows = log.where(F.col(entity).isNotNull()).repartition(entity).sortWithinPartitions(entity, *order)
    kinds = ", ".join(f"`{n}` {t}" for n, t in log.dtypes)
    return rows.mapInPandas(go, f"{kinds}, before string, after string, accepted boolean").select(*columns, "before", "after", "accepted")


def validity(replay: DataFrame, entity: str, at: str, order: Sequence[str], closed: Sequence[str]) -> DataFrame:
    """entity, state, n_accepted, n_refused, valid_to: where a replay ended; valid_to is the time of the accepted action that
    brought a closed state, null while the entity is open. Rows are never deleted, so the log remains the history."""
    last = F.max_by("after", F.struct(*order))
    ended = F.max(F.when(F.col("accepted") & F.col("after").isin(list(closed)), F.col(at)))
    out = replay.groupBy(entity).agg(last.alias("state"), F.count_if("accepted").alias("n_accepted"), F.count_if(~F.col("accepted")).alias("n_refused"), ended.alias("_ended"))
    return out.withColumn("valid_to", F.when(F.col("state").isin(list(closed)), F.col("_ended"))).drop("_ended")


def synced(chunks: DataFrame, versions: DataFrame, withdrawn: DataFrame) -> DataFrame:
    """chunks (document_version_id, review_status, ...) with status, that of their version after withdrawals (unknown without
    one), and whether they may be retrieved."""
    gone = withdrawn.select("document_version_id", F.lit(True).alias("_gone")).distinct()
    now = versions.join(gone, "document_version_id", "left")
    now = now.select("document_version_id", F.when(F.col("_gone"), "withdrawn").otherwise(F.col("status")).alias("status"))
    out = chunks.join(now, "document_version_id", "left").withColumn("status", F.coalesce("status", F.lit("unknown")))
    return out.withColumn("retrievable", F.coalesce(retrievable(), F.lit(False)))


def compared_gaps(pinned: Mapping[str, int], current: DataFrame) -> DataFrame:
    """name, now, pinned, level of current (name, n): a count above its pin fails, another that isn't 0 warns, 0 is fine; what
    isn't pinned is pinned at 0."""
    pin = F.lit(0)
    for name, n in pinned.items():
        pin = F.when(F.col("name") == name, n).otherwise(pin)
    level = F.when(F.col("n") > pin, "fail").when(F.col("n") > 0, "warn").otherwise("ok")
    return current.select("name", F.col("n").alias("now"), pin.cast("bigint").alias("pinned"), level.alias("level"))


GENESIS = "0" * 64


def link_hash(previous: Column, payload: Column) -> Column:
    return F.sha2(F.concat(previous, payload), 256)


def chained(rows: DataFrame, order: str, payload: Column) -> DataFrame:
    """rows with prev_hash and row_hash; a chain is sequential by nature, so its rows pass through one sorted task as a stream."""
    import hashlib

    def go(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = GENESIS
        for frame in frames:
            before, hashes = [], []
            for text in frame["payload"]:
                before.append(last)
                last = hashlib.sha256((last + text).encode()).hexdigest()
                hashes.append(last)
            yield frame.assign(prev_hash=before, row_hash=hashes)

    picked = rows.select(F.col(order).alias("seq"), payload.alias("payload")).repartition(1).sortWithinPartitions("seq")
    return picked.mapInPandas(go, f"seq {dict(rows.dtypes)[order]}, payload string, prev_hash string, row_hash string")


def broken(chain: DataFrame, block: int = 100_000) -> DataFrame:
    """seq of rows whose hash or link is wrong. Each row needs only the row before, see preceded()."""
    placed = preceded(chain, "seq", "row_hash", "_prev", block)
    right = F.coalesce("_prev", F.lit(GENESIS))
    return placed.where((F.col("prev_hash") != right) | (F.col("row_hash") != link_hash(F.col("prev_hash"), F.col("payload")))).select("seq")


def preceded(rows: DataFrame, order: str, value: str, name: str, block: int = 100_000) -> DataFrame:
    """rows with the value of the row before in one order over all rows (whole numbers, no two alike); null for the first.

    The window runs over blocks of the order; a block's first row takes the last row of the block before, looked up the
    same way among the blocks, so no window ever spans more than a block.
    """
    blocked = rows.withColumn("_b", F.floor(F.col(order) / block))
    lasts = cut(blocked.groupBy("_b").agg(F.max_by(value, order).alias("_last")))
    if lasts.count() <= block:
        before = lasts.select("_b", F.lag("_last").over(Window.orderBy("_b")).alias("_carried"))
    else:
        above = lasts.select(F.col("_b").alias("_at"), "_last")
        before = preceded(above, "_at", "_last", "_outer", block).select(F.col("_at").alias("_b"), F.col("_outer").alias("_carried"))
    within = F.lag(value).over(Window.partitionBy("_b").orderBy(order))
    return blocked.withColumn("_within", within).join(before, "_b").withColumn(name, F.coalesce("_within", "_carried")).drop("_b", "_within", "_carried")


def table_digest(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """n, digest: order-free digest of a table of any size, the sum of 60-bit row hashes."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns])
    h = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(h), F.lit(0).cast("decimal(38,0)")).cast("string").alias("digest"))
