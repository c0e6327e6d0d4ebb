"""Failures per key in windows anchored at the first failure, over a stream: the twin of workflow.anchored_windows.

State per key is two values, the count and the end of the window; it times out when the window has passed by event time.
Rows of one micro-batch are folded in order of time; a row later than the watermark has been dropped by Spark before.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "k string, t timestamp, count int, blocked boolean"
STATE = "count int, until timestamp"


def limited(events: DataFrame, key: str, at: str, failed: str, limit: int, seconds: float, late: str = "1 hour") -> DataFrame:
    """k, t, count, blocked of each failure of a streaming DataFrame."""

    def fold(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        count, until = state.get if state.exists else (0, None)
        rows = pd.concat(list(frames)).sort_values(["t", "fail"], kind="stable")
        out = []
        for t, fail in zip(rows["t"], rows["fail"], strict=True):
            if not fail:
                count, until = 0, None
                continue
            now = t.to_pydatetime()
            if until is None or now >= until:
                count, until = 0, now + timedelta(seconds=seconds)
            count += 1
            out.append((k[0], t, count, count > limit))
        if until is None:
            if state.exists:
                state.remove()
        else:
            state.update((count, until))
            state.setTimeoutTimestamp(max(int(until.timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["k", "t", "count", "blocked"]).astype({"count": "int32", "blocked": "bool"})

    rows = events.select(F.col(key).cast("string").alias("k"), F.col(at).cast("timestamp").alias("t"), F.col(failed).alias("fail")).where("k is not null and t is not null")
    return rows.withWatermark("t", late).groupBy("k").applyInPandasWithState(fold, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def counts(events: DataFrame, at: str, by: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events by key and tumbling window of event time, with a watermark."""
    rows = events.withColumn("t", F.col(at).cast("timestamp")).withWatermark("t", late)
    return rows.groupBy(F.window("t", window), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def drained(stream: DataFrame, folder: str, name: str) -> DataFrame:
    """Runs a stream over what its source holds now, into Parquet files, and reads them."""
    spark = stream.sparkSession
    out = f"{folder}/{name}"
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/{name}-state").trigger(availableNow=True).start(out)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


