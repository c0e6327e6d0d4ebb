"""Bootstrap intervals and tests of means, with resampling weights by hash.

In draw b an observation counts as often as a Poisson number of mean one says, taken from a hash of the draw and the
observation's key: the resample size varies around n instead of being n, which no longer matters from some dozens of
observations on. An observation needs to know neither its place nor the others', so there is no sort, no join and no
group that is gathered: every task sums weights and weighted values of its own rows per arm and draw, and only those sums
move. The same draws come out on any number of executors and in any engine.

Defined cases: null values have no weight (but count in n); an arm without a value has null limits; a draw in which no
observation counts is left out; rows with one key share their weights, as the two arms of a paired test must.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEED = 1234
DRAWS = 10_000
LEVEL = 0.95
#: A prime, so that products of two residues fit 62 bits in any engine.
PRIME = (1 << 31) - 1
#: From these residues on an observation counts once, twice, ...: the Poisson distribution of mean one.
STEPS = [math.floor(PRIME * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(10)]
#: Rows of a product of rows and draws, and arms that a task sums before it hands them on.
ROWS, ARMS = 64, 100


def key_residue(key: Column, seed: int = SEED) -> Column:
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("key"), key.cast("string")))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(PRIME))


def draw_residues(draws: int, seed: int = SEED) -> np.ndarray:
    digests = (hashlib.md5(f"{seed}|draw|{b}".encode()).hexdigest() for b in range(draws))
    return np.array([int(d[:8], 16) % PRIME for d in digests], dtype=np.int64)


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME for 0 <= x < 2 ** 62."""
    x = (x & PRIME) + (x >> 31)
    x = (x & PRIME) + (x >> 31)
    return np.where(x >= PRIME, x - PRIME, x)


def weights(keys: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Weight of each key in each draw: a polynomial of both residues modulo PRIME, read as a Poisson number."""
    x = _mod(keys[:, None] * draws[None, :])
    y = _mod(_mod(x * x) * (x ^ 1) + keys[:, None])
    out = np.zeros(y.shape, dtype=np.float64)
    for step in STEPS:
        out += y >= step
    return out


def _sums(by: list[str], draws: int, seed: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def go(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = draw_residues(draws, seed)
        held: dict[tuple, np.ndarray] = {}

        def out() -> Iterator[pd.DataFrame]:
            for arm, sums in held.items():
                frame = pd.DataFrame({"draw": np.arange(draws, dtype=np.int32), "s": sums[0], "w": sums[1]})
                for k, name in enumerate(by):
                    frame.insert(k, name, pd.Series([arm[k]] * draws, dtype=object))
                yield frame
            held.clear()

        for frame in frames:
            for arm, rows in frame.groupby(by, dropna=False, sort=False):
                sums = held.setdefault(tuple(None if pd.isna(v) else v for v in arm), np.zeros((2, draws)))
                keys, values = rows["_a"].to_numpy(), rows["value"].to_numpy()
                for at in range(0, len(rows), ROWS):
                    w = weights(keys[at : at + ROWS], numbers)
                    sums += np.stack([values[at : at + ROWS] @ w, w.sum(axis=0)])
            if len(held) > ARMS:
                yield from out()
        yield from out()

    return go


def _means(scores: DataFrame, by: Sequence[str], draws: int, seed: int) -> DataFrame:
    """by, draw, m: the mean of each draw. scores: by, key, value."""
    rows = scores.where("value is not null").select(*by, key_residue(F.col("key"), seed).alias("_a"), F.col("value").cast("double").alias("value"))
    kinds = [T.StructField(n, scores.schema[n].dataType) for n in by]
    schema = T.StructType([*kinds, T.StructField("draw", T.IntegerType()), T.StructField("s", T.DoubleType()), T.StructField("w", T.DoubleType())])
    parts = rows.mapInPandas(_sums(list(by), draws, seed), schema)
    summed = parts.groupBy(*by, "draw").agg(F.sum("s").alias("s"), F.sum("w").alias("w"))
    # Sums of parts come in any order: rounded, so that equal draws are equal.
    return summed.where("w > 0").select(*by, "draw", F.round(F.col("s") / F.col("w"), 12).alias("m"))


def _joined(base: DataFrame, limits: DataFrame, by: Sequence[str]) -> DataFrame:
    same = [base[b].eqNullSafe(limits[b]) for b in by]
    return base.join(limits, same, "left").drop(*[limits[b] for b in by])


def interval(scores: DataFrame, by: Sequence[str], draws: int = DRAWS, seed: int = SEED, level: float = LEVEL) -> DataFrame:
    """by, n, mean, low, high: percentile interval of the mean of `value`."""
    tail = (1 - level) / 2
    limits = _means(scores, by, draws, seed).groupBy(*by).agg(F.percentile("m", F.lit(tail)).alias("low"), F.percentile("m", F.lit(1 - tail)).alias("high"))
    return _joined(scores.groupBy(*by).agg(F.count("*").alias("n"), F.avg("value").alias("mean")), limits, by)


def paired_test(pairs: DataFrame, by: Sequence[str], draws: int = DRAWS, seed: int = SEED, level: float = LEVEL) -> DataFrame:
    """by, n, delta, low, high, p: interval of the mean of a - b over shared draws, and the two-sided p value: twice the share
    of draws on the other side of 0, ties included, 1 at most; equal arms give 1."""
    diffs = pairs.withColumn("value", F.col("a") - F.col("b"))
    base = diffs.groupBy(*by).agg(F.count("*").alias("n"), F.avg("value").alias("delta"))
    tail = (1 - level) / 2
    limits = _means(diffs, by, draws, seed).groupBy(*by).agg(
        F.percentile("m", F.lit(tail)).alias("low"), F.percentile("m", F.lit(1 - tail)).alias("high"),
        F.avg((F.col("m") <= 0).cast("double")).alias("_below"), F.avg((F.col("m") >= 0).cast("double")).alias("_above"),
    )
    other = F.when(F.col("delta") > 0, F.col("_below")).when(F.col("delta") < 0, F.col("_above")).when(F.col("delta") == 0, F.lit(1.0))
    return _joined(base, limits, by).withColumn("p", F.when(other.isNotNull(), F.least(F.lit(1.0), 2 * other))).drop("_below", "_above")


def interval_numpy(scores: DataFrame, by: str, draws: int = DRAWS, seed: int = SEED, level: float = LEVEL) -> DataFrame:
    """by, n, mean, low, high with numpy's generator, one arm a task: for arms of thousands of scores, not of millions."""

    def go(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        values = frame.sort_values("key").value.to_numpy()
        rng = np.random.default_rng(seed)
        means = np.concatenate([values[rng.integers(0, len(values), (min(500, draws - at), len(values)))].mean(axis=1) for at in range(0, draws, 500)])
        low, high = np.quantile(means, [(1 - level) / 2, (1 + level) / 2])
        return pd.DataFrame({by: [key[0]], "n": [len(values)], "mean": [values.mean()], "low": [low], "high": [high]})

    kind = dict(scores.dtypes)[by]
    return scores.groupBy(by).applyInPandas(go, f"{by} {kind}, n bigint, mean double, low double, high double")
