"""Joins that have no key of their own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of the larger side that a block holds.
BLOCK = 100_000
#: Ways over which a hot key of the larger side is spread.
SALTS = 16


def against_all(few: DataFrame, many: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every row of few with every row of many, in blocks: many is counted and dealt to blocks of about `block` rows by a hash
    of its row, few goes to each block, and both meet on the block. For a stated set of queries or settings against all
    rows; the result has |few| * |many| rows by nature, but no task holds more than a block of them.
    """
    blocks = max(1, -(-many.count() // block))
    dealt = many.withColumn("_block", F.pmod(F.xxhash64(*many.columns), F.lit(blocks)).cast("int"))
    spread = few.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return spread.join(dealt, "_block").drop("_block")


def salted(large: DataFrame, small: DataFrame, on: Sequence[str], spread: Sequence[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """large joined with small on columns of which one value may hold a third of large: its rows are spread over `salts`
    ways by a hash of the columns `spread`, and small, one row or few per key, stands in each of them.

    The planner may still broadcast small where its size is known to be small. how: inner, left, left_anti or left_semi.
    """
    dealt = large.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    every = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(every, [*on, "_salt"], how).drop("_salt")
