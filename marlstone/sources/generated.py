"""Invented records for tests and trials: every cell follows from a seed, the record's number and the field."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Whole numbers that a field takes, from and to.
FIELDS = [("age_days", 0, 28), ("heart_rate", 90, 200), ("respiratory_rate", 20, 90), ("oxygen_saturation", 70, 100), ("gestational_age", 24, 42)]


def records(spark: SparkSession, n: int, seed: int = 1234, sparse: float = 0.0, fields: Sequence[tuple[str, int, int]] = FIELDS) -> DataFrame:
    """key, field_name, field_value of n records; a share `sparse` of the cells (in thousandths) is missing."""
    listed = F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(a).alias("low"), F.lit(b).alias("high")) for f, a, b in fields]))
    cells = spark.range(n).select("id", listed)
    number = lambda *more: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "id", "field", *more)), 1, 8), 16, 10).cast("bigint")
    value = F.col("low") + number() % (F.col("high") - F.col("low") + 1)
    kept = cells.where(number(F.lit("gap")) % 1000 >= round(sparse * 1000))
    return kept.select(F.concat(F.lit("synthetic-"), "id").alias("key"), F.col("field").alias("field_name"), value.cast("string").alias("field_value"))
