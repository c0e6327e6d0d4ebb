"""Chance-corrected agreement of ordinal ratings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABELS = range(1, 6)


def alpha(scores: DataFrame, by: list[str]) -> DataFrame:
    """by columns, alpha, n_items, n_raters of live scores (result_id, domain_code, rater_id, score).

    The coincidences of an item follow from its counts per label, at most 25 rows an item; nothing is paired by rater.
    Items with one score carry no agreement. All labels equal is 1, no item with two scores is 0.
    """
    item = [*by, "result_id", "domain_code"] if "domain_code" not in by else [*by, "result_id"]
    labels = list(LABELS)
    counts = [F.sum((F.col("score") == k).cast("double")).alias(f"c{k}") for k in labels]
    per_item = scores.groupBy(*item).agg(*counts, F.count("*").alias("m"))
    usable = F.col("m") > 1
    cells = [
        F.sum(F.when(usable, F.col(f"c{c}") * (F.col(f"c{k}") - (1 if c == k else 0)) / (F.col("m") - 1)).otherwise(0.0)).alias(f"o{c}{k}")
        for c in labels
        for k in labels
        if c <= k
    ]
    sums = per_item.groupBy(*by).agg(*cells, F.sum(usable.cast("bigint")).alias("n_items"))
    o = lambda c, k: F.col(f"o{min(c, k)}{max(c, k)}")
    n = {c: reduce(lambda a, b: a + b, [o(c, k) for k in labels]) for c in labels}
    total = reduce(lambda a, b: a + b, n.values())

    def far(c: int, k: int) -> Column:
        between = reduce(lambda a, b: a + b, [n[g] for g in labels if c <= g <= k])
        return F.pow(between - (n[c] + n[k]) / 2, 2)

    pairs = [(c, k) for c in labels for k in labels if c < k]
    seen = reduce(lambda a, b: a + b, [o(c, k) * far(c, k) for c, k in pairs])
    expected = reduce(lambda a, b: a + b, [n[c] * n[k] * far(c, k) for c, k in pairs])
    value = F.when(F.col("n_items") == 0, 0.0).when(expected == 0, 1.0).otherwise(1 - (total - 1) * F.try_divide(seen, expected))
    raters = scores.groupBy(*by).agg(F.count_distinct("rater_id").alias("n_raters"))
    return sums.select(*by, value.alias("alpha"), "n_items").join(raters, by)
