"""Retrieval metrics over ranked rows and gold sets, and their summaries over experiment grids.

runs: query_id, item_id, rank and any columns that name an arm. gold: query_id, item_id. Queries without gold don't
count unless said otherwise; a query whose gold isn't retrieved counts with 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.statistics import interval, paired_test

DIGITS = 6


def at_k(runs: DataFrame, gold: DataFrame, ks: Sequence[int], arm: Sequence[str] = (), sizes: DataFrame | None = None) -> DataFrame:
    """arm, query_id, k, hits, n_returned, n_gold, precision, recall, hit, first_rank, reciprocal_rank for every k.

    Precision divides by what was returned up to k. One pass over the runs: hits and sizes at every k are conditional sums.
    sizes (query_id, n_gold): with them, gold need hold no more than what the runs hold of it.
    """
    marked = runs.join(gold.select("query_id", "item_id", F.lit(1).alias("is_gold")).distinct(), ["query_id", "item_id"], "left")
    sums: list[Column] = []
    for k in ks:
        inside = F.col("rank") <= k
        sums += [
            F.count_if(inside & F.col("is_gold").isNotNull()).alias(f"h{k}"),
            F.count_if(inside).alias(f"n{k}"),
            F.min(F.when(inside & F.col("is_gold").isNotNull(), F.col("rank"))).alias(f"f{k}"),
        ]
    per = marked.groupBy(*arm, "query_id").agg(*sums)
    sizes = gold.distinct().groupBy("query_id").agg(F.count("*").alias("n_gold")) if sizes is None else sizes
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"h{k}").alias("hits"), F.col(f"n{k}").alias("n_returned"), F.col(f"f{k}").alias("first_rank")) for k in ks]))
    flat = per.join(sizes, "query_id").select(*arm, "query_id", "n_gold", rows.alias("r")).select(*arm, "query_id", "n_gold", "r.*")
    return flat.select(
        *arm, "query_id", "k", "hits", "n_returned", "n_gold",
        F.round(F.when(F.col("n_returned") == 0, 0.0).otherwise(F.col("hits") / F.col("n_returned")), DIGITS).alias("precision"),
        F.round(F.col("hits") / F.col("n_gold"), DIGITS).alias("recall"),
        (F.col("hits") > 0).cast("double").alias("hit"),
        "first_rank",
        F.round(F.coalesce(1 / F.col("first_rank"), F.lit(0.0)), DIGITS).alias("reciprocal_rank"),
    )


def mean(measure: str) -> Column:
    """The mean in DIGITS digits, from whole units of the last digit: the same in any order of rows and in any engine."""
    unit = 10**DIGITS
    return F.floor(F.sum(F.round(F.col(measure) * unit).cast("bigint")) / F.count(measure) + 0.5) / unit


def summary(rows: DataFrame, by: Sequence[str], measures: Sequence[str] = ("precision", "recall", "hit", "reciprocal_rank")) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *[mean(m).alias(m) for m in measures])


def marginal(rows: DataFrame, by: Sequence[str], measure: str) -> DataFrame:
    """by, value: the mean over queries of each query's mean over the free dimensions."""
    per = rows.groupBy(*by, "query_id").agg(mean(measure).alias("v"))
    return per.groupBy(*by).agg(F.count("*").alias("n"), mean("v").alias("value"))


def best(rows: DataFrame, by: Sequence[str], choice: str, value: str) -> DataFrame:
    """by, choice, value of the largest value; the smaller choice wins ties."""
    top = F.max(F.struct(F.col(value), (-F.col(choice)).alias("_c")))
    return rows.groupBy(*by).agg(top.alias("t")).select(*by, (-F.col("t._c")).alias(choice), F.col(f"t.{value}").alias(value))


def paired(rows: DataFrame, arm: str, a: object, b: object, measure: str) -> DataFrame:
    """query_id, a, b, delta of queries present in both arms."""
    left = rows.where(F.col(arm) == F.lit(a)).groupBy("query_id").agg(mean(measure).alias("a"))
    right = rows.where(F.col(arm) == F.lit(b)).groupBy("query_id").agg(mean(measure).alias("b"))
    return left.join(right, "query_id").select("query_id", "a", "b", F.round(F.col("a") - F.col("b"), DIGITS).alias("delta"))


def core_rows(rows: DataFrame, scorer: str | None = None, plainer: str = "tf_idf") -> DataFrame:
    """rows of one scorer: the one named, else the only one there, else the plainer of several. What is summed over free
    dimensions must not mix scorers."""
    if scorer is not None:
        return rows.where(F.col("scorer") == scorer)
    present = rows.agg(F.min("scorer").alias("a"), F.max("scorer").alias("b")).first()  # two names
    return rows.where(F.col("scorer") == F.lit(present.a if present.a == present.b else plainer))


def tuned(rows: DataFrame, choice: str, measure: str, split: Column, baseline: object) -> DataFrame:
    """choice, score, n, delta, low, high, p: the choice of the largest mean over the queries of the split `tune` (the smaller one
    on ties), and its paired test against the baseline choice over the other queries. split: a column of rows."""
    per = rows.groupBy("query_id", choice).agg(mean(measure).alias("v"), F.first(split).alias("split"))
    means = per.where("split = 'tune'").groupBy(choice).agg(mean("v").alias("score"))
    top = means.agg(F.max(F.struct("score", (-F.col(choice)).alias("_c"))).alias("t")).select((-F.col("t._c")).alias(choice), F.col("t.score").alias("score"))
    won = top.first()  # one setting
    if won is None or won["score"] is None:
        return top.where("false").select(choice, "score", *[F.lit(None).cast("double").alias(c) for c in ("n", "delta", "low", "high", "p")])
    a = per.where((F.col("split") != "tune") & (F.col(choice) == F.lit(won[choice]))).select("query_id", F.col("v").alias("a"))
    b = per.where(F.col(choice) == F.lit(baseline)).select("query_id", F.col("v").alias("b"))
    pairs = a.join(b, "query_id").select(F.lit(won[choice]).alias(choice), F.lit(won["score"]).alias("score"), F.col("query_id").alias("key"), "a", "b")
    return paired_test(pairs, [choice, "score"]).withColumn("delta", F.round("delta", DIGITS))


def arm_summary(rows: DataFrame, arm: Sequence[str]) -> DataFrame:
    """arm, n, recall, mrr, low, high: means per arm with the bootstrap interval of the reciprocal rank; with columns fired and
    calls of rows also fired_rate and mean_calls."""
    sums = [F.count("*").alias("n"), mean("recall").alias("recall"), mean("reciprocal_rank").alias("mrr")]
    if {"fired", "calls"} <= set(rows.columns):
        sums += [F.round(F.avg(F.col("fired").cast("double")), DIGITS).alias("fired_rate"), F.round(F.avg("calls"), DIGITS).alias("mean_calls")]
    limits = interval(rows.select(*arm, F.col("query_id").alias("key"), F.col("reciprocal_rank").alias("value")), list(arm)).select(*arm, "low", "high")
    return rows.groupBy(*arm).agg(*sums).join(limits, list(arm))


def popular_heads(gold: DataFrame, depth: int) -> DataFrame:
    """query_id, item_id, n, overall: per query the first depth + |its gold| items by the number of queries that have them in
    their gold, ties by id. The head that all queries share is as long as the largest gold set and depth."""
    gold = gold.distinct()
    counts = gold.groupBy("item_id").agg(F.count("*").alias("n"))
    sizes = gold.groupBy("query_id").agg(F.count("*").alias("n_gold"))
    most = (sizes.agg(F.max("n_gold")).first()[0] or 0) + depth
    order = Window.orderBy(F.col("n").desc(), F.col("item_id"))
    pool = counts.orderBy(F.col("n").desc(), "item_id").limit(most).withColumn("overall", F.row_number().over(order))
    reach = sizes.select("query_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n_gold") + depth)).alias("overall"))
    return reach.join(pool, "overall").select("query_id", "item_id", "n", "overall")


def popularity(gold: DataFrame, depth: int) -> DataFrame:
    """query_id, item_id, rank up to depth: items by how many other queries have them in their gold, ties by id.

    Leaving a query out only lowers its own gold's counts by one, so the first depth + |gold| items of the overall order
    hold its first depth items. The pool per query is cut by rank before it joins, and counts of 0 never rank.
    """
    gold = gold.distinct()
    offered = popular_heads(gold, depth).join(gold.withColumn("own", F.lit(1)), ["query_id", "item_id"], "left")
    left = F.col("n") - F.coalesce("own", F.lit(0))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("left").desc(), F.col("item_id")))
    return offered.withColumn("left", left).where("left > 0").withColumn("rank", rank).where(F.col("rank") <= depth).select("query_id", "item_id", "rank")


def reference_drafts(cited: DataFrame, passages: DataFrame, share: float, excerpt: int = 240) -> DataFrame:
    """area, item_id, n, answered, share, include, excerpt: per area the passages cited by its answers, those cited by at least
    `share` of them proposed. cited: area, query_id, item_id, any number of rows a citation; an answer is a query with a
    citation. Passages (item_id, text) that are gone are left out; the excerpt has single blanks."""
    once = cited.where("area is not null").select("area", "query_id", "item_id").distinct()
    answered = once.groupBy("area").agg(F.count_distinct("query_id").alias("answered"))
    counts = once.groupBy("area", "item_id").agg(F.count("*").alias("n"))
    part = F.col("n") / F.col("answered")
    text = F.substring(F.trim(F.regexp_replace("text", r"\s+", " ")), 1, excerpt)
    joined = counts.join(answered, "area").join(passages, "item_id")
    return joined.select("area", "item_id", "n", "answered", F.round(part, 6).alias("share"), (part >= share).alias("include"), text.alias("excerpt"))


def loci(gold: DataFrame, predicted: DataFrame, tolerance: int = 0) -> DataFrame:
    """gold citations (query_id, chunk_id, page) with the first prediction of the same chunk and whether the page fits."""
    first = predicted.groupBy("query_id", "chunk_id").agg(F.min_by("page", "position").alias("predicted_page"))
    near = F.coalesce(F.abs(F.col("page") - F.col("predicted_page")) <= tolerance, F.lit(False))
    return gold.join(first, ["query_id", "chunk_id"], "left").withColumn("fits", near)
