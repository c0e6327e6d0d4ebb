"""Mixing sources to target shares of the total size in tokens: hash-threshold histograms.

Every document has a hash; a source's budget is met by the documents whose hash lies below a threshold. The threshold
comes from sums of tokens by source and hash bucket: the bucket in which the running sum crosses the budget is refined
on the next bits of the hash, and only that bucket, twice. Documents are then kept by a plain filter: nothing is
sorted, and a larger budget keeps every document that a smaller one kept. A source larger than its budget is thinned; a
smaller one is repeated, at most max_repeats times in all, the last repeat thinned likewise.

Without a given total the total is the largest for which every usable source reaches its share; with a larger one,
sources at their cap stay below their share and the report shows it.

Defined cases: a null or non-positive weight, and a source without documents, take no part, the other weights are
scaled to one; a null max_repeats is 1; documents of a null or unlisted source are left out; repeated rows of one
doc_id count once; repeated rows of a source in the targets count with the largest weight.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.session import cut

#: Bits of the hash that each level of the histogram resolves.
BITS, LEVELS = 10, 3
SEED = 7


def _with_hash(sized: DataFrame, seed: int) -> DataFrame:
    """b0, b1, b2: the leading bits of a document's hash, by level."""
    h = F.xxhash64("doc_id", F.lit(seed))
    parts = [F.shiftrightunsigned(h, 64 - BITS * (k + 1)).bitwiseAND((1 << BITS) - 1).cast("int").alias(f"b{k}") for k in range(LEVELS)]
    return sized.select("doc_id", "source", "n_tokens", *parts)


def plan(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """source, share, max_repeats, size, budget, full (whole repeats), part (tokens of the thinned repeat); a row per usable source."""
    wanted = targets.where("source is not null and target_weight > 0").groupBy("source").agg(
        F.max("target_weight").alias("weight"), F.greatest(F.max(F.coalesce("max_repeats", F.lit(1))), F.lit(0)).alias("max_repeats")
    )
    sizes = sized.where("source is not null").groupBy("source").agg(F.sum("n_tokens").alias("size"))
    usable = wanted.where("max_repeats > 0").join(sizes, "source").where("size > 0")
    # Two numbers: the sum of weights, and the tokens per weight that the scarcest source reaches.
    sums = usable.agg(F.sum("weight").alias("weight"), F.min(F.col("max_repeats") * F.col("size") / F.col("weight")).alias("reach")).first()
    weight, reach = sums.weight or 1.0, sums.reach or 0.0
    total = float(total_tokens) if total_tokens is not None else reach * weight
    usable = usable.withColumn("share", F.col("weight") / weight)
    budget = F.least(F.col("share") * total, F.col("max_repeats") * F.col("size"))
    planned = usable.withColumn("budget", budget).withColumn("full", F.floor(F.col("budget") / F.col("size") + 1e-9).cast("int"))
    return planned.withColumn("part", F.greatest(F.col("budget") - F.col("full") * F.col("size"), F.lit(0.0))).drop("weight")


def thresholds(hashed: DataFrame, planned: DataFrame) -> DataFrame:
    """planned with t0, t1, t2 and last: documents with (b0, b1, b2) below (t0, t1, t2), or at most if last, are in the part.

    Each level sums only the documents of the boundary bucket of the level before.
    """
    state = cut(planned.withColumn("left", F.col("part")))
    inside = hashed
    for k in range(LEVELS):
        on = ["source", *[f"b{j}" for j in range(k)]]
        bounds = state.select("source", "left", *[F.col(f"t{j}").alias(f"b{j}") for j in range(k)])
        sums = inside.join(bounds, on).groupBy("source", "left", f"b{k}").agg(F.sum("n_tokens").alias("n"))
        order = Window.partitionBy("source").orderBy(f"b{k}")
        running = sums.withColumn("upto", F.sum("n").over(order))
        crossing = (
            running.where("upto > left")
            .groupBy("source")
            .agg(F.min(F.struct(f"b{k}", "upto", "n")).alias("c"))
            .select("source", F.col(f"c.b{k}").alias(f"t{k}"), F.col("c.upto").alias("upto"), F.col("c.n").alias("n"))
        )
        state = state.join(crossing, "source", "left")
        over = F.coalesce(F.col("upto") - F.col("n"), F.lit(0))
        # The last level takes its boundary bucket whole if that comes nearer to the budget.
        state = state.withColumn("last", F.col("left") - over > F.coalesce(F.col("upto") - F.col("left"), F.lit(0.0)))
        state = cut(state.withColumn(f"t{k}", F.coalesce(f"t{k}", F.lit(1 << BITS))).withColumn("left", F.col("left") - over).drop("upto", "n"))
    return state.drop("left")


def mixed(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = SEED) -> DataFrame:
    """doc_id, source, n_tokens, copies of the documents in the mix (copies >= 1)."""
    hashed = _with_hash(sized, seed)
    bounds = thresholds(hashed, plan(sized, targets, total_tokens))
    at, to = F.struct("b0", "b1", "b2"), F.struct(F.col("t0").alias("b0"), F.col("t1").alias("b1"), F.col("t2").alias("b2"))
    inside = (at < to) | (F.col("last") & (at == to))
    copies = F.col("full") + F.when(inside & (F.col("part") > 0), 1).otherwise(0)
    return (
        hashed.join(bounds.select("source", "full", "part", "t0", "t1", "t2", "last"), "source")
        .withColumn("copies", copies)
        .where("copies > 0")
        .select("doc_id", "source", "n_tokens", "copies")
    )


def shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_weight, target_share, n_documents, most_copies, n_tokens, actual_share of every listed source."""
    got = mix.groupBy("source").agg(
        F.count("*").alias("n_documents"), F.max("copies").alias("most_copies"), F.sum(F.col("n_tokens") * F.col("copies")).alias("n_tokens")
    )
    listed = targets.where("source is not null").groupBy("source").agg(F.max("target_weight").alias("target_weight"))
    joined = cut(listed.join(got, "source", "left").fillna(0, ["n_documents", "most_copies", "n_tokens"]))
    usable = F.when((F.col("target_weight") > 0) & (F.col("n_tokens") > 0), F.col("target_weight"))
    sums = joined.agg(F.sum(usable).alias("weight"), F.sum("n_tokens").alias("n_tokens")).first()
    return joined.select(
        "source", "target_weight", F.coalesce(usable / float(sums.weight or 1), F.lit(0.0)).alias("target_share"),
        "n_documents", "most_copies", "n_tokens", (F.col("n_tokens") / float(sums.n_tokens or 1)).alias("actual_share"),
    )
