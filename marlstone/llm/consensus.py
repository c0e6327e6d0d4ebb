"""Consensus of several annotators' labels, chance-corrected agreement, reliability of each annotator.

Iteratively reweighted voting: items take the label with the largest sum of weights, an annotator's weight follows from
how often its labels equal the consensus of the others (leave one out), smoothed towards a fixed accuracy; both alternate
until the weights are stable, or recur in a cycle, over which they are averaged; where they do neither, steps get shorter, so
that the weights become the mean over rounds. Agreement is Krippendorff's alpha for ordinal labels, which allows missing ratings.

Defined cases: of the rows of one item and annotator the one rated last counts (the larger rating_id on a tie; a null
time is earliest); it counts only if its label is in range. Rows with a null item or annotator never count. Equal
sums of weights go to the label nearest the item's weighted mean, then to the lower one. Repeated rows change nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators.agreement import alpha
from marlstone.session import cut, dropped, tidied

LABELS = range(1, 6)
#: Smoothing: so many ratings of this accuracy are added to each annotator's own.
PRIOR, PRIOR_ACCURACY = 5.0, 0.5
#: A change of a weight below STABLE ends the rounds, a cycle of counts that holds for SETTLED rounds too; weights that still
#: move after MOST_ROUNDS are an error.
MOST_ROUNDS = 200
STABLE = 1e-4
WHOLE_ROUNDS = 50
SETTLED = 16
#: Among many annotators, cycles of unlike lengths together don't recur within any number of rounds. From round SLOW on the
#: weights are the mean of the odds since then, and after so many MEAN_ROUNDS steps shrink by SHRINK, so that they end before
#: MOST_ROUNDS however far the odds swing.
SLOW, MEAN_ROUNDS, SHRINK = 64, 48, 0.88
#: After FIRST_ROUNDS only those items are counted again that weights within a reach of NEAR (FURTHER times its last change,
#: where that is more) could decide otherwise; if there are more than FEW labels.
FIRST_ROUNDS, NEAR, FURTHER, FEW = 8, 0.1, 8.0, 200_000
#: Annotators whose weights the driver holds, a number each.
MOST_RATERS = 1_000_000


def domain(code: Column) -> Column:
    """A domain code without case, outer blanks and hyphens for underscores."""
    return F.replace(F.trim(F.lower(code)), F.lit("-"), F.lit("_"))


def live_scores(ratings: DataFrame, by_item: bool = False) -> DataFrame:
    """result_id, domain_code, rater_id, score: the live label of each annotator and item.

    The latest row is a maximum over structs, so rows are aggregated before they move and no group is gathered. by_item: rows
    move once, by item, and what groups them by item after needs no second shuffle.
    """
    row = F.struct(F.col("rated_at").isNotNull().alias("timed"), "rated_at", "rating_id", "score")
    told = ratings.select("result_id", domain(F.col("domain_code")).alias("domain_code"), "rater_id", "rated_at", "rating_id", "score")
    told = told.where("result_id is not null and rater_id is not null and domain_code is not null")
    latest = (
        (told.repartition("result_id", "domain_code") if by_item else told)
        .groupBy("result_id", "domain_code", "rater_id")
        .agg(F.max(row).alias("row"))
        .select("result_id", "domain_code", "rater_id", F.col("row.score").alias("score"))
    )
    return latest.where(F.col("score").between(min(LABELS), max(LABELS)))


def panels(live: DataFrame) -> DataFrame:
    """result_id, domain_code, raters, scores: the live labels of an item in one row, by rater. An item has one label of an
    annotator at most, so a row is no longer than the list of annotators."""
    row = F.sort_array(F.collect_list(F.struct("rater_id", "score")))
    rows = live.groupBy("result_id", "domain_code").agg(row.alias("row"))
    return rows.select("result_id", "domain_code", F.col("row.rater_id").alias("raters"), F.col("row.score").alias("scores"))


def _winner(sums: np.ndarray) -> np.ndarray:
    """Of each row the label with the largest sum; ties go to the one nearest the mean, then the lower."""
    labels = np.arange(LABELS.start, LABELS.stop)
    total = sums.sum(axis=1)
    mean = np.divide(sums @ labels, total, out=np.zeros(len(sums)), where=total > 0)
    rounded = np.round(sums, 9)
    far = np.round(np.abs(labels[None, :] - mean[:, None]), 6)
    far = np.where(rounded == rounded.max(axis=1, keepdims=True), far, np.inf)
    return far.argmin(axis=1)


def _opened(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Of each rating its item's row, its label from 0 and its rater; the ratings an item has."""
    raters, scores = batch.column("raters"), batch.column("scores")
    n = raters.value_lengths().to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(n)), n), scores.flatten().to_numpy(zero_copy_only=False).astype(int) - LABELS.start, raters.flatten(), n


def _sums(item: np.ndarray, label: np.ndarray, weight: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.bincount(item * len(LABELS) + label, weights=weight, minlength=len(n) * len(LABELS)).reshape(len(n), len(LABELS))


def _coded(items: DataFrame, names: pa.Array) -> DataFrame:
    """raters as places in names, and scores."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raters = batch.column("raters")
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(raters.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int32)), pc.index_in(raters.flatten(), value_set=names).cast(pa.int32()))
            yield pa.RecordBatch.from_arrays([lists, batch.column("scores").cast(pa.list_(pa.int32()))], ["raters", "scores"])

    return items.select("raters", "scores").mapInArrow(code, "raters array<int>, scores array<int>")


def _counted(coded: DataFrame, weights: np.ndarray, least: int, alone: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of each rater the labels on items with at least `least` of them, and how many equal the item's consensus: that of the
    others (alone), or of all. A task sends one row a rater."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, agreed = np.zeros(len(weights), np.int64), np.zeros(len(weights), np.int64)
        for batch in batches:
            item, label, raters, n = _opened(batch)
            rater = raters.to_numpy(zero_copy_only=False)
            weight = weights[rater]
            sums = _sums(item, label, weight, n)
            told = n[item] >= least
            item, label, rater, weight = item[told], label[told], rater[told], weight[told]
            if alone:
                others = sums[item]
                others[np.arange(len(item)), label] -= weight
                equal = _winner(others) == label
            else:
                equal = _winner(sums)[item] == label
            seen += np.bincount(rater, minlength=len(weights))
            agreed += np.bincount(rater[equal], minlength=len(weights))
        k = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(seen[k]), pa.array(agreed[k])], ["rater", "seen", "agreed"])

    parts = coded.mapInArrow(count, "rater int, seen bigint, agreed bigint")
    rows = parts.groupBy("rater").agg(F.sum("seen").alias("seen"), F.sum("agreed").alias("agreed")).toArrow()
    out = np.zeros((2, len(weights)), np.int64)
    out[:, rows.column("rater").to_numpy()] = rows.column("seen").to_numpy(), rows.column("agreed").to_numpy()
    return out[0], out[1]


def _near(coded: DataFrame, weights: np.ndarray, reach: np.ndarray) -> DataFrame:
    """The items of which weights within reach of these could change what others than some rater decide, by _winner()."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            item, label, raters, n = _opened(batch)
            rater = raters.to_numpy(zero_copy_only=False)
            others = _sums(item, label, weights[rater], n)[item]
            others[np.arange(len(item)), label] -= weights[rater]
            others.sort(axis=1)
            slack = np.bincount(item, weights=reach[rater], minlength=len(n))
            close = others[:, -1] - others[:, -2] <= slack[item] + 1e-6
            yield batch.filter(pa.array(np.bincount(item[close], minlength=len(n)) > 0))

    return cut(coded.mapInArrow(pick, coded.schema))


def _step(turn: int, whole: np.ndarray) -> np.ndarray | float:
    """The share of the way to the odds that a round goes."""
    if turn < SLOW:
        # Half a step while the odds still move, since whole steps can swing between two consensus labels of close items
        # for ever; the whole step once they are what they were, in the first WHOLE_ROUNDS rounds.
        return np.where(whole & (turn < WHOLE_ROUNDS), 1.0, 0.5)
    k = turn - SLOW
    return SHRINK ** max(0, k - MEAN_ROUNDS) / (min(k, MEAN_ROUNDS) + 1)


def _period(seen: list[bytes]) -> int:
    """The length of the cycle in which counts recur, 0 if they don't: at least twice in a row, and for SETTLED rounds, in which
    half steps bring weights as near to the cycle as STABLE."""
    for p in range(2, len(seen) // 2 + 1):
        n = max(2 * p, SETTLED)
        if len(seen) >= n and len(set(seen[-p:])) > 1 and all(seen[-k] == seen[-k - p] for k in range(1, n - p + 1)):
            return p
    return 0


class Consensus:
    """The live labels as panels and, of each annotator by name, what the rounds end with."""

    def __init__(self, ratings: DataFrame) -> None:
        with tidied(ratings.sparkSession):
            self.panels = cut(panels(live_scores(ratings, by_item=True)))
        raters = self.panels.select(F.explode("raters").alias("rater_id")).groupBy("rater_id").agg(F.count("*").alias("n_ratings"))
        rows = raters.limit(MOST_RATERS + 1).toArrow().combine_chunks().sort_by("rater_id")
        if len(rows) > MOST_RATERS:
            raise ValueError(f"ratings are of more than {MOST_RATERS} annotators")
        self.names, self.n_ratings = rows.column("rater_id").combine_chunks(), rows.column("n_ratings")
        self.coded = cut(_coded(self.panels, self.names))
        self.weights, self.n_judged, self.accuracy = self._rounds()

    def _counts(self, weights: np.ndarray, change: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray]:
        """_counted() of all items: from some round on of those near a change, and what the rest gave."""
        if self._held is not None:
            at, reach, near, rest = self._held
            if (np.abs(weights - at) <= reach).all():
                return tuple(np.add(rest, _counted(near, weights, 2, True)))
            dropped(near)
            self._held = None
        every = _counted(self.coded, weights, 2, True)
        if turn >= FIRST_ROUNDS and pc.sum(self.n_ratings).as_py() > FEW:
            reach = np.maximum(NEAR, FURTHER * change)
            near = _near(self.coded, weights, reach)
            self._held = weights, reach, near, np.subtract(every, _counted(near, weights, 2, True))
        return every

    def _rounds(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self._held: tuple | None = None
        try:
            return self._settled()
        finally:
            if self._held is not None:
                dropped(self._held[2])

    def _settled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        weights = np.ones(len(self.names))
        judged, accuracy = np.zeros(len(weights), np.int64), np.zeros(len(weights))
        had, change = np.full(len(weights), np.nan), np.zeros(len(weights))
        seen: list[bytes] = []
        counts: list[np.ndarray] = []

        def odds_of(agreed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            accuracy = (agreed + PRIOR * PRIOR_ACCURACY) / (judged + PRIOR)
            # Log odds against a guess among the labels, never below a trifle.
            return np.maximum(np.log(accuracy * (len(LABELS) - 1) / np.maximum(1 - accuracy, 1e-3)), 0.05), accuracy

        for turn in range(MOST_ROUNDS if len(weights) else 0):
            judged, agreed = self._counts(weights, change, turn)
            odds, told = odds_of(agreed)
            if turn < SLOW:
                seen.append(hashlib.sha256(agreed.tobytes()).digest())
                counts.append(agreed.astype(np.int32) if judged.max() < 1 << 31 else agreed)
                if p := _period(seen):
                    # No weights are those that follow from them: labels of close items change each other for ever.
                    odds, accuracy = (np.mean([odds_of(a)[k] for a in counts[-p:]], axis=0) for k in (0, 1))
                    return np.where(judged > 0, odds, 1.0), judged, accuracy
            step = _step(turn, np.abs(odds - had) < STABLE)
            new = np.where(judged > 0, weights + step * (odds - weights), 1.0)
            # Like the weights, the accuracy that is told is the mean over the slow rounds.
            accuracy = told if turn < SLOW else accuracy + step * (told - accuracy)
            change = np.abs(new - weights)
            weights, had = new, odds
            if change.max() < STABLE:
                return weights, judged, accuracy
        if len(weights):
            raise RuntimeError(f"weights still change by {change.max():.2g} after {MOST_ROUNDS} rounds")
        return weights, judged, accuracy

    def items(self) -> DataFrame:
        """result_id, domain_code, consensus, confidence, n_ratings."""
        names, weights = self.names, self.weights

        def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                item, label, raters, n = _opened(batch)
                sums = _sums(item, label, weights[pc.index_in(raters, value_set=names).to_numpy(zero_copy_only=False)], n)
                picked = _winner(sums)
                share = sums[np.arange(len(n)), picked] / sums.sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("result_id"), batch.column("domain_code"), pa.array((picked + LABELS.start).astype(np.int32)), pa.array(share), pa.array(n.astype(np.int64))],
                    ["result_id", "domain_code", "consensus", "confidence", "n_ratings"],
                )

        keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in self.panels.schema if f.name in ("result_id", "domain_code"))
        return cut(self.panels.mapInArrow(decide, f"{keys}, consensus int, confidence double, n_ratings bigint"))

    def raters(self) -> DataFrame:
        """rater_id, n_ratings, n_judged, loo_accuracy, weight."""
        told = pa.array(self.accuracy, mask=self.n_judged == 0)
        columns = {"rater_id": self.names, "n_ratings": self.n_ratings, "n_judged": pa.array(self.n_judged), "loo_accuracy": told, "weight": pa.array(self.weights)}
        return self._table(columns)

    def reliability(self, least_ratings: int = 3) -> DataFrame:
        """What reliability() gives, without a join of the labels with the items."""
        n, equal = _counted(self.coded, self.weights, least_ratings, False)
        k = np.flatnonzero(n)
        return self._table({"rater_id": self.names.take(pa.array(k)), "n_items": pa.array(n[k]), "n_equal": pa.array(equal[k]), "share": pa.array(equal[k] / n[k])})

    def _table(self, columns: dict[str, pa.Array]) -> DataFrame:
        kind = self.panels.schema["raters"].dataType.elementType.simpleString()
        types = {"rater_id": kind, "loo_accuracy": "double", "weight": "double", "share": "double"}
        schema = ", ".join(f"{c} {types.get(c, 'bigint')}" for c in columns)
        return self.panels.sparkSession.createDataFrame(pa.table(columns), schema)

    def live(self) -> DataFrame:
        """result_id, domain_code, rater_id, score."""
        rows = self.panels.select("result_id", "domain_code", F.explode(F.arrays_zip("raters", "scores")).alias("r"))
        return rows.select("result_id", "domain_code", F.col("r.raters").alias("rater_id"), F.col("r.scores").alias("score"))


def consensus(ratings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """items (result_id, domain_code, consensus, confidence, n_ratings), raters (rater_id, n_ratings, n_judged,
    loo_accuracy, weight) and the live scores, from raw ratings.

    The labels are written once, those of an item in one row. A round reads them and moves a row per rater and task; the
    driver holds a number for each annotator and round. Weights end within STABLE of the log odds that follow from them, at the mean
    of the log odds over a cycle of rounds that recurs, or at their mean over slow rounds.
    """
    c = Consensus(ratings)
    return c.items(), c.raters(), c.live()


def reliability(items: DataFrame, live: DataFrame, least_ratings: int = 3) -> DataFrame:
    """rater_id, n_items, n_equal, share: how often a rater equals the consensus of items with enough live scores."""
    agreed = live.join(items.where(F.col("n_ratings") >= least_ratings), ["result_id", "domain_code"])
    n_equal = F.sum((F.col("score") == F.col("consensus")).cast("bigint"))
    return (
        agreed.groupBy("rater_id")
        .agg(F.count("*").alias("n_items"), n_equal.alias("n_equal"))
        .withColumn("share", F.col("n_equal") / F.col("n_items"))
    )


def slice_agreement(live: DataFrame, slices: DataFrame) -> DataFrame:
    """slice_id, domain_code, value (as given), alpha, n_items, n_raters, matches: agreement over each slice's results."""
    wanted = slices.select("slice_id", domain(F.col("domain_code")).alias("domain_code"), F.explode("result_ids").alias("result_id")).distinct()
    scores = wanted.join(live, ["result_id", "domain_code"])
    computed = alpha(scores, ["slice_id", "domain_code"])
    given = slices.groupBy("slice_id", domain(F.col("domain_code")).alias("domain_code")).agg(F.max_by("value", "computed_at").alias("value"))
    out = given.join(computed, ["slice_id", "domain_code"], "left")
    near = F.coalesce(F.abs(F.col("value") - F.col("alpha")) < 1e-3, F.lit(False))
    return out.withColumn("matches", near)


def rater_counts(live: DataFrame, summaries: DataFrame) -> DataFrame:
    """result_id, given, counted, correct: distinct_rater_count against the raters with a live score."""
    counted = live.groupBy("result_id").agg(F.count_distinct("rater_id").alias("counted"))
    given = summaries.where("result_id is not null").select("result_id", F.col("distinct_rater_count").alias("given")).distinct()
    joined = given.join(counted, "result_id", "left").withColumn("counted", F.coalesce("counted", F.lit(0)))
    return joined.withColumn("correct", F.coalesce(F.col("given") == F.col("counted"), F.lit(False)))


def found(ratings: DataFrame, summaries: DataFrame, least_share: float = 0.6) -> DataFrame:
    """kind, case_id: unreliable raters, and results whose count of raters is missing or wrong."""
    c = Consensus(ratings)
    raters = c.reliability().where(F.col("share") < least_share).select(F.lit("rater").alias("kind"), F.col("rater_id").alias("case_id"))
    # Items move with their list of raters, not a row for each.
    listed = c.panels.select("result_id", "raters").repartition("result_id").select("result_id", F.explode("raters").alias("rater_id"))
    wrong = rater_counts(listed, summaries).where("not correct").select(F.lit("summary").alias("kind"), F.col("result_id").alias("case_id"))
    return raters.unionByName(wrong).distinct()
