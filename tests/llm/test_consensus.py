import datetime as dt
import math
import random

import pytest

from marlstone.llm import consensus as C

SCHEMA = "rating_id bigint, result_id string, rater_id string, domain_code string, score int, rated_at timestamp_ntz, weight double, n int"
SUMMARY = "result_id string, distinct_rater_count int, counted int"


def ratings(spark, rows):
    day = dt.datetime(2025, 1, 1)
    return spark.createDataFrame([(i, r, u, d, s, None if t is None else day + dt.timedelta(hours=t), 1.0, 1) for i, (r, u, d, s, t) in enumerate(rows)], SCHEMA)


def panel(seed=2):
    """30 items; seven careful raters, three who guess."""
    rng = random.Random(seed)
    rows, truth = [], {}
    for i in range(30):
        for d in ("harm", "recall"):
            truth[f"r{i}", d] = t = rng.randrange(1, 6)
            for u in range(10):
                good = u < 7 and rng.random() < 0.9
                rows.append((f"r{i}", f"u{u}", d, t if good else rng.randrange(1, 6), u))
    return rows, truth


def test_consensus_finds_the_truth_and_the_guessers(spark):
    rows, truth = panel()
    items, raters, live = C.consensus(ratings(spark, rows))
    got = {(r.result_id, r.domain_code): r.consensus for r in items.collect()}
    assert sum(got[k] == v for k, v in truth.items()) >= 0.95 * len(truth)
    weights = {r.rater_id: r.weight for r in raters.collect()}
    assert min(weights[f"u{u}"] for u in range(7)) > max(weights[f"u{u}"] for u in range(7, 10))
    low = {r.rater_id for r in C.reliability(items, live).where("share < 0.6").collect()}
    assert low == {"u7", "u8", "u9"}


def test_weights_end_at_the_odds_that_follow_from_them(spark):
    rows, _ = panel()
    for r in C.consensus(ratings(spark, rows))[1].collect():
        assert abs(r.weight - max(0.05, math.log(r.loo_accuracy * 4 / (1 - r.loo_accuracy)))) < 1e-4


def test_weights_that_do_not_settle_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(C, "MOST_ROUNDS", 2)
    with pytest.raises(RuntimeError, match="after 2 rounds"):
        C.consensus(ratings(spark, panel()[0]))


def test_live_score_is_the_latest_and_must_be_in_range(spark):
    rows = [("r", "a", "Recall", 2, 1), ("r", "a", " recall ", 4, 2), ("r", "b", "logical-x", 3, 1), ("r", "b", "logical_x", 9, 2), ("r", "c", "recall", 5, None), ("r", "c", "recall", 1, 0),
            (None, "a", "recall", 2, 1), ("r", None, "recall", 2, 1), ("r", "d", "recall", None, 1)]
    got = {(r.domain_code, r.rater_id): r.score for r in C.live_scores(ratings(spark, rows + rows)).collect()}
    assert got == {("recall", "a"): 4, ("recall", "c"): 1}


def test_found_raters_and_summaries(spark):
    rows, _ = panel()
    summary = spark.createDataFrame([("r0", 10, 1), ("r0", 10, 1), ("r1", None, 1), ("r2", 9, 1), ("none", 0, 1), ("none2", 3, 1), (None, 2, 1)], SUMMARY)
    got = {(r.kind, r.case_id) for r in C.found(ratings(spark, rows), summary).collect()}
    assert got == {("rater", "u7"), ("rater", "u8"), ("rater", "u9"), ("summary", "r1"), ("summary", "r2"), ("summary", "none2")}


def test_ties_go_to_the_label_near_the_mean_then_the_lower(spark):
    rows = [("r", "a", "d", 1, 1), ("r", "b", "d", 2, 1), ("r", "c", "d", 5, 1), ("s", "a", "d", 2, 1), ("s", "b", "d", 3, 1)]
    got = {r.result_id: r.consensus for r in C.consensus(ratings(spark, rows))[0].collect()}
    assert got["s"] == 2 and got["r"] in (1, 2, 5)


def test_empty_table(spark):
    empty = ratings(spark, [("r", "a", "d", 1, 1)]).where("false")
    items, raters, live = C.consensus(empty)
    assert items.count() == raters.count() == live.count() == 0
    assert C.found(empty, spark.createDataFrame([], SUMMARY)).count() == 0


def test_slices_compare_with_given_values(spark):
    rows, _ = panel()
    live = C.live_scores(ratings(spark, rows))
    slices = spark.createDataFrame([("s", ["r0", "r1", None, "gone"], "harm", 0.0, dt.datetime(2025, 1, 1)), ("t", None, "harm", 0.0, None), ("e", [], "harm", None, None)],
                                   "slice_id string, result_ids array<string>, domain_code string, value double, computed_at timestamp_ntz")
    got = {r.slice_id: r.n_items for r in C.slice_agreement(live, slices).collect()}
    assert got == {"s": 2, "t": None, "e": None}


def test_labels_that_change_each_other_for_ever_end_at_the_mean_of_their_cycle(spark, monkeypatch):
    # 6 raters of 20 items, whose counts of agreement recur every 6 rounds: no weights are those that follow from them.
    monkeypatch.setattr(C, "MOST_ROUNDS", 40)
    rng = random.Random(28)
    rows = []
    for i in range(20):
        t = rng.randrange(1, 6)
        for u in range(6):
            if rng.random() < 0.6:
                rows.append((f"r{i}", f"u{u}", "d", t if rng.random() < 0.6 else rng.randrange(1, 6), u))
    items, raters, live = C.consensus(ratings(spark, rows))
    got = {r.rater_id: r for r in raters.collect()}
    assert items.count() == len({r[0] for r in rows}) and live.count() == len(rows) and len(got) == 6
    # The mean of what the rounds of the cycle give differs from what follows from any single one.
    assert max(abs(r.weight - max(0.05, math.log(r.loo_accuracy * 4 / (1 - r.loo_accuracy)))) for r in got.values()) < 0.1
    again = {r.rater_id: r.weight for r in C.consensus(ratings(spark, rows).repartition(7))[1].collect()}
    assert again == {k: r.weight for k, r in got.items()}


def test_panels_give_the_reliability_that_the_labels_give(spark):
    c = C.Consensus(ratings(spark, panel()[0]))
    joined = {tuple(r) for r in C.reliability(c.items(), c.live()).select("rater_id", "n_items", "n_equal").collect()}
    assert {tuple(r) for r in c.reliability().select("rater_id", "n_items", "n_equal").collect()} == joined


def unsettled(groups):
    """Groups of 6 raters and 20 items each that have nothing in common; some settle, others cycle, with unlike periods."""
    rows = []
    for g in range(groups):
        rng = random.Random(g)
        for i in range(20):
            t = rng.randrange(1, 6)
            for u in range(6):
                if rng.random() < 0.6:
                    rows.append((f"g{g}r{i}", f"g{g}u{u}", "d", t if rng.random() < 0.6 else rng.randrange(1, 6), u))
    return rows


def test_many_cycles_of_unlike_periods_end_too(spark):
    # Together they recur only after the least common multiple of their periods.
    rows = unsettled(120)
    items, raters, _ = C.consensus(ratings(spark, rows))
    got = {r.rater_id: r for r in raters.collect()}
    assert items.count() == len({r[0] for r in rows}) and len(got) == len({r[1] for r in rows})
    # What settles by itself ends where it ends alone.
    alone = {r.rater_id: r.weight for r in C.consensus(ratings(spark, [r for r in rows if r[1].startswith("g0u")]))[1].collect()}
    assert all(abs(got[k].weight - w) < 1e-3 for k, w in alone.items())


def test_steps_end_before_the_last_round_however_far_odds_swing():
    farthest = math.log(4 / 1e-3)
    assert C._step(C.MOST_ROUNDS - 1, None) * farthest < C.STABLE


def test_items_near_a_change_give_the_counts_of_all(spark, monkeypatch):
    rows = unsettled(30)
    want = [(r.rater_id, r.weight, r.loo_accuracy) for r in C.Consensus(ratings(spark, rows)).raters().orderBy("rater_id").collect()]
    monkeypatch.setattr(C, "FEW", 0)
    monkeypatch.setattr(C, "FIRST_ROUNDS", 3)
    calls = []
    near = C._near
    monkeypatch.setattr(C, "_near", lambda *a: calls.append(near(*a)) or calls[-1])
    c = C.Consensus(ratings(spark, rows))
    assert want == [(r.rater_id, r.weight, r.loo_accuracy) for r in c.raters().orderBy("rater_id").collect()] and calls
