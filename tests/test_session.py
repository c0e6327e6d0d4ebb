import random

import pytest
from pyspark.sql import functions as F

from marlstone import session
from marlstone.functions import text as X
from marlstone.operators import layout as L
from marlstone.operators import workflow as W


def test_released_tables_are_dropped_and_forgotten(spark):
    forgotten = []
    session.on_release.append(lambda: forgotten.append(1))
    try:
        outer = session.cut(spark.range(3))
        with session.released(spark):
            with session.released(spark):
                inner = session.cut(spark.range(4))
                assert inner.count() == 4
            assert forgotten == [1]
            kept = session.cut(spark.range(5))
            assert kept.count() == 5
        assert outer.count() == 3
        with pytest.raises(Exception):  # noqa: B017
            spark.read.parquet(kept.inputFiles()[0]).count()
    finally:
        session.on_release.pop()


def test_settings_above_their_bound_are_an_error(spark):
    assert len(session.small_rows(spark.range(3), 3)) == 3
    with pytest.raises(ValueError):
        session.small_rows(spark.range(4), 3)


def test_each_row_meets_the_one_before_over_any_blocks(spark):
    rng = random.Random(1)
    seqs = sorted(rng.sample(range(10_000), 300))
    rows = spark.createDataFrame([(s, f"v{s}") for s in seqs], "seq bigint, v string")
    want = {s: None if i == 0 else f"v{seqs[i - 1]}" for i, s in enumerate(seqs)}
    for block in (7, 100_000):
        got = {r.seq: r.p for r in W.preceded(rows, "seq", "v", "p", block).collect()}
        assert got == want
    assert W.preceded(rows.where("false"), "seq", "v", "p").count() == 0


def test_unlike_lengths_and_equal_texts_need_no_matching(spark):
    rows = [("abc", "ABC "), ("a" * 100, "a" * 50), ("a" * 100, "a" * 99 + "b"), ("x" * 100, "y" * 100), (None, "a"), ("", "")]
    frame = spark.createDataFrame(rows, "a string, b string")
    assert [r[0] for r in frame.select(X.materially_different(F.col("a"), F.col("b"))).collect()] == [False, True, False, True, None, False]


def test_connectors_turn_meet_and_are_drawn_twice():
    lines = [((0, 0), (0, 10)), ((20, 10), (0, 10)), ((0.5, 0), (0.5, 10)), ((100, 0), (100, 5)), ((50, 50), (50, 50))]
    assert sorted(len(p) for p in L._paths(lines, [])) == [2, 3]
    # A box at the joint stops the line there.
    assert sorted(len(p) for p in L._paths(lines[:2], [(-1, 9, 1, 11)])) == [2, 2]
    ring = [((0, 0), (9, 0)), ((9, 0), (9, 9)), ((9, 9), (0, 0))]
    assert [len(p) for p in L._paths(ring, [])] == [4]
