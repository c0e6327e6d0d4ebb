import datetime as dt
import random

from pyspark.sql import functions as F

from marlstone.operators import filters as P
from marlstone.operators import grounding as G
from marlstone.operators import records as N
from marlstone.operators import workflow as W
from marlstone.sources import readers


def test_latest_timed_takes_first_of_equal_and_last_without_times(spark):
    frame = spark.createDataFrame([([(1, "a"), (2, "b"), (2, "c")],), ([(None, "a"), (None, "b")],), ([],), (None,)], "items array<struct<t:int,v:string>>")
    assert [r.v for r in frame.select(N.latest_timed(F.col("items"), "t")["v"].alias("v")).collect()] == ["b", "b", None, None]


def test_criteria_are_three_valued(spark):
    known = spark.createDataFrame([("k", "hr", 170.0, None), ("k", "flag", None, True)], "key string, path string, num double, flag boolean")
    rules = spark.createDataFrame([(1, "hr", ">", 160.0), (2, "hr", "<", 1.0), (3, "x", ">", 1.0), (4, "hr", "?", 1.0)], "criterion_id int, path string, operator string, value double")
    assert {r.criterion_id: r.matched for r in N.evaluated(rules, known).collect()} == {1: True, 2: False, 3: None, 4: None}


def test_similar_records_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [(str(i), rng.sample("abcdefgh", rng.randrange(0, 6)), rng.choice([None, float(rng.randrange(100, 130))])) for i in range(80)]
    frame = spark.createDataFrame(rows, "id string, findings array<string>, hr double")
    got = {(r.id_a, r.id_b) for r in N.similar_records(frame, 0.8, {"hr": 15.0}).collect()}
    want = set()
    for a in rows:
        for b in rows:
            if a[0] < b[0] and a[1] and b[1]:
                x, y = set(a[1]), set(b[1])
                if len(x & y) / len(x | y) >= 0.8 and (a[2] is None or b[2] is None or abs(a[2] - b[2]) <= 15):
                    want.add((a[0], b[0]))
    assert got == want and want


def test_presence_of_groups(spark):
    index = F.create_map(F.lit("sex"), F.lit(False), F.lit("vitals.0.hr"), F.lit(False), F.lit("vitals.1.hr"), F.lit(True))
    got = spark.range(1).select(*[N.present(index, F.lit(p), ["vitals"]).alias(f"c{i}") for i, p in enumerate(("sex", "vitals.hr", "vitals.rr", "other"))]).first()
    assert tuple(got) == (False, True, False, False)


def test_null_review_status_passes(spark):
    frame = spark.createDataFrame([("active", None), ("active", "pending"), ("withdrawn", None), (None, None)], "status string, review_status string")
    assert frame.where(P.retrievable()).count() == 1


def test_batch_guard_rejects_blank_and_todo(spark):
    frame = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", " todo: ask")], "dataset_id string, attested string")
    assert {r.dataset_id: r.accepted for r in P.batch_faults(frame, ["attested"]).collect()} == {"a": True, "b": False}


def test_anchored_windows_fold_per_key(spark):
    t = lambda s: dt.datetime(2025, 1, 1) + dt.timedelta(seconds=s)
    rows = [("k", t(0), True), ("k", t(10), True), ("k", t(899), True), ("k", t(900), True), ("k", t(901), False), ("k", t(902), True), ("j", t(5), True), (None, t(1), True)]
    got = W.anchored_windows(spark.createDataFrame(rows, "k string, t timestamp_ntz, f boolean"), "k", "t", "f", 2, 900)
    assert [(r.k, r["count"], r.blocked) for r in got.orderBy("k", "t").collect()] == [("j", 1, False), ("k", 1, False), ("k", 2, False), ("k", 3, True), ("k", 1, False), ("k", 1, False)]


def test_chain_check_finds_the_spoiled_row_and_its_successor(spark):
    chain = W.chained(spark.range(500).select(F.col("id").alias("n"), F.col("id").cast("string").alias("p")), "n", F.col("p"))
    spoiled = chain.withColumn("payload", F.when(F.col("seq") == 250, "x").otherwise(F.col("payload")))
    assert [r.seq for r in W.broken(spoiled, block=100).collect()] == [250]
    assert W.broken(chain, block=100).count() == 0
    assert {r.seq for r in W.broken(chain.where("seq <> 199"), block=100).collect()} == {200}


def test_digest_ignores_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    assert W.table_digest(a, ["a", "b"]).first() == W.table_digest(a.orderBy(F.desc("a")), ["a", "b"]).first()


def test_undated_versions_lose_to_dated(spark):
    rows = [("d", "v1", "9", None), ("d", "v2", "1", dt.date(2020, 1, 1)), ("d", "v3", "1", dt.date(2021, 1, 1))]
    got = W.superseded(spark.createDataFrame(rows, "document_id string, version_id string, label string, effective_date date"))
    assert [r.version_id for r in got.where("current").collect()] == ["v3"]


def test_grounding_verdicts_and_actions(spark):
    seg = [("a", 0, "claim", "Record respiratory rate for every neonate.", "Record respiratory rate for every neonate."), ("a", 1, "claim", "x", "y"), ("b", 0, "framing", "You should act.", None)]
    segments = spark.createDataFrame(seg, "answer_id string, segment_no int, type string, text string, quote string")
    cites = spark.createDataFrame(
        [("a", 0, "c1", "k", "Record  respiratory rate for every neonate.", None, False), ("a", 1, "c99", None, None, None, None)],
        "answer_id string, segment_no int, label string, chunk_id string, chunk_text string, review_status string, weak boolean",
    )
    judged = G.verdicts(segments, cites)
    got = {(r.answer_id, r.segment_no): (r.verdict, r.reason) for r in judged.collect()}
    assert got == {("a", 0): ("supported", None), ("a", 1): ("unsupported", "citation_not_retrieved"), ("b", 0): ("unsupported", "scope_violation")}
    assert {r.answer_id: (r.action, r.stripped) for r in G.actions(judged).collect()} == {"a": ("partial_strip", [1]), "b": ("escalate", [])}


def test_upserts_keep_old_versions_and_patches_merge(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    readers.upsert(spark, path, spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), ["k"])
    readers.upsert(spark, path, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), ["k"])
    now = spark.read.parquet(readers.current(path))
    assert sorted((r.k, r.v) for r in now.collect()) == [(1, "a"), (2, "c"), (3, "d")]
    patch = spark.createDataFrame([(1, "z"), (3, None)], "k int, v string")
    assert sorted((r.k, r.v) for r in readers.patched(now, patch, ["k"]).collect()) == [(1, "z"), (2, "c"), (3, "d")]
