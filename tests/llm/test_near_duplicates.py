import random
from itertools import combinations
from pathlib import Path

from pyspark.sql import functions as F

from marlstone.llm import near_duplicates as N
from marlstone.session import shared_folder


def records(seed=4, n=250):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    common = vocabulary[:15]
    rows = []
    for i in range(n):
        words = [*common, *rng.sample(vocabulary, 25)]
        rows.append((f"q{i:04}", " ".join(words)))
        for _ in range(rng.choice([0, 0, 1, 2])):
            edited = [w for w in words if rng.random() > 0.06] + rng.sample(vocabulary, 1)
            rng.shuffle(edited)
            rows.append((f"q{len(rows) + 5000:05}", " ".join(edited)))
    rows += [("copy1", rows[0][1]), ("copy2", rows[0][1].upper()), ("copy2", rows[0][1].upper()), ("none", None), ("blank", "?!"), ("blank2", "?!"), (None, rows[0][1])]
    return rows


def brute(rows, threshold):
    sets = [(i, set(t.lower().split())) for i, t in rows if i and t and t != "?!"]
    return {tuple(sorted((a, b))) for (a, x), (b, y) in combinations(sets, 2) if a != b and len(x & y) / len(x | y) >= threshold}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "question_id string, text string, id string, size int")


def test_pairs_equal_brute_force(spark):
    rows = records()
    members, sets = N.token_sets(frame(spark, rows), "question_id", N.word_set(F.col("text")))
    got = {(r.id_a, r.id_b) for r in N.record_pairs(members, N.similar_sets(sets)).collect()}
    want = brute(rows, 0.75)
    assert want and not got - want and len(got & want) >= 0.99 * len(want)


def test_buckets_that_never_part_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "MOST_ROUNDS", 1)
    base = [f"w{i}" for i in range(40)]
    rows = [(f"q{i}", " ".join([*base, f"own{i}"])) for i in range(60)]
    members, sets = N.token_sets(frame(spark, rows), "question_id", N.word_set(F.col("text")))
    assert N.record_pairs(members, N.similar_sets(sets, bucket=8)).count() == 60 * 59 // 2


def test_groups_hold_every_record_once_and_connect(spark):
    rows = [("a", "1 2 3 4 5 6 7 8"), ("b", "1 2 3 4 5 6 7 9"), ("c", "1 2 3 4 5 6 9 10"), ("d", "x y z"), ("e", "x y z"), ("f", None)]
    members, sets = N.token_sets(frame(spark, rows), "question_id", N.word_set(F.col("text")))
    links = N.similar_sets(sets)
    got = {r.id: r for r in N.groups(members, links, frame(spark, rows).select(F.col("question_id").alias("id"))).collect()}
    assert set(got) == set("abcdef")
    assert got["a"].group_id == got["b"].group_id == got["c"].group_id and got["b"].n_links == 2
    assert got["d"].group_id == got["e"].group_id and got["d"].n_copies == 2 and got["f"].group_id is None


def test_components_follow_long_chains(spark):
    links = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(100)] + [("z1", "z2")], "a string, b string")
    nodes = spark.createDataFrame([(f"n{i:03}",) for i in range(101)] + [("z1",), ("z2",), ("alone",)], "node string")
    got = {r.node: r.component for r in N.components(nodes, links).collect()}
    assert {v for k, v in got.items() if k[0] == "n"} == {"n000"} and got["z2"] == "z1" and got["alone"] == "alone"


def test_empty_table(spark):
    members, sets = N.token_sets(frame(spark, records()).where("false"), "question_id", N.word_set(F.col("text")))
    links = N.similar_sets(sets)
    assert N.record_pairs(members, links).count() == 0 and N.groups(members, links).count() == 0


def test_more_runs_for_more_recall():
    assert N.runs_for(0.75, 0.999, 7) > N.runs_for(0.75, 0.9, 7) >= 1


def test_sets_within_others_are_found_at_the_greatest_depth(spark):
    rows = []
    for i in range(300):
        words = [f"p{i}w{k}" for k in range(20)]
        rows += [(f"a{i}", " ".join(words)), (f"b{i}", " ".join(words[:15]))]
    members, sets = N.token_sets(frame(spark, rows), "question_id", N.word_set(F.col("text")))
    assert N.similar_sets(sets, bucket=1).count() >= 297


def test_very_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(300_000))
    rows = [("a", long), ("b", long + " more"), ("c", "short text"), ("d", "short text here and more")]
    members, sets = N.token_sets(frame(spark, rows), "question_id", N.word_set(F.col("text")))
    assert [(r.id_a, r.id_b) for r in N.record_pairs(members, N.similar_sets(sets)).collect()] == [("a", "b")]


def test_runs_in_passes_find_the_same_and_leave_no_tables(spark, monkeypatch):
    members, sets = N.token_sets(frame(spark, records(n=60)), "question_id", N.word_set(F.col("text")))
    tables = lambda: set(Path(shared_folder(spark).removeprefix("file://")).glob("cut-*"))
    before = tables()
    want = {(r.a, r.b) for r in N.similar_sets(sets).collect()}
    assert want and len(tables() - before) == 1
    monkeypatch.setattr(N, "PASS", 8 * sets.count())
    assert {(r.a, r.b) for r in N.similar_sets(sets).collect()} == want and len(tables() - before) == 2
