import random

from pyspark.sql import functions as F

from marlstone.operators import records as N
from marlstone.operators import selection as Z

KIND = "id string, category string, findings array<string>, hr double, extra int, _o string"


def people(n=120, seed=3):
    rng = random.Random(seed)
    return [(f"p{i:03}", rng.choice(["a", "b", None]), rng.sample("tuvwxyz", rng.randrange(0, 6)), rng.choice([None, float(rng.randrange(100, 140))]), 1, "x") for i in range(n)]


def like(a, b):
    x, y = set(a[2]), set(b[2])
    return bool(x and y) and len(x & y) >= 0.8 * len(x | y) and (a[3] is None or b[3] is None or abs(a[3] - b[3]) <= 15)


def literal(rows, loops):
    accepted, picks, short = [], [], []
    for name, targets in loops:
        for category in sorted(targets):
            have = 0
            for r in sorted((r for r in rows if r[1] == category), key=lambda r: r[0][::-1]):
                if have < targets[category] and not any(r[0] == a[0] or like(r, a) for a in accepted):
                    accepted.append(r)
                    have += 1
                    picks.append((name, category, have, r[0]))
            short.append((name, category, targets[category] - have))
    return picks, short


def test_picks_equal_the_literal_rule_with_blocks_of_any_size(spark):
    rows = people() + [("hot" + str(i), "a", ["t", "u"], None, 1, "x") for i in range(60)]
    loops = [("one", {"a": 6, "b": 5}), ("two", {"a": 40, "b": 3})]
    want, missing = literal(rows, loops)
    frame = spark.createDataFrame(rows + rows[:3], KIND)
    for block in (4, 500):
        picks, short = Z.picked(frame, [Z.Loop(n, t) for n, t in loops], F.reverse("id"), 0.8, {"hr": 15.0}, block=block)
        assert sorted((r.loop, r.category, r.pick, r.id) for r in picks.collect()) == sorted(want)
        assert sorted((r.loop, r.category, r.missing) for r in short.collect()) == sorted(missing)


def test_empty_tables_and_targets(spark):
    frame = spark.createDataFrame([], KIND)
    picks, short = Z.picked(frame, [Z.Loop("one", {"a": 2, "b": 0})], F.col("id"), 0.8, {"hr": 15.0})
    assert picks.count() == 0 and {(r.category, r.missing) for r in short.collect()} == {("a", 2), ("b", 0)}


def test_links_by_class_equal_links_by_pair(spark):
    rows = [(r[0], r[2], r[3]) for r in people(150, 7)] + [(f"copy{i}", ["t", "u", "v"], 120.0) for i in range(30)] + [("nofinding", [], 120.0), ("null", None, None)]
    frame = spark.createDataFrame(rows, "id string, findings array<string>, hr double")
    for tolerance in ({"hr": 15.0}, {}):
        pairs = N.link_counts(N.similar_records(frame, 0.8, tolerance))
        assert {tuple(r) for r in N.similar_links(frame, 0.8, tolerance).collect()} == {tuple(r) for r in pairs.collect()}
