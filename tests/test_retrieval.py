import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from marlstone.operators import metrics as M
from marlstone.operators import retrieval as R
from marlstone.operators import statistics as S
from marlstone.operators.agreement import alpha


def scores(spark, rows):
    return spark.createDataFrame(rows, "query_id bigint, item_id bigint, score double")


def test_okapi_equals_the_formula(spark):
    items = spark.createDataFrame([(1, "fever fever cough"), (2, "fever rash"), (3, "rash"), (4, None), (5, "")], "id bigint, text string")
    held = R.terms(items, "id", "text")
    query = R.queries_of(spark.createDataFrame([(9, "fever")], "id bigint, text string"), "id", "text")
    got = {r.item_id: r.score for r in R.okapi(query, held).collect()}
    idf, mean = math.log((3 - 2 + 0.5) / 2.5 + 1), 2.0
    want = {1: idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / mean)), 2: idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 2 / mean))}
    assert set(got) == {1, 2} and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_cosine_blocks_equal_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    x[5] = 0
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "id bigint, vector array<double>")
    got = R.cosine(frame.where("id < 10"), frame, 7).collect()
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    for q in range(10):
        s = np.round(unit @ unit[q], 6)
        order = [i for i in sorted(range(300), key=lambda i: (-s[i], i)) if i != q][:7]
        assert [r.item_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: (-r.score, r.item_id))] == order


def test_constant_pool_is_one_and_missing_side_is_zero(spark):
    union = R.channels(scores(spark, [(1, 1, 3.0), (1, 2, 3.0)]), scores(spark, [(1, 3, 0.5)]))
    out = {r.item_id: (r.lexical, r.dense) for r in R.min_max(R.min_max(union.fillna(0.0), "lexical"), "dense").collect()}
    assert out == {1: (1.0, 0.0), 2: (1.0, 0.0), 3: (0.0, 1.0)}


def test_ties_go_by_id(spark):
    assert [r.item_id for r in R.top(scores(spark, [(1, 5, 1.0), (1, 3, 1.0), (1, 4, 1.0)]), 2).orderBy("rank").collect()] == [3, 4]


def test_reciprocal_rank_of_missing_channel(spark):
    union = R.channels(scores(spark, [(1, 1, 3.0)]), scores(spark, [(1, 2, 0.5)]))
    got = {(r.item_id, r.weight): r.score for r in R.weighted_reciprocal(union, [0.25]).collect()}
    assert abs(got[(1, 0.25)] - 0.25 / 61) < 1e-9 and abs(got[(2, 0.25)] - 0.75 / 61) < 1e-9


def test_parts_over_their_limit_leave_room_under_the_cap(spark):
    rows = [(1, 1, "d", "t", 1, 9.0), (1, 1, "d", "t", 2, 8.0), (1, 1, "d", "t", 3, 7.0), (1, 1, "d", None, 4, 6.0)]
    frame = spark.createDataFrame(rows, "query_id bigint, group int, document string, split_id string, item_id bigint, score double")
    assert sorted(r.item_id for r in R.capped(frame, cap=3, least=0.0, parts=2).collect()) == [1, 2, 4]


def test_metrics_at_k_and_queries_without_gold(spark):
    runs = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 10, 1), (3, 10, 1)], "query_id bigint, item_id bigint, rank int")
    gold = spark.createDataFrame([(1, 11), (1, 11), (1, 12), (2, 99)], "query_id bigint, item_id bigint")
    got = {(r.query_id, r.k): (r.precision, r.recall, r.reciprocal_rank) for r in M.at_k(runs, gold, [1, 5]).collect()}
    assert got == {(1, 1): (0.0, 0.0, 0.0), (1, 5): (0.5, 0.5, 0.5), (2, 1): (0.0, 0.0, 0.0), (2, 5): (0.0, 0.0, 0.0)}


def test_popularity_leaves_own_gold_out(spark):
    gold = spark.createDataFrame([(1, 1), (2, 1), (2, 2), (3, 3)], "query_id bigint, item_id bigint")
    got = [(r.item_id, r["rank"]) for r in M.popularity(gold, 2).where("query_id = 3").orderBy("rank").collect()]
    assert got == [(1, 1), (2, 2)]


def test_identical_arms_have_p_one(spark):
    pairs = spark.createDataFrame([("x", i, 0.5, 0.5) for i in range(20)], "arm string, key bigint, a double, b double")
    row = S.paired_test(pairs, ["arm"], draws=50).first()
    assert row.p == 1.0 and row.low == row.high == 0.0


def test_clear_difference_has_small_p_and_paired_interval_is_narrow(spark):
    a, b = [1, 1, 0.5, 1, 0.5] * 10, [0, 0.5, 0, 0.5, 0] * 10
    pairs = spark.createDataFrame([("x", i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b))], "arm string, key bigint, a double, b double")
    assert S.paired_test(pairs, ["arm"], draws=200).first().p < 0.01


def test_registered_bootstraps_take_all_draws(spark, tmp_path, monkeypatch):
    from marlstone.plans import workflow_queries as Q

    rows = [("x", i, float(100 * (i % 7) - 200)) for i in range(30)] + [("y", i, float(i)) for i in range(12)]
    spark.createDataFrame(rows, "c_mktsegment string, c_custkey bigint, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    seen = []
    for name in ("interval", "paired_test", "interval_numpy"):
        real = getattr(S, name)
        monkeypatch.setattr(S, name, lambda *a, draws=S.DRAWS, real=real: seen.append(draws) or real(*a, draws=draws))
    for name in ("sta1_bootstrap_interval", "sta2_paired_interval", "sta3_paired_test", "sta1_numpy_interval"):
        assert Q.QUERIES[name](spark, str(tmp_path)).count() == 2
    assert seen == [10_000] * 4


def test_draws_equal_those_of_the_stated_hash(spark):
    import hashlib

    residue = lambda kind, v: int(hashlib.md5(f"1234|{kind}|{v}".encode()).hexdigest()[:8], 16) % S.PRIME

    def weight(key, draw):
        a = residue("key", key)
        x = a * residue("draw", draw) % S.PRIME
        y = ((x * x % S.PRIME) * (x ^ 1) + a) % S.PRIME
        return sum(y >= t for t in S.STEPS)

    rows = [("x", i, float(i * i % 11)) for i in range(9)] + [("y", i, None if i == 2 else float(i)) for i in range(5)] + [(None, 7, 2.5), ("z", 1, None)]
    got = {(r.arm, r.draw): r.m for r in S._means(spark.createDataFrame(rows, "arm string, key bigint, value double"), ["arm"], 200, 1234).collect()}
    for arm in ("x", "y", None):
        for draw in range(200):
            drawn = [(weight(k, draw), v) for a, k, v in rows if a == arm and v is not None]
            n = sum(w for w, _ in drawn)
            assert (arm, draw) not in got if n == 0 else abs(got[arm, draw] - sum(w * v for w, v in drawn) / n) < 1e-9
    assert not any(arm == "z" for arm, _ in got)


def test_weights_are_poisson_and_independent():
    keys = np.random.default_rng(1).integers(0, S.PRIME, 400)
    w = S.weights(keys, S.draw_residues(2000))
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    assert np.abs(np.corrcoef(w)[np.triu_indices(400, 1)]).mean() < 0.025 and np.abs(np.corrcoef(w.T[:300])[np.triu_indices(300, 1)]).mean() < 0.06


def test_interval_is_near_the_one_with_replacement(spark):
    rng = np.random.default_rng(2)
    scores = spark.createDataFrame([("x", i, float(v)) for i, v in enumerate(rng.exponential(1.0, 600))], "arm string, key bigint, value double")
    one, two = S.interval(scores, ["arm"], draws=4000).first(), S.interval_numpy(scores, "arm", draws=4000).first()
    assert one.n == two.n == 600 and abs(one.mean - two.mean) < 1e-9
    assert abs(one.low - two.low) < 0.01 and abs(one.high - two.high) < 0.01


def test_arms_of_one_key_of_no_value_and_empty_tables(spark):
    kind = "arm string, key bigint, value double, a double, b double, draw int"
    scores = spark.createDataFrame([("one", 1, 2.0, 1.0, 2.0, 1), ("none", 1, None, None, 1.0, 1)], kind)
    got = {r.arm: r for r in S.interval(scores, ["arm"], draws=50).collect()}
    assert got["one"].low == got["one"].high == 2.0 and got["none"].low is None and got["none"].n == 1
    assert {r.arm: r.p for r in S.paired_test(scores, ["arm"], draws=50).collect()} == {"one": 0.0, "none": None}
    assert S.interval(scores.where("false"), ["arm"], draws=5).count() == S.paired_test(scores.where("false"), ["arm"], draws=5).count() == 0


def _corpus(spark, n=700):
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join(rng.choice(words, rng.integers(1, 30)))) for i in range(n)]
    # An id with two rows, equal texts (ties), no text at all.
    return spark.createDataFrame(rows + [(3, "w1 w1 w2"), (n, rows[5][1]), (n + 1, rows[5][1]), (n + 2, None), (n + 3, "")], "id bigint, text string")


def test_blocks_of_texts_give_the_scores_of_postings(spark):
    items = _corpus(spark)
    held, bag = R.terms(items, "id", "text"), R.bags(items, "id", "text")
    query = R.queries_of(items.where("id < 150"), "id", "text")
    for norm, old in ((True, R.okapi), (False, R.tf_idf)):
        want = {(r.query_id, r.item_id): r.score for r in old(query, held).collect()}
        got = {(r.query_id, r.item_id): r.score for r in R.scored(query, bag, norm).collect()}
        assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 2e-6
        first = {(r.query_id, r.item_id, r.rank) for r in R.top(R.scored(query, bag, norm, 9), 9).collect()}
        assert first == {(r.query_id, r.item_id, r.rank) for r in R.top(R.scored(query, bag, norm), 9).collect()}


def test_best_of_each_label_and_few_pairs_move(spark):
    items = _corpus(spark).withColumn("kind", F.when(F.col("id") % 7 > 0, (F.col("id") % 7).cast("string")))
    bag = R.bags(items, "id", "text", ["kind"])
    query = R.queries_of(items.where("id < 20"), "id", "text")
    kinds = bag.select("item_id", "kind")
    every = R.scored(query, bag).join(kinds, "item_id")
    few = R.scored(query, bag, depth=2, label=F.col("kind")).join(kinds, "item_id")
    rank = lambda df: {(r.query_id, r.kind, r.item_id) for r in R.top(df.where("kind is not null"), 2, ["query_id", "kind"]).collect()}
    assert rank(few) == rank(every)
    assert few.where("kind is null").count() == every.where("kind is null").count()
    # What a ranking moves is bounded by depth and parts, not by the pairs that share a term.
    assert R.scored(query, bag, depth=2).count() <= 20 * 3 * 3 < every.count() / 10


def test_no_queries_and_no_items(spark):
    items = _corpus(spark, 20)
    bag, query = R.bags(items, "id", "text"), R.queries_of(items, "id", "text")
    assert R.scored(query.where("false"), bag, depth=3).count() == R.scored(query, bag.where("false"), depth=3).count() == 0


def test_both_norms_in_one_pass_by_keys_of_two_fields(spark):
    items = _corpus(spark)
    bag = R.bags(items, "id", "text")
    query = R.queries_of(items.where("id < 40"), "id", "text")
    keyed = query.withColumn("query_id", F.struct(F.lit("plain").alias("words"), "query_id"))
    both = R.scored_by(keyed, bag, [True, False], 9).select("query_id.*", "item_id", "score", "norm")
    for norm in (True, False):
        got = {(r.query_id, r.item_id): r.score for r in both.where(F.col("norm") == norm).collect()}
        assert got and got == {(r.query_id, r.item_id): r.score for r in R.scored(query, bag, norm, 9).collect()}


def test_rare_and_common_terms_give_the_matrix_product():
    rng = np.random.default_rng(2)
    n, width, terms = 30, 200, 50
    share = np.concatenate([np.full(3, 0.9), np.full(40, 0.02), np.zeros(7)])
    asked, held = rng.random((n, terms)) < share, rng.random((width, terms)) < share
    t, q = np.nonzero(asked.T)
    code, item = np.nonzero(held.T)
    weight, value = rng.random(len(t)), rng.random(len(code))
    left, right = np.zeros((n, terms)), np.zeros((terms, width))
    left[q, t], right[code, item] = weight, value
    block = (n, q, t, weight, np.append(0, np.cumsum(asked.sum(axis=0))))
    met = asked.sum(axis=0) * held.sum(axis=0)
    assert (met > R.DENSE * n * width).sum() >= 3 and ((met > 0) & (met <= R.DENSE * n * width)).any()
    for got, v in zip(R._products_of(block, code, item, np.append(0, np.cumsum(held.sum(axis=0))), [value, 2 * value], width), (1, 2)):
        assert np.allclose(got, v * (left @ right)) and ((got > 0) == (left @ right > 0)).all()


def test_a_part_drops_what_is_overtaken_and_labels_lie_in_few_parts(spark, monkeypatch):
    items = _corpus(spark, 4000).withColumn("kind", (F.col("id") % 11).cast("string"))
    bag = R.bags(items, "id", "text", ["kind"])
    query = R.queries_of(items.where("id < 20"), "id", "text")
    every = R.scored(query, bag).join(bag.select("item_id", "kind"), "item_id").where("score >= 1")
    few = R.scored(query, bag, depth=2, label=F.col("kind"), least=1.0).join(bag.select("item_id", "kind"), "item_id")
    rank = lambda df: {(r.query_id, r.kind, r.item_id) for r in R.top(df, 2, ["query_id", "kind"]).collect()}
    assert rank(few) == rank(every) and few.where("score < 1").count() == 0
    # Two parts hold a label at most.
    assert few.groupBy("query_id", "kind").count().where("count > 2 * 3").isEmpty()
    part = R._Part([None], 3)
    part.asked = [pa.RecordBatch.from_pydict({"query_id": [1], "text": ["a"], "weights": [[1.0]]})]
    monkeypatch.setattr(R, "SPARE", 10)
    for start in range(0, 400, 40):
        texts = ["a " * (1 + k % 97) for k in range(start, start + 40)]
        list(part.add(pa.RecordBatch.from_pydict({"item_id": list(range(start, start + 40)), "text": [t.strip() for t in texts], "label": [0] * 40})))
        assert sum(len(rows[1]) for rows in part.best[0][0]) <= 2 * 3 + 10
    assert [(r["item_id"], r["score"]) for b in part.end() for r in b.to_pylist()] == [(96, 97.0), (193, 97.0), (290, 97.0)]
