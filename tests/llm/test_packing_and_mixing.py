import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import mixing as M
from marlstone.llm import packing as P
from marlstone.llm import tokens as K

SPEC = "container string, capacity_tokens int, capacity int"
TARGETS = "source string, target_weight double, max_repeats int, share double"


def sizes(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens int")


def test_every_text_has_one_place_and_nothing_overflows(spark):
    rng = random.Random(1)
    rows = [(i, "s", rng.choice([3, 40, 100, 130, 400, 5000])) for i in range(400)]
    places = P.packed(sizes(spark, rows), spark.createDataFrame([("a", 512, 1), ("b", 128, 1), ("c", 0, 1), (None, 9, 1), ("d", None, 1)], SPEC), shard=150).collect()
    for box, capacity in (("a", 512), ("b", 128)):
        used, pieces = {}, {}
        for p in places:
            if p.container == box:
                used[p.sequence_id] = used.get(p.sequence_id, 0) + p.n_tokens
                pieces.setdefault(p.doc_id, []).append((p.token_from, p.n_tokens))
        assert max(used.values()) <= capacity
        for doc, _, n in rows:
            spans = sorted(pieces[doc])
            assert sum(k for _, k in spans) == n and spans[0][0] == 0
            assert len(spans) == (1 if n <= capacity else math.ceil(n / capacity))
    assert {p.container for p in places} == {"a", "b"}


def test_little_space_is_left():
    rng = np.random.default_rng(2)
    x = np.sort(rng.integers(10, 400, 4000))[::-1]
    place = P.pack(x, 512)
    assert np.bincount(place, x).max() <= 512
    assert x.sum() / (512 * (place.max() + 1)) > 0.98


def test_empty_packing(spark):
    assert P.packed(sizes(spark, []), spark.createDataFrame([("a", 5, 1)], SPEC)).count() == 0


def test_shares_are_reached_within_a_document(spark):
    rng = random.Random(3)
    rows = [(i, "abc"[i % 3], rng.randrange(20, 200)) for i in range(6000)] + [(9000 + i, None, 50) for i in range(5)]
    targets = spark.createDataFrame([("a", 2.0, 1, 0.0), ("b", 1.0, 3, 0.0), ("c", 1.0, None, 0.0), ("gone", 1.0, 2, 0.0), ("d", None, 1, 0.0), ("e", 0.0, 1, 0.0)], TARGETS)
    mix = M.mixed(sizes(spark, rows), targets)
    got = {r.source: r for r in M.shares(mix, targets).collect()}
    assert abs(got["a"].actual_share - 0.5) < 0.002 and abs(got["b"].actual_share - 0.25) < 0.002
    assert got["gone"].n_tokens == got["d"].n_tokens == 0 and mix.where("source is null").count() == 0


def test_small_sources_repeat_up_to_the_cap_and_larger_budgets_nest(spark):
    rows = [(i, "big", 100) for i in range(1000)] + [(2000 + i, "small", 100) for i in range(100)]
    targets = spark.createDataFrame([("big", 0.5, 1, 0.0), ("small", 0.5, 3, 0.0)], TARGETS)
    mix = {r.doc_id: r.copies for r in M.mixed(sizes(spark, rows), targets, 40_000).collect()}
    small = [c for k, c in mix.items() if k >= 2000]
    assert len(small) == 100 and set(small) == {2}
    more = {r.doc_id: r.copies for r in M.mixed(sizes(spark, rows), targets, 50_000).collect()}
    assert all(more[k] >= c for k, c in mix.items())
    capped = M.mixed(sizes(spark, rows), targets, 200_000)
    got = {r.source: r.n_tokens for r in M.shares(capped, targets).collect()}
    assert got == {"big": 100_000, "small": 30_000}


def test_mix_of_nothing(spark):
    targets = spark.createDataFrame([("a", 1.0, 1, 0.0)], TARGETS)
    assert M.mixed(sizes(spark, []), targets).count() == 0
    assert M.mixed(sizes(spark, [(1, "a", 5)]), targets.where("false")).count() == 0


@pytest.mark.skipif(not __import__("os").path.exists(K.VOCABULARY), reason="no vocabulary here")
def test_token_counts_and_pieces_restore_texts(spark):
    texts = ["Hello world, it's 5 mg/kg.", "", None, "éàü " * 300, "<|endoftext|>"]
    docs = spark.createDataFrame([(i, "s", t, 7) for i, t in enumerate(texts)], "doc_id bigint, source string, text string, n_tokens int")
    sized = K.sized(docs, F.col("text"))
    code = K.encoding()
    assert {r.doc_id: r.n_tokens for r in sized.collect()} == {i: len(code.encode_ordinary(t)) for i, t in enumerate(texts) if t}
    places = P.packed(sized, spark.createDataFrame([("a", 64, 1)], SPEC))
    parts = sorted((r.doc_id, r.piece_no, r.text) for r in P.with_text(places, docs, K.VOCABULARY).collect())
    whole = {}
    for doc, _, text in parts:
        whole[doc] = whole.get(doc, "") + text
    assert whole[0] == texts[0] and whole[4] == texts[4] and len(whole[3]) == len(texts[3])


def one_by_one(sizes, capacity, opened, close):
    """The rule taken literally: items of one size first where they fill a sequence almost, then by lowest cost with room."""
    room, cost, place = [capacity] * opened, [0.0] * opened, []
    for n in sorted(set(sizes.tolist()), reverse=True):
        k, price = int((sizes == n).sum()), P.LINEAR * n + P.QUADRATIC * float(n) ** 2
        exact = sorted((i for i, r in enumerate(room) if 0 <= r - n <= close), key=lambda i: (cost[i], i))[:k]
        picks = list(exact)
        for i in exact:
            room[i], cost[i] = room[i] - n, cost[i] + price
        for _ in range(k - len(picks)):
            fits = [i for i, r in enumerate(room) if r >= n]
            if not fits:
                room.append(capacity)
                cost.append(0.0)
                fits = [len(room) - 1]
            i = min(fits, key=lambda i: (cost[i], i))
            room[i], cost[i] = room[i] - n, cost[i] + price
            picks.append(i)
        place += picks
    return len(room), sorted(round(c, 6) for c in cost)


def test_items_of_one_size_placed_together_go_where_single_ones_would():
    rng = np.random.default_rng(5)
    for capacity in (64, 200):
        x = np.sort(rng.integers(1, capacity, 300))[::-1].copy()
        place, m, _ = P.balanced(x, capacity, 100, capacity // 32)
        price = P.LINEAR * x + P.QUADRATIC * x.astype(float) ** 2
        assert (m, sorted(round(c, 6) for c in np.bincount(place, price, minlength=m))) == one_by_one(x, capacity, 100, capacity // 32)


def test_packed_pieces_carry_their_text(spark):
    texts = [(1, "a few words of text", 1), (2, "one two three four five six seven eight nine ten", 1), (2, "short", 1), (3, None, 1), (4, "", 1)]
    documents = spark.createDataFrame(texts, "doc_id bigint, text string, capacity int")
    sized = K.sized(documents.withColumn("source", F.lit("s")), F.col("text"))
    places = P.packed(sized, spark.createDataFrame([("a", 6, 1)], SPEC))
    rows = sorted(P.with_text(places, documents).collect(), key=lambda r: (r.doc_id, r.piece_no))
    whole = {}
    for r in rows:
        whole[r.doc_id] = whole.get(r.doc_id, "") + r.text
    assert whole == {1: texts[0][1], 2: texts[1][1]}
