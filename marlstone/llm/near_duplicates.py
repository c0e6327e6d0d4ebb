"""Similarity join of token sets by the chosen-path method, and groups of similar records.

Every run splits the sets recursively: at each step a set moves on to a bucket for each of its tokens that a hash of the
bucket and the token selects, with a chance of CHILDREN / (threshold * size), so similar sets share a selected token at
every step with an expectation of at least CHILDREN while unlike sets part ways. Buckets of at most `bucket` sets are
compared by brute force on one-bit sketches, survivors are verified exactly on their tokens; larger buckets split further
as long as splitting saves comparisons, then they are compared in blocks. Runs repeat until the expected recall of any
pair at the threshold, one set within the other and split as far as buckets are ever split, reaches the target. Equal
sets are one set throughout.

Defined cases: null or wordless texts are similar to nothing; repeated rows of one id count once; an id with several
texts is a member of several sets and keeps the links of each; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.session import cut, dropped, tidied

THRESHOLD = 0.75
RECALL = 0.999
#: Buckets up to this size are compared by brute force.
BUCKET = 128
#: Shared selected tokens a step that a pair at the threshold can expect. Above one a run keeps most pairs however deep it
#: goes, so few runs do; the number of buckets a set is in grows by CHILDREN / threshold a step.
CHILDREN = 1.25
#: Steps taken before sizes are counted first, and in each later round.
FIRST_STEPS, NEXT_STEPS = 3, 2
MOST_ROUNDS = 8
#: Sets times runs that are followed at once: further runs wait until the tables of those before are dropped, so that what
#: lies on disk doesn't grow with the runs.
PASS = 1_000_000
SKETCH_WORDS = 8
#: Tokens that a worker handles at a time.
PORTION = 200_000
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def word_set(text: Column) -> Column:
    """Distinct runs of a-z and 0-9 after lower-casing, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)))


def token_sets(records: DataFrame, record_id: str, tokens: Column) -> tuple[DataFrame, DataFrame]:
    """members (id, set_id) and sets (set_id, tokens as 64-bit hashes); set_id is a 128-bit digest of the sorted tokens."""
    listed = (
        records.where(F.col(record_id).isNotNull())
        .select(F.col(record_id).alias("id"), tokens.alias("words"))
        .where(F.size("words") > 0)
        .withColumn("set_id", F.md5(F.array_join("words", " ")))
    )
    sets = listed.groupBy("set_id").agg(F.first("words").alias("words"))
    with tidied(records.sparkSession):
        members = cut(listed.select("id", "set_id").distinct())
        return members, cut(sets.select("set_id", F.transform("words", lambda w: F.xxhash64(w)).alias("tokens")))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def survival(mean: float, steps: int) -> float:
    """Chance that a branching process with a Poisson number of children of this mean lives for so many steps."""
    alive = 1.0
    for _ in range(steps):
        alive = 1 - math.exp(-mean * alive)
    return alive


def runs_for(threshold: float, recall: float, steps: int) -> int:  # noqa: ARG001
    """Runs after which any pair at the threshold that goes down so many steps is found with the chance `recall`.

    Sets of a and b >= a tokens share a mean of CHILDREN * (1 + a / b) / (1 + threshold) chosen tokens a step. That is
    least where the smaller set lies within the larger, a / b = threshold, and CHILDREN there whatever the threshold.
    """
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(CHILDREN, steps)))


def _flat(tokens: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(t) for t in tokens], dtype=np.int64)
    flat = np.concatenate(list(tokens)).astype(np.int64).view(np.uint64) if len(tokens) else np.zeros(0, np.uint64)
    return sizes, np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(tokens) else sizes, flat


def _descend(paths: np.ndarray, rows: np.ndarray, sizes: np.ndarray, starts: np.ndarray, flat: np.ndarray, threshold: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Follows every (path, row) down so many steps; a path's children are the selected tokens of its row."""
    for _ in range(steps):
        n = sizes[rows]
        owner = np.repeat(np.arange(len(rows)), n)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        h = mix(mix(paths[owner] + _GOLDEN) ^ flat[starts[rows[owner]] + within])
        limit = np.minimum(1.0, CHILDREN / (threshold * n)) * float(1 << 63)
        chosen = (h >> np.uint64(1)).astype(np.float64) < limit[owner]
        paths, rows = mix(h[chosen] ^ np.uint64(0xD6E8FEB86659FD93)), rows[owner[chosen]]
    return paths, rows


def _portions(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Parts of a batch of at most PORTION tokens (a longer set alone), so that long texts don't fill the worker's memory."""
    load = frame.tokens.map(len).cumsum() // PORTION
    for _, part in frame.groupby(load.to_numpy(), sort=False):
        yield part


def _first_paths(runs: range, threshold: float, steps: int):  # noqa: ANN202
    def go(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in (part for batch in frames for part in _portions(batch)):
            sizes, starts, flat = _flat(frame.tokens)
            ids = frame.sid.to_numpy()
            for run in runs:
                seed = mix(np.full(len(frame), run + 1, dtype=np.uint64) * _GOLDEN)
                paths, rows = _descend(seed, np.arange(len(frame)), sizes, starts, flat, threshold, steps)
                yield pd.DataFrame({"path": paths.view(np.int64), "sid": ids[rows], "parent": np.int64(-1)})

    return go


def _next_paths(threshold: float, steps: int):  # noqa: ANN202
    def go(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in (part for batch in frames for part in _portions(batch)):
            sizes, starts, flat = _flat(frame.tokens)
            ids, parent = frame.sid.to_numpy(), frame.n.to_numpy()
            seed = frame.path.to_numpy().astype(np.int64).view(np.uint64)
            paths, rows = _descend(seed, np.arange(len(frame)), sizes, starts, flat, threshold, steps)
            yield pd.DataFrame({"path": paths.view(np.int64), "sid": ids[rows], "parent": parent[rows]})

    return go


def _sketches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One-bit minwise sketches of 64 * SKETCH_WORDS bits."""
    seeds = mix(np.arange(1, 64 * SKETCH_WORDS + 1, dtype=np.uint64) * _GOLDEN)
    for frame in frames:
        for part in _portions(frame):
            sizes, starts, flat = _flat(part.tokens)
            bits = np.empty((len(part), len(seeds)), dtype=np.uint8)
            for k, seed in enumerate(seeds):
                bits[:, k] = (np.minimum.reduceat(mix(flat ^ seed), starts) >> np.uint64(7)).astype(np.uint8) & 1
            packed = np.packbits(bits, axis=1)
            yield pd.DataFrame({"sid": part.sid.to_numpy(), "size": sizes.astype(np.int32), "sketch": [row.tobytes() for row in packed]})


def _compare(threshold: float, crossed: bool):  # noqa: ANN202
    """Brute force over rows sorted by bucket: row i meets the rows i + 1, i + 2, ... of its bucket.

    crossed: only rows of different sides of the bucket meet.
    """
    n_bits = 64 * SKETCH_WORDS
    agree = (1 + threshold) / 2
    least = n_bits * (agree - 4.5 * math.sqrt(agree * (1 - agree) / n_bits))

    def pairs(frame: pd.DataFrame) -> pd.DataFrame:
        bucket, ids, size = frame.bucket.to_numpy(), frame.sid.to_numpy(), frame["size"].to_numpy()
        side = frame.side.to_numpy()
        sketch = np.frombuffer(b"".join(frame.sketch), dtype=np.uint64).reshape(len(frame), SKETCH_WORDS)
        left, right = [], []
        live = np.arange(len(frame))
        d = 0
        while len(live):
            d += 1
            live = live[live + d < len(frame)]
            live = live[bucket[live] == bucket[live + d]]
            i = live[side[live] != side[live + d]] if crossed else live
            j = i + d
            fits = np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j])
            i, j = i[fits], j[fits]
            same = n_bits - np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1)
            i, j = i[same >= least], j[same >= least]
            left.append(ids[i])
            right.append(ids[j])
        a = np.concatenate(left) if left else np.zeros(0, np.int64)
        b = np.concatenate(right) if right else np.zeros(0, np.int64)
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()

    def go(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            last = frame.bucket == frame.bucket.iloc[-1]
            done, rest = frame[~last], frame[last]
            if len(done):
                yield pairs(done.reset_index(drop=True))
        if rest is not None and len(rest):
            yield pairs(rest.reset_index(drop=True))

    return go


def _brute_force(rows: DataFrame, sketched: DataFrame, threshold: float, crossed: bool) -> DataFrame:
    """rows: bucket, side, sid."""
    return (
        rows.join(sketched, "sid")
        .select("bucket", "side", "sid", "size", "sketch")
        .repartition("bucket")
        .sortWithinPartitions("bucket", "sid")
        .mapInPandas(_compare(threshold, crossed), "a bigint, b bigint")
    )


def similar_sets(sets: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, bucket: int = BUCKET) -> DataFrame:
    """a, b, similarity of the pairs of different sets (a < b) with a Jaccard similarity of at least the threshold.

    A large bucket of which a split would leave more than (threshold / CHILDREN) ** steps holds sets so much alike that
    splitting costs more comparisons than it saves. It is compared in blocks of at most `bucket` sets against each other,
    like any bucket still too large after MOST_ROUNDS rounds, so that no task holds the bucket and no pair is lost.
    Sets carry a number while they are compared.
    """
    runs = runs_for(threshold, recall, FIRST_STEPS + MOST_ROUNDS * NEXT_STEPS)
    with tidied(sets.sparkSession):
        numbered = cut(sets.withColumn("sid", F.monotonically_increasing_id()))
        sketched = cut(numbered.select("sid", "tokens").mapInPandas(_sketches, "sid bigint, size int, sketch binary"))
        at_once = max(1, min(runs, PASS // max(1, numbered.count())))
        passes = [range(k, min(k + at_once, runs)) for k in range(0, runs, at_once)]
        found = [_candidates(numbered, sketched, some, threshold, bucket) for some in passes]
        dropped(sketched)
        links = verified(_union(found).distinct(), numbered, threshold)
        dropped(numbered, *found)
    return links


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    return out


def _candidates(numbered: DataFrame, sketched: DataFrame, runs: range, threshold: float, bucket: int) -> DataFrame:
    """a, b by number: pairs of these runs that the sketches let through. A round's tables go as soon as the next has its own."""
    schema = "path bigint, sid bigint, parent bigint"
    active = cut(numbered.select("sid", "tokens").mapInPandas(_first_paths(runs, threshold, FIRST_STEPS), schema))
    found = []
    least = (threshold / CHILDREN) ** NEXT_STEPS
    for turn in range(MOST_ROUNDS + 1):
        counts = active.groupBy("path").agg(F.count("*").alias("n"))
        sized = cut(active.join(counts.where("n > 1"), "path"))
        dropped(active)
        small = sized.where(F.col("n") <= bucket).select(F.col("path").alias("bucket"), F.lit(0).alias("side"), "sid")
        found.append(cut(_brute_force(small, sketched, threshold, crossed=False).distinct()))
        large = sized.where(F.col("n") > bucket)
        alike = (F.col("parent") > 0) & (F.col("n") > F.col("parent") * least) if turn < MOST_ROUNDS else F.lit(True)
        whole = large.where(alike)
        if not whole.isEmpty():
            found.append(cut(_blocks(whole, sketched, threshold, bucket).distinct()))
        large = large.where(~alike)
        if turn == MOST_ROUNDS or large.isEmpty():
            dropped(sized)
            break
        wider = large.select("path", "sid", "n").join(numbered.select("sid", "tokens"), "sid")
        active = cut(wider.mapInPandas(_next_paths(threshold, NEXT_STEPS), schema))
        dropped(sized)
    pairs = cut(_union(found).distinct())
    dropped(*found)
    return pairs


def _blocks(large: DataFrame, sketched: DataFrame, threshold: float, bucket: int) -> DataFrame:
    """Pairs of the oversized buckets (path, n, sid), block against block."""
    n_blocks = F.ceil(F.col("n") / F.lit(bucket)).cast("int")
    blocked = large.withColumn("blocks", n_blocks).withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    meets = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda o: F.struct(F.least(o, F.col("block")).alias("low"), F.greatest(o, F.col("block")).alias("high")),
    )
    spread = blocked.select("path", "sid", "block", F.explode(meets).alias("meet"))
    key = F.xxhash64("path", "meet.low", "meet.high").alias("bucket")
    side = (F.col("block") == F.col("meet.high")).cast("int").alias("side")
    within = F.col("meet.low") == F.col("meet.high")
    same = spread.where(within).select(key, F.lit(0).alias("side"), "sid")
    other = spread.where(~within).select(key, side, "sid")
    return _brute_force(same, sketched, threshold, crossed=False).unionByName(_brute_force(other, sketched, threshold, crossed=True))


def verified(candidates: DataFrame, numbered: DataFrame, threshold: float) -> DataFrame:
    """The exact check: similarity from the tokens of both sides. candidates: a, b by number; out come the sets' digests."""
    one = numbered.select(F.col("sid").alias("a"), F.col("set_id").alias("sa"), F.col("tokens").alias("ta"))
    two = numbered.select(F.col("sid").alias("b"), F.col("set_id").alias("sb"), F.col("tokens").alias("tb"))
    half = cut(candidates.join(one, "a"))
    joined = half.join(two, "b").withColumn("shared", F.size(F.array_intersect("ta", "tb")))
    similarity = F.col("shared") / (F.size("ta") + F.size("tb") - F.col("shared"))
    near = joined.select(F.least("sa", "sb").alias("a"), F.greatest("sa", "sb").alias("b"), similarity.alias("similarity"))
    links = cut(near.where(F.col("similarity") >= threshold))
    dropped(half)
    return links


def record_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """id_a < id_b of different records in equal or linked sets: the full expansion, for where it is asked for."""
    sides = members.select(F.col("id").alias("id_a"), F.col("set_id").alias("a"))
    others = members.select(F.col("id").alias("id_b"), F.col("set_id").alias("b"))
    linked = links.select("a", "b").join(sides, "a").join(others, "b").select("id_a", "id_b")
    copies = sides.join(others, F.col("a") == F.col("b")).where("id_a < id_b").select("id_a", "id_b")
    ordered = linked.where("id_a <> id_b").select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
    return ordered.unionByName(copies).distinct()


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node, component (its least node): smallest labels spread over the links, doubling their reach by pointer jumps.

    Nothing goes to the driver but the number of labels that changed.
    """
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut(both.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
    while True:
        offered = both.join(label.select(F.col("node").alias("b"), "component"), "b").select(F.col("a").alias("node"), "component")
        least = offered.unionByName(label).groupBy("node").agg(F.min("component").alias("component"))
        over = label.select(F.col("node").alias("component"), F.col("component").alias("further"))
        jumped = least.join(over, "component", "left").select("node", F.least("component", F.coalesce("further", "component")).alias("component"))
        new = cut(jumped)
        changed = new.join(label.withColumnRenamed("component", "was"), "node").where("component <> was").limit(1).count()
        label = new
        if not changed:
            break
    return nodes.join(label, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def groups(members: DataFrame, links: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """id, group_id, n_links, n_copies: one row per record and set. group_id is the least set of the connected sets,
    n_links counts other sets linked to the record's, n_copies the records that share its set (itself included).

    records (id): records without words come too, with a null group, no links and one copy.
    """
    degree = (
        links.select(F.col("a").alias("set_id"))
        .unionByName(links.select(F.col("b").alias("set_id")))
        .groupBy("set_id")
        .agg(F.count("*").alias("n_links"))
    )
    copies = members.groupBy("set_id").agg(F.count("*").alias("n_copies"))
    labels = components(copies.select(F.col("set_id").alias("node")), links)
    per_set = copies.join(labels.withColumnRenamed("node", "set_id"), "set_id").join(degree, "set_id", "left")
    found = members.join(per_set, "set_id").select(
        "id", F.col("component").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies"
    )
    if records is None:
        return found
    bare = records.where("id is not null").select("id").distinct().join(members.select("id").distinct(), "id", "left_anti")
    none = bare.select("id", F.lit(None).cast("string").alias("group_id"), F.lit(0).cast("bigint").alias("n_links"), F.lit(1).cast("bigint").alias("n_copies"))
    return found.unionByName(none)
