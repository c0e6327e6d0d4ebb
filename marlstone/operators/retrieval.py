"""Lexical and vector scoring, fusion of channels, capped selection.

Scores are rows (query_id, item_id, score). Every ranking has a total order: the score, rounded to DIGITS, then the id.
Defined cases: items without a shared term have no lexical row; zero or null vectors have similarity 0; empty inputs
give empty results; a query without rows has no rank.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import analyze, query_terms
from marlstone.operators.joins import against_all

K1, B = 1.2, 0.75
RRF_DAMPING = 60
CANDIDATES, FUSED = 40, 24
DIGITS = 6
#: Rows of a block of vectors, on either side of the product.
ITEM_BLOCK, QUERY_BLOCK = 1024, 128
#: Queries of a block of lexical scores.
LEXICAL_BLOCK = 1024
#: Share of a block's pairs from which on a term goes into the matrix product.
DENSE = 0.004
#: Parts of many items, and items of a part where there are more than those hold; all queries go to each part.
PARTS, PART = 12, 131_072
#: Best items of a block of queries that a part holds besides those it needs, before it drops what others have overtaken.
SPARE = 50_000


def terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """item_id, term, tf."""
    exploded = items.select(F.col(item_id).alias("item_id"), F.explode(analyze(F.col(text))).alias("term"))
    return exploded.groupBy("item_id", "term").agg(F.count("*").cast("double").alias("tf"))


def lengths(postings: DataFrame) -> DataFrame:
    """item_id, n_terms."""
    return postings.groupBy("item_id").agg(F.sum("tf").alias("n_terms"))


def corpus_size(postings: DataFrame) -> tuple[int, float]:
    """Number of items with a term, and their mean length: two numbers."""
    row = lengths(postings).agg(F.count("*").alias("n"), F.avg("n_terms").alias("mean")).first()
    return row.n, row.mean or 0.0


def document_frequency(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def queries_of(texts: DataFrame, query_id: str, text: str) -> DataFrame:
    """query_id, term, weight: each distinct term of weight one."""
    return texts.select(F.col(query_id).alias("query_id"), F.explode(query_terms(F.col(text))).alias("term")).withColumn("weight", F.lit(1.0))


def emphasised(query: DataFrame, emphasis: DataFrame, weight: float) -> DataFrame:
    """query rows with the terms that also stand in the emphasis (query_id, term) at another weight."""
    marked = emphasis.select("query_id", "term", F.lit(True).alias("marked")).distinct()
    return query.join(marked, ["query_id", "term"], "left").select(
        "query_id", "term", F.when(F.col("marked"), F.lit(weight)).otherwise(F.col("weight")).alias("weight")
    )


def inverse_frequency(df: Column, n: int) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def tf_idf(query: DataFrame, postings: DataFrame) -> DataFrame:
    """Raw term frequency times inverse document frequency, no length norm."""
    n, _ = corpus_size(postings)
    weighted = query.join(document_frequency(postings), "term").withColumn("w", F.col("weight") * inverse_frequency(F.col("df"), n))
    scored = weighted.join(postings, "term").groupBy("query_id", "item_id").agg(F.sum(F.col("w") * F.col("tf")).alias("score"))
    return scored.withColumn("score", F.round("score", DIGITS))


def okapi(query: DataFrame, postings: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """Okapi BM25. Only postings of asked terms move; sums of a query and item form before the shuffle."""
    n, mean = corpus_size(postings)
    weighted = query.join(document_frequency(postings), "term").withColumn("w", F.col("weight") * inverse_frequency(F.col("df"), n))
    long = F.col("tf") + k1 * (1 - b + b * F.col("n_terms") / (mean or 1.0))
    part = F.col("w") * F.col("tf") * (k1 + 1) / long
    scored = weighted.select("query_id", "term", "w").join(postings.join(lengths(postings), "item_id"), "term")
    return scored.groupBy("query_id", "item_id").agg(F.round(F.sum(part), DIGITS).alias("score"))


def bags(items: DataFrame, item_id: str, text: str, keep: Sequence[str] = ()) -> DataFrame:
    """item_id, tokens, keep: the analyzer's tokens of each item that has any, one row an item. Columns of keep are null where
    rows of an id differ in them."""
    rows = items.select(F.col(item_id).alias("item_id"), analyze(F.col(text)).alias("tokens"), *keep).where("size(tokens) > 0")
    # Ids alone are counted: the texts are analyzed once, where the bags are written.
    sizes = items.agg(F.count("*").alias("n"), F.count_distinct(item_id).alias("items")).first()  # two numbers
    # Only where an id has several rows, they are put together.
    kept = [F.when((F.min(c) == F.max(c)) & (F.count(c) == F.count("*")), F.min(c)).alias(c) for c in keep]
    return rows if sizes.n == sizes.items else rows.groupBy("item_id").agg(F.flatten(F.collect_list("tokens")).alias("tokens"), *kept)


def terms_of(bag: DataFrame) -> DataFrame:
    """query_id, term, weight of one: each distinct token of the bags asks."""
    return bag.select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct("tokens")).alias("term")).withColumn("weight", F.lit(1.0))


class _Part:
    """The queries of a part, and the best items met so far. means: the mean length of items for Okapi's norm, None without norm;
    what the norms share is done once."""

    def __init__(self, means: Sequence[float | None], depth: int | None, least: float | None = None) -> None:
        self.means, self.depth, self.least = means, depth, least
        self.asked: list[pa.RecordBatch] = []
        self.vocabulary: pa.Array | None = None
        self.ids: list[pa.Array] = []
        self.n = 0

    def begin(self) -> None:
        asked = pa.Table.from_batches(self.asked).combine_chunks()
        lists = pc.split_pattern(asked.column("text"), " ").combine_chunks()
        coded = lists.flatten().dictionary_encode()
        self.vocabulary = coded.dictionary
        self.queries = asked.column("query_id").combine_chunks()
        of = np.repeat(np.arange(len(self.queries)), lists.value_lengths().to_numpy(zero_copy_only=False))
        code = coded.indices.to_numpy(zero_copy_only=False)
        weight = asked.column("weights").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        n = -(-len(self.queries) // LEXICAL_BLOCK)
        self.blocks = []
        for k in range(n):
            # The entries of a block's queries by term.
            lo, hi = np.searchsorted(of, [k * LEXICAL_BLOCK, (k + 1) * LEXICAL_BLOCK])
            order = np.argsort(code[lo:hi], kind="stable") + lo
            ends = np.cumsum(np.bincount(code[lo:hi], minlength=len(self.vocabulary)))
            self.blocks.append((min(LEXICAL_BLOCK, len(self.queries) - k * LEXICAL_BLOCK), of[order] - k * LEXICAL_BLOCK, code[order], weight[order], np.append(0, ends)))
        self.floor = [[{} for _ in self.means] for _ in range(n)]
        self.best: list[list[list[tuple]]] = [[[] for _ in self.means] for _ in range(n)]
        self.most = [[SPARE for _ in self.means] for _ in range(n)]

    def add(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if self.vocabulary is None:
            self.begin()
        for start in range(0, len(batch), 2048):
            yield from self._meet(batch.slice(start, 2048))

    def _meet(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lists = pc.split_pattern(batch.column("text"), " ")
        length = lists.value_lengths().to_numpy(zero_copy_only=False)
        width = len(length)
        code = pc.fill_null(pc.index_in(lists.flatten(), value_set=self.vocabulary), -1).to_numpy(zero_copy_only=False)
        item = np.repeat(np.arange(width), length)[code >= 0]
        cell, tf = np.unique(code[code >= 0].astype(np.int64) * width + item, return_counts=True)
        code, item = np.divmod(cell, width)
        ends = np.append(0, np.cumsum(np.bincount(code, minlength=len(self.vocabulary))))
        values = [tf.astype(float) if mean is None else tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[item] / mean)) for mean in self.means]
        labels = batch.column("label").to_numpy(zero_copy_only=False)
        groups = [(x, np.flatnonzero(labels == x)) for x in np.unique(labels)]
        for k, block in enumerate(self.blocks):
            for m, score in enumerate(_products_of(block, code, item, ends, values, width)):
                shared = score > 0
                score = np.round(score, DIGITS)
                if self.least is not None:
                    shared &= score >= self.least
                if self.depth is None:
                    q, x = np.nonzero(shared)
                    yield self._rows(k, m, q, batch.column("item_id").take(pa.array(x)), score[q, x])
                    continue
                score[~shared] = -np.inf
                for label, columns in groups:
                    part = score if len(groups) == 1 else score[:, columns]
                    floors, good = self.floor[k][m], part > -np.inf
                    # A label of few items has no floor.
                    if label in floors or len(columns) > self.depth:
                        floor = floors.setdefault(label, np.full(len(score), -np.inf))
                        good &= part >= floor[:, None]
                        many = np.flatnonzero(good.sum(axis=1) > self.depth)
                        if len(many):
                            floor[many] = -np.partition(-part[many], self.depth - 1, axis=1)[:, self.depth - 1]
                            good[many] &= part[many] >= floor[many][:, None]
                    q, x = np.nonzero(good)
                    self.best[k][m].append((np.full(len(q), label), q.astype(np.int32), (columns[x] + self.n).astype(np.int32), part[q, x]))
                if sum(len(rows[1]) for rows in self.best[k][m]) > self.most[k][m]:
                    self.best[k][m] = [self._first(self.best[k][m])]
                    self.most[k][m] = 2 * len(self.best[k][m][0][1]) + SPARE
        if self.depth is not None:
            self.ids.append(batch.column("item_id"))
        self.n += len(batch)

    def _rows(self, k: int, m: int, q: np.ndarray, items: pa.Array, score: np.ndarray) -> pa.RecordBatch:
        norm = pa.array(np.full(len(q), self.means[m] is not None))
        return pa.RecordBatch.from_arrays([self.queries.take(pa.array(q.astype(np.int64) + k * LEXICAL_BLOCK)), items, pa.array(score), norm], ["query_id", "item_id", "score", "norm"])

    def end(self) -> Iterator[pa.RecordBatch]:
        if not self.ids:
            return
        ids = pa.concat_arrays(self.ids)
        for k, m, rows in ((k, m, rows) for k, best in enumerate(self.best) for m, rows in enumerate(best)):
            _, q, x, score = self._first(rows)
            yield self._rows(k, m, q, ids.take(pa.array(x)), score)

    def _first(self, rows: list[tuple]) -> tuple[np.ndarray, ...]:
        """Of each label and query the first depth items."""
        label, q, x, score = (np.concatenate(c) for c in zip(*rows, strict=True))
        # Items come in the order of their ids.
        order = np.lexsort((x, -score, q, label))
        label, q, x, score = label[order], q[order], x[order], score[order]
        first = np.flatnonzero(np.concatenate([[True], (label[1:] != label[:-1]) | (q[1:] != q[:-1])])) if len(q) else np.zeros(0, int)
        keep = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q)))) < self.depth
        return label[keep], q[keep], x[keep], score[keep]


def _products_of(block: tuple, code: np.ndarray, item: np.ndarray, ends: np.ndarray, values: list[np.ndarray], width: int) -> list[np.ndarray]:
    """Queries x items for each of the values: the sums over common terms. Terms that many queries and items have go into one matrix
    product, each of the others adds to the pairs that have it."""
    n, of, asked, weight, starts = block
    met = np.diff(starts) * np.diff(ends)
    dense = met > DENSE * n * width
    place = np.cumsum(dense) - 1
    inside, held = dense[asked], dense[code]
    weights = np.zeros((n, int(dense.sum())))
    weights[of[inside], place[asked[inside]]] = weight[inside]
    out = []
    for v in values:
        tf = np.zeros((weights.shape[1], width))
        tf[place[code[held]], item[held]] = v[held]
        out.append(weights @ tf)
    flat = [score.reshape(-1) for score in out]
    for t in np.flatnonzero((met > 0) & ~dense):
        q, x = slice(starts[t], starts[t + 1]), slice(ends[t], ends[t + 1])
        at, w = of[q, None] * width + item[x], weight[q, None]
        for score, v in zip(flat, values):
            score[at] += w * v[x]
    return out


def scored(query: DataFrame, bag: DataFrame, norm: bool = True, depth: int | None = None, label: Column | None = None, least: float | None = None) -> DataFrame:
    """query_id, item_id, score of okapi(), without norm of tf_idf(), over bags(): what they give, pair by pair.

    Items are dealt to parts, all queries go to each of them, and a part multiplies blocks of queries with blocks of items;
    pairs never move. With a depth only the first depth + 1 items a query of each part are given (one may be the query
    itself), of each label of items if there is one, and all items whose label is null; top() ranks them. Weights are positive.
    Scores below `least` are left out.
    """
    return scored_by(query, bag, [norm], depth, label, least).drop("norm")


def scored_by(query: DataFrame, bag: DataFrame, norms: Sequence[bool], depth: int | None = None, label: Column | None = None, least: float | None = None) -> DataFrame:
    """query_id, item_id, score, norm: scored() with and without norm in one pass over the items."""
    sizes = bag.agg(F.count("*").alias("n"), F.sum(F.size("tokens")).alias("tokens")).first()  # two numbers
    n, mean = sizes.n, (sizes.tokens or 0) / max(1, sizes.n) or 1.0
    df = bag.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weighted = query.groupBy("query_id", "term").agg(F.sum("weight").alias("weight")).join(df, "term")
    row = F.sort_array(F.collect_list(F.struct("term", (F.col("weight") * inverse_frequency(F.col("df"), n)).alias("w"))))
    packed = weighted.groupBy("query_id").agg(row.alias("row"))
    parts = max(min(PARTS, -(-n // 256)), -(-n // PART), 1)
    kinds = {c: t.dataType.simpleString() for f in (query, bag) for c, t in ((x.name, x) for x in f.schema) if c in ("query_id", "item_id")}
    no = lambda c: F.lit(None).cast(kinds[c]).alias(c)
    asks = packed.select(
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("kind"), no("item_id"), "query_id", F.array_join("row.term", " ").alias("text"), F.col("row.w").alias("weights"), F.lit(0).alias("label")
    )
    code = F.lit(0) if label is None else F.coalesce(F.when(label.isNotNull(), F.xxhash64(label)), F.xxhash64("item_id"))
    # Items of a label lie in few parts, each of which gives its first ones.
    place = F.xxhash64("item_id") if label is None else F.xxhash64(code, F.pmod(F.xxhash64("item_id"), F.lit(max(2, parts // 8))))
    held = bag.select(
        F.pmod(place, F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("kind"), "item_id", no("query_id"), F.array_join("tokens", " ").alias("text"), F.lit(None).cast("array<double>").alias("weights"), code.alias("label")
    )
    dealt = asks.unionByName(held).repartitionById(parts, F.col("part")).sortWithinPartitions("part", "kind", "item_id")
    norm_by, keep = [mean if norm else None for norm in norms], None if depth is None else depth + 1

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part = None, _Part(norm_by, keep, least)
        for batch in batches:
            begun = batch.column("part").to_numpy(zero_copy_only=False) * 2 + batch.column("kind").to_numpy(zero_copy_only=False)
            for x in np.unique(begun):
                rows = batch.slice(int(np.searchsorted(begun, x)), int(np.searchsorted(begun, x, "right") - np.searchsorted(begun, x)))
                if x // 2 != at:
                    yield from part.end()
                    at, part = x // 2, _Part(norm_by, keep, least)
                if x % 2 == 0:
                    part.asked.append(rows)
                elif part.asked:
                    yield from part.add(rows)
        yield from part.end()

    return dealt.mapInArrow(meet, f"query_id {kinds['query_id']}, item_id {kinds['item_id']}, score double, norm boolean")


def ranked(scores: DataFrame, by: Sequence[str] = ("query_id",), score: str = "score", item: str = "item_id", name: str = "rank") -> DataFrame:
    """scores with a rank from 1; equal scores go by id."""
    order = Window.partitionBy(*by).orderBy(F.col(score).desc_nulls_last(), F.col(item))
    return scores.withColumn(name, F.row_number().over(order))


def top(scores: DataFrame, n: int, by: Sequence[str] = ("query_id",), score: str = "score") -> DataFrame:
    """The first n per query; the planner keeps only n rows a query of each partition before the shuffle."""
    return ranked(scores, by, score).where(F.col("rank") <= n)


_PAIRS = "query_id bigint, item_id bigint, score double"


def _products(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for row in frame.itertuples(index=False):
            q = np.stack([np.asarray(v, dtype=np.float64) for v in row.query_vectors])
            x = np.stack([np.asarray(v, dtype=np.float64) for v in row.item_vectors])
            norm = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]
            score = np.round(np.divide(q @ x.T, norm, out=np.zeros_like(norm), where=norm > 0), DIGITS)
            ids, others = np.asarray(row.item_ids), np.asarray(row.query_ids)
            keep = min(row.depth + 1, len(ids))
            for k, query in enumerate(others):
                order = np.lexsort((ids, -score[k]))[:keep]
                yield pd.DataFrame({"query_id": query, "item_id": ids[order], "score": score[k][order]})


def cosine(queries: DataFrame, items: DataFrame, depth: int) -> DataFrame:
    """The first `depth` items per query by cosine of (id, vector) rows, a query's own id aside.

    Vectors come in blocks and a block product is one matrix product; each product keeps depth + 1 items a query, so what
    moves grows with the number of blocks, not of pairs.
    """

    def blocks(df: DataFrame, size: int, side: str) -> DataFrame:
        n = max(1, -(-df.count() // size))
        keyed = df.where("vector is not null").withColumn(f"{side}_block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
        rows = keyed.groupBy(f"{side}_block").agg(F.sort_array(F.collect_list(F.struct("id", "vector"))).alias("rows"))
        return rows.select(f"{side}_block", F.col("rows.id").alias(f"{side}_ids"), F.col("rows.vector").alias(f"{side}_vectors")), n

    asked, n_asked = blocks(queries, QUERY_BLOCK, "query")
    held, _ = blocks(items, ITEM_BLOCK, "item")
    meets = held.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1))))
    pairs = meets.join(asked, "query_block").select("query_ids", "query_vectors", "item_ids", "item_vectors", F.lit(depth).alias("depth"))
    return top(pairs.mapInPandas(_products, _PAIRS).where("query_id <> item_id"), depth).drop("rank")


def pair_cosine(pairs: DataFrame, queries: DataFrame, items: DataFrame) -> DataFrame:
    """pairs (query_id, item_id, ...) with score: the cosine of their vectors (id, vector), null where one has none.

    Only the vectors of the pairs asked for are joined.
    """
    q = queries.select(F.col("id").alias("query_id"), F.col("vector").alias("_q"))
    x = items.select(F.col("id").alias("item_id"), F.col("vector").alias("_x"))
    joined = pairs.join(q, "query_id", "left").join(x, "item_id", "left")
    add = lambda acc, v: acc + v
    dot = F.aggregate(F.zip_with("_q", "_x", lambda a, b: a * b), F.lit(0.0), add)
    norm = lambda c: F.sqrt(F.aggregate(F.transform(c, lambda a: a * a), F.lit(0.0), add))
    both = norm("_q") * norm("_x")
    score = F.when(F.col("_q").isNull() | F.col("_x").isNull(), F.lit(None)).when(both > 0, F.round(dot / both, DIGITS)).otherwise(F.lit(0.0))
    return joined.withColumn("score", score.cast("double")).drop("_q", "_x")


def channels(lexical: DataFrame, dense: DataFrame, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """by, item_id, lexical, dense: the union of both channels; a missing side is null. by: the query and what names an arm."""
    a = lexical.select(*by, "item_id", F.col("score").alias("lexical"))
    b = dense.select(*by, "item_id", F.col("score").alias("dense"))
    return a.join(b, [*by, "item_id"], "full")


def min_max(scores: DataFrame, column: str, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """column scaled to 0..1 within each query's pool; a constant pool is 1 throughout.

    A pool is what top() left of each channel, some hundred rows a query: the windows here and in weighted_reciprocal()
    are over such pools, not over scores of all items.
    """
    pool = Window.partitionBy(*by)
    low, high = F.min(column).over(pool), F.max(column).over(pool)
    return scores.withColumn(column, F.when(high == low, 1.0).otherwise((F.col(column) - low) / (high - low)))


def blended(union: DataFrame, weights: Sequence[float], by: Sequence[str] = ("query_id",)) -> DataFrame:
    """by, item_id, weight, score: weighted sums of the min-max scaled channels for every weight of the lexical one."""
    filled = union.fillna(0.0, ["lexical", "dense"])
    scaled = min_max(min_max(filled, "lexical", by), "dense", by)
    w = F.explode(F.array(*[F.lit(float(x)) for x in weights])).alias("weight")
    spread = scaled.select("*", w)
    score = F.col("weight") * F.col("lexical") + (1 - F.col("weight")) * F.col("dense")
    return spread.select(*by, "item_id", "weight", F.round(score, DIGITS).alias("score"))


def reciprocal(rankings: Sequence[DataFrame], damping: int = RRF_DAMPING) -> DataFrame:
    """Unweighted reciprocal-rank fusion of rankings (query_id, item_id, rank)."""
    every = rankings[0].select("query_id", "item_id", "rank")
    for r in rankings[1:]:
        every = every.unionByName(r.select("query_id", "item_id", "rank"))
    fused = every.groupBy("query_id", "item_id").agg(F.sum(1 / (F.lit(float(damping)) + F.col("rank"))).alias("score"))
    return fused.withColumn("score", F.round("score", 9))


def weighted_reciprocal(union: DataFrame, weights: Sequence[float], damping: int = RRF_DAMPING, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """w / (damping + lexical rank) + (1 - w) / (damping + dense rank); a channel without the item gives nothing."""
    order = lambda c: Window.partitionBy(*by).orderBy(F.col(c).desc_nulls_last(), F.col("item_id"))
    placed = union.withColumn("rl", F.when(F.col("lexical").isNotNull(), F.row_number().over(order("lexical"))))
    placed = placed.withColumn("rd", F.when(F.col("dense").isNotNull(), F.row_number().over(order("dense"))))
    spread = placed.select("*", F.explode(F.array(*[F.lit(float(x)) for x in weights])).alias("weight"))
    score = F.coalesce(F.col("weight") / (damping + F.col("rl")), F.lit(0.0)) + F.coalesce((1 - F.col("weight")) / (damping + F.col("rd")), F.lit(0.0))
    return spread.select(*by, "item_id", "weight", F.round(score, 9).alias("score"))


def hybrid(lexical: DataFrame, dense: DataFrame, candidates: int = CANDIDATES, fused: int = FUSED) -> DataFrame:
    """query_id, item_id, score, rank: the first candidates of each channel, fused by reciprocal rank, the first `fused`."""
    return top(reciprocal([top(lexical, candidates), top(dense, candidates)]), fused)


def with_rest(scores: DataFrame, queries: DataFrame, items: DataFrame, depth: int) -> DataFrame:
    """query_id, item_id, rank up to depth: scored items by score, the others behind them by id.

    A query with fewer scored items than depth is filled from the first 2 * depth ids, which hold enough unscored ones;
    so what is built per query is bounded by the depth, however many items there are.
    """
    first = top(scores, depth).select("query_id", "item_id", "score", "rank")
    pool = items.select("item_id").distinct().orderBy("item_id").limit(2 * depth)
    held = first.groupBy("query_id").agg(F.count("*").alias("n"))
    short = queries.select("query_id").distinct().join(held, "query_id", "left").where(F.coalesce("n", F.lit(0)) < depth)
    rest = against_all(short.select("query_id"), pool).join(first.select("query_id", "item_id"), ["query_id", "item_id"], "left_anti")
    both = first.select("query_id", "item_id", "score").unionByName(rest.withColumn("score", F.lit(None).cast("double")))
    return top(both, depth).select("query_id", "item_id", "rank")


def grouped(scores: DataFrame, titles: DataFrame, priorities: DataFrame) -> DataFrame:
    """scores (with document) and group: a document's priority, the others together in the last group."""
    known = titles.join(priorities, "document", "left")
    last = priorities.agg(F.max("priority")).first()[0] or 0
    return scores.join(known, "document", "left").withColumn("group", F.coalesce("priority", F.lit(last + 1))).drop("priority")


def capped(scores: DataFrame, cap: int, least: float, parts: int) -> DataFrame:
    """Within query and group by score: at least `least`, at most `parts` of a split table, at most `cap` of a document.

    Parts over their limit don't use up the cap. Exact as long as a split table lies within one document. Only parts of
    split tables are ranked among their table; both ranks keep the first rows of each partition before rows move.
    scores: query_id, group, document, split_id (null for whole items), item_id, score.
    """
    order = [F.col("score").desc(), F.col("item_id")]
    good = scores.where(F.col("score") >= least)
    within = Window.partitionBy("query_id", "group", "split_id").orderBy(*order)
    split = good.where("split_id is not null").withColumn("part", F.row_number().over(within)).where(F.col("part") <= parts).drop("part")
    kept = split.unionByName(good.where("split_id is null"))
    per = Window.partitionBy("query_id", "group", "document").orderBy(*order)
    return kept.withColumn("nth", F.row_number().over(per)).where(F.col("nth") <= cap).drop("nth")


def confidence(scores: DataFrame, floor: float = 0.20, least: float = 0.30, supporters: int = 2) -> DataFrame:
    """query_id, top_score, supporting, essentially_empty, low_confidence."""
    out = scores.groupBy("query_id").agg(F.max("score").alias("top_score"), F.count_if(F.col("score") >= floor).alias("supporting"))
    empty = F.col("top_score") < floor
    low = empty | (F.col("top_score") < least) | (F.col("supporting") < supporters)
    return out.withColumn("essentially_empty", empty).withColumn("low_confidence", low)


def budgeted(items: DataFrame, budget: int) -> DataFrame:
    """Items (query_id, document, item_id, score, tokens) that fit the budget: the lowest scores go first, the best item of
    each document last. Once an item goes, all that would go before it are gone; an item larger than the budget goes too."""
    best = Window.partitionBy("query_id", "document").orderBy(F.col("score").desc(), F.col("item_id").desc())
    flagged = items.withColumn("keeps", (F.row_number().over(best) == 1).cast("int"))
    keep_first = Window.partitionBy("query_id").orderBy(F.col("keeps").desc(), F.col("score").desc(), F.col("item_id").desc())
    upto = F.sum("tokens").over(keep_first.rowsBetween(Window.unboundedPreceding, 0))
    return flagged.withColumn("upto", upto).where(F.col("upto") <= budget).drop("keeps", "upto")


def token_jaccard(a: Column, b: Column) -> Column:
    """Similarity of two texts by their distinct words in lower case, by white space."""
    x = F.array_distinct(F.filter(F.split(F.lower(a), r"\s+"), lambda w: w != ""))
    y = F.array_distinct(F.filter(F.split(F.lower(b), r"\s+"), lambda w: w != ""))
    both = F.size(F.array_union(x, y))
    return F.when(both == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / both)


def stub_vector(text: Column, dim: int = 384) -> Column:
    """A deterministic unit vector from SHA-256 bytes of the text, for where no model is at hand."""
    hexes = F.concat(*[F.sha2(F.concat(F.lit(f"{k}|"), text), 256) for k in range(-(-dim // 32))])
    pairs = F.slice(F.regexp_extract_all(hexes, F.lit(".."), 0), 1, dim)
    raw = F.transform(pairs, lambda h: F.conv(h, 16, 10).cast("double") / 127.5 - 1)
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda acc, x: acc + x * x))
    # Zipped, so that the norm is computed once and not for every element.
    return F.zip_with(raw, F.array_repeat(norm, dim), lambda x, n: x / n)
