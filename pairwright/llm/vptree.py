"""Nearest neighbours by largest inner product, with vantage-point trees per shard.

Vectors get one place more, the root of the shard's largest squared norm less their own, and
queries, scaled to that norm, a zero there: the largest inner product is then the smallest distance,
and the triangle inequality holds. A node of a tree splits its vectors at the median distance from
a vantage point. A search enters the nearer half first and the other half only if

    factor * |distance to the vantage point - median| <= distance of the k-th best so far.

Factor one, the default, is the triangle inequality and exact whatever the vectors are like. A
larger factor prunes more and loses neighbours, most where pruning works best: at factor 6 over
0.95 are found on vectors that spread in all dimensions, but fewer than 0.9 in a subspace of few.

A shard holds vectors of like norm only (their largest components lie within a factor of two), scaled
by a power of two: beside one huge vector the others would lose their differences to rounding, and
squares could overflow. Distances only decide what is looked at, with a margin for their rounding;
what may be among the best is scored again from the original components, in double precision, and
ranked by that score and then by id, so ties are settled by ids however many there are.

Rows are not shuffled: a task makes shards of what it reads, at most ``SHARD`` rows each. Queries are
broadcast in blocks of bounded size; a batch of them walks a tree together, and the k-th best that
a task knows already bounds the search of its later trees. Tasks send on their best of every query.

Of equal vectors of a shard only the ``k + 1`` smallest ids go into the tree; no other of them can be
among anyone's ``k`` nearest. Vectors that are null, zero, of another length than most (the shorter of two
as frequent) or hold a null or non-finite number take no part, nor do rows without an id. Rows alike in
id and score count once; of rows that share a query's id each different vector is a query of its
own. A score beyond double precision is infinite.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwright.llm.whole import finite
from pairwright.scratch import stored

SHARD = 16384
# Bytes of a broadcast block of queries, on average.
BLOCK_BYTES = 8 << 20
LEAF = 128
FACTOR = 1.0
# Numbers that a search works on at a time, and queries that walk a tree together.
STEP = 1 << 20
TOGETHER = 4096
# Rounding of distances and of products, as shares of the shard's norm and its square.
MARGIN = 1e-6
SCORE_MARGIN = 1e-10


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``id, vector, asked`` of the rows that take part, in double precision."""
    wide = vectors.select(
        F.col(key).cast("long").alias("id"),
        F.col(vector).cast("array<double>").alias("vector"),
        "asked",
    )
    good = wide.filter(
        F.col("id").isNotNull()
        & (F.size("vector") > 0)
        & finite("vector")
        & F.exists("vector", lambda x: x != 0)
    )
    length = good.groupBy(F.size("vector").alias("n")).count()
    most = length.orderBy(F.desc("count"), "n").first()
    return good.filter(F.size("vector") == (most["n"] if most else 0))


class Best:
    """The best ``k`` ids and scores of every query, ties to smaller ids."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = np.full((queries, k), -np.inf)
        self.ids = np.full((queries, k), -1, np.int64)
        self.n = np.zeros(queries, np.int64)

    def least(self, who: np.ndarray) -> np.ndarray:
        """What a row must reach; anything where there are fewer than ``k`` so far."""
        return np.where(self.n[who] < self.k, -np.inf, self.score[who, -1])

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        some = np.unique(query)
        held = np.arange(self.k) < self.n[some][:, None]
        query = np.concatenate([query, np.repeat(some, self.n[some])])
        ids = np.concatenate([ids, self.ids[some][held]])
        score = np.concatenate([score, self.score[some][held]])
        order = np.lexsort((ids, -score, query))
        query, ids, score = query[order], ids[order], score[order]
        alike = (query[1:] == query[:-1]) & (ids[1:] == ids[:-1]) & (score[1:] == score[:-1])
        query, ids, score = (x[np.r_[True, ~alike]] for x in (query, ids, score))
        starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
        sizes = np.diff(np.r_[starts, len(query)])
        place = np.arange(len(query)) - np.repeat(starts, sizes)
        keep = place < self.k
        self.score[query[keep], place[keep]] = score[keep]
        self.ids[query[keep], place[keep]] = ids[keep]
        self.n[some] = np.minimum(sizes, self.k)


class Tree:
    """A vantage-point tree over vectors of like norm, as flat arrays.

    A node has a vantage point, a radius and two children; a leaf has a range of ``order``.
    """

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, seed: int = 1):
        self.vectors, self.ids = vectors, ids
        # A power of two: scaling by it loses nothing.
        self.scale = 2.0 ** -float(np.floor(np.log2(np.abs(vectors).max())))
        scaled = vectors * self.scale
        square = (scaled**2).sum(axis=1)
        self.largest = float(np.sqrt(square.max()))
        rest = np.sqrt(np.maximum(square.max() - square, 0))
        self.points = np.concatenate([scaled, rest[:, None]], axis=1)
        self.order = np.arange(len(vectors))
        self.nodes: list[tuple] = []
        self._build(0, len(vectors), np.random.default_rng(seed))

    def _build(self, low: int, high: int, rng: np.random.Generator) -> int:
        number = len(self.nodes)
        self.nodes.append((low, high, None, 0.0, -1, -1))
        if high - low <= LEAF:
            return number
        own = self.order[low:high]
        vantage = own[rng.integers(len(own))]
        distance = np.linalg.norm(self.points[own] - self.points[vantage], axis=1)
        rank = np.argsort(distance, kind="stable")
        middle = len(own) // 2
        radius = float(distance[rank[middle - 1]])
        if not distance[rank[middle]] > radius:  # too many at one distance to part them here
            middle = int(np.searchsorted(distance[rank], radius, side="right"))
        if middle == len(own):
            return number
        self.order[low:high] = own[rank]
        near = self._build(low, low + middle, rng)
        far = self._build(low + middle, high, rng)
        self.nodes[number] = (low, high, vantage, radius, near, far)
        return number

    def search(self, queries: np.ndarray, own_ids: np.ndarray, best: Best, factor: float) -> None:
        """Add what the tree has for each query to ``best``; a query's own id is nobody's neighbour."""
        # A power of two brings each query to norms around one, the rest of the way is their length.
        size = 2.0 ** -np.floor(np.log2(np.abs(queries).max(axis=1)))
        lifted = queries * size[:, None]
        length = np.linalg.norm(lifted, axis=1)
        lifted = np.concatenate([lifted * (self.largest / length)[:, None], np.zeros((len(queries), 1))], axis=1)
        with np.errstate(over="ignore", under="ignore"):
            # From a score of original vectors to a product of lifted ones.
            self.to_lifted = size * (self.largest / length)
        self.asked = queries, own_ids, lifted, best, factor
        for first in range(0, len(queries), TOGETHER):
            self._visit(0, np.arange(first, min(first + TOGETHER, len(queries))))

    def _least(self, who: np.ndarray) -> np.ndarray:
        """The k-th best so far as a product of lifted vectors; an overflow bounds nothing."""
        with np.errstate(over="ignore", invalid="ignore"):
            least = self.asked[3].least(who) * self.to_lifted[who] * self.scale
        return np.where(np.isfinite(least), least, -np.inf)

    def _visit(self, number: int, who: np.ndarray) -> None:
        low, high, vantage, radius, near, far = self.nodes[number]
        if vantage is None:
            own = self.order[low:high]
            step = max(1, STEP // len(own))
            for first in range(0, len(who), step):
                self._leaf(own, who[first : first + step])
            return
        _, _, lifted, _, factor = self.asked
        distance = np.linalg.norm(lifted[who] - self.points[vantage], axis=1)
        inside = distance <= radius
        gap = factor * np.abs(distance - radius)
        for chosen, first, second in ((inside, near, far), (~inside, far, near)):
            some = who[chosen]
            if not len(some):
                continue
            self._visit(first, some)
            reach = np.sqrt(np.maximum(2 * self.largest**2 - 2 * self._least(some), 0))
            enter = gap[chosen] <= reach + factor * MARGIN * self.largest
            if enter.any():
                self._visit(second, some[enter])

    def _leaf(self, own: np.ndarray, who: np.ndarray) -> None:
        queries, own_ids, lifted, best, _ = self.asked
        score = lifted[who, :-1] @ self.points[own, :-1].T
        reach = self._least(who) - SCORE_MARGIN * self.largest**2
        row, column = np.nonzero((score >= reach[:, None]) & (own_ids[who][:, None] != self.ids[own]))
        width = max(1, STEP // self.vectors.shape[1])
        for first in range(0, len(row), width):
            some = slice(first, first + width)
            asked, point = who[row[some]], own[column[some]]
            with np.errstate(over="ignore", invalid="ignore"):
                exact = (self.vectors[point] * queries[asked]).sum(axis=1)
            exact = np.where(np.isnan(exact), -np.inf, exact)
            kept = exact >= best.least(asked)
            if kept.any():
                best.add(asked[kept], self.ids[point[kept]], exact[kept])


def few_of_equal(vectors: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Positions of the rows of which fewer than ``most`` equal ones have smaller ids."""
    order = np.argsort(ids, kind="stable")
    rows = np.ascontiguousarray(vectors[order] + 0.0)  # one zero, not two
    whole = rows.view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).ravel()
    _, same = np.unique(whole, return_inverse=True)
    ranked = np.argsort(same, kind="stable")
    counts = np.bincount(same)
    place = np.empty(len(same), np.int64)
    place[ranked] = np.arange(len(same)) - np.repeat(np.cumsum(counts) - counts, counts)
    return order[place < most]


def shards(vectors: np.ndarray, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Vectors by the power of two of their largest component."""
    band = np.floor(np.log2(np.abs(vectors).max(axis=1)))
    for one in np.unique(band):
        yield vectors[band == one], ids[band == one]


def nearest(
    vectors: DataFrame,
    queries: Column,
    *,
    k: int = 20,
    factor: float = FACTOR,
    key: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows that ``queries`` selects, against all rows
    but the query's own."""
    if factor < 1 or k < 1:
        raise ValueError("factor and k are at least 1")
    spark = vectors.sparkSession
    marked = vectors.select(
        F.col(key), F.col(vector), F.coalesce(queries, F.lit(False)).alias("asked")
    )
    rows = usable(marked, key, vector)
    asked = stored(rows.filter("asked").select("id", "vector").distinct())
    rows = rows.select("id", "vector")
    sizes = asked.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("length")).first()
    n_blocks = max(1, -(-sizes["n"] * 8 * (sizes["length"] or 1) // BLOCK_BYTES))
    block_of = F.pmod(F.xxhash64("id", "vector"), F.lit(n_blocks))
    schema = "block int, query int, query_id long, vec_id long, score double"
    shard_rows = SHARD
    found = []
    for number in range(n_blocks):
        block = asked.filter(block_of == number).toArrow()
        if not block.num_rows:
            continue
        shared = spark.sparkContext.broadcast((block["id"].to_numpy(), matrix(block["vector"])))

        def work(batches: Iterator[pa.RecordBatch], shared=shared, number=number) -> Iterator[pa.RecordBatch]:
            ids, wanted = shared.value
            best = Best(len(ids), k)
            held: list[pa.RecordBatch] = []

            def flush() -> None:
                table = pa.Table.from_batches(held)
                every, names = matrix(table["vector"]), table["id"].to_numpy()
                some = few_of_equal(every, names, k + 1)
                for part, part_ids in shards(every[some], names[some]):
                    Tree(part, part_ids).search(wanted, ids, best, factor)
                held.clear()

            for batch in batches:
                while batch.num_rows:
                    room = shard_rows - sum(b.num_rows for b in held)
                    held.append(batch.slice(0, room))
                    batch = batch.slice(room)
                    if sum(b.num_rows for b in held) >= shard_rows:
                        flush()
            if held:
                flush()
            query, place = np.nonzero(np.arange(k) < best.n[:, None])
            yield pa.record_batch(
                [
                    pa.array(np.full(len(query), number), pa.int32()),
                    pa.array(query, pa.int32()),
                    pa.array(ids[query], pa.int64()),
                    pa.array(best.ids[query, place], pa.int64()),
                    pa.array(best.score[query, place], pa.float64()),
                ],
                names=["block", "query", "query_id", "vec_id", "score"],
            )

        # Rows alike have one dense rank, so cutting by it before they are made one loses none.
        order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
        ranked = rows.mapInArrow(work, schema).withColumn("rank", F.dense_rank().over(order))
        found.append(stored(ranked.filter(F.col("rank") <= k).drop("block", "query").distinct()))
        shared.destroy()
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    every = found[0]
    for part in found[1:]:
        every = every.union(part)
    return every.select("query_id", "rank", "vec_id", "score")


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks()
    if isinstance(values, pa.ChunkedArray):
        values = pa.concat_arrays(values.chunks)
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)
