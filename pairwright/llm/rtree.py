"""Hard negatives by inner product, with R-trees packed where the rows lie.

Components become ``floor(256 * x)``. Every task packs the rows it reads, some ``SHARD_BYTES`` at a
time, into an R-tree by sort-tile-recursive packing: rows are sorted and cut into slabs along one
coordinate after the other, those of largest spread first, until a slab fills one leaf; runs of
``FANOUT`` nodes make the nodes above. Rows are never shuffled and a lost task reads its rows again.

Anchors come in blocks of bounded size, each broadcast once for their positives and once, with the
windows that these give, for their negatives. A node's bounding box gives an interval for every
coordinate's product with the anchor, and their sum one for the inner product. An anchor's queue
holds nodes by the upper end of that interval. The best are taken a few at a time (twice as many
every time), those of all anchors of a tile together, so that a node costs one product of matrices
for all anchors that take it. A node is pruned if its interval lies outside all score windows or
strictly below the k-th best found so far in them; rows level with the k-th are still looked at,
since ties go to smaller ids. What a task has found bounds the trees it packs later. Tasks send on
no more than ``k`` rows of an anchor's window for each tile of work, which a window function ranks.

Everything is computed in whole numbers: by the processor's matrix product in double precision
where no sum can reach 2**53, as 64-bit integers beyond, and as Python's own integers where these
could overflow (slow but exact); scores that do not fit 64 bits come back null, in their true order.

Rows with a null id, a null label, or a vector that is null or has a null or non-finite component
take no part, and neither do vectors of another length than most (the longer of two as frequent).
Of rows that share an id one is never the positive or the negative of another, and those alike in
score to an anchor count once; each of different rows with one id is an anchor of its own. An
anchor without positives, or a positive without negatives, gives no row; an empty table none at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwright.llm.whole import finite, flat, floors
from pairwright.scratch import stored

SCALE = 256
LEAF = 128
FANOUT = 16
# Bytes of vectors packed into one tree, and of a broadcast block of anchors, on average.
SHARD_BYTES = 48 << 20
BLOCK_BYTES = 8 << 20
# Anchors that walk a tree together, and nodes that each of them takes first.
TILE = 256
TAKEN = 8
LONGEST = (1 << 63) - 1

POSITIVES = 5
NEGATIVES = 3


@dataclass(frozen=True)
class Numbers:
    """How components are held: ``kind`` is the type of matrices and of their products."""

    length: int
    largest: int

    @property
    def kind(self):
        bound = max(self.length, 1) * self.largest**2
        return np.float64 if bound < 2**53 else np.int64 if bound < 2**62 else object

    def matrix(self, column) -> np.ndarray:
        values = floors(flat(column), SCALE).reshape(len(column), self.length)
        return values.astype(self.kind)


class Tree:
    """An R-tree over the rows of a matrix; row ranges of leaves are ``start`` and ``end``.

    Nodes of all levels have consecutive numbers, leaves first. ``first`` and ``last`` are the
    children's numbers of an inner node.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray):
        order = packed_order(rows, LEAF)
        self.ids, self.labels, self.rows = ids[order], labels[order], rows[order]
        starts = np.arange(0, len(rows), LEAF)
        self.start, self.end = starts, np.minimum(starts + LEAF, len(rows))
        low, high = [np.minimum.reduceat(self.rows, starts)], [np.maximum.reduceat(self.rows, starts)]
        first, last, below = [], [], 0
        while len(low[-1]) > FANOUT:
            cuts = np.arange(0, len(low[-1]), FANOUT)
            first.append(below + cuts)
            last.append(below + np.minimum(cuts + FANOUT, len(low[-1])))
            below += len(low[-1])
            low.append(np.minimum.reduceat(low[-1], cuts))
            high.append(np.maximum.reduceat(high[-1], cuts))
        self.low, self.high = np.concatenate(low), np.concatenate(high)
        leaves = len(starts)
        self.first = np.concatenate([np.zeros(leaves, int), *first]).astype(int)
        self.last = np.concatenate([np.zeros(leaves, int), *last]).astype(int)
        self.roots = np.arange(below, len(self.low))

    def interval(self, anchors: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest inner product of each anchor with what a node's box may hold."""
        up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
        low, high = self.low[nodes].T, self.high[nodes].T
        return up @ low + down @ high, up @ high + down @ low


def packed_order(rows: np.ndarray, leaf: int) -> np.ndarray:
    """Sort-tile-recursive order: runs of ``leaf`` rows are the leaves.

    With ``n`` leaves to make and ``c`` coordinates to go, a slab is cut into the c-th root of n
    slabs, at least two, along the next coordinate.
    """
    order = np.arange(len(rows))
    if not rows.shape[1] or len(rows) <= leaf:
        return order
    spread = [float(x) for x in rows.max(axis=0) - rows.min(axis=0)]
    coordinates = np.argsort(-np.array(spread), kind="stable")
    slab = np.zeros(len(rows), np.int64)
    size = len(rows)  # of the largest slab
    for done, coordinate in enumerate(coordinates):
        leaves = -(-size // leaf)
        if leaves <= 1:
            break
        pieces = max(2, int(np.ceil(leaves ** (1 / (len(coordinates) - done)))))
        step = -(-leaves // pieces) * leaf
        values = rows[order, coordinate]
        if values.dtype == object:
            values = np.unique(values, return_inverse=True)[1]
        order = order[np.lexsort((values, slab))]  # slabs stay where they are
        starts = np.flatnonzero(np.r_[True, slab[1:] != slab[:-1]])
        place = np.arange(len(rows)) - starts[slab]
        cuts = np.r_[True, (slab[1:] != slab[:-1]) | (place[1:] % step == 0)]
        slab = np.cumsum(cuts) - 1
        size = step
    return order


class Found:
    """The best ``k`` rows of every anchor's windows, and the score that a row must reach."""

    def __init__(self, anchors: int, windows: int, k: int, kind):
        self.k, self.shape = k, (anchors, windows)
        self.least = np.full(self.shape, -np.inf, object if kind is object else np.float64)
        if kind is np.int64:
            self.least = np.full(self.shape, -LONGEST, np.int64)
        self.cell = np.empty(0, np.int64)  # anchor * windows + window
        self.id = np.empty(0, np.int64)
        self.score = np.empty(0, kind)

    def add(self, cell: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        cell = np.concatenate([self.cell, cell])
        ids = np.concatenate([self.id, ids])
        score = np.concatenate([self.score, score])
        level = np.unique(score, return_inverse=True)[1] if score.dtype == object else score
        order = np.lexsort((ids, -level, cell))
        cell, ids, score, level = cell[order], ids[order], score[order], level[order]
        fresh = np.r_[True, (cell[1:] != cell[:-1]) | (ids[1:] != ids[:-1]) | (level[1:] != level[:-1])]
        fresh = fresh[: len(cell)]
        cell, ids, score = cell[fresh], ids[fresh], score[fresh]
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])[: len(cell)]
        sizes = np.diff(np.r_[starts, len(cell)])
        place = np.arange(len(cell)) - np.repeat(starts, sizes)
        keep = place < self.k
        self.cell, self.id, self.score = cell[keep], ids[keep], score[keep]
        last = place == self.k - 1
        self.least.reshape(-1)[cell[last]] = score[last]


@dataclass
class Asked:
    """Anchors with their score windows, one row each; ``same`` asks for rows of their own label."""

    number: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    rows: np.ndarray
    low: np.ndarray
    high: np.ndarray
    same: bool

    def part(self, some: slice) -> Asked:
        cut = (self.number, self.ids, self.labels, self.rows, self.low, self.high)
        return Asked(*[values[some] for values in cut], self.same)


def search(tree: Tree, asked: Asked, found: Found) -> None:
    """Add to ``found`` what the tree has for a tile of anchors."""
    n_anchors, n_windows = asked.low.shape
    floor_of = -np.inf if tree.rows.dtype != np.int64 else -LONGEST
    nodes = len(tree.low)
    upper = np.full((n_anchors, nodes), floor_of, tree.rows.dtype)
    lower = upper.copy()
    waiting = np.zeros((n_anchors, nodes), bool)

    def enter(who: np.ndarray, some: np.ndarray) -> None:
        least, most = tree.interval(asked.rows[who], some)
        lower[np.ix_(who, some)], upper[np.ix_(who, some)] = least, most
        waiting[np.ix_(who, some)] = True

    enter(np.arange(n_anchors), tree.roots)
    taken = TAKEN
    while True:
        # Whatever no window can use leaves the queues.
        use = np.zeros_like(waiting)
        for window in range(n_windows):
            low = np.maximum(asked.low[:, window], found.least[:, window])[:, None]
            use |= (upper >= low) & (lower <= asked.high[:, window][:, None])
        waiting &= use
        if not waiting.any():
            return
        rank = np.where(waiting, upper, floor_of)
        best = np.argsort(-rank, axis=1, kind="stable")[:, :taken]
        who, column = np.nonzero(np.take_along_axis(waiting, best, axis=1))
        node = best[who, column]
        taken *= 2
        waiting[who, node] = False
        order = np.argsort(node, kind="stable")
        who, node = who[order], node[order]
        starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        hits = []
        for start, end in zip(starts, np.r_[starts[1:], len(node)]):
            number, anchors = node[start], who[start:end]
            if tree.last[number]:
                enter(anchors, np.arange(tree.first[number], tree.last[number]))
            else:
                hits.append(leaf_hits(tree, number, anchors, asked, found))
        if hits:
            found.add(*[np.concatenate(parts) for parts in zip(*hits)])


def leaf_hits(tree: Tree, number: int, anchors: np.ndarray, asked: Asked, found: Found):
    """Cells, ids and scores of a leaf's rows that lie in a window and reach its k-th best."""
    own = slice(tree.start[number], tree.end[number])
    score = asked.rows[anchors] @ tree.rows[own].T
    alike = asked.labels[anchors][:, None] == tree.labels[own]
    fits = (alike == asked.same) & (asked.ids[anchors][:, None] != tree.ids[own])
    cells, ids, scores = [], [], []
    for window in range(asked.low.shape[1]):
        low = np.maximum(asked.low[anchors, window], found.least[anchors, window])[:, None]
        row, column = np.nonzero(fits & (score >= low) & (score <= asked.high[anchors, window][:, None]))
        cells.append(anchors[row] * asked.low.shape[1] + window)
        ids.append(tree.ids[own][column])
        scores.append(score[row, column])
    return np.concatenate(cells), np.concatenate(ids), np.concatenate(scores)


def sort_key(score: int) -> str:
    """A text that orders as the whole number does: sign, number of digits, digits."""
    text = str(abs(int(score)))
    if score >= 0:
        return f"1{len(text):04d}{text}"
    return f"0{9999 - len(text):04d}" + "".join(str(9 - int(c)) for c in text)


def taking_part(marked: DataFrame) -> tuple[DataFrame, Numbers]:
    """The rows of ``id, label, vector, anchor`` that take part, and how their numbers are held."""
    rows = marked.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & finite("vector"))
    far = F.greatest(F.abs(F.array_max("vector")), F.abs(F.array_min("vector"))).cast("double")
    lengths = rows.groupBy(F.size("vector").alias("n")).agg(
        F.count("*").alias("rows"), F.max(far).alias("far")
    )
    most = lengths.orderBy(F.desc("rows"), F.desc("n")).first()
    length, largest = (most["n"], most["far"] or 0.0) if most else (0, 0.0)
    return rows.filter(F.size("vector") == length), Numbers(length, (int(largest) + 1) * SCALE)


FOUND = "anchor long, window int, id long, score long, far string, rank_key string"


def scan(rows: DataFrame, numbers: Numbers, asked: Asked, k: int) -> DataFrame:
    """The best ``k`` rows of each anchor's windows with their ``rank``, written to a table."""
    shared = rows.sparkSession.sparkContext.broadcast(asked)
    shard_rows = max(LEAF, SHARD_BYTES // (8 * max(numbers.length, 1)))

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[Tree]:
        held, n_rows = [], 0

        def tree() -> Tree:
            table = pa.Table.from_batches(held)
            return Tree(
                table["id"].to_numpy(), table["label"].to_numpy(), numbers.matrix(table["vector"])
            )

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n_rows += batch.num_rows
            if n_rows >= shard_rows:
                yield tree()
                held, n_rows = [], 0
        if held:
            yield tree()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = shared.value
        tiles = [every.part(slice(i, i + TILE)) for i in range(0, len(every.ids), TILE)]
        found = [Found(*tile.low.shape, k, numbers.kind) for tile in tiles]
        for tree in trees(batches):
            for tile, best in zip(tiles, found):
                search(tree, tile, best)
        for tile, best in zip(tiles, found):
            windows = max(tile.low.shape[1], 1)
            scores = [int(x) for x in best.score]
            small = [x if -LONGEST <= x <= LONGEST else None for x in scores]
            wide = numbers.kind is object
            yield pa.record_batch(
                [
                    pa.array(tile.number[best.cell // windows], pa.int64()),
                    pa.array(best.cell % windows, pa.int32()),
                    pa.array(best.id, pa.int64()),
                    pa.array(small, pa.int64()),
                    pa.array([str(x) if wide else None for x in scores], pa.string()),
                    pa.array([sort_key(x) if wide else None for x in scores], pa.string()),
                ],
                names=["anchor", "window", "id", "score", "far", "rank_key"],
            )

    order = Window.partitionBy("anchor", "window").orderBy(F.desc("rank_key"), F.desc("score"), "id")
    partial = rows.mapInArrow(work, FOUND)
    # Rows alike have the same dense rank, so cutting by it before they are made one loses none.
    ranked = partial.withColumn("rank", F.dense_rank().over(order)).filter(F.col("rank") <= k)
    best = stored(ranked.distinct())
    shared.destroy()
    return best


def anchors_of(block: pa.Table, numbers: Numbers) -> Asked:
    """A block of anchors that ask for rows of their label, whatever the score."""
    n = block.num_rows
    kind = object if numbers.kind is object else np.float64
    low, high = np.full((n, 1), -np.inf, kind), np.full((n, 1), np.inf, kind)
    if numbers.kind is np.int64:
        low, high = np.full((n, 1), -LONGEST, np.int64), np.full((n, 1), LONGEST, np.int64)
    return Asked(
        np.arange(n),
        block["id"].to_numpy(),
        block["label"].to_numpy(),
        numbers.matrix(block["vector"]),
        low,
        high,
        True,
    )


def with_windows(asked: Asked, positives: pa.Table, numbers: Numbers, k: int) -> Asked:
    """The anchors with a window for each positive: half its score to 95 hundredths of it.

    In whole numbers that is from the half rounded up to the other end rounded down. Where there
    is no positive of a rank, and for a negative score, the window is empty.
    """
    kind = object if numbers.kind is object else np.int64
    low, high = np.full((len(asked.ids), k), 1, kind), np.full((len(asked.ids), k), 0, kind)
    scores = [int(f) if f else s for f, s in zip(positives["far"].to_pylist(), positives["score"].to_pylist())]
    for anchor, rank, score in zip(positives["anchor"].to_pylist(), positives["rank"].to_pylist(), scores):
        low[anchor, rank - 1], high[anchor, rank - 1] = -(-score // 2), (95 * score) // 100
    if numbers.kind is np.float64:
        low, high = low.astype(np.float64), high.astype(np.float64)
    return Asked(asked.number, asked.ids, asked.labels, asked.rows, low, high, False)


def hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    *,
    relabelled: Column | None = None,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchors`` selects the anchors by the columns of ``vectors``; ``relabelled`` is the label to
    use where it is not the column's own.
    """
    marked = vectors.select(
        F.col(key).cast("long").alias("id"),
        (F.col(label) if relabelled is None else relabelled).cast("long").alias("label"),
        F.col(vector).alias("vector"),
        F.coalesce(anchors, F.lit(False)).alias("anchor"),
    )
    rows, numbers = taking_part(marked)
    chosen = stored(rows.filter("anchor").select("id", "label", "vector").distinct())
    rows = rows.select("id", "label", "vector")
    block_rows = max(1, BLOCK_BYTES // (8 * max(numbers.length, 1)))
    blocks = max(1, -(-chosen.count() // block_rows))
    spread = F.pmod(F.xxhash64("id", "vector"), F.lit(blocks))
    results = []
    for number in range(blocks):
        block = chosen.filter(spread == number).toArrow()
        if not block.num_rows:
            continue
        asked = anchors_of(block, numbers)
        near = scan(rows, numbers, asked, positives)
        # No more than `positives` rows of each anchor of the block.
        windows = with_windows(asked, near.select("anchor", "rank", "score", "far").toArrow(), numbers, positives)
        far = scan(rows, numbers, windows, negatives)
        names = rows.sparkSession.createDataFrame(
            pa.table({"anchor": asked.number, "anchor_id": pa.array(asked.ids, pa.int64())})
        )
        near = near.select(
            "anchor",
            F.col("rank").alias("nth"),
            F.col("id").alias("positive_id"),
            F.col("score").alias("positive_score"),
        )
        far = far.select(
            "anchor",
            (F.col("window") + 1).alias("nth"),
            "rank",
            F.col("id").alias("negative_id"),
            F.col("score").alias("negative_score"),
        )
        named = far.join(near, ["anchor", "nth"]).join(F.broadcast(names), "anchor")
        results.append(
            named.select(
                "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
            )
        )
    if not results:
        return rows.sparkSession.createDataFrame(
            [],
            "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long",
        )
    every = results[0]
    for result in results[1:]:
        every = every.union(result)
    return every
