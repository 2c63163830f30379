"""Packing of token runs into windows of a fixed capacity by multiway differencing.

A document's ids are cut into full windows and a rest; the rest is cut into pieces of at most
``grain`` ids, as equal as can be. Full windows are sequences of their own. All other pieces
are dealt by a random key into groups of about ``GROUP_WINDOWS`` windows, each packed by
itself: the partial partitions with the largest imbalance are merged, the fullest windows of
one with the emptiest of the other, until one partition of near-equal windows is left. If one
of its windows exceeds the capacity, the group is packed anew with one window more. Groups have
a bounded size however large the corpus or one document is, and their number follows it.

A text is tokenized once: a piece carries the checksum of its ids, and only pieces move. A null
or empty text has the closing id alone. Rows that repeat are packed as often as they occur.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.bpe import encoded, vocabulary
from pairwright.llm.columns import text_slices
from pairwright.scratch import stored

CAPACITY = 2048
GRAIN = 512
GROUP_WINDOWS = 256
# Rows of pieces that a Python worker hands on at once.
BATCH_PIECES = 50_000


def pieces(
    documents: DataFrame,
    path: str,
    *,
    key: str = "doc_id",
    text: str = "text",
    end_id: int = 1,
    capacity: int = CAPACITY,
    grain: int = GRAIN,
) -> DataFrame:
    """``key, start, length, ids_crc32, doc_tokens, uid`` of the pieces of every document."""
    schema = documents.select(key).schema
    for name in ("start", "length", "ids_crc32", "doc_tokens", "uid"):
        schema = schema.add(name, "long")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        uid = TaskContext.get().partitionId() << 40
        for rows in text_slices(batches, text):
            ids, at = encoded(rows.column(text), vocab)
            ids = ids.astype("<u4")
            row_of, starts, lengths, sums, totals = [], [], [], [], []
            for row in range(rows.num_rows):
                own = np.append(ids[at[row] : at[row + 1]], np.uint32(end_id))
                for first, last in cuts(len(own), capacity, grain):
                    row_of.append(row)
                    starts.append(first)
                    lengths.append(last - first)
                    sums.append(zlib.crc32(own[first:last].tobytes()))
                    totals.append(len(own))
            uids = np.arange(uid, uid + len(row_of))
            uid += len(row_of)
            yield pa.RecordBatch.from_arrays(
                [rows.column(key).take(pa.array(row_of, pa.int64()))]
                + [pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals, uids)],
                names=schema.names,
            )

    return documents.select(key, text).mapInArrow(work, schema)


def cuts(tokens: int, capacity: int, grain: int) -> list[tuple[int, int]]:
    """The pieces of a document of so many tokens: full windows, then an evenly cut rest."""
    full = tokens // capacity
    out = [(n * capacity, (n + 1) * capacity) for n in range(full)]
    rest, first = tokens - full * capacity, full * capacity
    parts = -(-rest // grain)
    ends = [first + rest * (n + 1) // parts for n in range(parts)]
    return out + list(zip([first, *ends], ends))


def differenced(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window of each size by Karmarkar and Karp's differencing for many windows.

    A partial partition is a vector of window sums, less their smallest, fullest first. Its
    windows are chains of sizes: heads and tails per window, and one array of next sizes.
    """
    n = len(sizes)
    following = np.full(n, -1, np.int64)
    none = np.full(windows, -1, np.int64)
    heap = []
    for i in range(n):
        sums = np.zeros(windows, np.int64)
        sums[0] = sizes[i]
        ends = none.copy()
        ends[0] = i
        heap.append((-int(sizes[i]), i, sums, ends, ends.copy()))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, order, sums, heads, tails = heapq.heappop(heap)
        _, _, other_sums, other_heads, other_tails = heapq.heappop(heap)
        other_heads, other_tails = other_heads[::-1], other_tails[::-1]
        sums = sums + other_sums[::-1]
        both = (tails >= 0) & (other_heads >= 0)
        following[tails[both]] = other_heads[both]
        heads = np.where(heads < 0, other_heads, heads)
        tails = np.where(other_tails < 0, tails, other_tails)
        rank = np.argsort(-sums, kind="stable")
        sums, heads, tails = sums[rank], heads[rank], tails[rank]
        sums -= sums[-1]
        heapq.heappush(heap, (-int(sums[0]), order, sums, heads, tails))
    window = np.empty(n, np.int64)
    for w, item in enumerate(heap[0][3] if heap else ()):
        while item >= 0:
            window[item] = w
            item = following[item]
    return window


def packed_group(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Windows for the sizes, as few as differencing fills without exceeding the capacity."""
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window = differenced(sizes, windows)
        if not len(sizes) or np.bincount(window, sizes).max() <= capacity:
            return window
        windows += 1


def pack(
    documents: DataFrame,
    path: str,
    *,
    key: str = "doc_id",
    text: str = "text",
    end_id: int = 1,
    capacity: int = CAPACITY,
    grain: int = GRAIN,
) -> DataFrame:
    """``key, start, length, ids_crc32, doc_tokens, sequence_id, offset`` of every piece.

    ``sequence_id`` is unique and has gaps: even for packed groups, odd for full windows.
    """
    found = stored(
        pieces(
            documents, path, key=key, text=text, end_id=end_id, capacity=capacity, grain=grain
        )
    )
    full = F.col("length") == capacity
    total = found.filter(~full).agg(F.sum("length")).first()[0] or 0
    groups = max(1, round(total / (capacity * GROUP_WINDOWS)))
    rest = found.filter(~full).withColumn(
        "pack_group", F.pmod(F.xxhash64("uid"), F.lit(groups)).cast("long")
    )
    schema = found.drop("uid").schema.add("sequence_id", "long").add("offset", "long")

    def work(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("uid")
        sizes = group.column("length").to_numpy()
        window = packed_group(sizes, capacity)
        order = np.argsort(window, kind="stable")
        ends = np.cumsum(sizes[order])
        first = np.searchsorted(window[order], window[order])
        offset = np.empty(len(sizes), np.int64)
        offset[order] = ends - sizes[order] - (ends - sizes[order])[first]
        number = group.column("pack_group").to_numpy() * (1 << 22) + window * 2
        group = group.drop_columns(["uid", "pack_group"])
        return group.append_column("sequence_id", pa.array(number)).append_column(
            "offset", pa.array(offset)
        )

    rest = rest.repartition(_tasks(documents, groups), "pack_group")
    grouped = rest.groupBy("pack_group").applyInArrow(work, schema)
    whole = found.filter(full).select(
        *found.drop("uid").columns,
        (F.col("uid") * 2 + 1).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    return grouped.unionByName(whole)


def _tasks(documents: DataFrame, groups: int) -> int:
    """As many tasks as groups, but no more than keep a thousand cores busy."""
    least = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(groups, max(least, groups // 64)))
