"""Runs of words that occur more than once in a collection of texts.

A word goes if a run of ``words`` words that covers it starts at a second place anywhere, in the
same text or another. Words are what stands between white space, compared by 64-bit hashes of
their bytes; the white space between them is not compared.

Every run has an anchor, as strings have in `suffix`: the ``GRAM`` words in it with the smallest
hash. Only runs around anchors that occur twice are hashed whole (128 bits) and counted, with
counts before the shuffle. Runs are exact: two that merely meet or overlap, each repeated
elsewhere, do not make a third.

A text that occurs twice goes whole, if it has so many words. A null text is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwright.llm.columns import run_hashes, text_slices, utf8
from pairwright.llm.suffix import _keyed, anchors_of, bounded, rolled
from pairwright.scratch import scope, stored

GRAM = 12
# White space of one byte, and of more: U+0085, U+00A0, U+1680, U+2000 to U+200A, U+2028,
# U+2029, U+202F, U+205F and U+3000.
_BLANK = np.zeros(256, bool)
_BLANK[[*range(9, 14), *range(28, 33)]] = True
_TWO = {0xC2: [0x85, 0xA0]}
_THREE = {
    (0xE1, 0x9A): [0x80],
    (0xE2, 0x80): [*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF],
    (0xE2, 0x81): [0x9F],
    (0xE3, 0x80): [0x80],
}


def blanks(data: np.ndarray) -> np.ndarray:
    """Which bytes are white space."""
    blank = _BLANK[data]
    for lead, lasts in _TWO.items():
        at = np.flatnonzero(data[:-1] == lead)
        at = at[np.isin(data[at + 1], lasts)]
        blank[at] = blank[at + 1] = True
    for (lead, second), lasts in _THREE.items():
        at = np.flatnonzero(data[:-2] == lead)
        at = at[(data[at + 1] == second) & np.isin(data[at + 2], lasts)]
        blank[at] = blank[at + 1] = blank[at + 2] = True
    return blank


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words start and end, and the offsets of each text's words."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    blank = blanks(data)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    edge[1:-1] |= blank[1:] != blank[:-1]
    edges = np.flatnonzero(edge)
    inside = np.flatnonzero(~blank[edges[:-1]])
    starts, ends = edges[inside], edges[inside + 1]
    return starts, ends, np.searchsorted(starts, offsets)


def _anchor_table(texts: DataFrame, words: int, gram: int) -> DataFrame:
    schema = T.StructType().add("key", "binary").add("gram", "long").add("at", "integer")
    schema = schema.add("near", "integer").add("far", "integer").add("head", "boolean")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_slices(batches, "content"):
            data, offsets = utf8(rows.column("content"))
            starts, ends, firsts = words_of(data, offsets)
            hashes = rolled(run_hashes(data, starts, ends), gram)
            own, hashes, at, near, far = anchors_of(hashes, firsts, words, gram)
            head = np.ones(len(own), bool)
            head[1:] = own[1:] != own[:-1]
            yield pa.RecordBatch.from_arrays(
                [rows.column("key").take(pa.array(own)), pa.array(hashes.view(np.int64))]
                + [pa.array(x.astype(np.int32)) for x in (at, near, far)]
                + [pa.array(head)],
                names=schema.names,
            )

    return texts.mapInArrow(work, schema)


def _runs(texts: DataFrame, words: int) -> DataFrame:
    """The hash and the bytes of every run around the anchors of each text."""
    schema = T.StructType().add("one", "long").add("two", "long").add("key", "binary")
    schema = schema.add("first", "integer").add("last", "integer")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_slices(batches, "content"):
            data, offsets = utf8(rows.column("content"))
            starts, ends, firsts = words_of(data, offsets)
            symbols = run_hashes(data, starts, ends)
            lists = rows.column("anchors")
            flat = lists.flatten()
            of = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            at, near, far = (flat.field(n).to_numpy() for n in ("at", "near", "far"))
            count = (far - near + 1).astype(np.int64)
            nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            begin = np.repeat(firsts[of] + at - far, count) + nth
            row = np.repeat(of, count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rolled(symbols, words, seed)[begin].view(np.int64)) for seed in (0, 1)]
                + [
                    rows.column("key").take(pa.array(row)),
                    pa.array((starts[begin] - offsets[row]).astype(np.int32)),
                    pa.array((ends[begin + words - 1] - offsets[row]).astype(np.int32)),
                ],
                names=schema.names,
            )

    return texts.mapInArrow(work, schema)


def repeated_passages(
    documents: DataFrame, words: int, *, text: str = "text", gram: int = GRAM
) -> DataFrame:
    """``key, whole, spans`` of every distinct text with something to remove, as
    `suffix.duplicate_spans` has them."""
    with scope() as own:
        return own.keep(_repeated(documents, words, text, min(gram, words)))


def _repeated(documents: DataFrame, words: int, text: str, gram: int) -> DataFrame:
    # So many words have as many bytes at least, and one less between them.
    texts = _keyed(documents, text).filter(F.octet_length("content") >= 2 * words - 1)
    found = stored(_anchor_table(texts, words, gram))
    copies = found.filter("head").groupBy("key").count().filter("count > 1").select("key")
    place = F.xxhash64("key", "at")
    shared = (
        found.groupBy("gram")
        .agg(F.min(place).alias("low"), F.max(place).alias("high"))
        .filter("low < high")
        .select("gram")
    )
    shared = bounded(stored(shared), F.lit(16))
    wanted = found.join(shared, "gram", "left_semi").dropDuplicates(["key", "at"])
    lists = stored(
        wanted.groupBy("key").agg(F.collect_list(F.struct("at", "near", "far")).alias("anchors"))
    )
    keys = bounded(lists.select("key"), F.lit(100))
    once = texts.join(keys, "key", "left_semi").dropDuplicates(["key"])
    runs = stored(_runs(once.join(lists, "key"), words))
    twice = runs.groupBy("one", "two").count().filter("count > 1").select("one", "two")
    twice = bounded(stored(twice), F.lit(32))
    spans = (
        runs.join(twice, ["one", "two"], "left_semi")
        .groupBy("key")
        .agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("spans"))
    )
    whole = copies.select("key", F.lit(True).alias("whole"))
    return stored(
        spans.join(whole, "key", "full_outer").select(
            "key", F.coalesce("whole", F.lit(False)).alias("whole"), F.col("spans")
        )
    )
