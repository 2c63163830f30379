"""Removal of byte strings that occur more than once in a collection of texts.

A byte goes if a string of ``length`` bytes that covers it starts at a second place anywhere,
in the same text or another. Texts are judged as they came; matches never cross texts.

1. Equal texts share a key (128 bits of SHA-256). A text that occurs twice goes whole, if it is
   long enough; it is compared with the others once.
2. Every string of ``length`` bytes has an *anchor*: the ``gram`` bytes in it with the smallest
   hash, the first of equal ones. Equal strings have equal anchors at equal places, so only
   strings around the same anchor need comparing, and an anchor that occurs once is done with.
   There is about one anchor per 170 bytes.
3. Around every anchor that occurs twice the text is cut out: a segment of at most
   ``2 * length - gram`` bytes. Segments with the same anchor form a small collection, whose
   suffixes are sorted column by column from the right: each round puts one symbol in front of
   the suffix of every segment and updates the order, as inserting into a Burrows-Wheeler
   transform does, and the common prefixes of neighbours, by range minima. Where neighbours
   share ``length`` symbols, both strings occur twice.

A round over whole texts would make as many passes over the collection as the longest text has
bytes; segments bound the rounds, and since strings are only compared at the same place from
their anchor, a segment needs no suffix but its newest. Blocks of segments are sorted in memory
that does not depend on the input; Spark's shuffle is the sequential file between the steps.

An anchor in more than ``GROUP`` places is not sorted in one block: its strings are hashed one by
one and counted, with counts before the shuffle.

A null text is empty. Rows that repeat are copies of each other. Texts shorter than ``length``
stay as they are. No step depends on ties.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwright.llm.columns import mixed, text_slices, utf8
from pairwright.scratch import scope, stored

LENGTH = 400
GRAM = 64
GROUP = 50_000
# Segments sorted together, and those laid out in columns at once.
BLOCK = 8_000
FILLED = 512
# Bytes of text hashed at every place at once: that takes some 120 bytes for each.
HASHED_BYTES = 256 << 10
# Tables up to this size are broadcast, larger ones joined by a shuffle.
BROADCAST_BYTES = 32 << 20

_PLACE_BITS = np.uint64(31)
_PLACE = np.uint64((1 << 31) - 1)
_BYTES = np.random.default_rng(8).integers(0, 2**64, 256, dtype=np.uint64)
_STEPS = np.random.default_rng(9).integers(0, 2**63, 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ABSENT = 256


def gram_hashes(data: np.ndarray, gram: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes from every place that has as many after it."""
    return rolled(_BYTES[data], gram, seed)


def rolled(part: np.ndarray, gram: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the ``gram`` symbols, given as random words, from every place that has
    as many after it."""
    if len(part) < gram:
        return np.zeros(0, np.uint64)
    power, size = _STEPS[seed : seed + 1], 1
    whole, done, n = None, 0, len(part) - gram + 1
    while True:
        if gram & size:
            piece = part[done : done + n]
            whole = piece if whole is None else whole * power + piece
            done += size
        if size * 2 > gram:
            return mixed(whole)
        part = part[:-size] * power + part[size:]
        power = power * power
        size *= 2


def anchors(
    data: np.ndarray, offsets: np.ndarray, length: int, gram: int
) -> tuple[np.ndarray, ...]:
    """Of every anchor: its text, hash, place in the text, and how far before it the nearest
    and the farthest string starts whose anchor it is."""
    return anchors_of(gram_hashes(data, gram), offsets, length, gram)


def anchors_of(
    hashes: np.ndarray, offsets: np.ndarray, length: int, gram: int
) -> tuple[np.ndarray, ...]:
    """The anchors of texts of any symbols, from the hashes of their grams."""
    none = np.zeros(0, np.int64)
    sizes = np.diff(offsets)
    strings = np.maximum(sizes - length + 1, 0)
    if not strings.any():
        return none, none.view(np.uint64), none, none, none
    width = length - gram + 1
    value = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    blocks = -(-len(value) // width)
    value = np.concatenate([value, np.full(blocks * width - len(value), ~np.uint64(0))])
    value = value.reshape(blocks, width)
    forward = np.minimum.accumulate(value, axis=1).ravel()
    backward = np.minimum.accumulate(value[:, ::-1], axis=1)[:, ::-1].ravel()
    text_of = np.repeat(np.arange(len(sizes)), strings)
    firsts = np.cumsum(strings) - strings
    start = np.arange(len(text_of)) - firsts[text_of] + offsets[:-1][text_of]
    least = np.minimum(backward[start], forward[start + width - 1])
    at = (least & _PLACE).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (text_of[1:] != text_of[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(at)) - 1
    own = text_of[begin]
    place = at[begin]
    return own, hashes[place], place - offsets[own], place - start[end], place - start[begin]


def _symbols(segments: list[bytes], begin: np.ndarray, places: int) -> np.ndarray:
    """(places, segments): the bytes of each segment from place ``begin`` on, `ABSENT` elsewhere."""
    symbol = np.empty((places, len(segments)), np.uint16)
    for low in range(0, len(segments), FILLED):
        some = segments[low : low + FILLED]
        rows = np.full((len(some), places), ABSENT, np.uint16)
        for row, segment, first in zip(rows, some, begin[low : low + FILLED].tolist(), strict=True):
            row[first : first + len(segment)] = np.frombuffer(segment, np.uint8)
        symbol[:, low : low + FILLED] = rows.T
    return symbol


def repeated(segments: list[bytes], group: np.ndarray, far: np.ndarray, length: int) -> np.ndarray:
    """(strings, segments): whether the string that starts so far before the anchor occurs in
    another segment of its group.

    ``far`` is how many bytes a segment has before its anchor; groups are contiguous.
    """
    n = len(segments)
    size = np.fromiter(map(len, segments), np.int64, n)
    left = int(far.max())
    right = int((size - far).max())
    symbol = _symbols(segments, left - far, left + right)
    # Symbols of different groups differ.
    own = (group * (ABSENT + 1)).astype(np.int32)
    out = np.zeros((left + 1, n), bool)
    order = np.arange(n)
    common = np.zeros(n + 1, np.int32)
    last = own + ABSENT
    for column in range(left + right - 1, -1, -1):
        key = symbol[column, order] + own[order]
        moved = np.argsort(key, kind="stable")
        key = key[moved]
        order = order[moved]
        same = np.flatnonzero((key[1:] == key[:-1]) & (key[1:] != last[order[1:]])) + 1
        low, high = moved[same - 1] + 1, moved[same]
        shared = common[high]
        wide = np.flatnonzero(low < high)
        if len(wide):
            span = np.empty(2 * len(wide), np.int64)
            span[0::2], span[1::2] = low[wide], high[wide] + 1
            shared[wide] = np.minimum.reduceat(common, span)[0::2]
        common = np.zeros(n + 1, np.int32)
        common[same] = shared + 1
        if column <= left:
            found = same[common[same] >= length]
            out[left - column, order[found]] = True
            out[left - column, order[found - 1]] = True
    return out


def spans_of(hit: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """The segment and the covered bytes of each run of repeated strings."""
    padded = np.zeros((hit.shape[1], hit.shape[0] + 2), np.int8)
    padded[:, 1:-1] = hit.T
    change = np.diff(padded, axis=1)
    of, nearest = np.nonzero(change == 1)
    _, beyond = np.nonzero(change == -1)
    return of, at[of] - beyond + 1, at[of] - nearest + length


def bounded(rows: DataFrame, row_bytes: Column) -> DataFrame:
    """``rows``, marked for broadcast if their summed size allows it."""
    size = rows.agg(F.sum(row_bytes)).first()[0] or 0
    return F.broadcast(rows) if size <= BROADCAST_BYTES else rows


def _keyed(documents: DataFrame, text: str) -> DataFrame:
    content = F.coalesce(F.col(text), F.lit(""))
    return documents.select(
        F.substring(F.unhex(F.sha2(content, 256)), 1, 16).alias("key"), content.alias("content")
    )


def _anchor_table(texts: DataFrame, length: int, gram: int) -> DataFrame:
    schema = T.StructType().add("key", "binary").add("gram", "long")
    schema = schema.add("at", "integer").add("near", "integer").add("far", "integer")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_slices(batches, "content", HASHED_BYTES):
            data, offsets = utf8(rows.column("content"))
            own, hashes, at, near, far = anchors(data, offsets, length, gram)
            yield pa.RecordBatch.from_arrays(
                [rows.column("key").take(pa.array(own)), pa.array(hashes.view(np.int64))]
                + [pa.array(x.astype(np.int32)) for x in (at, near, far)],
                names=schema.names,
            )

    return texts.mapInArrow(work, schema)


def _segments(texts: DataFrame, length: int) -> DataFrame:
    schema = T.StructType().add("gram", "long").add("key", "binary").add("at", "integer")
    schema = schema.add("far", "integer").add("segment", "binary")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_slices(batches, "content"):
            data, offsets = utf8(rows.column("content"))
            lists = rows.column("anchors")
            flat = lists.flatten()
            of = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            at, near, far = (flat.field(n).to_numpy() for n in ("at", "near", "far"))
            first = offsets[:-1][of] + at - far
            last = offsets[:-1][of] + at - near + length
            raw = data.tobytes()
            for low in range(0, len(of), BLOCK):
                some = slice(low, low + BLOCK)
                cut = [raw[a:b] for a, b in zip(first[some].tolist(), last[some].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        flat.field("gram").slice(low, BLOCK),
                        rows.column("key").take(pa.array(of[some])),
                        pa.array(at[some], pa.int32()),
                        pa.array(far[some], pa.int32()),
                        pa.array(cut, pa.binary()),
                    ],
                    names=schema.names,
                )

    return texts.mapInArrow(work, schema)


SPANS = T.StructType().add("key", "binary").add("first", "integer").add("last", "integer")


def _sorted_spans(segments: DataFrame, length: int) -> DataFrame:
    """Spans from segments of which those with one anchor are neighbours."""

    def spans(rows: pa.Table) -> pa.RecordBatch:
        gram = rows.column("gram").to_numpy()
        group = np.cumsum(np.concatenate([[0], gram[1:] != gram[:-1]]))
        far = rows.column("far").to_numpy().astype(np.int64)
        hit = repeated(rows.column("segment").to_pylist(), group, far, length)
        of, first, last = spans_of(hit, rows.column("at").to_numpy(), length)
        return pa.RecordBatch.from_arrays(
            [
                rows.column("key").combine_chunks().take(pa.array(of)),
                pa.array(first.astype(np.int32)),
                pa.array(last.astype(np.int32)),
            ],
            names=SPANS.names,
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK):
                waiting.append(batch.slice(low, BLOCK))
                if sum(b.num_rows for b in waiting) < BLOCK:
                    continue
                rows = pa.Table.from_batches(waiting).combine_chunks()
                gram = rows.column("gram").to_numpy()
                whole = int(np.searchsorted(gram, gram[-1]))
                waiting = rows.slice(whole).to_batches()
                if whole:
                    yield spans(rows.slice(0, whole))
        if waiting:
            yield spans(pa.Table.from_batches(waiting).combine_chunks())

    return segments.mapInArrow(work, SPANS)


def _counted_spans(segments: DataFrame, length: int) -> DataFrame:
    """Spans from segments of very frequent anchors: every string is hashed and counted."""
    schema = T.StructType().add("one", "long").add("two", "long").add("key", "binary")
    schema = schema.add("first", "integer")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_slices(batches, "segment", HASHED_BYTES):
            data, offsets = utf8(rows.column("segment"))
            strings = np.diff(offsets) - length + 1
            of = np.repeat(np.arange(len(strings)), strings)
            nth = np.arange(len(of)) - (np.cumsum(strings) - strings)[of]
            at = offsets[:-1][of] + nth
            begin = rows.column("at").to_numpy() - rows.column("far").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram_hashes(data, length, seed)[at].view(np.int64)) for seed in (0, 1)]
                + [
                    rows.column("key").take(pa.array(of)),
                    pa.array((begin[of] + nth).astype(np.int32)),
                ],
                names=schema.names,
            )

    strings = segments.select("key", "at", "far", "segment").mapInArrow(work, schema)
    twice = strings.groupBy("one", "two").count().filter("count > 1").select("one", "two")
    # One string may have any share of the rows. They stay where they are if the names of all
    # repeated ones fit; else adaptive execution splits them, which it does beside a stored table.
    twice = bounded(stored(twice), F.lit(32))
    found = strings.join(twice, ["one", "two"], "left_semi")
    return found.select("key", "first", (F.col("first") + length).alias("last"))


def duplicate_spans(
    documents: DataFrame,
    *,
    text: str = "text",
    length: int = LENGTH,
    gram: int = GRAM,
    group: int = GROUP,
) -> DataFrame:
    """``key, whole, spans`` of every distinct text with something to remove."""
    with scope() as own:
        return own.keep(_duplicate_spans(documents, text, length, gram, group))


def _duplicate_spans(
    documents: DataFrame, text: str, length: int, gram: int, group: int
) -> DataFrame:
    texts = _keyed(documents, text)
    long_texts = texts.filter(F.octet_length("content") >= length)
    copies = long_texts.groupBy("key").count().filter("count > 1").select("key")
    found = stored(_anchor_table(long_texts, length, gram))
    place = F.xxhash64("key", "at")
    shared = (
        found.groupBy("gram")
        .agg(F.min(place).alias("low"), F.max(place).alias("high"))
        .filter("low < high")
        .select("gram")
    )
    shared = bounded(stored(shared), F.lit(16))
    wanted = stored(found.join(shared, "gram").dropDuplicates(["key", "at"]))
    frequent = stored(wanted.groupBy("gram").count().filter(F.col("count") > group).select("gram"))
    lists = wanted.groupBy("key").agg(
        F.collect_list(F.struct("gram", "at", "near", "far")).alias("anchors")
    )
    keys = bounded(stored(wanted.select("key").distinct()), F.lit(100))
    once = long_texts.join(keys, "key", "left_semi").dropDuplicates(["key"])
    segments = _segments(once.join(lists, "key"), length)
    spans = None
    if frequent.isEmpty():
        rare = segments
    else:
        segments = stored(segments)
        names = F.broadcast(frequent) if frequent.count() < 1_000_000 else frequent
        rare = segments.join(names, "gram", "left_anti")
        spans = _counted_spans(segments.join(names, "gram", "left_semi"), length)
    rare = rare.repartition("gram").sortWithinPartitions("gram")
    rare = _sorted_spans(rare, length)
    spans = stored(rare if spans is None else rare.union(spans))
    grouped = spans.groupBy("key").agg(
        F.array_sort(F.collect_set(F.struct("first", "last"))).alias("spans")
    )
    whole = copies.select("key", F.lit(True).alias("whole"))
    both = grouped.join(whole, "key", "full_outer")
    return stored(
        both.select(
            "key", F.coalesce("whole", F.lit(False)).alias("whole"), F.col("spans")
        )
    )


def _kept(raw: bytes, whole: bool | None, spans: list | None) -> tuple[bytes, int]:
    """What is left, and the number of maximal removed runs."""
    if whole:
        return b"", 1
    parts, runs, done = [], 0, 0
    for span in spans or ():
        if span["first"] > done or not runs:
            parts.append(raw[done : span["first"]])
            runs += 1
        done = max(done, span["last"])
    parts.append(raw[done:])
    return b"".join(parts), runs


def _placed(documents: DataFrame, text: str, found: DataFrame) -> DataFrame:
    """The rows with what is to be removed from them.

    Spans that fit are broadcast. Else rows that lose nothing and copies that go whole stay where
    they are, if at least the keys fit, and only the others are shuffled to their spans.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    key = F.substring(F.unhex(F.sha2(content, 256)), 1, 16)
    rows = documents.select(F.struct("*").alias("row"), key.alias("key"))
    size = F.lit(150) + F.coalesce(F.size("spans"), F.lit(0)) * 40
    figures = found.agg(F.sum(size).alias("bytes"), F.count("*").alias("n")).first()
    if (figures["bytes"] or 0) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(found), "key", "left")
    if figures["n"] * 100 > BROADCAST_BYTES:
        return rows.join(found, "key", "left")
    marked = rows.join(F.broadcast(found.select("key", "whole")), "key", "left")
    cut = marked.filter(~F.col("whole")).drop("whole").join(found.filter(~F.col("whole")), "key")
    stays = marked.filter(F.col("whole").isNull() | F.col("whole"))
    return cut.unionByName(stays, allowMissingColumns=True)


def digests(documents: DataFrame, *, key: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """``key, n_bytes, n_removed, n_spans, kept_sha256`` of every row."""
    slim = documents.select(F.col(key), F.col(text))
    placed = _placed(slim, text, duplicate_spans(slim, text=text, **limits))
    placed = placed.select(
        F.col(f"row.{key}").alias(key), F.col(f"row.{text}").alias("content"), "whole", "spans"
    )
    schema = placed.select(key).schema.add("n_bytes", "long").add("n_removed", "long")
    schema = schema.add("n_spans", "long").add("kept_sha256", "string")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_slices(batches, "content"):
            data, offsets = utf8(rows.column("content"))
            raw = data.tobytes()
            sizes, removed, runs, kept_hash = [], [], [], []
            for a, b, whole, spans in zip(
                offsets[:-1].tolist(),
                offsets[1:].tolist(),
                rows.column("whole").to_pylist(),
                rows.column("spans").to_pylist(),
                strict=True,
            ):
                kept, n = _kept(raw[a:b], whole, spans)
                sizes.append(b - a)
                removed.append(b - a - len(kept))
                runs.append(n)
                kept_hash.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), *(pa.array(x, pa.int64()) for x in (sizes, removed, runs)), pa.array(kept_hash, pa.string())],
                names=schema.names,
            )

    return placed.mapInArrow(work, schema)


def without_repeats(
    documents: DataFrame, *, text: str = "text", words: int | None = None, **limits
) -> DataFrame:
    """The rows with all columns, repeated strings taken out of the text and ``n_chars`` set anew.

    With ``words``, runs of so many words that repeat are taken out as well, however short they
    are in bytes. Where a removal cuts a character in two, the rest of that character goes as well.
    """
    with scope() as own:
        found = duplicate_spans(documents, text=text, **limits)
        if words is not None:
            from pairwright.llm import passages  # it builds on this module

            both = found.unionByName(passages.repeated_passages(documents, words, text=text))
            spans = F.array_sort(F.flatten(F.collect_list("spans")))
            found = stored(
                both.groupBy("key").agg(F.max("whole").alias("whole"), spans.alias("spans"))
            )
        own.keep(found)
    placed = _placed(documents, text, found)
    placed = placed.select(F.col(f"row.{text}").alias("content"), "whole", "spans", "row")
    schema = T.StructType().add("row", documents.select(F.struct("*").alias("row")).schema["row"].dataType)
    schema = schema.add("kept", "string")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_slices(batches, "content"):
            data, offsets = utf8(rows.column("content"))
            raw = data.tobytes()
            kept = [
                None if null else _kept(raw[a:b], whole, spans)[0].decode(errors="ignore")
                for null, a, b, whole, spans in zip(
                    rows.column("content").is_null().to_pylist(),
                    offsets[:-1].tolist(),
                    offsets[1:].tolist(),
                    rows.column("whole").to_pylist(),
                    rows.column("spans").to_pylist(),
                    strict=True,
                )
            ]
            yield pa.RecordBatch.from_arrays(
                [rows.column("row"), pa.array(kept, pa.string())], names=schema.names
            )

    done = placed.mapInArrow(work, schema)
    new = {text: F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return done.select(
        *[new.get(c, F.col("row")[c]).alias(c) for c in documents.columns]
    )
