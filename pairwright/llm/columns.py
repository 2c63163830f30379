"""Texts of Arrow batches as flat byte arrays, and small helpers every operator shares."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# A slice of a batch holds about this many bytes of text, and at least one row. Work arrays
# take some 50 bytes per byte of text, so this bounds the memory of a Python worker.
SLICE_BYTES = 2 << 20
# Bytes of runs hashed at once.
HASHED_BYTES = 256 << 10

_MULTIPLIER = np.uint64(0xBF58476D1CE4E5B9)
_TABLE = np.random.default_rng(20240229).integers(0, 2**64, (32, 256), dtype=np.uint64).ravel()


def text_slices(
    batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Rows in their order, in slices of bounded text size."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64)
        first = 0
        while first < len(ends):
            done = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(first, last - first)
            first = last


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end and the offsets of each; a null text is empty."""
    texts = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) else "")
    texts = texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or len(at) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def mixed(values: np.ndarray) -> np.ndarray:
    """Bits of 64-bit integers spread over all places."""
    values = (values ^ (values >> np.uint64(31))) * _MULTIPLIER
    return values ^ (values >> np.uint64(29))


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte run ``data[start:end]``.

    Tabulation hashing: a random word for each place and byte value, summed. Two different
    runs agree with a chance of 2**-64. The runs must not overlap and must not be empty.
    """
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    hashes = np.empty(len(sizes), np.uint64)
    done = np.cumsum(sizes)
    first = 0
    while first < len(sizes):
        before = done[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(done, before + HASHED_BYTES, side="right")))
        some = slice(first, last)
        hashes[some] = _run_hashes(data, starts[some], sizes[some])
        first = last
    return hashes


def _run_hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    place = np.arange(sizes.sum(), dtype=np.int64)
    firsts = np.cumsum(sizes) - sizes
    at = place + np.repeat(starts - firsts, sizes)
    place -= np.repeat(firsts, sizes)
    words = _TABLE[((place & 31) << 8) | data[at]]
    far = np.flatnonzero(place > 31)
    if len(far):  # the table begins anew every 32 places
        words[far] = mixed(words[far] + (place[far] >> 5).astype(np.uint64))
    return mixed(np.add.reduceat(words, firsts) + sizes.astype(np.uint64))
