"""Codes of vectors by product quantisation in whole numbers.

Components become ``floor(4096 * x)`` and vectors are cut into equal consecutive parts, each with a
codebook of its own that a fixed number of rounds improves. Rows are read where they lie: every
round is one scan that assigns parts and adds them up in the task, and only sums of codebook
entries are shuffled, so a round moves some thousand numbers a task whatever the table's size. The
codebooks (16 entries of a vector's length) are all the driver holds.

A part finds its nearest entry after a Walsh-Hadamard transform of both, zero-padded to a power of
two, with coefficients in the order of their sequency (their number of sign changes). The transform
is made of additions and scales every squared distance by the padded length, so it leaves their
order as it is, and most of a distance lies in the first coefficients where neighbouring
components are alike. Squared differences are added up in that order; an entry goes as soon as its
sum so far exceeds the full distance of the entry that looked nearest after the first of them.
All of it is done in integers, 64-bit ones while squares fit and Python's own beyond, which is
slow but exact: no floating point takes part after the first floor.

Rows whose vector is null or holds a null or a non-finite component are dropped, and so are those
of another length than most vectors have (the longer of two as frequent), which no codebook fits. A
length that the number of parts does not divide is filled up with zeros. Codebooks start from the
vectors of the smallest ids, a null id after all others; of rows that share an id the smallest
vector counts. With fewer ids the codebooks are smaller; without rows the result is empty. Every kept row
has a result, repeated rows one each. Ties go to the lower entry. An error that does not fit 64 bits, and the sum
of a label with such an error, is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.groups import with_figures
from pairwright.llm.whole import finite, flat, floors, usual_length
from pairwright.scratch import stored

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
# Sums go through the shuffle as signed digits of this base, so that they have no bound.
BASE_BITS = 32
# Differences held at once by one task.
CELLS = 1 << 21
LONGEST = (1 << 63) - 1


def sequency_order(size: int) -> np.ndarray:
    """Positions of a Walsh-Hadamard transform of ``size`` places by their sign changes."""
    rows = walsh(np.eye(size, dtype=np.int64), None)
    return np.argsort((rows[:, 1:] != rows[:, :-1]).sum(axis=1), kind="stable")


def walsh(values: np.ndarray, order: np.ndarray | None) -> np.ndarray:
    """The transform along the last axis, a power of two long, in the given order."""
    values = values.copy()
    size = values.shape[-1]
    half = 1
    while half < size:
        pairs = values.reshape(*values.shape[:-1], size // (2 * half), 2, half)
        low, high = pairs[..., 0, :].copy(), pairs[..., 1, :].copy()
        pairs[..., 0, :], pairs[..., 1, :] = low + high, low - high
        half *= 2
    return values if order is None else values[..., order]


class Codebook:
    """Entries of one part position, ready for comparison."""

    def __init__(self, entries: list[list[int]]):
        self.width = len(entries[0])
        self.size = 1 << max(0, self.width - 1).bit_length()
        self.order = sequency_order(self.size)
        self.largest = max((abs(x) for entry in entries for x in entry), default=0)
        self.transformed = self._transform(np.array(entries, dtype=object).reshape(len(entries), -1))

    def _transform(self, parts: np.ndarray) -> np.ndarray:
        padded = np.zeros((len(parts), self.size), parts.dtype)
        padded[:, : self.width] = parts
        return walsh(padded, self.order)

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of every part."""
        entries = self.transformed
        largest = max(self.largest, int(np.abs(parts).max())) if parts.size else self.largest
        # A difference of coefficients is at most 2 * size * largest, and `size` squares add up.
        if 4 * self.size**3 * largest**2 <= LONGEST:
            parts, entries = parts.astype(np.int64), entries.astype(np.int64)
        else:
            parts = parts.astype(object)
        step = max(1, CELLS // (len(entries) * self.size))
        found = [self._assign(self._transform(parts[i : i + step]), entries) for i in range(0, len(parts), step)]
        return (
            np.concatenate([code for code, _ in found]),
            np.concatenate([distance for _, distance in found]) // self.size,
        )

    def _assign(self, parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        every = np.arange(len(parts))
        first = max(1, self.size // 4)
        sums = ((parts[:, None, :first] - entries[None, :, :first]) ** 2).sum(axis=2)
        guess = sums.argmin(axis=1)
        best = sums[every, guess] + ((parts[:, first:] - entries[guess, first:]) ** 2).sum(axis=1)
        left = sums <= best[:, None]
        left[every, guess] = False
        row, entry = np.nonzero(left)
        sums = sums[row, entry]
        for start in range(first, self.size, first):
            some = slice(start, start + first)
            sums = sums + ((parts[row, some] - entries[entry, some]) ** 2).sum(axis=1)
            stays = sums <= best[row]
            row, entry, sums = row[stays], entry[stays], sums[stays]
        # What is left is as near as the guess or nearer; the last write for a row is its nearest.
        code = guess.copy()
        for place in range(len(entries) - 1, -1, -1):
            own = entry == place
            rows, near = row[own], sums[own]
            better = (near < best[rows]) | ((near == best[rows]) & (place < code[rows]))
            best[rows[better]], code[rows[better]] = near[better], place
        return code, best


def cut(column, length: int, parts: int) -> np.ndarray:
    """Whole components of a batch by row, part and position, the last part filled with zeros."""
    values = floors(flat(column), SCALE).reshape(-1, length)
    width = -(-length // parts)
    whole = np.zeros((len(values), parts * width), values.dtype)
    whole[:, :length] = values
    return whole.reshape(len(values), parts, width)


def digits(value: int) -> list[tuple[int, int]]:
    """Signed digits of a whole number to the base of the sums, with their places."""
    sign, value, found, place = (1, value, [], 0) if value >= 0 else (-1, -value, [], 0)
    while value:
        value, digit = value >> BASE_BITS, value & ((1 << BASE_BITS) - 1)
        if digit:
            found.append((place, sign * digit))
        place += 1
    return found


def first_entries(rows: DataFrame, length: int, parts: int, entries: int) -> list[list[list[int]]]:
    """By part, the components of the vectors with the smallest ids.

    Tasks send on no more rows than there are entries, so the shuffle has few whatever the table.
    """

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            vectors = flat(batch.column("vector")).reshape(-1, length)
            ids = batch.column("id").to_pylist()
            bound = max(held) if len(held) == entries else None
            for place, name in enumerate(ids):
                name = (name is None, name or 0)
                if bound is not None and name > bound:
                    continue
                vector = vectors[place].tolist()
                if name not in held or vector < held[name]:
                    held[name] = vector
                    if len(held) > entries:
                        del held[max(held)]
                    bound = max(held) if len(held) == entries else None
        names = sorted(held)
        yield pa.record_batch(
            [
                pa.array([None if missing else name for missing, name in names], pa.int64()),
                pa.array([held[name] for name in names], pa.list_(pa.float64())),
            ],
            names=["id", "vector"],
        )

    candidates = rows.select("id", "vector").mapInArrow(smallest, "id long, vector array<double>")
    chosen = (
        candidates.groupBy("id")
        .agg(F.min("vector").alias("vector"))
        .orderBy(F.asc_nulls_last("id"))
        .limit(entries)
        .toArrow()
    )
    if not chosen.num_rows:
        return []
    order = sorted(range(chosen.num_rows), key=lambda i: (chosen["id"][i].as_py() is None, chosen["id"][i].as_py() or 0))
    return [[part.tolist() for part in parts_of] for parts_of in np.swapaxes(cut(chosen["vector"], length, parts)[order], 0, 1)]


def improved(rows: DataFrame, books: list[list[list[int]]], length: int) -> list[list[list[int]]]:
    """The codebooks after one round: every used entry is the floored mean of its parts."""
    parts, entries, width = len(books), len(books[0]), len(books[0][0])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = [Codebook(book) for book in books]
        sums = np.zeros((parts, entries, width), object)
        counts = np.zeros((parts, entries), np.int64)
        for batch in batches:
            whole = cut(batch.column("vector"), length, parts)
            for part, coder in enumerate(coders):
                code, _ = coder.nearest(whole[:, part])
                counts[part] += np.bincount(code, minlength=entries)
                for entry in np.unique(code):
                    sums[part, entry] += whole[code == entry, part].sum(axis=0).astype(object)
        found = []
        for part in range(parts):
            for entry in np.flatnonzero(counts[part]).tolist():
                found.append((part, entry, -1, 0, int(counts[part, entry])))
                for place, total in enumerate(sums[part, entry]):
                    found.extend((part, entry, place, *digit) for digit in digits(int(total)))
        columns = list(zip(*found)) if found else [[]] * 5
        kinds = [pa.int32()] * 4 + [pa.int64()]
        yield pa.record_batch(
            [pa.array(column, kind) for column, kind in zip(columns, kinds)],
            names=["part", "entry", "place", "digit", "total"],
        )

    totals = (
        rows.select("vector")
        .mapInArrow(add_up, "part int, entry int, place int, digit int, total long")
        .groupBy("part", "entry", "place", "digit")
        .agg(F.sum("total").alias("total"))
        .toArrow()
    )
    sums: dict = {}
    for row in totals.to_pylist():
        at = (row["part"], row["entry"], row["place"])
        sums[at] = sums.get(at, 0) + (row["total"] << (BASE_BITS * row["digit"]))
    return [
        [
            [sums.get((part, entry, place), 0) // sums[part, entry, -1] for place in range(width)]
            if (part, entry, -1) in sums
            else books[part][entry]
            for entry in range(entries)
        ]
        for part in range(parts)
    ]


def codebooks(
    rows: DataFrame, length: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> list[list[list[int]]]:
    """By part, the entries after all rounds."""
    books = first_entries(rows, length, parts, entries)
    for _ in range(rounds if books else 0):
        books = improved(rows, books, length)
    return books


def digest(books: list[list[list[int]]]) -> str:
    numbers = ",".join(str(x) for book in books for entry in book for x in entry)
    return hashlib.sha256(numbers.encode()).hexdigest()


def compress(
    vectors: DataFrame,
    *,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> DataFrame:
    """``vec_id, label, code, error, label_error, codebooks_sha256`` of every kept row."""
    kept = vectors.select(
        F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector")
    ).filter(finite("vector"))
    length = usual_length(kept, "vector")
    kept = kept.filter(F.size("vector") == length)
    books = codebooks(kept, length, parts, entries, rounds) if length else [[[]]] * parts

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = [Codebook(book) for book in books]
        for batch in batches:
            if not batch.num_rows:
                continue
            if length:
                whole = cut(batch.column("vector"), length, parts)
                found = [coder.nearest(whole[:, part]) for part, coder in enumerate(coders)]
            else:  # vectors without components
                found = [(np.zeros(batch.num_rows, np.int64),) * 2] * parts
            codes = np.stack([code for code, _ in found], axis=1).astype(np.uint8)
            errors = sum(distance.astype(object) for _, distance in found)
            yield pa.record_batch(
                [
                    batch.column("id"),
                    batch.column("label"),
                    pa.array([row.tobytes().hex() for row in codes], pa.string()),
                    pa.array([x if x <= LONGEST else None for x in map(int, errors)], pa.int64()),
                ],
                names=["vec_id", "label", "code", "error"],
            )

    kind = kept.schema["label"].dataType.simpleString()
    coded = stored(kept.mapInArrow(encode, f"vec_id long, label {kind}, code string, error long"))
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    figures = coded.groupBy("label").agg(
        F.when(F.count("error") == F.count("*"), total).try_cast("long").alias("label_error"),
        F.count("*").alias("_rows"),
    )
    return with_figures(coded, stored(figures), "label", "_rows").select(
        "vec_id", "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")
    )
