"""Bulk payloads read item by item: a data source that never holds a whole payload.

A payload ``{"seq": n, "items": [command, ...]}`` is one line of a JSON file and may have millions
of items. The source cuts files into ranges of bytes, one to a task; a payload belongs to the range its
line begins in. A task reads on in pieces, follows strings and brackets, and gives each item out
as the text of its JSON as soon as it has ended, so it holds one piece and one item. What
else there is to say about a payload (its ``seq``, which may come after the items, how many items it
had, what was wrong) is one more row at its end.

``explode_streamed`` makes typed commands of these rows and rejects payloads whole, as
``explode_items`` does for payloads that fit a row.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pairwright.operators.joins import join_counted
from pairwright.operators.validate import REASONS, command_problems
from pairwright.schemas import SEQ, EntitySpec
from pairwright.scratch import stored
from pairwright.sources.files import opened
from pairwright.sources.payloads import MALFORMED, PLACE, envelope, record_of, typed, unpack

# Bytes of a range of a file, and of a piece that is read at once.
RANGE_BYTES = 64 << 20
PIECE_BYTES = 1 << 20
# Bytes of items in a batch given to Spark.
BATCH_BYTES = 4 << 20

ROWS = "payload string, pos long, item string, seq long, n_items long, fault string"

# A whole string, or a character that opens, closes or separates; an open string has no match.
_TOKEN = re.compile(rb'"(?:[^"\\]|\\.)*"|[{}\[\],:]', re.DOTALL)
_OPEN = b"{["
_CLOSE = b"}]"


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


class _Payload:
    """Follows one payload through its pieces; ``feed`` returns the items that ended."""

    def __init__(self) -> None:
        self.held = b""  # bytes from the start of the value or item that is open
        self.at = 0  # where scanning goes on within them
        self.begin = 0  # where the open value or item begins
        self.depth = 0
        self.key: str | None = None
        self.in_items = False
        self.has_items = False
        self.seq: int | None = None
        self.n_items = 0
        self.fault: str | None = None
        self.ended = False
        self.expects_item = False

    def feed(self, piece: bytes, last: bool) -> Iterator[bytes]:
        if self.fault:
            return
        data = self.held + piece
        at, begin = self.at, self.begin
        while self.fault is None:
            match = _TOKEN.search(data, at)
            quote = data.find(b'"', at)
            if match is None or (quote >= 0 and quote < match.start()):
                # Nothing more, or a string that goes on in the next piece.
                at = quote if quote >= 0 else len(data)
                break
            token, at = match[0], match.end()
            if self.ended:
                self.fault = "malformed"
            elif token in (b"{", b"["):
                self.depth += 1
                if self.depth == 1:
                    begin = at
                    if token != b"{":
                        self.fault = "malformed"
                elif self.depth == 2 and self.key == "items" and token == b"[":
                    if self.has_items or data[begin : at - 1].strip():
                        self.fault = "malformed"
                    self.in_items = self.has_items = True
                    begin = at
            elif token in (b"}", b"]"):
                if self.in_items and self.depth == 2:
                    item = data[begin : at - 1].strip()
                    if item or self.expects_item:
                        yield self._item(item)
                    self.in_items, self.key, begin = False, None, at
                    self.depth -= 1
                else:
                    self.depth -= 1
                    if self.depth == 0:
                        self._value(data[begin : at - 1])
                        self.ended = True
                        begin = at
            elif token == b",":
                if self.in_items and self.depth == 2:
                    yield self._item(data[begin : at - 1].strip())
                    self.expects_item, begin = True, at
                elif self.depth == 1:
                    self._value(data[begin : at - 1])
                    begin = at
            elif token == b":" and self.depth == 1:
                try:
                    self.key = json.loads(data[begin : at - 1])
                except ValueError:
                    self.fault = "malformed"
                begin = at
        self.held, self.at, self.begin = data[begin:], at - begin, 0
        if last and not self.fault and (not self.ended or self.held.strip()):
            self.fault = "malformed"

    def _item(self, item: bytes) -> bytes:
        self.n_items += 1
        self.expects_item = False
        if not item:
            self.fault = "malformed"
        return item

    def _value(self, value: bytes) -> None:
        """The end of a member of the payload; of ``seq`` and a null ``items`` the value counts."""
        if self.key in ("seq", "items") and value.strip():
            try:
                found = json.loads(value)
            except ValueError:
                self.fault = "malformed"
                return
            whole = isinstance(found, int) and not isinstance(found, bool)
            if found is not None and (self.key == "items" or not whole):
                self.fault = "malformed"
            if self.key == "seq":
                self.seq = found
        self.key = None


def _lines(source, span: Range, size: int) -> Iterator[tuple[int, Iterator[tuple[bytes, bool]]]]:
    """Offsets of the lines that begin in a range, each with its pieces; pieces must be used up."""
    at = span.start
    source.seek(max(0, at - 1))
    held = source.read(PIECE_BYTES)
    if span.start:
        # A line begins here only if the byte before ends one; else after the next that does.
        at -= 1
        while (cut := held.find(b"\n")) < 0 and held:
            at += len(held)
            if at >= span.end:
                return
            held = source.read(PIECE_BYTES)
        at, held = at + cut + 1, held[cut + 1 :]

    def pieces() -> Iterator[tuple[bytes, bool]]:
        nonlocal at, held
        while True:
            if not held:
                held = source.read(PIECE_BYTES)
            cut = held.find(b"\n")
            if cut >= 0 or not held:
                line, held = (held[:cut], held[cut + 1 :]) if held else (b"", b"")
                at += len(line) + 1
                yield line, True
                return
            at += len(held)
            piece, held = held, b""
            yield piece, False

    while at < min(span.end, size):
        yield at, pieces()


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[Range]:
        system, place = opened(self.path)
        info = system.get_file_info(place)
        files = [info]
        if info.type == fs.FileType.Directory:
            files = system.get_file_info(fs.FileSelector(place, recursive=True))
        ranges = []
        for file in sorted(files, key=lambda f: f.path):
            if file.type == fs.FileType.File and file.base_name[0] not in "._":
                starts = range(0, file.size, RANGE_BYTES)
                ranges += [Range(file.path, s, min(s + RANGE_BYTES, file.size)) for s in starts]
        return ranges or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, _ = opened(self.path)
        size = system.get_file_info(partition.path).size
        rows: list[tuple] = []
        held = 0
        with system.open_input_file(partition.path) as source:
            for offset, pieces in _lines(source, partition, size):
                name = f"{partition.path}:{offset:020d}"
                payload, blank = _Payload(), True
                for piece, last in pieces:
                    blank = blank and not piece.strip()
                    if blank and last:
                        break
                    for item in payload.feed(piece, last):
                        rows.append((name, payload.n_items - 1, item.decode("utf-8", "replace"), None, None, None))
                        held += len(item) + 64
                        if held >= BATCH_BYTES:
                            yield _batch(rows)
                            rows, held = [], 0
                if not blank:
                    fault = payload.fault or (None if payload.has_items else "missing")
                    rows.append((name, None, None, payload.seq, payload.n_items, fault))
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    names = ["payload", "pos", "item", "seq", "n_items", "fault"]
    return pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], names=names)


class BulkItems(DataSource):
    """``spark.read.format("bulk_items").load(path)``: items and ends of payloads."""

    @classmethod
    def name(cls) -> str:
        return "bulk_items"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Items (``payload, pos, item``) and ends (``payload, seq, n_items, fault``) of payloads."""
    spark.dataSource.register(BulkItems)
    return spark.read.format("bulk_items").load(path)


def explode_streamed(
    spark: SparkSession, spec: EntitySpec, path: str
) -> tuple[DataFrame, DataFrame]:
    """Typed commands of all valid payloads below a path, and the rejected payloads with reasons.

    A payload with a bad item is rejected whole, as is one that is malformed, wherever in it the fault
    lies. Whether a payload has a bad item is one flag per payload and task before it is
    shuffled; the ends of payloads go back to their items by a join that knows how many items each
    has, so a payload with a third of all items is no single task's work.
    """
    rows = stored(read_items(spark, path))
    items = rows.where(F.col("pos").isNotNull()).select(
        "payload",
        F.col("pos").cast("int").alias("pos"),
        F.from_json("item", envelope(spec.command_schema), {"columnNameOfCorruptRecord": MALFORMED}).alias("item"),
    )
    record = record_of(spec, F.col("item"))
    labels = {name for name, _ in spec.labels}
    problems = command_problems(spec, lambda name: F.col("item")[name] if name in labels else record[name])
    bad = F.col("item").isNull() | F.col("item")[MALFORMED].isNotNull() | (F.size(problems) > 0)
    faulty = items.groupBy("payload").agg(F.max(F.coalesce(bad, F.lit(True))).alias("bad"))
    ends = rows.where(F.col("pos").isNull()).select("payload", SEQ, "n_items", "fault")
    judged = stored(
        ends.join(faulty, "payload", "left").select(
            "payload",
            SEQ,
            "n_items",
            F.array_compact(
                F.array(
                    F.when(F.col("fault") == "malformed", F.lit("payload: malformed")),
                    F.when(F.col("fault") == "missing", F.lit("items: missing")),
                    F.when(F.col("fault").isNull() & F.col("bad"), F.lit("items: invalid")),
                )
            ).alias(REASONS),
        )
    )
    good = judged.where(F.size(REASONS) == 0).drop(REASONS)
    found = join_counted(items, good, "payload", "n_items", 256).drop("n_items")
    place = F.struct(F.col(SEQ).isNull().alias("without"), SEQ, F.col("payload").alias("_payload"), "pos")
    commands = found.withColumn(PLACE, place)
    keep = ("payload", "pos", SEQ, PLACE)
    return (
        typed(unpack(commands, spec, "item", keep=keep), spec),
        judged.where(F.size(REASONS) > 0).select("payload", SEQ, REASONS),
    )
