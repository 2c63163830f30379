"""Commands into vector tables: incremental, and as a whole replacement."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.operators import changes
from pairwright.operators.changes import newest, newest_of_scan, read_again
from pairwright.operators.embed import BATCH_ROWS, Embedder, Tally, embed
from pairwright.operators.metrics import append_run
from pairwright.operators.validate import id_problems, split
from pairwright.functions import canonical_uuid
from pairwright.schemas import DELETE, OP, SEQ, EntitySpec
from pairwright.scratch import scope, stored
from pairwright.sources.payloads import PLACE
from pairwright.sources.store import Note, VersionedTable


def given_order(commands: DataFrame) -> Column:
    """Which of several commands with one id counts: the highest ``seq``, any command without
    one before those with one, and of these the last as read."""
    if PLACE in commands.columns:
        return F.col(PLACE)
    own = F.col(SEQ) if SEQ in commands.columns else F.lit(None).cast("long")
    return F.struct(own.isNull().alias("without"), own.alias("seq"), F.monotonically_increasing_id())


def vectorize(
    commands: DataFrame, spec: EntitySpec, embedder: Embedder, clustered: bool = False
) -> DataFrame:
    """Typed commands as rows of the stored table.

    Of an id with several commands only the newest is rendered and embedded. Deletes have
    no text and get no vector. ``clustered`` orders the rows by the entity's clustering
    columns before they are embedded, while they are small to move; the id among these
    columns splits a hot value over many partitions.
    """
    scanned = changes.input_bytes(commands) >= changes.SHUFFLED_BYTES and read_again(commands)
    reduced = newest_of_scan if scanned else newest
    commands = reduced(commands, order=given_order(commands))
    if clustered:
        order = spec.cluster_by
        commands = commands.repartitionByRange(*order).sortWithinPartitions(*order)
    document = spec.document()
    if OP in commands.columns:
        document = F.when(F.col(OP) != DELETE, document)
    rows = embed(commands.withColumn("_document", document), "_document", embedder)
    kept = [name for name in (SEQ, OP) if name in commands.columns]
    return rows.select(*spec.columns, *kept)


def _derived(commands: DataFrame, spec: EntitySpec) -> DataFrame:
    """Commands as a scan: the columns that count are written once where more than a scan makes them
    from a large input. What tells commands with one id apart is written too, as they were read.
    """
    if changes.input_bytes(commands) < changes.SHUFFLED_BYTES or read_again(commands):
        return commands
    named = [name for name, _ in (*spec.record, *spec.labels)] + [SEQ, OP]
    kept = [name for name in named if name in commands.columns]
    return stored(commands.select(*kept, given_order(commands).alias(PLACE)))


def _counted(table: VersionedTable, embedder: Embedder, run: str, stage: str) -> tuple[Embedder, Note]:
    """The embedder with its calls counted, and what a commit says about the run.

    Rows and rejects are counted by the write; texts and model calls by the tasks that make them;
    chunks are those of ``BATCH_ROWS`` rows that all rows with a text fill.
    """
    tally = Tally.of(table.spark)

    def note() -> dict:
        return {
            "run": run,
            "stage": stage,
            "texts": tally.texts.value,
            "calls": tally.calls.value,
            "chunks": -(-tally.rows.value // BATCH_ROWS),
        }

    return replace(embedder, tally=tally), note


def sync(
    table: VersionedTable,
    commands: DataFrame,
    embedder: Embedder,
    batch: tuple[str, int] | None = None,
    metrics: tuple[str, str] | None = None,
) -> dict:
    """Upsert (and delete) by commands. Raises before anything is committed on failure.

    The commit holds the run's figures, see `VersionedTable.runs`. ``metrics`` names the run and the
    folder of a table they are appended to as well.
    """
    run = metrics[0] if metrics else f"{batch[0]} {batch[1]}" if batch else uuid.uuid4().hex
    embedder, note = _counted(table, embedder, run, f"sync {table.spec.table}")
    with scope():
        rows = vectorize(_derived(commands, table.spec), table.spec, embedder)
        state = table.merge(rows, batch, unique=True, note=note)
    _record(table, state, run, metrics)
    table.maintain()
    return state


def _record(table: VersionedTable, state: dict, run: str, metrics: tuple[str, str] | None) -> None:
    """Append the figures of a run that made a version."""
    if metrics and state["last"].get("run") == run:
        append_run(table.spark, metrics[1], state["last"])


def delete_commands(table: VersionedTable, commands: DataFrame) -> tuple[dict, DataFrame]:
    """Delete by the ids of commands, in any form of a UUID; the rejected come back with reasons.

    ``commands`` has ``id`` and may have ``seq``. Ids that no row has change nothing.
    """
    valid, rejected = split(commands, id_problems(F.col))
    state = table.delete(valid.withColumn("id", canonical_uuid("id")))
    return state, rejected


def bulk_sync(
    table: VersionedTable,
    commands: DataFrame,
    embedder: Embedder,
    metrics: tuple[str, str] | None = None,
) -> dict:
    """Replace the table by the commands' rows, in one job.

    The version is promoted after everything is written. When a stage fails the error is
    raised and the live version stays. No commands at all change nothing.
    """
    run = metrics[0] if metrics else uuid.uuid4().hex
    embedder, note = _counted(table, embedder, run, f"bulk_sync {table.spec.table}")
    with scope():
        rows = vectorize(_derived(commands, table.spec), table.spec, embedder, clustered=True)
        state = table.replace(rows, unique=True, note=note)
    _record(table, state, run, metrics)
    return state
