"""A stream of commands folded into a vector table.

Each micro-batch is validated, rendered, embedded and merged like a batch of commands.
Order is decided by ``seq``, so files that come late or twice end in the same table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from pairwright.operators.embed import Embedder
from pairwright.plans.sync import sync
from pairwright.sources.payloads import accept
from pairwright.sources.store import VersionedTable


def stream_sync(
    feed: DataFrame,
    table: VersionedTable,
    embedder: Embedder,
    checkpoint: str,
    name: str = "sync",
    available_now: bool = False,
    interval: str = "10 seconds",
    metrics: str | None = None,
) -> StreamingQuery:
    """Start folding an unpacked change feed into ``table``.

    A batch's rejected changes, if any, go to ``<table>/rejected/<name>-<batch>`` as Parquet. The batch number
    is committed with the table, so a replayed batch is skipped there and only rewrites its
    own rejects. ``available_now`` takes what has landed and stops: background ingestion. The commits
    hold every batch's figures; ``metrics`` names the folder of a table to append them to as well.
    """

    def fold_batch(batch: DataFrame, number: int) -> None:
        batch.persist()  # read once for the two writes
        try:
            valid, rejected = accept(batch, table.spec)
            if not rejected.isEmpty():
                rejected.write.mode("overwrite").parquet(
                    f"{table.path}/rejected/{name}-{number:012d}"
                )
            figures = (f"{name} {number}", metrics) if metrics else None
            sync(table, valid, embedder, (name, number), figures)
        finally:
            batch.unpersist()

    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return (
        feed.writeStream.foreachBatch(fold_batch)
        .queryName(name)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )
