"""Intermediate tables in the folder that driver and executors share.

The folder is ``spark.checkpoint.dir``. A temporary folder of this machine is taken only
where it is unset and the master is local, as in tests; anywhere else that is an error,
because executors would not see each other's files.
"""

from __future__ import annotations

import gc
import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from pairwright.errors import StoreError


def shared_folder(spark: SparkSession) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise StoreError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="pairwright-")


def scratch_root(spark: SparkSession) -> str:
    """The name of a new folder below the shared one."""
    return os.path.join(shared_folder(spark), f"pairwright-{uuid.uuid4().hex}")


# Codec of written tables: ids in hexadecimal and texts take about half the room that the default leaves.
COMPRESSION = "zstd"
# Bytes of written tables after which the shuffle files of finished plans are let go.
RECLAIM_BYTES = 64 << 20

_open = threading.local()
_written: dict[str, int] = {}


def reclaim(spark: SparkSession) -> None:
    """Let the shuffle files of finished plans go. They go when the driver has collected the plans,
    which may otherwise happen long after the disks of the executors are full."""
    gc.collect()
    spark._jvm.System.gc()


def written(spark: SparkSession, path: str) -> None:
    """Say that the table at ``path`` is written, so that its plan's shuffle files are not needed
    any more; after a number of small tables, or one large one, they are let go."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    application = spark.sparkContext.applicationId
    size = _written.get(application, 0) + files.getContentSummary(folder).getLength()
    if size >= RECLAIM_BYTES:
        reclaim(spark)
        size = 0
    _written[application] = size


class Scope:
    """The folders made by `stored`, or named to `in_scope`, since the scope was opened."""

    def __init__(self) -> None:
        self.tables: dict[str, DataFrame] = {}
        self.kept: dict[str, DataFrame] = {}

    def keep(self, table: DataFrame) -> DataFrame:
        """``table``, as `stored` returned it, outlives the scope."""
        path = table._scratch
        self.kept[path] = self.tables.pop(path)
        return table


@contextmanager
def scope() -> Iterator[Scope]:
    """Delete the scratch tables made within, but for those kept, which an outer scope may delete.

    What is returned from within must read kept tables only.
    """
    scopes = _open.__dict__.setdefault("scopes", [])
    own = Scope()
    scopes.append(own)
    try:
        yield own
    finally:
        scopes.remove(own)
        if scopes:
            scopes[-1].tables.update(own.kept)
        for path, table in own.tables.items():
            spark = table.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        if own.tables and not scopes:
            own.tables.clear()
            reclaim(spark)


def in_scope(path: str, table: DataFrame) -> DataFrame:
    """``table``, read from the scratch folder ``path``, which goes with the innermost open scope."""
    table._scratch = path
    if scopes := _open.__dict__.get("scopes"):
        scopes[-1].tables[path] = table
    return table


def stored(rows: DataFrame) -> DataFrame:
    """``rows`` written once and read back: later plans start from the files, which outlive
    the executors that wrote them, and every reader sees the same rows."""
    path = scratch_root(rows.sparkSession)
    rows.write.parquet(path, compression=COMPRESSION)
    written(rows.sparkSession, path)
    return in_scope(path, rows.sparkSession.read.schema(rows.schema).parquet(path))
