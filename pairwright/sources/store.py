"""Versioned Parquet tables keyed by ``id``.

A version is a commit file that names a base folder and the change sets written since.
Commits are created whole and never overwritten, so readers see the old or the new version; a
writer that finds its version taken looks at the newer state and tries again. Data folders are
written once; nothing is overwritten in place.

A merge writes only its changes. Readers fold them into the base. `maintain` merges small change
sets into larger ones and, when changes have grown to a share of the base, writes a new base;
neither changes what is read. Replacement writes a new base and forgets the old rows.

Rows that cannot be stored are set aside in the same write, and the commit made by it lists them:
changes with a ``seq`` from before the last replacement, and live rows whose vector is missing, of
the wrong size or not finite. `rejected` returns them with their reason, `runs` the figures of
every write, as long as their versions are kept. A commit lists nothing of earlier ones but the
folders that are read, so it does not grow with their number, and `maintain` forgets old ones.
"""

from __future__ import annotations

import json
import logging
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pairwright.errors import EmbeddingError, MatchmakingError, StoreError
from pairwright.operators.changes import (
    BROADCAST_IDS,
    MARK_WORDS,
    fold,
    fold_scans,
    live,
    n_marks,
    newest,
    tombstones,
)
from pairwright.schemas import ARRIVAL, DELETE, EPOCH, OP, SEQ, UPSERT, EntitySpec
from pairwright.scratch import COMPRESSION, scratch_root, written as table_written  # noqa: F401
from pairwright.sources.files import FileSystem

log = logging.getLogger(__name__)

# Small change sets are merged when there are more than this.
MAX_CHANGE_SETS = 16
# A new base is written when the changed rows are more than this share of it.
BASE_SHARE = 0.25
# How often a writer tries again after another one committed first.
ATTEMPTS = 10
# Rows of a write by what becomes of them; the folder's partitions.
FATE = "_fate"
STORED, LATE, VECTOR_FAULT = "stored", "late", "vector"
FAULTS = {LATE: "seq: before the last replacement", VECTOR_FAULT: "vector: unusable"}
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
# Versions that maintenance keeps; it forgets older ones when there are twice as many.
KEPT_VERSIONS = 200
RUNS = (
    "version long, last struct<run: string, stage: string, rows: long, rejected: long, "
    "chunks: long, texts: long, calls: long, at: timestamp>"
)

NOTHING = {
    "version": 0,
    "base": None,
    "base_rows": 0,
    "changes": [],
    "change_rows": 0,
    "high_seq": -1,
    "floor": -1,
    "epoch": 0,
    "batches": {},
    "rejected": [],
    "last": {"rows": 0, "rejected": 0},
}


# Figures that are known once a write has run.
Note = Callable[[], dict]


def staged(error: Exception, what: str) -> MatchmakingError:
    """The error of a failed job, by the stage that failed."""
    if isinstance(error, MatchmakingError):
        return error
    if "EmbeddingError" in str(error):
        return EmbeddingError(f"{what}: embedding failed")
    return StoreError(f"{what}: {error}")


class VersionedTable:
    """The table of one entity below ``root``.

    A new base is written when more than ``compact_above`` rows have changed and these are more
    than a share of the base. ``dimension`` is the size of a vector; without it all live rows
    need a vector of finite numbers, whatever its size.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        spec: EntitySpec,
        compact_above: int = BROADCAST_IDS,
        dimension: int | None = None,
    ) -> None:
        self.compact_above = compact_above
        self.dimension = dimension
        self.spark = spark
        self.spec = spec
        self.path = f"{root.rstrip('/')}/{spec.table}"
        self._files = FileSystem(spark, root)
        # One open file per fate, so that rows need no sorting by it and keep their order.
        if int(spark.conf.get(WRITERS)) <= len(FAULTS):
            spark.conf.set(WRITERS, len(FAULTS) + 1)

    # -- versions ---------------------------------------------------------

    def state(self) -> dict:
        """The newest commit."""
        names = self._commits()
        return self._read(names[-1]) if names else json.loads(json.dumps(NOTHING))

    def _commits(self) -> list[str]:
        return [n for n in self._files.names(f"{self.path}/commits") if n.endswith(".json")]

    def _read(self, commit: str) -> dict:
        return json.loads(self._files.read_text(f"{self.path}/commits/{commit}"))

    def _commit(self, before: dict, **changes) -> dict | None:
        """The new state; None where another writer was first."""
        own = {"rejected": [], "last": {}}
        after = {**before, **own, **changes, "version": before["version"] + 1}
        path = f"{self.path}/commits/{after['version']:012d}.json"
        return after if self._files.create_text(path, json.dumps(after)) else None

    def _fate(self, floor: int | None) -> Column:
        finite = F.forall(
            "vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
        )
        size = F.size("vector") > 0 if self.dimension is None else F.size("vector") == self.dimension
        usable = F.coalesce((F.col(OP) == DELETE) | (size & finite), F.lit(False))
        fate = F.when(~usable, VECTOR_FAULT)
        if floor is not None:
            fate = F.when(F.col(SEQ) <= floor, LATE).when(~usable, VECTOR_FAULT)
        return fate.otherwise(STORED)

    def _write(self, rows: DataFrame, kind: str, floor: int | None = None) -> tuple[str, dict]:
        """Write rows to a new folder; the folder and, by fate, figures of what was written.

        The write itself counts: nothing is read again.
        """
        folder = f"{kind}-{uuid.uuid4().hex}"
        columns = [F.col(f.name).cast(f.dataType) for f in self.spec.table_schema]
        rows = rows.select(*columns).withColumn(FATE, self._fate(floor))
        seen = Observation()
        figures = []
        for fate in (STORED, *FAULTS):
            own = F.col(FATE) == fate
            figures += [
                F.count_if(own).alias(f"{fate}_rows"),
                F.max(F.when(own, F.col(SEQ))).alias(f"{fate}_seq"),
                F.max(F.when(own, F.col(EPOCH))).alias(f"{fate}_epoch"),
            ]
        path = f"{self.path}/data/{folder}"
        try:
            rows.observe(seen, *figures).write.partitionBy(FATE).parquet(path, compression=COMPRESSION)
        except Exception as error:
            raise staged(error, f"{self.spec.table}: write of {kind}") from error
        found = seen.get
        table_written(self.spark, path)
        return folder, {
            fate: {name: found[f"{fate}_{name}"] for name in ("rows", "seq", "epoch")}
            for fate in (STORED, *FAULTS)
            if found[f"{fate}_rows"]
        }

    def _scan(self, *folders: str, fate: str = STORED) -> DataFrame:
        paths = [f"{self.path}/data/{folder}/{FATE}={fate}" for folder in folders]
        return self.spark.read.schema(self.spec.table_schema).parquet(*paths)

    # -- reading ----------------------------------------------------------

    def _rows(self, state: dict) -> DataFrame:
        """Rows of a version, tombstones included."""
        if state["base"] is None and not state["changes"]:
            return self.spark.createDataFrame([], self.spec.table_schema)
        if not state["changes"]:
            return self._scan(state["base"])
        changes = self._scan(*[folder for folder, _ in state["changes"]])
        if state["change_rows"] > BROADCAST_IDS:
            rows = state["base_rows"] + state["change_rows"]
            # Every row that is overtaken is so by a change of its own.
            if n_marks(rows, state["change_rows"]) <= MARK_WORDS:
                base = None if state["base"] is None else self._scan(state["base"])
                return fold_scans(base, changes, state["change_rows"])
        if state["base"] is None:
            return newest(changes)
        return fold(self._scan(state["base"]), changes, state["change_rows"])

    def read(self) -> DataFrame:
        """Live rows of the newest version; an empty table where nothing was written yet."""
        return live(self._rows(self.state())).select(*self.spec.columns)

    def rejected(self) -> DataFrame:
        """Rows that were not stored, with the ``reason`` and the ``version`` they came with."""
        found = self.spark.createDataFrame([], self.spec.table_schema)
        found = found.select("*", F.lit("").alias("reason"), F.lit(0).alias("version"))
        for commit in self._commits():
            state = self._read(commit)
            for folder, fate, _ in state["rejected"]:
                rows = self._scan(folder, fate=fate)
                reason, version = F.lit(FAULTS[fate]), F.lit(state["version"])
                found = found.union(rows.select("*", reason.alias("reason"), version.alias("version")))
        return found

    def runs(self) -> DataFrame:
        """Figures of the writes that made the versions kept: ``version, run, stage, rows, rejected,
        chunks, texts, calls, at``. Maintenance, which stores nothing new, has none."""
        if not self._commits():
            commits = self.spark.createDataFrame([], RUNS)
        else:
            commits = self.spark.read.schema(RUNS).json(f"{self.path}/commits/*.json")
        return commits.where("last.rows is not null").select("version", "last.*")

    def row_bound(self) -> int:
        """No more rows than this, without reading any."""
        state = self.state()
        return state["base_rows"] + state["change_rows"]

    # -- writing ----------------------------------------------------------

    def _sequenced(self, rows: DataFrame, state: dict) -> DataFrame:
        """Rows with ``seq``, ``op`` and their place among all changes."""
        if SEQ not in rows.columns:
            rows = rows.withColumn(SEQ, F.lit(None).cast("long"))
        if OP not in rows.columns:
            rows = rows.withColumn(OP, F.lit(UPSERT))
        epoch = F.when(F.col(SEQ).isNull(), state["epoch"] + 1).otherwise(state["epoch"])
        return rows.withColumns(
            {EPOCH: epoch.cast("long"), ARRIVAL: F.lit(state["version"] + 1).cast("long")}
        )

    @staticmethod
    def _figures(written: dict, note: Note | None) -> dict:
        """What one write stored and set aside, with what its caller has to add."""
        rows = {fate: row["rows"] for fate, row in written.items()}
        stored = rows.get(STORED, 0)
        return {
            "rows": stored,
            "rejected": sum(rows.values()) - stored,
            "at": datetime.now(timezone.utc).isoformat(),
            **(note() if note else {}),
        }

    @staticmethod
    def _set_aside(folder: str, written: dict) -> list:
        return [[folder, fate, row["rows"]] for fate, row in written.items() if fate in FAULTS]

    def merge(
        self,
        changes: DataFrame,
        batch: tuple[str, int] | None = None,
        unique: bool = False,
        note: Note | None = None,
    ) -> dict:
        """Upsert rows by id and delete those marked so.

        Changes without a ``seq`` count in the order they arrive: after everything so far, and of
        one merge the last as read. ``batch`` names a stream and its batch: one that is already
        in is skipped, so a replay changes nothing. An empty input makes no version. ``unique``
        says that no id comes twice. Changes with a ``seq`` from before the last replacement are
        rejected. ``note`` gives further figures of the run for the commit.
        """
        state = self.state()
        folder = written = None
        for _ in range(ATTEMPTS):
            if batch and state["batches"].get(batch[0], -1) >= batch[1]:
                return state
            if folder is None:
                placed = self._sequenced(changes, state)
                if not unique:
                    read = F.monotonically_increasing_id()
                    placed = placed.withColumn("_read", read)
                    order = F.struct(EPOCH, F.coalesce(SEQ, F.lit(-1)), "_read")
                    placed = newest(placed, order=order).drop("_read")
                folder, written = self._write(placed, "changes", state["floor"])
            if not written and not batch:
                return state
            stored = written.get(STORED)
            rows = stored["rows"] if stored else 0
            after = self._commit(
                state,
                changes=[*state["changes"], [folder, rows]] if rows else state["changes"],
                change_rows=state["change_rows"] + rows,
                high_seq=max(state["high_seq"], stored["seq"] if rows and stored["seq"] is not None else -1),
                epoch=max(state["epoch"], stored["epoch"] if rows else 0),
                batches={**state["batches"], batch[0]: batch[1]} if batch else state["batches"],
                last=self._figures(written, note),
                rejected=self._set_aside(folder, written),
            )
            if after:
                return after
            # Another writer was first: what was written counts from there on. It is placed
            # anew, since other changes without a seq or a replacement may have come between.
            newer = self.state()
            if (newer["floor"], newer["epoch"]) != (state["floor"], state["epoch"]):
                folder = None
            state = newer
        raise StoreError(f"{self.spec.table}: other writers were first {ATTEMPTS} times")

    def delete(self, ids: DataFrame) -> dict:
        """Delete rows by canonical id; unknown and null ids change nothing."""
        ids = ids.select("id", *[c for c in (SEQ,) if c in ids.columns]).where("id is not null")
        return self.merge(tombstones(ids, self.spark.createDataFrame([], self.spec.table_schema)))

    def replace(self, rows: DataFrame, unique: bool = False, note: Note | None = None) -> dict:
        """Make ``rows`` the whole table. An empty input makes no version.

        Of an id that comes twice the highest ``seq`` counts. The rows then take the place
        of all changes so far: those count as older, whatever their ``seq``.
        """
        state = self.state()
        if not unique:
            rows = newest(self._sequenced(rows, state))
        rows = rows.withColumns(
            {
                SEQ: F.lit(state["high_seq"]).cast("long"),
                OP: F.lit(UPSERT),
                EPOCH: F.lit(state["epoch"]).cast("long"),
                ARRIVAL: F.lit(state["version"] + 1).cast("long"),
            }
        )
        folder, written = self._write(rows, "base")
        if not written:
            return state
        if STORED not in written:
            raise StoreError(f"{self.spec.table}: no row of the replacement can be stored")
        for _ in range(ATTEMPTS):
            after = self._commit(
                state,
                base=folder,
                base_rows=written[STORED]["rows"],
                changes=[],
                change_rows=0,
                floor=state["high_seq"],
                last=self._figures(written, note),
                rejected=self._set_aside(folder, written),
            )
            if after:
                return after
            state = self.state()
        raise StoreError(f"{self.spec.table}: other writers were first {ATTEMPTS} times")

    def maintain(self) -> dict:
        """Merge change sets or write a new base where that is due.

        Nothing of what is read changes, so a failure is logged and left to the next call.
        """
        try:
            state = self.state()
            most = max(self.compact_above, int(BASE_SHARE * state["base_rows"]))
            if state["change_rows"] > most:
                state = self.compact()
            if len(state["changes"]) > MAX_CHANGE_SETS:
                state = self._merge_change_sets(state)
            if state["version"] % KEPT_VERSIONS == 0 and len(self._commits()) >= 2 * KEPT_VERSIONS:
                self.vacuum(KEPT_VERSIONS)
            return state
        except Exception:
            log.exception("%s: maintenance failed; the table is as it was", self.spec.table)
            return self.state()

    def _merge_change_sets(self, state: dict) -> dict:
        """The newest change sets as one, as far back as the next is no more than twice as large
        as all after it: a row is written again only when its set has about doubled."""
        first = len(state["changes"]) - 1
        rows = state["changes"][first][1]
        while first > 0 and state["changes"][first - 1][1] <= 2 * rows:
            first -= 1
            rows += state["changes"][first][1]
        merged = state["changes"][first:]
        if len(merged) < 2:
            merged, first = state["changes"], 0
        folder, written = self._write(newest(self._scan(*[name for name, _ in merged])), "changes")
        kept, count = state["changes"][:first], written[STORED]["rows"]
        after = self._commit(
            state,
            changes=[*kept, [folder, count]],
            change_rows=sum(n for _, n in kept) + count,
        )
        return after or self.state()

    def compact(self, forget_before: int | None = None) -> dict:
        """Write the current rows as a new base, in the order of the entity's clustering columns.

        Tombstones are kept, since a late change may still arrive for them, except those
        with a ``seq`` below ``forget_before``. When another writer commits meanwhile, nothing
        happens. Data that only versions before the newest read goes first, so that no more than two
        bases take room at once.
        """
        state = self.state()
        self._let_go(state)
        rows = self._rows(state)
        if forget_before is not None:
            rows = rows.where((F.col(OP) != DELETE) | (F.coalesce(SEQ, F.lit(-1)) >= forget_before))
        order = self.spec.cluster_by
        rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
        folder, written = self._write(rows, "base")
        after = self._commit(
            state,
            base=folder if written else None,
            base_rows=written[STORED]["rows"] if written else 0,
            changes=[],
            change_rows=0,
        )
        return after or self.state()

    def _let_go(self, state: dict) -> None:
        """Delete stored rows that ``state`` does not read and some version before it did. Its commits
        stay, and so do rejected rows."""
        read = {state["base"], *[folder for folder, _ in state["changes"]]}
        for commit in self._commits():
            older = self._read(commit)
            if older["version"] < state["version"]:
                named = {older["base"], *[folder for folder, _ in older["changes"]]} - read - {None}
                for folder in sorted(named):
                    self._files.delete(f"{self.path}/data/{folder}/{FATE}={STORED}")
                read |= named

    def vacuum(self, keep: int = 2) -> list[str]:
        """Forget all but the last ``keep`` versions and remove data only they named.

        Folders no version names are left alone: a writer may be filling one.
        """

        def named(commit: str) -> set[str]:
            state = self._read(commit)
            folders = [folder for folder, *_ in (*state["changes"], *state["rejected"])]
            return {folder for folder in (state["base"], *folders) if folder}

        commits = self._commits()
        old, kept = commits[:-keep], commits[-keep:]
        unused = set().union(*map(named, old)) - set().union(*map(named, kept))
        for folder in sorted(unused):
            self._files.delete(f"{self.path}/data/{folder}")
        for commit in old:
            self._files.delete(f"{self.path}/commits/{commit}")
        return sorted(unused)
