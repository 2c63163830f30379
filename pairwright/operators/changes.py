"""Keyed changes: the newest row per id, and changes folded into a table.

Rows carry ``seq``, the position of the change that wrote them, and ``op``. The highest
``seq`` of an id wins, whatever order changes arrive in, and a delete stays as a
tombstone so that a late update cannot bring the row back. Folding a change twice is
the same as folding it once.

Rows of a stored table are ordered by three columns: the epoch, which every merge with changes
without a ``seq`` begins anew, so these come after all that arrived before them and before all that
arrives later; the ``seq`` within an epoch; and the arrival, so that of equals the later counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwright.schemas import DELETE, OP, ORDER, SEQ, UPSERT
from pairwright.scratch import stored

# Ids that may be broadcast: 36 characters, a position and overhead, about 100 MB.
BROADCAST_IDS = 1_000_000
# Beyond that their filter is: words of 64 bits, broadcast as rows of some 40 bytes, and the bits
# for each id. With fewer than the least bits left for each id it would let most rows through.
FILTER_WORDS = 1 << 21
FILTER_BITS = 16
LEAST_BITS = 2
# Bits an id sets in its word.
SET_BITS = 4
# Where a row of a stored table lies, and words of 64 bits that mark such rows: broadcast as rows of
# some 130 bytes.
FILE, ROW = "_file", "_row"
MARK_WORDS = 1 << 20
# What a plan has that is more than a scan; a limit would also end a task before its figures are in.
COSTLY = ("Exchange", "Python", "InArrow", "InPandas", "BatchScan", "Limit", "TakeOrdered")
# Inputs of fewer bytes are shuffled whole to find the newest rows, which takes fewer jobs.
SHUFFLED_BYTES = 32 << 20


def position(rows: DataFrame) -> Column:
    """What orders the rows of one id, highest last."""
    present = [name for name in ORDER if name in rows.columns]
    return F.struct(*[F.coalesce(F.col(name), F.lit(-1).cast("long")).alias(name) for name in present])


def newest(
    changes: DataFrame, key: str = "id", order: Column | str | None = None
) -> DataFrame:
    """The row with the highest ``order`` of each key; by default that of its `position`.

    Spark cuts each key to one row before the shuffle too, so that a key with a third
    of all changes sends one row per task.
    """
    if order is None:
        order = position(changes)
    order = F.col(order) if isinstance(order, str) else order
    place = F.row_number().over(Window.partitionBy(key).orderBy(order.desc()))
    return changes.withColumn("_place", place).where(F.col("_place") == 1).drop("_place")


def input_bytes(rows: DataFrame) -> int:
    """Bytes of the files and kept tables that the rows are made from, as far as they are known."""
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(size for size in sizes if size < 1 << 62)


def read_again(rows: DataFrame) -> bool:
    """The rows come straight from a scan, so that reading them again costs little and nothing is shuffled."""
    plan = rows._jdf.queryExecution().executedPlan().toString()
    return not any(costly in plan for costly in COSTLY)


def newest_of_scan(changes: DataFrame, order: Column, key: str = "id") -> DataFrame:
    """`newest` of rows that can be read again, see `read_again`: only rows of keys that come more
    than once are shuffled, the others stay where they are.

    A first pass shuffles hashes of the keys, counted where they lie. Keys that share a hash are
    only shuffled in vain.
    """
    hashed = F.xxhash64(key)
    counts = changes.select(hashed.alias("_key")).groupBy("_key").agg(F.count("*").alias("_rows"))
    repeated = stored(counts.where("_rows > 1").select("_key", F.lit(True).alias("_again")))
    n_repeated = repeated.count()
    if not n_repeated:
        return changes
    if n_repeated > BROADCAST_IDS:
        return newest(changes, key, order)
    placed = changes.withColumn("_order", order).withColumn("_key", hashed)
    marked = placed.join(F.broadcast(repeated), "_key", "left").drop("_key")
    single = marked.where(F.col("_again").isNull()).drop("_again", "_order")
    again = marked.where(F.col("_again").isNotNull()).drop("_again")
    return single.unionByName(newest(again, key, "_order").drop("_order"))


def live(rows: DataFrame) -> DataFrame:
    """Rows that are not tombstones."""
    return rows.where(F.col(OP) == UPSERT)


def _word(n_words: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(n_words)).alias("_word")


def _mask() -> Column:
    """The bits of an id in its word, from a hash of its own."""
    drawn = F.xxhash64("id", F.lit("bits"))
    one = F.lit(1).cast("long")
    mask = None
    for n in range(SET_BITS):
        bit = F.shiftrightunsigned(drawn, 6 * n).bitwiseAND(F.lit(63).cast("long")).cast("int")
        bit = F.call_function("shiftleft", one, bit)
        mask = bit if mask is None else mask.bitwiseOR(bit)
    return mask


def split_by_filter(base: DataFrame, changes: DataFrame, n_changes: int) -> tuple[DataFrame, DataFrame]:
    """Rows of ``base`` that certainly have no change, and the others, which are those with a
    change and few besides. Neither is shuffled.

    A Bloom filter of the changed ids is made by an aggregation and broadcast: every id has one
    word of 64 bits, so that a row looks in one place, and sets a few bits there.
    """
    n_words = min(FILTER_WORDS, max(1, n_changes * FILTER_BITS // 64))
    words = changes.select(_word(n_words), _mask().alias("_mask"))
    words = words.groupBy("_word").agg(F.bit_or("_mask").alias("_bits"))
    marked = base.withColumn("_word", _word(n_words)).join(F.broadcast(words), "_word", "left")
    mask = _mask()
    maybe = F.coalesce(F.col("_bits").bitwiseAND(mask) == mask, F.lit(False))
    return (
        marked.where(~maybe).select(*base.columns),
        marked.where(maybe).select(*base.columns),
    )


def fold(base: DataFrame, changes: DataFrame, n_changes: int | None = None) -> DataFrame:
    """``base``, one row per id, with ``changes`` applied; tombstones included.

    The base is scanned, not shuffled, when ``n_changes`` proves that the changed ids fit
    a broadcast. With more changes only rows that a filter of their ids lets through are shuffled,
    once, together with the changes; without a count, or with too many for a filter, all rows are.
    """
    if n_changes is None or n_changes > BROADCAST_IDS:
        untouched = None
        if n_changes is not None and n_changes * LEAST_BITS <= FILTER_WORDS * 64:
            untouched, base = split_by_filter(base, changes, n_changes)
        # Of equals the change counts: it came later.
        both = base.withColumn("_change", F.lit(0)).unionByName(changes.withColumn("_change", F.lit(1)))
        folded = newest(both, order=F.struct(position(changes), F.col("_change"))).drop("_change")
        return folded if untouched is None else untouched.unionByName(folded)
    latest = newest(changes)
    marks = F.broadcast(latest.select("id", position(latest).alias("_position")))
    # Of equals the change counts: it came later.
    stays = F.col("_position").isNull() | (position(base) > F.col("_position"))
    kept = base.join(marks, "id", "left").where(stays).drop("_position")
    names = [name for name in ORDER if name in base.columns]
    overtaken = base.select("id", *names).join(marks, "id").where(stays).select("id")
    fresh = latest.join(overtaken, "id", "left_anti")
    return kept.unionByName(fresh)


def n_marks(n_rows: int, n_lost: int) -> int:
    """No more words than this mark ``n_lost`` of ``n_rows`` stored rows, but for one more a file."""
    return min(n_lost, n_rows // 64 + 1)


def located(rows: DataFrame) -> DataFrame:
    """Rows of a scan with the place where each lies: its file, named after the write that made it,
    and its number there."""
    return rows.select(
        "*", F.col("_metadata.file_name").alias(FILE), F.col("_metadata.row_index").alias(ROW)
    )


def fold_scans(base: DataFrame | None, changes: DataFrame, n_changes: int) -> DataFrame:
    """`fold` of a stored base, or none, and stored changes, both scans of Parquet files.

    What is shuffled are ids, positions and places. Each id's newest row is found from these; the
    others are marked by bits in words, one for 64 rows of a file, and the words are broadcast to a
    second scan. So no row is moved, however many change.
    """
    changes = located(changes)
    names = [name for name in ORDER if name in changes.columns]
    narrow = changes.select("id", *names, FILE, ROW, F.lit(1).alias("_change"))
    if base is not None:
        base = located(base)
        offered = base.select("id", *names, FILE, ROW, F.lit(0).alias("_change"))
        if n_changes * LEAST_BITS <= FILTER_WORDS * 64:
            _, offered = split_by_filter(offered, narrow, n_changes)
        narrow = offered.unionByName(narrow)
    # Of equals the change counts: it came later.
    order = F.struct(position(narrow), F.col("_change"))
    place = F.row_number().over(Window.partitionBy("id").orderBy(order.desc()))
    lost = narrow.withColumn("_place", place).where(F.col("_place") > 1)
    word = F.shiftright(F.col(ROW), 6)
    bit = F.call_function(
        "shiftleft", F.lit(1).cast("long"), F.col(ROW).bitwiseAND(F.lit(63).cast("long")).cast("int")
    )
    words = lost.select(FILE, word.alias("_word"), bit.alias("_bit"))
    words = words.groupBy(FILE, "_word").agg(F.bit_or("_bit").alias("_bits"))

    def kept(rows: DataFrame) -> DataFrame:
        own = [name for name in rows.columns if name not in (FILE, ROW)]
        marked = rows.withColumn("_word", word).join(F.broadcast(words), [FILE, "_word"], "left")
        return marked.where(F.coalesce(F.col("_bits"), F.lit(0)).bitwiseAND(bit) == 0).select(*own)

    return kept(changes) if base is None else kept(base).unionByName(kept(changes))


def merge(
    current: DataFrame, changes: DataFrame, n_changes: int | None = None
) -> DataFrame:
    """Upserts and deletes applied to a table; live rows only."""
    return live(fold(current, changes, n_changes))


def delete(current: DataFrame, ids: DataFrame, n_ids: int | None = None) -> DataFrame:
    """Rows whose id is not among ``ids``; unknown ids change nothing.

    Repeated ids are combined before the shuffle.
    """
    ids = ids.select("id").distinct()
    if n_ids is not None and n_ids <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return current.join(ids, "id", "left_anti")


def tombstones(ids: DataFrame, like: DataFrame) -> DataFrame:
    """Delete changes for ``(id, seq)`` rows, in the columns of a stored table."""
    empty = {
        f.name: F.lit(None).cast(f.dataType)
        for f in like.schema
        if f.name not in ("id", OP) and f.name not in ids.columns
    }
    return ids.withColumns({**empty, OP: F.lit(DELETE)}).select(*like.columns)
