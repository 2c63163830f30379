"""Near-duplicate documents by bottom-k sketches of one hash function.

A document's set is its distinct word shingles. Its sketch holds the ``SKETCH`` smallest hashes.
Documents with equal sets form a class, worked on once. Then:

1. *Candidates* come from inverted lists. A list belongs to two retained values that follow one
   another in a sketch; sets with a similarity of 0.8 have most such pairs in common, while a
   single value of a frequent shingle would give a list of unbounded length. For sets whose
   union fits the sketch a common list is certain: an element that only one set has parts at
   most one pair of common neighbours, and there are more pairs than such elements. Above that
   the chance to share no list is below 1e-9 at a similarity of exactly 0.8.
2. Lists of at most ``LIST`` classes give their pairs. Longer ones give the pairs with their
   most central class and are divided by longer runs of neighbouring values, which bring
   together what is most alike. So the number of pairs grows with the rows, not with the
   square of a group. Classes that have several long lists and are not connected by leaders are
   then joined by rare members of their whole sets, which is exact.
3. *Estimation*: the smallest hashes of the union of two sketches are looked up in both; pairs
   whose share is six standard deviations below the limit are dropped.
4. *Verification* compares the full sets of the rest. First each class with its smallest
   partner, then what is not yet connected.

Classes, links and components stay in tables. Null and empty texts have no shingles and are
linked with nothing; a text with fewer words than a shingle has them all as one. Rows with one
``doc_id`` are one node and are each returned. Ties need no order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwright.llm.columns import mixed, run_hashes, text_slices, utf8
from pairwright.llm.components import components
from pairwright.llm.groups import among, narrow
from pairwright.operators.joins import join_counted
from pairwright.scratch import scope, stored

SKETCH = 32
LIST = 16
LONG = 5
FREQUENT = 500
# Left-over classes of a component beyond which they are compared by their differences.
CROWD = 256
RUNS = (2, 8, SKETCH)
PERCENT = 80
# Bytes of a list's key and figures in a broadcast.
LIST_BYTES = 64

_STEP = np.uint64(0x9E3779B97F4A7C15)


def _case() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    return table


CASE = _case()
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all texts, ascending within a text, and their offsets."""
    data, offsets = utf8(texts)
    data = CASE[data]
    inside = ~BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) & ~edge[:-1]
    starts = np.flatnonzero(inside & ~before)
    after = np.concatenate([inside[1:], [False]]) & ~edge[1:]
    ends = np.flatnonzero(inside & ~after) + 1
    hashes = run_hashes(data, starts, ends)
    at = np.searchsorted(starts, offsets)
    counts = np.diff(at)
    # A shingle starts at every word that has enough after it, or at the only start of a short text.
    shingles = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    text_of = np.repeat(np.arange(len(counts)), shingles)
    firsts = np.cumsum(shingles) - shingles
    begin = at[:-1][text_of] + np.arange(len(text_of)) - firsts[text_of]
    length = np.minimum(counts, words)[text_of]
    values = length.astype(np.uint64) * _STEP
    padded = np.concatenate([hashes, np.zeros(words, np.uint64)])
    for n in range(words):
        values = np.where(n < length, mixed(values * _STEP + padded[begin + n]), values)
    order = np.lexsort((values, text_of))
    values, text_of = values[order], text_of[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (text_of[1:] != text_of[:-1])
    values, text_of = values[new], text_of[new]
    return values, np.searchsorted(text_of, np.arange(len(counts) + 1))


def sketches(documents: DataFrame, words: int, key: str, text: str) -> DataFrame:
    """``doc, n, first_key, second_key, sketch``; equal sets have equal keys of 128 bits."""
    schema = documents.select(F.col(key).alias("doc")).schema
    schema = schema.add("n", "long").add("first_key", "long").add("second_key", "long")
    schema = schema.add("sketch", "binary")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_slices(batches, "content"):
            values, at = shingle_sets(rows.column("content"), words)
            zero = np.zeros(1, np.uint64)
            sums = np.cumsum(np.concatenate([zero, mixed(values)]))
            others = np.cumsum(np.concatenate([zero, mixed(values ^ _STEP)]))
            raw = values.tobytes()
            kept = [raw[8 * a : 8 * min(a + SKETCH, b)] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc"),
                    pa.array(np.diff(at)),
                    pa.array((sums[at[1:]] - sums[at[:-1]]).view(np.int64)),
                    pa.array((others[at[1:]] - others[at[:-1]]).view(np.int64)),
                    pa.array(kept, pa.binary()),
                ],
                names=schema.names,
            )

    slim = documents.select(F.col(key).alias("doc"), F.col(text).alias("content"))
    return slim.mapInArrow(work, schema)


def runs_of(sketch: DataFrame, size: int) -> DataFrame:
    """``list, node, n, at``: a key for every run of ``size`` retained values that starts at one
    of the places ``at``. A shorter sketch has one run, all of it."""
    schema = sketch.select(F.lit(0).cast("long").alias("list"), "node", "n").schema
    schema = schema.add("at", "integer")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            lists, of, places = [], [], []
            for row, (raw, ats) in enumerate(
                zip(rows.column("sketch").to_pylist(), rows.column("ats").to_pylist(), strict=True)
            ):
                values = np.frombuffer(raw, np.uint64)
                length = min(size, len(values))
                runs = len(values) - length + 1
                key = np.full(runs, length, np.uint64)
                for n in range(length):
                    key = mixed(key * _STEP + values[n : n + runs])
                at = np.arange(runs) if ats is None else np.array([a for a in ats if a < runs], int)
                lists.append(key[at].view(np.int64))
                places.append(at)
                of.append(np.full(len(at), row))
            row = pa.array(np.concatenate(of))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(lists)),
                    rows.column("node").take(row),
                    rows.column("n").take(row),
                    pa.array(np.concatenate(places).astype(np.int32)),
                ],
                names=schema.names,
            )

    return sketch.select("node", "n", "sketch", "ats").mapInArrow(work, schema)


def _near_in_size(left: str, right: str, percent: int) -> Column:
    """Sets that differ more than this in size cannot be alike."""
    return F.least(left, right) * 100 >= F.greatest(left, right) * percent


def candidates(nodes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs ``a < b`` of classes of like size from the inverted lists, and the long lists of
    neighbouring pairs as ``list, node, length``.

    The leader of a long list is its most central class: the one whose own long lists are the
    longest together, so that what the others have changed is left out of it.
    """
    with scope() as own:
        pairs, crowds = _candidates(nodes, percent)
        return own.keep(pairs), own.keep(stored(crowds))


def _candidates(nodes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    pairs = []
    crowds = score = None
    level = nodes.withColumn("ats", F.lit(None).cast("array<int>"))
    for size in RUNS:
        rows = stored(runs_of(level, size))
        lengths = stored(rows.groupBy("list").agg(F.count("*").alias("length")).filter("length > 1"))
        # Most lists have one member: only the rows of others move.
        shared = stored(join_counted(rows, lengths, "list", "length", LIST_BYTES))
        short = shared.filter(F.col("length") <= LIST).select("list", "node", "n")
        pairs.append(
            short.alias("x")
            .join(short.alias("y"), "list")
            .filter((F.col("x.node") < F.col("y.node")) & _near_in_size("x.n", "y.n", percent))
            .select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
        )
        crowd = shared.filter(F.col("length") > LIST)
        if score is None:
            crowds = crowd.select("list", "node", "length")
            score = stored(crowd.groupBy("node").agg(F.sum("length").alias("score")))
        pairs.append(_with_leader(crowd.select("list", "node", "n"), score, percent))
        if crowd.isEmpty():
            break
        ats = crowd.groupBy("node").agg(F.collect_set("at").alias("ats"))
        level = nodes.join(ats, "node")
    every = pairs[0]
    for more in pairs[1:]:
        every = every.union(more)
    return stored(every.distinct()), crowds


def _with_leader(rows: DataFrame, score: DataFrame, percent: int) -> DataFrame:
    """Every member of a list paired with the member of the highest score."""
    rank = F.struct("score", (-F.col("node")).alias("r"), "n")
    placed = rows.join(score, "node").withColumn("rank", rank)
    leader = placed.groupBy("list").agg(F.max("rank").alias("rank"), F.count("*").alias("length"))
    leader = stored(
        leader.select("list", "length", (-F.col("rank.r")).alias("leader"), F.col("rank.n").alias("n_leader"))
    )
    pairs = join_counted(rows, leader, "list", "length", LIST_BYTES).filter(
        (F.col("node") != F.col("leader")) & _near_in_size("n", "n_leader", percent)
    )
    return pairs.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"))


def likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs, as a written table, whose estimate from the sketch of the union does not rule the
    limit out."""
    share = percent / 100
    least = SKETCH * share - 6 * math.sqrt(SKETCH * share * (1 - share))
    # The pairs go to the sketches, and only sketches of a second partner are shuffled.
    sketch = nodes.select("node", "sketch")
    joined = sketch.toDF("a", "left").join(narrow(pairs), "a")
    second = among(sketch, stored(pairs.select("b").distinct()), "node")
    joined = joined.join(second.toDF("b", "right"), "b")
    schema = pairs.select("a", "b").schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            keep = []
            for left, right in zip(
                rows.column("left").to_pylist(), rows.column("right").to_pylist(), strict=True
            ):
                left, right = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
                union = np.sort(np.concatenate([left, right]))
                twice = np.flatnonzero(union[1:] == union[:-1])
                # The smallest values of the union: as many as the sketch holds.
                distinct = len(union) - len(twice)
                within = twice if distinct <= SKETCH else twice[twice - np.arange(len(twice)) < SKETCH]
                keep.append(len(within) * SKETCH >= least * min(distinct, SKETCH))
            yield rows.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(work, schema)


def verified(
    pairs: DataFrame, documents: DataFrame, words: int, percent: int, key: str, text: str
) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    with scope() as own:
        return own.keep(stored(_verified(pairs, documents, words, percent, key, text)))


def _verified(
    pairs: DataFrame, documents: DataFrame, words: int, percent: int, key: str, text: str
) -> DataFrame:
    pairs = stored(pairs)
    seconds = stored(pairs.select("b").distinct())
    wanted = stored(pairs.select(F.col("a").alias("node")).union(seconds).distinct())
    texts = documents.select(F.col(key).alias("node"), F.col(text).alias("content"))
    texts = among(texts, wanted, "node")
    schema = texts.select("node").schema.add("members", "binary")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_slices(batches, "content"):
            values, at = shingle_sets(rows.column("content"), words)
            raw = values.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("node"),
                    pa.array([raw[8 * a : 8 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary()),
                ],
                names=schema.names,
            )

    members = stored(texts.mapInArrow(sets, schema))
    joined = members.toDF("a", "left").join(narrow(pairs), "a")
    joined = joined.join(among(members, seconds, "node").toDF("b", "right"), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            keep = []
            for left, right in zip(rows.column("left"), rows.column("right"), strict=True):
                left = np.frombuffer(left.as_buffer(), np.uint64)
                right = np.frombuffer(right.as_buffer(), np.uint64)
                both = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(100 * both >= percent * (len(left) + len(right) - both))
            yield rows.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(compare, pairs.select("a", "b").schema)


def near_duplicates(
    documents: DataFrame,
    *,
    words: int = 5,
    percent: int = PERCENT,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``key, n_shingles, component_id, kept`` of every row.

    The row of a null key is a document of its own: its component is null and it is kept.
    """
    with scope() as own:
        return own.keep(stored(_grouped(documents, words, percent, key, text)))


def _grouped(
    documents: DataFrame, words: int, percent: int, key: str, text: str
) -> DataFrame:
    found = stored(sketches(documents, words, key, text))
    # Rows without a key are nobody's copy: as one document they would link what they hold.
    filled = found.filter("n > 0 and doc is not null")
    classes = filled.groupBy("first_key", "second_key").agg(F.min("doc").alias("node"))
    member = stored(
        filled.select("doc", "first_key", "second_key")
        .join(classes, ["first_key", "second_key"])
        .select("doc", "node")
    )
    first = stored(member.select("node").distinct())
    nodes = stored(among(filled.select(F.col("doc").alias("node"), "n", "sketch"), first, "node"))
    # Rows of one document with different texts are one node.
    several = member.groupBy("doc").agg(F.min("node").alias("a"), F.max("node").alias("b"))
    links = (
        member.join(several.filter("a < b"), "doc")
        .filter("a < node")
        .select("a", F.col("node").alias("b"))
    )

    tested, long_lists = candidates(nodes, percent)
    close = stored(likely(tested, nodes, percent))
    smallest = close.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = stored(
        links.union(verified(smallest, documents, words, percent, key, text)).distinct()
    )
    rest = apart(close, components(links))
    links = stored(links.union(verified(rest, documents, words, percent, key, text)).distinct())
    roots = components(links)

    with scope() as own:
        again = left_over(long_lists, nodes, roots, documents, words, percent, key, text)
        again = stored(again.join(tested, ["a", "b"], "left_anti"))
        again = own.keep(stored(likely(again, nodes, percent)))
    if not again.isEmpty():
        more = verified(again, documents, words, percent, key, text)
        roots = components(stored(links.union(more).distinct()))

    roots = roots.toDF("node", "root")
    result = (
        found.select("doc", "n")
        .join(member.distinct().groupBy("doc").agg(F.min("node").alias("node")), "doc", "left")
        .join(roots, "node", "left")
        .withColumn("component_id", F.coalesce("root", "node", "doc"))
    )
    return result.select(
        F.col("doc").alias(key),
        F.col("n").alias("n_shingles"),
        "component_id",
        F.coalesce(F.col("doc") == F.col("component_id"), F.lit(True)).alias("kept"),
    )


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs that are not in one component."""
    joined = pairs.join(roots.toDF("a", "root_a"), "a", "left").join(
        roots.toDF("b", "root_b"), "b", "left"
    )
    return joined.filter(
        F.coalesce("root_a", "a") != F.coalesce("root_b", "b")
    ).select("a", "b")


def frequent_members(texts: DataFrame, n_texts: int, words: int) -> np.ndarray:
    """The shingles of at least one in ``FREQUENT`` sets, ascending: at most ``FREQUENT`` times the
    mean size of a set."""
    schema = T.StructType().add("list", "long")

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_slices(batches, "content"):
            values, _ = shingle_sets(rows.column("content"), words)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64))], names=["list"])

    least = max(LIST + 1, n_texts // FREQUENT)
    counts = texts.mapInArrow(every, schema).groupBy("list").count()
    common = counts.filter(F.col("count") >= least).select("list").toArrow()
    return np.sort(common.column("list").to_numpy().view(np.uint64))


def rare_first(texts: DataFrame, frequent: np.ndarray, words: int, percent: int) -> DataFrame:
    """``list, node, n, at, before`` for the first members of every set in an order that all sets
    share, frequent ones last; ``before`` is the member before it, null for the first.

    Two sets with a similarity of at least ``percent`` have a common one among their first
    ``n - ceil(n * percent / 100) + 1`` members, whatever the order.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_slices(batches, "content"):
            values, at = shingle_sets(rows.column("content"), words)
            last = np.isin(values, frequent, assume_unique=False)
            sizes = np.diff(at)
            lists, of, places, before = [], [], [], []
            for row, (low, high) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                n = high - low
                order = np.argsort(last[low:high], kind="stable")
                keep = order[: n + (-n * percent) // 100 + 1] if n else order
                lists.append(values[low:high][keep].view(np.int64))
                before.append(np.concatenate([np.zeros(min(n, 1), np.int64), lists[-1][:-1]]))
                of.append(np.full(len(keep), row))
                places.append(np.arange(len(keep), dtype=np.int32))
            of = np.concatenate(of)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(lists)),
                    rows.column("node").take(pa.array(of)),
                    pa.array(sizes[of]),
                    pa.array(np.concatenate(places)),
                    pa.array(np.concatenate(before), mask=np.concatenate(places) == 0),
                ],
                names=["list", "node", "n", "at", "before"],
            )

    out = T.StructType().add("list", "long").add("node", texts.schema["node"].dataType)
    out = out.add("n", "long").add("at", "integer").add("before", "long")
    return texts.select("node", "content").mapInArrow(first, out)


def deviations(
    near: DataFrame, texts: DataFrame, centres: DataFrame, frequent: np.ndarray, words: int, percent: int
) -> DataFrame:
    """``main, node, root, list, at, before, rest, excess``: the members by which the sets of
    ``near`` (``main, node, root``) differ from the ``base`` of their ``main``, frequent ones last.

    One row of each set, with ``at = -1``, stands for the set itself. ``rest`` is how many members
    are left from a place on. Two sets x and y with differences X and Y differ in
    ``|X| + |Y| - 2 |X & Y|`` members, so they are alike if
    ``2 (100 + percent) |X & Y| >= excess(x) + excess(y)``. Of a set that differs in more members than
    it has there is that one row only, without an excess.
    """
    counts = near.groupBy("main").agg(F.count("*").alias("rows"))
    centres = stored(centres.join(counts, "main"))
    row_bytes = (centres.agg(F.max(F.octet_length("base"))).first()[0] or 0) + LIST_BYTES
    wide = texts.select("node", "content").join(narrow(near), "node")
    wide = join_counted(wide, centres, "main", "rows", row_bytes)
    wide = wide.select("main", "node", "root", "content", "base")
    schema = wide.select("main", "node", "root").schema.add("list", "long").add("at", "integer")
    schema = schema.add("before", "long").add("rest", "long").add("excess", "long")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_slices(batches, "content"):
            values, at = shingle_sets(rows.column("content"), words)
            bases: dict[int, np.ndarray] = {}
            lists, before, sizes, excess, far = [], [], [], [], []
            for row, main in enumerate(rows.column("main").to_pylist()):
                if main not in bases:
                    bases[main] = shingle_sets(rows.column("base").slice(row, 1), words)[0]
                own = values[at[row] : at[row + 1]]
                members = np.setxor1d(own, bases[main], assume_unique=True)
                excess.append((100 + percent) * len(members) - (100 - percent) * len(own))
                far.append(len(members) > len(own))
                members = members[:0] if far[-1] else members
                members = members[np.argsort(np.isin(members, frequent), kind="stable")]
                lists.append(np.concatenate([[0], members.view(np.int64)]))
                before.append(np.concatenate([[0], lists[-1][:-1]]))
                sizes.append(len(members))
            sizes = np.array(sizes, np.int64)
            of = np.repeat(np.arange(len(sizes)), sizes + 1)
            place = np.arange(len(of)) - (np.cumsum(sizes + 1) - sizes - 1)[of] - 1
            yield pa.RecordBatch.from_arrays(
                [
                    *(rows.column(c).take(pa.array(of)) for c in ("main", "node", "root")),
                    pa.array(np.concatenate(lists)),
                    pa.array(place.astype(np.int32)),
                    pa.array(np.concatenate(before), mask=place <= 0),
                    pa.array(sizes[of] - place),
                    pa.array(np.array(excess, np.int64)[of], mask=np.array(far, bool)[of]),
                ],
                names=schema.names,
            )

    return wide.mapInArrow(work, schema)


def among_crowds(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` of unlike roots that may be alike, from written `deviations`.

    The set nearest its base stands for all that must be alike with it, and so with one another
    through it. Of what is left, sets outside the component meet the others in the lists of their
    differences. Those are mostly rare, where all sets of a crowd have most of their members in
    common; and of a set only as many first differences are in lists as leave enough for the least
    demanding partner.
    """
    rows = rows.filter("excess is not null")
    heads = rows.filter("at < 0")
    best = heads.groupBy("main").agg(F.min(F.struct("excess", "node", "root")).alias("best"))
    best = narrow(
        stored(
            best.select(
                "main",
                F.col("best.excess").alias("least"),
                F.col("best.node").alias("best"),
                F.col("best.root").alias("root_best"),
            )
        )
    )
    sure = heads.join(best, "main").filter("excess + least <= 0 and root <> root_best")
    sure = sure.select(F.least("node", "best").alias("a"), F.greatest("node", "best").alias("b"))

    members = rows.filter("at >= 0").join(best, "main")
    reach = 2 * (100 + percent)
    x = members.filter(
        (F.col("root") != F.col("main"))
        & (F.col("excess") + F.col("least") > 0)
        & (F.col("rest") * reach >= F.col("excess") + F.col("least"))
    ).select(
        "main",
        "list",
        F.col("node").alias("x"),
        F.col("root").alias("root_x"),
        F.col("before").alias("before_x"),
        F.col("rest").alias("rest_x"),
        F.col("excess").alias("excess_x"),
    )
    x = stored(x)
    lowest = stored(x.groupBy("main").agg(F.min("excess_x").alias("lowest")))
    y = (
        members.join(narrow(lowest), "main")
        .filter(F.col("rest") * reach >= F.col("excess") + F.col("lowest"))
        .select(
            "main",
            "list",
            F.col("node").alias("y"),
            F.col("root").alias("root_y"),
            F.col("before").alias("before_y"),
            F.col("rest").alias("rest_y"),
            F.col("excess").alias("excess_y"),
            # Not among the x.
            ((F.col("root") == F.col("main")) | (F.col("excess") + F.col("least") <= 0)).alias("passive"),
        )
    )
    enough = F.least("rest_x", "rest_y") * reach >= F.col("excess_x") + F.col("excess_y")
    once = F.col("passive") | (F.col("x") < F.col("y"))
    new = F.coalesce(F.col("before_x") != F.col("before_y"), F.lit(True))
    met = x.join(y, ["main", "list"]).filter((F.col("root_x") != F.col("root_y")) & once & new & enough)
    return sure.union(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def left_over(
    long_lists: DataFrame,
    nodes: DataFrame,
    roots: DataFrame,
    documents: DataFrame,
    words: int,
    percent: int,
    key: str,
    text: str,
) -> DataFrame:
    """Pairs that share long lists only and that leaders have not connected.

    Two classes that are alike and have not met in a short list share at least ``LONG`` long ones,
    or two fifths of a small sketch's. Classes with as many are compared by the first members of
    their whole sets in a common order, which leaves no pair out: of a list the members outside
    its largest component are paired with those members of other components that enough is left
    of. Two members that have the same one before have met in its list, with more left, and do
    not meet again.

    In a component of more than ``CROWD`` such classes most sets have most members in common. Lists
    whose largest component is one of these are left to the differences from its most central
    class, but for sets that have less in common with that.
    """
    runs = F.greatest(F.least("n", F.lit(SKETCH)) - 1, F.lit(1))
    sizes = nodes.groupBy("node").agg(F.min("n").alias("n"))
    roots = roots.select("node", "root")
    # A list within one component can link nothing.
    held = long_lists.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed_lists = held.groupBy("list").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("length")
    )
    mixed_lists = stored(mixed_lists.filter("low < high").select("list", "length"))
    open_lists = join_counted(long_lists.select("list", "node"), mixed_lists, "list", "length", LIST_BYTES)
    full = open_lists.groupBy("node").agg(F.count("*").alias("long"), F.sum("length").alias("score"))
    full = full.join(sizes, "node").join(roots, "node", "left")
    least = F.least(F.lit(LONG), F.greatest(F.lit(1), F.floor(runs * 0.4)))
    full = full.filter(F.col("long") >= least)
    full = stored(full.select("node", "score", F.coalesce("root", "node").alias("root")))
    texts = documents.select(F.col(key).alias("node"), F.col(text).alias("content"))
    texts = stored(among(texts, full.select("node").distinct(), "node"))
    frequent = frequent_members(texts, full.count(), words)
    placed = rare_first(texts, frequent, words, percent).join(full.select("node", "root"), "node")
    placed = stored(placed.select("list", "node", "at", "before", "n", "root"))
    main = (
        placed.groupBy("list", "root")
        .agg(F.count("*").alias("members"))
        .groupBy("list")
        .agg(
            F.max(F.struct("members", "root")).alias("main"),
            F.count("*").alias("roots"),
            F.sum("members").alias("size"),
        )
        .filter("roots > 1")
        .select("list", F.col("main.root").alias("main"), "size")
    )
    shared = stored(join_counted(placed, stored(main), "list", "size", LIST_BYTES))
    centre = F.max(F.struct("score", (-F.col("node")).alias("r"))).alias("centre")
    crowds = full.groupBy(F.col("root").alias("main")).agg(F.count("*").alias("members"), centre)
    crowds = crowds.filter(F.col("members") > CROWD)
    crowds = stored(crowds.select("main", (-F.col("centre.r")).alias("node")))
    crowded = crowds.select("main")
    near = stored(shared.join(narrow(crowded), "main", "left_semi").select("main", "node", "root").distinct())
    base = among(texts, crowds.select("node"), "node").groupBy("node").agg(F.min("content").alias("base"))
    base = base.join(crowds, "node").select("main", "base")
    differing = stored(deviations(near, texts, base, frequent, words, percent))
    far = stored(differing.filter("excess is null").select("main", "node", F.lit(1).alias("far")).distinct())
    shared = shared.join(narrow(crowded.withColumn("crowd", F.lit(1))), "main", "left")
    shared = shared.join(narrow(far), ["main", "node"], "left")
    shared = shared.withColumn("open", F.col("crowd").isNull() | F.col("far").isNotNull())
    x = shared.filter("root <> main").select(
        "list",
        F.col("node").alias("x"),
        F.col("root").alias("root_x"),
        F.col("n").alias("n_x"),
        (F.col("n") - F.col("at")).alias("rest_x"),
        F.col("before").alias("before_x"),
        F.col("open").alias("open_x"),
        "main",
    )
    y = shared.select(
        "list",
        F.col("node").alias("y"),
        F.col("root").alias("root_y"),
        F.col("n").alias("n_y"),
        (F.col("n") - F.col("at")).alias("rest_y"),
        F.col("before").alias("before_y"),
        F.col("open").alias("open_y"),
    )
    # What two sets have in common from their first common member on is no more than what is
    # left of either from there.
    enough = F.least("rest_x", "rest_y") * (100 + percent) >= (F.col("n_x") + F.col("n_y")) * percent
    once = (F.col("root_y") == F.col("main")) | (F.col("x") < F.col("y"))
    new = F.coalesce(F.col("before_x") != F.col("before_y"), F.lit(True))
    met = x.filter("open_x").join(y, "list").union(x.filter("not open_x").join(y.filter("open_y"), "list"))
    pairs = met.filter((F.col("root_x") != F.col("root_y")) & once & new & enough)
    pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return pairs.union(among_crowds(differing, percent)).distinct()


def keep_one(documents: DataFrame, *, words: int = 5, percent: int = PERCENT) -> DataFrame:
    """All columns of one document of each group of near-duplicates, the one with the smallest id."""
    with scope() as own:
        found = near_duplicates(documents, words=words, percent=percent)
        dropped = own.keep(stored(found.filter("not kept").select("doc_id").distinct()))
    return documents.join(narrow(dropped), "doc_id", "left_anti").select(
        *documents.columns
    )
