"""I-Match document fingerprints over randomised lexicons, in DataFrame functions only.

The lexicon holds the terms whose inverse document frequency lies in a band: terms of more than
``max_share`` of the documents say too little, terms of fewer than ``min_share`` are typing
errors and names. The band reaches up to half of the documents, so the words of near copies that
are a third of the table stay in it. A document has at most its length in terms, so the lexicon cannot hold more
than the mean number of distinct terms divided by ``min_share``, however large the corpus is,
and is broadcast.

A fingerprint hashes the sorted distinct lexicon terms of a document: all of them, and those in
each of several randomised lexicon subsets. Subsets come in levels, each with half the terms of
the one before; a document of m terms uses the two levels at which a half to one and a quarter
to a half of its terms are left in a subset on average. A change of a few terms leaves most such subsets alone,
for short and long texts alike.

The likeness of two fingerprints is the share of equal hashes among the subsets, at levels both
use, that are not empty in both; it is 1 for equal fingerprints and 0 without a common level.

A document without a term in the lexicon is fingerprinted by all its terms in the same way, and
one without terms by the hash of nothing. Null texts are empty. Rows of one id are each fingerprinted; the
next document is the first in the order of text of the next larger id. Terms are the words
between blanks and line breaks in lower case, compared by 58-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwright.scratch import stored

MIN_SHARE = 1 / 2000
MAX_SHARE = 1 / 2
SUBSETS = 16
# Tables up to this size are broadcast, larger ones joined by a shuffle.
BROADCAST_BYTES = 32 << 20
# The level of the fingerprint of documents without any term.
ALL_TERMS = -1
# A term's hash leaves its lowest six bits free: for marks, and for the term's last level.
FREE = 63
IN_TEXT, IN_EDITED = 1, 2
AGGREGATION = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"


def blanked(text: Column) -> Column:
    """A text with plain blanks between its words."""
    for other in "\n\r\t":
        text = F.replace(text, F.lit(other), F.lit(" "))
    return text


def term(word: str) -> Column:
    return _cleared(F.xxhash64(word))


def _cleared(value: Column) -> Column:
    return value.bitwiseAND(F.lit(~FREE).cast("long"))


def lexicon(
    documents: DataFrame, text: str, min_share: float = MIN_SHARE, max_share: float = MAX_SHARE
) -> DataFrame:
    """``term, value`` of every term in the band; the value carries the deepest level at which
    any of the subsets still has the term."""
    n = documents.count()
    words = F.array_distinct(F.split(blanked(F.lower(F.col(text))), " "))
    counts = documents.select(F.explode(words).alias("word")).filter("word <> ''")
    counts = counts.groupBy(term("word").alias("term")).count()
    band = counts.filter(
        (F.col("count") >= min_share * n) & (F.col("count") <= max(1.0, max_share * n))
    )
    drawn = [F.xxhash64("term", F.lit(k)) for k in range(SUBSETS)]
    deepest = F.greatest(*[F.bit_count(d.bitwiseAND(-d) - 1) for d in drawn])
    value = F.col("term").bitwiseOR(F.least(deepest, F.lit(FREE)).cast("long"))
    return stored(band.select("term", value.alias("value")))


def followers(documents: DataFrame, key: str, text: str) -> DataFrame:
    """``prev, next, need`` for every id: the next larger id, the smallest after the largest,
    and how many characters of its text an edit can take.

    Ids are sorted in ranges; only the first id of every range meets the others in one task.
    """
    need = F.floor(F.max(F.length(F.coalesce(F.col(text), F.lit("")))) / 4).cast("long")
    ids = documents.groupBy(F.col(key).alias("prev")).agg(need.alias("need"))
    known = ids.filter("prev is not null").repartitionByRange("prev")
    known = stored(known.withColumn("part", F.spark_partition_id()))
    firsts = known.groupBy("part").agg(F.min("prev").alias("first"))
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.select(
        "part",
        F.coalesce(
            F.lead("first").over(Window.orderBy("part")), F.min("first").over(every)
        ).alias("other"),
        F.min("first").over(every).alias("smallest"),
    )
    within = F.lead("prev").over(Window.partitionBy("part").orderBy("prev"))
    known = known.withColumn("later", within).join(F.broadcast(firsts), "part")
    found = known.select("prev", F.coalesce("later", "other").alias("next"), "need")
    # A row without an id stands before all others and is nobody's next.
    none = ids.filter("prev is null").join(F.broadcast(firsts.select("smallest").limit(1)))
    return stored(found.union(none.select("prev", F.col("smallest").alias("next"), "need")))


def _place(column: str) -> Column:
    """An id that is never null, to join by."""
    return F.coalesce(F.col(column).cast("string"), F.lit("null"))


def small(rows: DataFrame, row_bytes: int) -> DataFrame:
    return F.broadcast(rows) if rows.count() * row_bytes <= BROADCAST_BYTES else rows


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _print(values: Column, every: Column) -> tuple[Column, Column, Column]:
    """Level, hash of all terms (``every`` where there are none) and subset hashes; a hash of 0
    stands for an empty subset."""
    count = F.size(values)
    level = F.when(count == 0, ALL_TERMS).otherwise(
        F.floor(F.log2(F.greatest(count, F.lit(1)).cast("double"))).cast("int") + 1
    )
    free = F.lit(FREE).cast("long")
    active = _bound(
        F.struct(values.alias("v"), level.alias("l")),
        lambda p: F.struct(
            F.filter(p["v"], lambda v: v.bitwiseAND(free) >= p["l"]).alias("a"), p["l"].alias("l")
        ),
    )

    def at(p: Column, deeper: int) -> Column:
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), p["l"] + deeper) - 1
        return F.array_repeat(F.struct(p["a"].alias("a"), mask.alias("m")), SUBSETS)

    def subset(p: Column, n: Column) -> Column:
        return F.xxhash64(
            F.filter(
                p["a"], lambda v: F.xxhash64(_cleared(v), n % SUBSETS).bitwiseAND(p["m"]) == 0
            )
        )

    nothing = F.xxhash64(F.array().cast("array<bigint>"))
    hashes = _bound(active, lambda p: F.transform(F.concat(at(p, 0), at(p, 1)), subset))
    hashes = F.transform(
        hashes, lambda h: F.when(h == nothing, 0).otherwise(F.hash(h).bitwiseOR(1)).cast("int")
    )
    hashes = F.when(count == 0, F.array().cast("array<int>")).otherwise(hashes)
    return level, F.when(count == 0, every).otherwise(F.xxhash64(values)), hashes


def likeness(left: str, right: str) -> Column:
    """The share of equal hashes at the levels that both fingerprints have."""
    a, b = F.col(f"{left}.hashes"), F.col(f"{right}.hashes")
    apart = F.col(f"{right}.level") - F.col(f"{left}.level")
    upper, lower = (F.lit(SUBSETS + 1), F.lit(SUBSETS)), (F.lit(1), F.lit(SUBSETS))
    pairs = (
        F.when(apart == 0, F.arrays_zip(a.alias("a"), b.alias("b")))
        .when(apart == 1, F.arrays_zip(F.slice(a, *upper).alias("a"), F.slice(b, *lower).alias("b")))
        .when(apart == -1, F.arrays_zip(F.slice(a, *lower).alias("a"), F.slice(b, *upper).alias("b")))
    )
    filled = F.filter(pairs, lambda p: (p["a"] != 0) | (p["b"] != 0))
    equal = F.filter(filled, lambda p: p["a"] == p["b"])
    same = (apart == 0) & (F.col(f"{left}.whole") == F.col(f"{right}.whole"))
    return (
        F.when(same, 1.0)
        .when(F.coalesce(F.size(filled), F.lit(0)) <= 0, 0.0)
        .otherwise(F.size(equal) / F.size(filled))
    )


def written(part: str) -> Column:
    """A fingerprint as text: level, hash of all terms, subset hashes."""
    return F.concat_ws(
        ":",
        F.col(f"{part}.level").cast("string"),
        F.lower(F.hex(f"{part}.whole")),
        F.concat_ws(",", F.transform(f"{part}.hashes", lambda h: F.lower(F.hex(h)))),
    )


def fingerprints(documents: DataFrame, *, key: str = "doc_id", text: str = "text", **band) -> DataFrame:
    """``key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    The edited text of a document is its own with the last quarter replaced by the beginning of
    the next document.
    """
    spark = documents.sparkSession
    slim = documents.select(
        F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("content")
    )
    known = lexicon(slim, "content", **band)
    follow = followers(slim, "id", "content")
    needs = follow.select(F.col("next").alias("id"), "prev", "need")
    heads = (
        slim.join(small(needs, 32), "id")
        .select(
            _place("prev").alias("place"),
            F.substring("content", F.lit(1), F.col("need").cast("int")).alias("head"),
        )
        .groupBy("place")
        .agg(F.min("head").alias("head"))
    )
    both = slim.withColumn("place", _place("id")).join(heads, "place", "left")
    own, head = F.col("content"), F.coalesce("head", F.lit(""))
    chars = F.length(own)
    quarter = F.floor(chars / 4).cast("int")
    taken = F.substring(head, F.lit(1), quarter)
    both = both.select(
        "place",
        "id",
        F.monotonically_increasing_id().alias("row"),
        chars.cast("long").alias("n_chars"),
        F.unhex(F.sha2(F.concat(F.substring(own, F.lit(1), chars - quarter), taken), 256)).alias("sha"),
        F.substring(blanked(own), F.lit(1), chars - quarter).alias("front"),
        F.substring(blanked(own), chars - quarter + 1, quarter).alias("back"),
        blanked(taken).alias("taken"),
    )
    # The words before the last blank of the front are in both texts; what follows it goes on
    # into the old and into the new back.
    cut = F.substring_index("front", " ", -1)
    front = F.split("front", " ")
    both = both.select(
        "place",
        "id",
        "row",
        "n_chars",
        "sha",
        front.alias("front"),
        F.split(F.concat(cut, F.col("back")), " ").alias("back"),
        F.split(F.concat(cut, F.col("taken")), " ").alias("taken"),
    )
    common = F.size("front") - 1
    rows = both.select(
        "place",
        "id",
        "row",
        "n_chars",
        "sha",
        common.alias("common"),
        (common + F.size("back")).alias("own_end"),
        F.posexplode(
            F.concat(F.slice("front", F.lit(1), common), F.col("back"), F.col("taken"))
        ).alias("nth", "word"),
    )
    # Lower case may be longer or shorter than the text, so it comes after all cutting.
    rows = rows.withColumn("word", F.lower("word"))
    mark = (
        F.when(F.col("nth") < F.col("common"), IN_TEXT | IN_EDITED)
        .when(F.col("nth") < F.col("own_end"), IN_TEXT)
        .otherwise(IN_EDITED)
    )
    rows = rows.withColumn("mark", mark).withColumn("term", term("word"))
    rows = rows.join(small(known, 64), "term", "left")

    def inside(part: int) -> Column:
        return (F.col("mark").bitwiseAND(F.lit(part)) != 0) & (F.col("word") != "")

    def values(part: int) -> Column:
        return F.sort_array(F.collect_set(F.when(inside(part), F.col("value"))))

    def beyond(part: int) -> Column:
        # Terms outside the lexicon, for texts that have no other; any subset may hold them.
        out = inside(part) & F.col("value").isNull()
        return F.sort_array(
            F.collect_set(F.when(out, F.col("term").bitwiseOR(F.lit(FREE).cast("long"))))
        )

    grouped = rows.groupBy("place", "id", "row", "n_chars", "sha").agg(
        values(IN_TEXT).alias("values"),
        values(IN_EDITED).alias("edited_values"),
        beyond(IN_TEXT).alias("beyond"),
        beyond(IN_EDITED).alias("edited_beyond"),
    )
    for own, other in (("values", "beyond"), ("edited_values", "edited_beyond")):
        grouped = grouped.withColumn(own, F.when(F.size(own) == 0, F.col(other)).otherwise(F.col(own)))
    nothing = F.xxhash64(F.array().cast("array<bigint>"))
    names = ("level", "whole", "hashes")
    prints = grouped.select(
        "place",
        "id",
        "n_chars",
        "sha",
        F.struct(*[c.alias(n) for c, n in zip(_print(F.col("values"), nothing), names)]).alias("own"),
        F.struct(
            *[c.alias(n) for c, n in zip(_print(F.col("edited_values"), nothing), names)]
        ).alias("edited"),
    )
    # Documents of a task are grouped as they come; a task's lists are bounded by its texts.
    before = spark.conf.get(AGGREGATION)
    spark.conf.set(AGGREGATION, str(2**30))
    try:
        prints = stored(prints)
    finally:
        spark.conf.set(AGGREGATION, before)
    others = prints.groupBy(F.col("place").alias("next_place")).agg(F.min("own").alias("other"))
    links = follow.select(
        _place("prev").alias("place"), _place("next").alias("next_place")
    )
    joined = prints.join(small(links, 64), "place", "left").join(others, "next_place", "left")
    return joined.select(
        F.col("id").alias(key),
        "n_chars",
        F.lower(F.hex("sha")).alias("edited_sha256"),
        written("own").alias("fingerprint"),
        written("edited").alias("edited_fingerprint"),
        likeness("own", "edited").alias("near_edited"),
        F.when(F.col("other").isNull(), 0.0).otherwise(likeness("own", "other")).alias("near_next"),
    )
