"""Secrets in texts, told from examples by how many own them in the whole corpus.

One scan of the texts finds the base spans by fixed patterns and further candidates: words that
look drawn at random and words that may repeat an assigned value without its name. Only digests of
candidates, some hundred bytes each, leave the scan; texts are never shuffled. Per digest the
distinct repositories and owners are counted over all documents (combined in the task first, so a
string that a third of the documents hold is a row per task and owner), and the counts go back to
the documents that hold it:

* widely copied: more than ``OWNERS`` owners. An example, a test key, a line of a licence.
* live: owned by no more than ``OWNERS``, and looks drawn at random: enough bits a character and no
  word that marks a placeholder. How many repositories of these owners repeat it does not matter.

Base spans stay whatever they are; ``n_live`` and ``n_copied`` say how many of them are live and how
many widely copied. Two kinds of span are added: ``repeat``, a live value that is assigned
somewhere in the corpus and stands here without a name, and ``owned``, a live random-looking word
that no base pattern finds.

A null text is empty, a null owner or repository is one like any other, rows that repeat a document
are rows of their own. Without candidates a document has its base spans, without those an empty list.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.llm.columns import text_slices
from pairwright.llm.groups import with_figures
from pairwright.scratch import stored

# Fixed patterns of the base rules and the least sizes of what they find.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ASSIGNED_SIZE = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # 18 characters or more
HEX = re.compile(r"[0-9a-f]{16,}")

KINDS = ("assign", "access", "hex", "repeat", "owned")
# Owners of a string that is still nobody else's.
OWNERS = 3
# Bits a character of a string drawn at random; decimal digits have 3.3, hexadecimal ones 4.
RANDOM_BITS = 2.8
# A random-looking word: its least size, and letters of both cases with digits.
WORD = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
EDGES = "+/_.=-"
OWNED_SIZE = 20
OWNED = re.compile(r"(?=[^a-z]*[a-z])(?=[^A-Z]*[A-Z])(?=[^0-9]*[0-9])[A-Za-z0-9+/_=-]+")
PLACEHOLDER = re.compile(r"example|sample|dummy|changeme|placeholder|your[_-]?|xxxx|0000", re.IGNORECASE)


def random_looking(value: str) -> bool:
    counts = Counter(value).values()
    bits = math.log2(len(value)) - sum(n * math.log2(n) for n in counts) / len(value)
    return bits >= RANDOM_BITS and not PLACEHOLDER.search(value)


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """``(start, kind, end, value)`` of the base patterns, in the order of start and kind."""
    found = [
        (m.start(), 0, m.end(), m[2])
        for m in ASSIGN.finditer(text)
        if m.end(2) - m.start(2) >= ASSIGNED_SIZE
    ]
    found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found, key=lambda span: span[:3])


def further_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Random-looking words clear of base spans; whether they are added depends on the corpus.

    Of kind ``owned`` they may be added by themselves, of kind ``repeat`` only if assigned elsewhere.
    """
    found, place, covered = [], 0, 0
    for m in WORD.finditer(text):
        while place < len(base) and base[place][0] < m.end():
            covered = max(covered, base[place][2])
            place += 1
        if m.start() < covered:
            continue
        value = m[0].strip(EDGES)
        if len(value) < ASSIGNED_SIZE or value.isalpha() or not random_looking(value):
            continue
        start = m.start() + m[0].index(value)
        long = len(value) >= OWNED_SIZE and OWNED.fullmatch(value)
        found.append((start, 4 if long else 3, start + len(value), value))
    return found


SPANS = "array<struct<start: int, kind: int, end: int>>"
CANDIDATES = "array<struct<start: int, kind: int, end: int, digest: binary, random: boolean>>"
SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
CANDIDATE = pa.struct([*SPAN, ("digest", pa.binary()), ("random", pa.bool_())])


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, "text"):
        spans, candidates = [], []
        for text in batch.column("text").to_pylist():
            text = text or ""
            base = base_spans(text)
            every = base + further_spans(text, base)
            spans.append([(start, kind, end) for start, kind, end, _ in base])
            candidates.append(
                [
                    (start, kind, end, hashlib.md5(value.encode(), usedforsecurity=False).digest(), random_looking(value))
                    for start, kind, end, value in ((*span[:3], span[3].strip(EDGES)) for span in every)
                    if value
                ]
            )
        yield pa.record_batch(
            [
                *[batch.column(name) for name in ("doc_id", "repository", "owner")],
                pa.array(spans, pa.list_(SPAN)),
                pa.array(candidates, pa.list_(CANDIDATE)),
            ],
            names=["doc_id", "repository", "owner", "base", "candidates"],
        )


def _listed(spans) -> Column:
    """Spans as text, by start and kind."""
    names = F.array(*[F.lit(name) for name in KINDS])
    return F.array_join(
        F.transform(
            F.array_sort(spans),
            lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def ownership(candidates: DataFrame) -> DataFrame:
    """``digest, repositories, owners, holders, assigned``: how many distinct repositories and
    owners hold a digest, how many rows do, and whether a base pattern found it with a name."""
    return candidates.groupBy("digest").agg(
        F.countDistinct(F.struct("repository")).alias("repositories"),
        F.countDistinct(F.struct("owner")).alias("owners"),
        F.count("*").alias("holders"),
        F.max(F.col("kind") == 0).alias("assigned"),
    )


def find_secrets(
    documents: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    repository: str = "doc_id",
    owner: str = "source",
    owners: int = OWNERS,
) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied`` of every row."""
    rows = documents.select(
        F.col(key).alias("doc_id"),
        F.col(text).alias("text"),
        F.col(repository).cast("string").alias("repository"),
        F.col(owner).cast("string").alias("owner"),
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, repository string, owner string, base {SPANS}, candidates {CANDIDATES}"
    # Numbers of rows are fixed once the table is written.
    scanned = stored(
        rows.mapInArrow(scan, schema).withColumn("row", F.monotonically_increasing_id())
    )
    candidates = scanned.select("row", "repository", "owner", F.inline("candidates"))
    figures = stored(ownership(candidates))
    known = with_figures(
        candidates.select("row", "start", "kind", "end", "digest", "random"), figures, "digest", "holders"
    )
    copied = F.col("owners") > owners
    live = ~copied & F.col("random")
    base = F.col("kind") <= 2
    added = live & ((F.col("kind") == 4) | ((F.col("kind") == 3) & F.col("assigned")))
    # A repeat of an assigned value is one, whatever else it looks like.
    shown = F.when((F.col("kind") == 4) & F.col("assigned"), 3).otherwise(F.col("kind")).alias("kind")
    judged = known.groupBy("row").agg(
        F.collect_list(F.when(added, F.struct("start", shown, "end"))).alias("added"),
        F.count_if(base & live).alias("n_live"),
        F.count_if(base & copied).alias("n_copied"),
    )
    none = scanned.filter(F.size("candidates") == 0).select(
        "doc_id",
        "base",
        F.array().cast(SPANS).alias("added"),
        F.lit(0).cast("long").alias("n_live"),
        F.lit(0).cast("long").alias("n_copied"),
    )
    some = (
        scanned.filter(F.size("candidates") > 0)
        .select("row", "doc_id", "base")
        .join(judged, "row")
        .select("doc_id", "base", F.col("added").cast(SPANS).alias("added"), "n_live", "n_copied")
    )

    def number(of: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == of)).cast("long")

    return none.union(some).select(
        "doc_id",
        number(0).alias("n_assign"),
        number(1).alias("n_access"),
        number(2).alias("n_hex"),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.concat("base", "added")).alias("spans"),
        "n_live",
        "n_copied",
    )
