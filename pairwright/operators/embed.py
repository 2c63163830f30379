"""Texts to unit vectors, in batches, with the model as a plug.

An ``Embedder`` wraps a function that loads a model and returns ``predict(texts) ->
matrix``. A Python worker loads it once and keeps it over tasks; Spark hands it texts through
Arrow. The model goes where the data is: no chunk loop, nothing through the driver.

A model call gets no more than ``batch_rows`` texts and, unless one text alone is longer, no more
than ``batch_chars`` characters once all are padded to the longest. Equal texts of an Arrow batch are
embedded once, and texts of like length go together, so one very long text does not make the
batch around it as wide. ``embed_once`` embeds each distinct text of a whole table once.

``hashing_embedder`` needs no model. It is lexical, not semantic: texts are near each
other when they share words. It makes whole pipelines reproducible and checkable.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.accumulators import Accumulator
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.errors import EmbeddingError
from pairwright.functions import prefixed
from pairwright.functions.wording import DOCUMENT_PREFIX, QUERY_PREFIX
from pairwright.operators.joins import join_counted
from pairwright.schemas import VECTOR
from pairwright.scratch import stored

# Size of a stored vector and rows per model call.
DIMENSION = 768
BATCH_ROWS = 128
# Characters of a model call, padding to its longest text included.
BATCH_CHARS = 1 << 18
# Vectors that a worker sends on at a time.
SENT_ROWS = 1024
# Characters of the texts that `hashing_embedder` splits into words at a time.
WORD_CHARS = 1 << 20
# Models that a worker keeps.
KEPT_MODELS = 2

PREFIXES = {"document": DOCUMENT_PREFIX, "query": QUERY_PREFIX}

# Whatever is not a letter, digit or mark separates words (RE2 syntax).
WORD_BREAKS = r"[^\p{L}\p{N}\p{M}]+"

Predict = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Tally:
    """Rows with a text of a run, the texts in its model calls and these calls, added up by the
    tasks; a task that is repeated counts again."""

    rows: Accumulator
    texts: Accumulator
    calls: Accumulator

    @staticmethod
    def of(spark: SparkSession) -> Tally:
        return Tally(*[spark.sparkContext.accumulator(0) for _ in range(3)])


@dataclass(frozen=True)
class Embedder:
    """``load()`` runs once per Python worker and returns the batch function."""

    load: Callable[[], Predict]
    dimension: int = DIMENSION
    batch_rows: int = BATCH_ROWS
    batch_chars: int = BATCH_CHARS
    name: str = field(default_factory=lambda: uuid.uuid4().hex)
    tally: Tally | None = None


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows divided by their norms in double, as 32-bit floats; zero rows stay zero."""
    matrix = matrix.astype(np.float64)
    norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    return (matrix / np.where(norms > 0, norms, 1.0)[:, None]).astype(np.float32)


def text_batches(lengths: np.ndarray, rows: int, chars: int) -> Iterator[np.ndarray]:
    """Positions of texts, in batches of like length: at most ``rows``, and as many as fit
    ``chars`` when all are as long as the longest; a longer text is alone."""
    order = np.argsort(lengths, kind="stable")
    first = 0
    while first < len(order):
        widths = lengths[order[first : first + rows]]
        padded = widths * np.arange(1, len(widths) + 1)
        n = max(1, int(np.searchsorted(padded, chars, side="right")))
        yield order[first : first + n]
        first += n


_models: OrderedDict[str, Predict] = OrderedDict()
# The last text of a batch and its vector: a run of equal texts may go on in the next batch.
_last: dict[str, tuple[str, np.ndarray]] = {}


def _model(embedder: Embedder) -> Predict:
    """The embedder's function, loaded at its first use in this worker."""
    if embedder.name not in _models:
        try:
            loaded = embedder.load()
        except Exception as error:
            raise EmbeddingError(f"EmbeddingError: model did not load: {error}") from error
        _models[embedder.name] = loaded
        while len(_models) > KEPT_MODELS:
            _last.pop(_models.popitem(last=False)[0], None)
    _models.move_to_end(embedder.name)
    return _models[embedder.name]


def _distinct_vectors(embedder: Embedder, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the distinct texts and, for each text, the row of its own."""
    predict = _model(embedder)
    coded = pc.fill_null(texts, "").dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    distinct = coded.dictionary
    lengths = pc.utf8_length(distinct).to_numpy(zero_copy_only=False)
    vectors = np.empty((len(distinct), embedder.dimension), np.float32)
    known = 0
    if len(distinct) and embedder.name in _last and _last[embedder.name][0] == distinct[0].as_py():
        vectors[0], known = _last[embedder.name][1], 1
    for batch in text_batches(lengths[known:], embedder.batch_rows, embedder.batch_chars):
        batch = batch + known
        try:
            called = np.array(distinct.take(pa.array(batch)).to_pylist(), dtype=object)
            made = np.asarray(predict(called))
        except Exception as error:
            raise EmbeddingError(f"EmbeddingError: model failed: {error}") from error
        if made.shape != (len(batch), embedder.dimension):
            raise EmbeddingError(
                f"EmbeddingError: model returned shape {made.shape}, "
                f"expected ({len(batch)}, {embedder.dimension})"
            )
        vectors[batch] = unit_rows(made)
        if embedder.tally:
            embedder.tally.calls.add(1)
            embedder.tally.texts.add(len(batch))
    if embedder.tally:
        embedder.tally.rows.add(len(texts) - texts.null_count)
    codes = coded.indices.to_numpy()
    if len(codes):
        _last[embedder.name] = distinct[int(codes[-1])].as_py(), vectors[codes[-1]].copy()
    return vectors, codes


def unit_vectors(embedder: Embedder, texts: pa.Array) -> np.ndarray:
    """Unit vectors of texts in their order, each distinct text embedded once; used in workers."""
    vectors, codes = _distinct_vectors(embedder, texts)
    return vectors[codes]


def unit_parts(embedder: Embedder, texts: pa.Array) -> Iterator[np.ndarray]:
    """The same in parts of up to ``SENT_ROWS`` rows: of a whole batch a worker holds one vector for
    each distinct text, and what was in use for it is given back."""
    vectors, codes = _distinct_vectors(embedder, texts)
    for start in range(0, len(codes), SENT_ROWS):
        yield vectors[codes[start : start + SENT_ROWS]]
    pa.default_memory_pool().release_unused()


def list_array(matrix: np.ndarray) -> pa.Array:
    """Rows of a matrix as an Arrow list column."""
    ends = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(matrix).ravel()))


def prefixed_embedding(text: Column | str, embedder: Embedder) -> Column:
    """Unit vector of a text that has its task prefix already and is never null."""

    @F.arrow_udf(returnType=VECTOR)
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for made in unit_parts(embedder, texts):
                yield list_array(made)

    return predict(text)


def embedding(text: Column | str, embedder: Embedder, kind: str) -> Column:
    """Unit vector of a text with the task prefix of ``kind``; null for a null text."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(text.isNotNull(), prefixed_embedding(prefixed(PREFIXES[kind], text), embedder))


def enough_splits(df: DataFrame) -> bool:
    """The rows come from a scan with as many splits as there are cores, or more.

    After a shuffle their number is known only when it has run, so that counts as too few.
    """
    plan = df._jdf.queryExecution().executedPlan()
    if "Exchange" in plan.toString():
        return False
    return df.rdd.getNumPartitions() >= df.sparkSession.sparkContext.defaultParallelism


def embed(
    df: DataFrame,
    text: str,
    embedder: Embedder,
    kind: str = "document",
    output: str = "vector",
    spread_by: str | None = None,
) -> DataFrame:
    """``df`` with the vector of its text column.

    ``spread_by`` names a key to spread the rows by first. A model call takes milliseconds,
    moving its text microseconds, so this pays wherever the input has fewer splits than
    the cluster has cores, such as one small file. A plain scan of enough splits stays as it is.
    """
    if spread_by and not enough_splits(df):
        df = df.repartition(spread_by)
    return df.withColumn(output, embedding(text, embedder, kind))


def embed_once(
    df: DataFrame,
    text: str,
    embedder: Embedder,
    kind: str = "document",
    output: str = "vector",
) -> DataFrame:
    """``embed`` with each distinct text of the table embedded once.

    A table of the distinct texts is embedded and written, and vectors are joined back by the
    text's digest. Equal texts are made one before they are shuffled, and the vectors of the most
    frequent texts are broadcast, so one text may have any share of the rows. It pays where a
    model call costs more than moving a vector to each row.
    """
    keyed = df.withColumn("_text", F.md5(F.coalesce(F.col(text), F.lit(""))))
    there = keyed.where(F.col(text).isNotNull())
    texts = there.groupBy("_text", F.col(text).alias("_of")).agg(F.count("*").alias("_rows"))
    made = embed(texts, "_of", embedder, kind, output, spread_by="_text")
    made = stored(made.select("_text", output, "_rows"))
    found = join_counted(there, made, "_text", "_rows", 4 * embedder.dimension + 64).drop("_rows")
    none = keyed.where(F.col(text).isNull()).withColumn(output, F.lit(None).cast(VECTOR))
    return found.unionByName(none).drop("_text")


def _digests(words: pa.Array) -> np.ndarray:
    """MD5 of each word as a row of bytes, read from the words' Arrow buffers."""
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int64, len(words) + 1, words.offset * 8).tolist()
    letters = memoryview(data) if data is not None else memoryview(b"")
    md5 = hashlib.md5
    digests = [
        md5(letters[start:end], usedforsecurity=False).digest()
        for start, end in zip(ends, ends[1:])
    ]
    return np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 16)


def hashing_embedder(
    dimension: int = DIMENSION, batch_rows: int = 1024, batch_chars: int = 1 << 24
) -> Embedder:
    """Words counted into ``dimension`` signed buckets by their MD5 hash.

    The first four bytes of a word's hash choose its bucket, the fifth its sign.
    """

    def load() -> Predict:
        def counted(texts: np.ndarray) -> np.ndarray:
            lowered = pc.utf8_lower(pa.array(texts, pa.large_string()))
            words = pc.split_pattern_regex(lowered, WORD_BREAKS)
            row = np.repeat(np.arange(len(texts)), pc.list_value_length(words).to_numpy())
            coded = words.flatten().dictionary_encode()
            code = coded.indices.to_numpy()
            digests = _digests(coded.dictionary)
            bucket = digests[:, :4].copy().view(">u4")[:, 0].astype(np.int64) % dimension
            sign = np.where(digests[:, 4] < 128, 1.0, -1.0)
            # Breaks at the ends of a text leave empty words.
            sign[pc.equal(coded.dictionary, "").to_numpy(zero_copy_only=False)] = 0.0
            counts = np.bincount(
                row * dimension + bucket[code],
                weights=sign[code],
                minlength=len(texts) * dimension,
            )
            return counts.reshape(len(texts), dimension)

        def predict(texts: np.ndarray) -> np.ndarray:
            # Words take many times the room of their texts.
            counts = np.empty((len(texts), dimension))
            parts = np.cumsum([len(text) for text in texts]) // WORD_CHARS
            for own in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(parts)) + 1):
                counts[own] = counted(texts[own])
            return counts

        return predict

    return Embedder(load, dimension, batch_rows, batch_chars, f"hashing-{dimension}")


def sentence_transformer_embedder(
    model: str,
    dimension: int = DIMENSION,
    device: str | None = None,
    batch_rows: int = BATCH_ROWS,
    batch_chars: int = BATCH_CHARS,
    revision: str | None = None,
    trust_remote_code: bool = False,
) -> Embedder:
    """A sentence-transformers model by name or path; the library must be on the workers.

    Without a ``device`` the library takes a GPU where there is one. Models that bring code of
    their own need ``trust_remote_code``; name their ``revision`` then.
    """

    def load() -> Predict:
        from sentence_transformers import SentenceTransformer

        # Older releases of the library know no revision.
        pinned = {} if revision is None else {"revision": revision}
        encoder = SentenceTransformer(
            model, device=device, trust_remote_code=trust_remote_code, **pinned
        )
        return lambda texts: encoder.encode(list(texts), normalize_embeddings=True)

    return Embedder(load, dimension, batch_rows, batch_chars)
