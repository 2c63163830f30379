"""From raw documents to packed token windows: the pipeline over `documents`.

Every stage takes the documents its predecessor kept and returns them with the same columns;
the last returns the pieces of token windows. `run` writes each stage's result to the shared
scratch folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairwright.llm import langid, minhash, packing, queries, suffix
from pairwright.scratch import stored
from pairwright.shipping import ship

# Word shingles and similarity of near-duplicates.
SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 80
# A passage that repeats goes if it has so many words: over 50.
PASSAGE_WORDS = 51
# A Python worker gets texts in batches of about so many bytes, unless the session sets a size.
# Beside its heap an executor holds a few of them for each core, and so do its Python workers.
BATCH_SIZE = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH = "1m"


def prepared(spark: SparkSession) -> bool:
    """Workers have this package and get small batches; whether that size was set here."""
    ship(spark)
    own = spark.conf.get(BATCH_SIZE, None) is None
    if own:
        spark.conf.set(BATCH_SIZE, BATCH)
    return own


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a text in one of the languages learned from the labelled ones."""
    prepared(spark)
    return langid.keep_known(docs, langid.learned(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    prepared(spark)
    return minhash.keep_one(docs, words=SHINGLE_WORDS, percent=SIMILARITY_PERCENT)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of over 50 words that occur more than once, nor the
    repeated strings of `suffix.LENGTH` bytes, in whatever few words or none they are written."""
    prepared(spark)
    return suffix.without_repeats(docs, words=PASSAGE_WORDS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the token windows that hold all documents."""
    prepared(spark)
    return packing.pack(docs, queries.tokenizer_path())


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_each),
    ("repeats", unrepeated),
    ("packing", packed),
]

# A network, hash-based candidates and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    own = prepared(spark)
    try:
        for _, stage in STAGES:
            docs = stored(stage(spark, docs, sf_dir))
    finally:
        if own:
            spark.conf.unset(BATCH_SIZE)
    return docs
