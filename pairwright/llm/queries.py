"""The numbered queries over the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.llm import (
    bpe,
    chat,
    codes,
    fingerprint,
    htmltext,
    langid,
    minhash,
    ownership,
    packing,
    rtree,
    sharding,
    suffix,
    vptree,
)

Query = Callable[[SparkSession, str], DataFrame]
SHARDS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op2_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return sharding.shard(documents, [1.0] * SHARDS, [1.0] * (SHARDS + 1))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return langid.predict(documents, langid.learned(documents))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=2)


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return htmltext.extract(pages, htmltext.learned(pages))


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digests(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-1, 0, "user", trap), (-1, 1, "assistant", trap)], conversations.schema
    )
    return chat.digests(chat.format_conversations(conversations.unionByName(extra)))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    changed = (F.col("label") + 1) % 10
    return rtree.hard_negatives(
        vectors,
        F.col("vec_id") % 50 == 0,
        relabelled=F.when(F.col("vec_id") % 7 == 0, changed).otherwise(F.col("label")),
    )


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ownership.find_secrets(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_fingerprint": op1_fingerprint,
    "op2_shard": op2_shard,
    "op3_language": op3_language,
    "op4_minhash": op4_minhash,
    "op5_nearest": op5_nearest,
    "op6_html": op6_html,
    "op7_pack": op7_pack,
    "op8_suffix": op8_suffix,
    "op9_bpe": op9_bpe,
    "op10_chat": op10_chat,
    "op11_negatives": op11_negatives,
    "op12_codes": op12_codes,
    "op13_secrets": op13_secrets,
}
