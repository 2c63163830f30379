"""Figures of a run: rows, model calls, rows per chunk."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pairwright.operators.embed import BATCH_ROWS


def chunk_number(position: Column | str, chunk_rows: int = BATCH_ROWS) -> Column:
    """Chunk, from 1, that a zero-based position falls in."""
    position = F.col(position) if isinstance(position, str) else position
    return (F.floor(position / F.lit(chunk_rows)) + 1).cast("int")


def chunk_count(rows: Column, chunk_rows: int = BATCH_ROWS) -> Column:
    """Chunks needed for a number of rows."""
    return F.ceil(rows / F.lit(chunk_rows)).cast("int")


def chunk_plan(items: DataFrame, position: str = "pos", chunk_rows: int = BATCH_ROWS) -> DataFrame:
    """Rows per chunk of a bulk payload, beside the number of chunks it needs.

    Counts per chunk are combined before the shuffle; the total comes from a scalar
    subquery, so no row is grouped twice.
    """
    total = items.select(chunk_count(F.count(F.lit(1)), chunk_rows)).scalar()
    return (
        items.groupBy(chunk_number(position, chunk_rows).alias("chunk"))
        .agg(F.count(F.lit(1)).alias("n_records"))
        .withColumn("n_chunks", total)
    )


def run_metrics(df: DataFrame, stage: str, chunk_rows: int = BATCH_ROWS) -> DataFrame:
    """One row: how many rows a stage has and how many model calls they make."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(stage).alias("stage"),
        "n_rows",
        chunk_count(F.col("n_rows"), chunk_rows).alias("n_chunks"),
    )


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``df`` counted while it is written: read ``observation.get`` after the action."""
    observation = Observation(name)
    return df.observe(observation, F.count(F.lit(1)).alias("n_rows")), observation


RUN = (
    "run string, stage string, n_rows long, n_rejected long, n_chunks long, n_texts long, "
    "n_calls long, at timestamp"
)


def append_run(spark: SparkSession, path: str, figures: dict) -> None:
    """Append the figures of one run, as a commit has them, to the table of runs: one small file."""
    row = (
        *[figures.get(name) for name in ("run", "stage", "rows", "rejected", "chunks", "texts", "calls")],
        datetime.fromisoformat(figures["at"]),
    )
    spark.createDataFrame([row], RUN).coalesce(1).write.mode("append").parquet(path)
