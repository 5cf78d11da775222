"""Corpus reports: chunk statistics and type distribution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as tx


def corpus_stats(chunks: DataFrame, text_col: str = "text") -> DataFrame:
    """One row — chunks, characters, words, average/min/max chunk size — or no
    row for an empty input.  Overlapping characters are counted once per chunk
    they appear in (``chunk_characters``)."""
    t = F.col(text_col)
    agg = chunks.agg(
        F.count(F.lit(1)).cast("long").alias("total_chunks"),
        F.sum(F.length(t)).cast("long").alias("chunk_characters"),
        F.sum(tx.word_count(t)).cast("long").alias("total_words"),
        F.avg(F.length(t)).alias("average_chunk_size"),
        F.min(F.length(t)).cast("long").alias("min_chunk_size"),
        F.max(F.length(t)).cast("long").alias("max_chunk_size"),
    )
    return agg.where(F.col("total_chunks") > 0)


def type_distribution(df: DataFrame, type_col: str = "file_type") -> DataFrame:
    """(file_type, n) with missing types reported as ``unknown``."""
    return df.groupBy(F.coalesce(F.col(type_col), F.lit("unknown")).alias("file_type")).agg(
        F.count(F.lit(1)).cast("long").alias("n"))
