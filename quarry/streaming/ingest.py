"""Streaming ingestion: new document files become chunk rows incrementally.

Every stage of chunking and annotation is a stateless per-row projection, so
the same plan runs unchanged on ``readStream``.  Progress and exactly-once
output are the file sink's business (its checkpoint folder must be on shared
storage on a cluster).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.operators import annotate, chunking, dense

DOCUMENT_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def chunk_stream(stream: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Annotated, normalised fixed-size chunks with content ids and vectors."""
    ann = annotate.annotate_documents(stream, text_col)
    keep = [c for c in ann.columns if c != text_col]
    ch = chunking.chunk_fixed(ann, text_col=text_col, keep=keep)
    ch = annotate.with_content_ids(ch, metadata_cols=[id_col, "chunk_index", "chunk_size", "chunk_start_char",
                                                      "chunk_end_char"])
    return dense.hash_embed(ch).withColumn("ingested_at", F.current_timestamp())


def start_ingest(spark: SparkSession, source_dir: str, out_dir: str, checkpoint: str,
                 schema: str = DOCUMENT_SCHEMA, glob: str = "*.parquet", available_now: bool = True,
                 max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Watch ``source_dir`` for Parquet document files and append chunks to ``out_dir``."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    chunks = chunk_stream(reader.parquet(source_dir))
    writer = (chunks.writeStream.format("parquet").option("path", out_dir)
              .option("checkpointLocation", checkpoint).outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
