"""Streaming query answering: query files arriving in a folder are answered
against a persisted index, one micro-batch at a time.

Ranking uses windows and Arrow scoring that Structured Streaming does not
run on an unbounded stream directly, so each micro-batch is handed to the
batch query plan with ``foreachBatch`` and its hits are appended to a
Parquet table.  The sink writes are idempotent per batch id (one folder per
batch, overwritten on replay), which keeps replays after a failure exact.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.plans import jobs

QUERY_SCHEMA = "item_id long, text string"


def start_query_stream(spark: SparkSession, index_dir: str, source_dir: str, out_dir: str, checkpoint: str,
                       schema: str = QUERY_SCHEMA, id_col: str = "item_id", glob: str = "*.parquet",
                       k: int = 10, methods=("spider", "bm25", "gmm"), available_now: bool = True) -> StreamingQuery:
    index = jobs.open_index(spark, index_dir)

    def answer(batch: DataFrame, batch_id: int) -> None:
        queries = batch.select(F.col(id_col).alias("query_id"), "text")
        if queries.isEmpty():
            return
        out = jobs.query_index(index, queries, k=k, methods=methods)
        hits = out["hits"].join(out["confidence"], "query_id").withColumn("batch_id", F.lit(batch_id))
        hits.write.mode("overwrite").parquet(os.path.join(out_dir, f"batch={batch_id}"))

    stream = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(source_dir)
    writer = stream.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
