"""Reading the input tables (Parquet); column pruning and filter pushdown are
left to Catalyst.

A scan yields one task per Parquet row group, which is plenty on a cluster.  A
caller whose table is a single small file can ask for its rows to be dealt out
over the cores, by the session setting ``quarry.spread`` = true; the default
adds no exchange.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    if spark.conf.get("quarry.spread", "false") == "true":
        cores = spark.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() < cores:
            return df.repartition(cores)
    return df
