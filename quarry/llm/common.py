"""Helpers shared by the training-data operators: byte-level word splitting,
tables staged in the shared folder, global ranks and connected components.

Every iterative step cuts its lineage by writing Parquet under the folder that
``spark.checkpoint.dir`` names, so a lost executor costs one step at most.
"""

from __future__ import annotations

import sys
import types
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.session import table_path

# Byte tables: A-Z to a-z; for WORD_BYTES everything below 0x80 that is neither
# a letter nor a digit becomes a space, all bytes of non-ASCII letters stay.
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
                   for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z, as UTF-8."""
    return text.encode("utf-8", "replace").translate(WORD_BYTES).split() if text else []


def spaced_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, as UTF-8."""
    return text.encode("utf-8", "replace").translate(LOWER_BYTES).split() if text else []


def per_process(name: str) -> dict:
    """A dictionary that lives as long as the Python process.  Functions travel to
    the workers by value, so what their module holds would not outlast a task."""
    home = sys.modules.setdefault("_quarry_process", types.ModuleType("_quarry_process"))
    return vars(home).setdefault(name, {})


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return it reread."""
    spark = df.sparkSession
    path = table_path(spark, "llm", f"{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def global_rank(df: DataFrame, cols: list[str], name: str, rank: str = "rank") -> DataFrame:
    """Number the rows 0, 1, ... in the order of ``cols``.

    A range sort keeps partitions even whatever the keys; only one row count per
    partition reaches the driver.  The sorted rows are staged, so the numbers do
    not change when a task is run again.
    """
    spark = df.sparkSession
    placed = stage(df.repartitionByRange(*cols).sortWithinPartitions(*cols)
                   .withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33)
    sizes = sorted(placed.groupBy(part.alias("_part")).count().collect())
    firsts, total = [], 0
    for p, n in sizes:
        firsts.append((p, total))
        total += n
    starts = spark.createDataFrame(firsts, "_part long, _first long")
    return (placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
            .withColumn(rank, F.col("_first") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
            .drop("_part", "_first", "_at"))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star forest (node, smallest node) with the components of edges a-b."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[:len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while True:
        ru, rv = root[u], root[v]
        open_ = ru != rv
        if not open_.any():
            break
        lo, hi = np.minimum(ru, rv)[open_], np.maximum(ru, rv)[open_]
        np.minimum.at(root, hi, lo)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    inner = root != np.arange(len(nodes))
    return nodes[inner], nodes[root[inner]]


def _contract(batches):
    for batch in batches:
        a, b = forest(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["u", "v"])


def connected_components(edges: DataFrame, name: str) -> DataFrame:
    """Components of ``edges`` (two long columns): rows (node, root) for every node
    that is not its component's smallest; empty edges give no rows.

    Alternating large-star and small-star rounds; each batch of edges is first
    contracted to a star forest where it lies.  The minimum of a node's
    neighbours is staged before it is joined back, so that both sides of that
    join are plain shuffles and a hub with a large share of all edges is split.
    """
    u, v = edges.columns[:2]
    pair = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u != v")
    state = stage(pair.mapInArrow(_contract, "u long, v long").distinct(), f"{name}-edges")
    while True:
        spread = state.groupBy("u").agg(F.count(F.lit(1)).alias("n")).select("u", "n", F.lit(0).alias("hub"))
        spread = spread.unionByName(state.select(F.col("v").alias("u"), F.lit(0).cast("long").alias("n"),
                                                 F.lit(1).alias("hub")).distinct())
        loose = (spread.groupBy("u").agg(F.max("n").alias("n"), F.max("hub").alias("hub"))
                 .where("n > 1 OR (n = 1 AND hub = 1)"))
        if loose.isEmpty():
            return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}-low")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.distinct().mapInArrow(_contract, "u long, v long"), f"{name}-large")
        low = stage(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-low")
        small = (large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))))
        state = stage(small.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                      .distinct(), f"{name}-edges")


def component_ids(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """``nodes`` (node long, least any) with ``component_id``: the smallest
    ``least`` (nulls aside) over the nodes reachable through ``edges``."""
    roots = connected_components(edges, name)
    placed = stage(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), f"{name}-roots")
    least = stage(placed.groupBy("root").agg(F.min("least").alias("component_id")), f"{name}-least")
    return placed.join(least, "root").drop("root")


def field(df: DataFrame, col: str) -> T.DataType:
    return df.schema[col].dataType
