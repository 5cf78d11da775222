"""Consecutive row numbers without a single-partition window and without
moving rows through Python."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import materialize


def consecutive_numbers(df: DataFrame, order_cols: list[str] | None = None, out_col: str = "_g",
                        start: int = 0) -> DataFrame:
    """Add ``start``-based consecutive positions.

    With ``order_cols`` the frame is range-partitioned and sorted by them
    (Spark samples the bounds, so a hot value is split across tasks);
    without, the current partition order is kept.  The positions are
    written once to the shared folder, so a lost executor cannot change them; per-partition row
    counts — one small row per partition — become offsets, and
    ``monotonically_increasing_id`` gives the position inside a partition.
    """
    base = df
    if order_cols:
        base = df.repartitionByRange(*order_cols).sortWithinPartitions(*order_cols)
    srt = materialize(base.withColumn("_pid", F.spark_partition_id())
                      .withColumn("_local", F.monotonically_increasing_id() - F.shiftleft(
                          F.spark_partition_id().cast("long"), 33)))
    counts = srt.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_off"))
    return (srt.join(F.broadcast(offsets), "_pid")  # one row per partition
            .select(*df.columns, (F.col("_off") + F.col("_local") + F.lit(start)).alias(out_col)))
