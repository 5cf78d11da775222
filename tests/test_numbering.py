"""Consecutive numbering across partitions."""

from pyspark.sql import functions as F

from quarry.operators.numbering import consecutive_numbers


def test_ordered_numbers(spark):
    df = spark.range(0, 1000).select(F.col("id").alias("x"), (F.col("id") % 7).alias("hot")).repartition(5)
    got = consecutive_numbers(df, ["hot", "x"], "n").collect()
    pairs = sorted((r["hot"], r["x"], r["n"]) for r in got)
    assert [p[2] for p in pairs] == list(range(1000))


def test_current_order_numbers(spark):
    df = spark.createDataFrame([(f"k{i:03d}",) for i in range(50)], "k string").coalesce(3)
    got = consecutive_numbers(df, None, "n", start=1).collect()
    assert sorted(r["n"] for r in got) == list(range(1, 51))
