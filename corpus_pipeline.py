"""A training-corpus pipeline of five operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written as Parquet and read again as the next stage's documents.  All stages but
the last return the columns of ``documents``; the last returns the packed pieces.

Nulls, empty texts, repeated rows and empty tables have the results that the
operators' modules state.  Rows are told apart by doc_id and a hash of the text;
of fully repeated rows the near-duplicate stage leaves one.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import cnn_quality, decontaminate, line_dedup, packing, simhash
from quarry.llm.common import stage
from quarry.llm.queries import table, tokenizer_path


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows as (key, text, row): the key orders by doc_id and tells texts apart;
    the row travels as one struct, so its column names cannot clash."""
    return docs.select(F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h")).alias("key"), F.col("text").alias("text"),
                       F.struct("*").alias("row"))


def _rows(keyed: DataFrame, columns: list[str]) -> DataFrame:
    return keyed.select(*[F.col("row").getField(c).alias(c) for c in columns])


def _same(left: str, right: str):
    """Whether two key columns are equal, a null doc_id included."""
    return F.col(f"{left}.id").eqNullSafe(F.col(f"{right}.id")) & (F.col(f"{left}.h") == F.col(f"{right}.h"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return cnn_quality.keep_good(docs, cnn_quality.fit(docs, table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their source's boilerplate lines; n_chars follows the text.
    Copies of a text count once, as they are the near-duplicate stage's to remove."""
    left = line_dedup.drop_lines(docs, F.col("source"), n_dropped="lines dropped", by_text=True)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col("lines dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType))
                               .otherwise(F.col("n_chars")))
    return left.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of the smallest doc_id."""
    keyed = _keyed(docs)
    groups = stage(simhash.near_duplicates(keyed, "key", "text", shingle=3, distance=2), "pipeline-groups")
    kept = stage(groups.where("key = component_id").groupBy(F.col("key").alias("kept"))
                 .agg(F.count(F.lit(1)).alias("copies")), "pipeline-kept")
    met = keyed.join(kept, _same("key", "kept")).select("key", "row", "copies")
    once = met.where("copies = 1").select("row")
    more = met.where("copies > 1").dropDuplicates(["key"]).select("row")
    return _rows(once.unionByName(more), docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word in a benchmark window."""
    keyed = _keyed(docs)
    matches = decontaminate.find_matches(keyed, table(spark, sf_dir, "benchmark"), id_col="key", window=10)
    bad = stage(matches.where(F.size("starts") > 0).select(F.col("key").alias("bad")).distinct(), "pipeline-contaminated")
    return _rows(keyed.join(bad, _same("key", "bad"), "left_anti"), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of at most 2048 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("simhash_dedup", near_duplicates),
    ("decontamination", decontaminated),
    ("best_fit_packing", packed),
]

# The classifier, the fingerprints' hash and the tokenizer are beyond SQL; the
# stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and read again."""
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


def queries():
    return {"pipeline": run}


def oracle_sql():
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
