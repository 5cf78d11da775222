"""Registered queries over persisted indexes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import dense, mixture, quantize
from quarry.plans import catalog, lexical_store
from quarry.plans import sqlparts as sq
from quarry.plans.catalog import K, all_benchmark, register
from quarry.plans.catalog_hybrid import bm25_sql
from quarry.plans.catalog_more import FIXED_CLUSTER, FIXED_DIM, _every_twentieth, _fixed_model
from quarry.plans.tables import load
from quarry.session import table_path


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder for an index, in the shared scratch space."""
    return table_path(spark, "index", f"{name}-{uuid.uuid4().hex}")


def _hits(df: DataFrame) -> DataFrame:
    return df.select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", F.round("score", 6).alias("score"))


@register("bm25_pruned", bm25_sql)
def q_bm25_pruned(spark, sf_dir):
    """BM25 top-k of all benchmark items through block-max postings."""
    root = _folder(spark, "bm25")
    lexical_store.create(spark, root, load(spark, sf_dir, "documents"))
    return _hits(lexical_store.search(spark, root, all_benchmark(spark, sf_dir), k=K))


def _copies(docs: DataFrame) -> DataFrame:
    """Ids of all documents but the first of each text."""
    first = docs.groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    return docs.select("doc_id").join(first, "doc_id", "left_anti")


@register("bm25_incremental", lambda: bm25_sql("SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text"))
def q_bm25_incremental(spark, sf_dir):
    """BM25 top-k over an index of the English documents to which all others were appended
    and from which repeated texts were deleted: as over the texts' first documents."""
    root = _folder(spark, "bm25")
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    english = F.col("lang").eqNullSafe("en")
    lexical_store.create(spark, root, docs.where(english))
    lexical_store.append(spark, root, docs.where(~english))
    lexical_store.delete(spark, root, _copies(docs))
    return _hits(lexical_store.search(spark, root, all_benchmark(spark, sf_dir), k=K))


def clustered_search(spark, sf_dir, root: str) -> DataFrame:
    """Vectors stored by cluster under ``root``; every query searches the files of its cluster only."""
    mixture.assign(load(spark, sf_dir, "embeddings"), _fixed_model(FIXED_DIM)).write.partitionBy("cluster").parquet(root)
    queries = _every_twentieth(spark, sf_dir).withColumn("cluster", F.lit(FIXED_CLUSTER))
    return dense.dense_search(spark.read.parquet(root), queries, k=K, id_col="vec_id", group_col="cluster", query_group_col="cluster")


@register("gmm_search_pruned", lambda: catalog._ORACLES["gmm_search"]())
def q_gmm_search_pruned(spark, sf_dir):
    """``gmm_search`` over a table partitioned by cluster, pruned when it runs."""
    hits = clustered_search(spark, sf_dir, _folder(spark, "clusters"))
    return hits.select("query_id", F.col("rank").cast("long").alias("rank"), F.col("doc_id").alias("vec_id"),
                       F.round("score", 6).alias("score"))


@register("dense_pq", lambda: f"""WITH s AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_cosine_similarity(d.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score
  FROM embeddings q, embeddings d WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::BIGINT AS rank, vec_id, round(score, 6) AS score FROM {sq.ranked('s', K, ids='vec_id')}""")
def q_dense_pq(spark, sf_dir):
    """Top-k neighbours through byte codes and an exact re-rank of each query's shortlist; the
    SQL is the exhaustive search, which it equals as long as no neighbour is missed."""
    path = _folder(spark, "quantized")
    emb = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    quantize.write_store(emb, quantize.train(emb), path)
    hits = quantize.search(spark, path, _every_twentieth(spark, sf_dir), k=K)
    return hits.select("query_id", F.col("rank").cast("long").alias("rank"), F.col("doc_id").alias("vec_id"),
                       F.round("score", 6).alias("score"))
