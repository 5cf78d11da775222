"""Registered queries: one Spark callable and (where SQL can say it) one DuckDB
oracle string per operator of the inventory.

Each callable takes ``(spark, sf_dir)`` and returns a DataFrame with flat,
aliased columns (integers as BIGINT, doubles rounded to 6 places, long text
as its MD5) so that results can be compared with the oracle value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators import chunking, lexical
from quarry.plans import sqlparts as sq
from quarry.plans.tables import load

QueryFn = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, QueryFn] = {}
_ORACLES: dict[str, Callable[[], str]] = {}

K = 10


def register(name: str, oracle: Callable[[], str] | None = None):
    def wrap(fn: QueryFn) -> QueryFn:
        _QUERIES[name] = fn
        if oracle is not None:
            _ORACLES[name] = oracle
        return fn
    return wrap


def _register_all() -> None:
    # importing the modules registers their queries
    from quarry.plans import catalog_hybrid, catalog_index, catalog_io, catalog_joins, catalog_learnt, catalog_more, catalog_text  # noqa: F401


def queries() -> dict[str, QueryFn]:
    _register_all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _register_all()
    return {k: f() for k, f in _ORACLES.items()}


def first_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The single query used by single-query operators: the first benchmark item."""
    return (load(spark, sf_dir, "benchmark").orderBy("item_id").limit(1)
            .select(F.col("item_id").alias("query_id"), "text"))


def all_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


FIRST_QUERY_SQL = "queries AS (SELECT item_id AS query_id, text FROM benchmark ORDER BY item_id LIMIT 1)"
ALL_QUERIES_SQL = "queries AS (SELECT item_id AS query_id, text FROM benchmark)"


def documents_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return chunking.chunk_fixed(docs, keep=["doc_id"])


# --- M0: normalise, chunk, vocabulary, single query -------------------------------------

def _normalize_sql() -> str:
    return f"""SELECT doc_id, md5({sq.normalize('text')}) AS norm_md5,
       length({sq.normalize('text')})::BIGINT AS norm_len FROM documents"""


@register("normalize", _normalize_sql)
def q_normalize(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", tx.normalize("text").alias("n"))
    return d.select("doc_id", F.md5("n").alias("norm_md5"), F.length("n").cast("long").alias("norm_len"))


def _chunk_fixed_sql() -> str:
    return f"""WITH {sq.chunks_cte()}
SELECT doc_id, chunk_index::BIGINT AS chunk_index, chunk_number::BIGINT AS chunk_number,
       total_chunks::BIGINT AS total_chunks, length(text)::BIGINT AS chunk_size,
       chunk_start_char::BIGINT AS chunk_start_char,
       (chunk_start_char + length(text))::BIGINT AS chunk_end_char, md5(text) AS chunk_md5
FROM chunks"""


@register("chunk_fixed", _chunk_fixed_sql)
def q_chunk_fixed(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    c = chunking.chunk_fixed(docs, keep=["doc_id"], first_occurrence=True)
    return c.select("doc_id", *[F.col(n).cast("long").alias(n) for n in (
        "chunk_index", "chunk_number", "total_chunks", "chunk_size", "chunk_start_char", "chunk_end_char")],
        F.md5("text").alias("chunk_md5"))


def _vocab_sql() -> str:
    return f"""WITH corpus AS (SELECT doc_id, text FROM documents), {ALL_QUERIES_SQL},
{sq.tfidf_ctes('corpus', 'queries')}
SELECT term, df::BIGINT AS df, cf::BIGINT AS cf, round(idf, 6) AS idf FROM _vocab"""


@register("vocab_topn", _vocab_sql)
def q_vocab(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    return lexical.vocabulary(docs).select("term", F.col("df").cast("long").alias("df"),
                                           F.col("cf").cast("long").alias("cf"), F.round("idf", 6).alias("idf"))


def _tfidf_sql(queries_sql: str) -> str:
    return f"""WITH corpus AS (SELECT doc_id, text FROM documents), {queries_sql},
{sq.tfidf_ctes('corpus', 'queries')}
SELECT query_id, rank::BIGINT AS rank, doc_id, round(score, 6) AS score
FROM {sq.ranked('_scores', K)}"""


def _tfidf(spark, sf_dir, queries: DataFrame) -> DataFrame:
    idx = lexical.build_tfidf_index(load(spark, sf_dir, "documents"))
    hits = lexical.tfidf_search(idx, queries, k=K)
    return hits.select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id",
                       F.round("score", 6).alias("score"))


@register("tfidf_topk", lambda: _tfidf_sql(FIRST_QUERY_SQL))
def q_tfidf_topk(spark, sf_dir):
    return _tfidf(spark, sf_dir, first_benchmark(spark, sf_dir))


@register("tfidf_batch", lambda: _tfidf_sql(ALL_QUERIES_SQL))
def q_tfidf_batch(spark, sf_dir):
    return _tfidf(spark, sf_dir, all_benchmark(spark, sf_dir))
