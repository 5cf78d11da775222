"""A persisted BM25 index that grows: append, delete, merge, search.

Under ``root`` lie the tables of ``operators.postings`` (a delta per append) and, per
delete, ``deleted/<name>``: the places of its documents and what their terms counted.
Versions (``plans.versions``) list the live deltas and deletes and hold the sums of
documents and words, so document frequencies, the number of documents and their mean
length are those of the documents that are live, as after a rebuild.

Appends commute: one that loses a race to commit is only checked against the documents
that the other has added.  A delete or a merge that loses is done again.  Files of
earlier versions stay, for their readers.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import stopwords
from quarry.operators import postings
from quarry.operators.lexical import BM25_B, BM25_K1, DEFAULT_K, term_lists
from quarry.plans import versions
from quarry.session import materialize


def _counted(corpus: DataFrame, id_col: str, text_col: str, stop: list[str]) -> DataFrame:
    docs = corpus.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    lists = term_lists(docs, "doc_id", "text", stop, 1)
    return materialize(lists.select("doc_id", "terms", F.col("tfs").cast("array<double>").alias("values"), "n_words"), "counted")


def _sums(docs: DataFrame) -> dict:
    r = docs.agg(F.count(F.lit(1)).alias("docs"), F.sum("n_words").alias("words"), F.countDistinct("doc_id").alias("ids")).first()
    if r["ids"] != r["docs"]:
        raise ValueError("document ids are not unique, or null")
    return {"docs": r["docs"], "words": r["words"] or 0}


def _write(docs: DataFrame, root: str, meta: dict) -> dict:
    """A new delta of ``docs``; what a version says of it."""
    entry = {"name": f"d-{uuid.uuid4().hex}", **_sums(docs)}
    postings.write_delta(docs, root, entry["name"], meta["buckets"], meta["segment_docs"])
    return entry


def create(spark: SparkSession, root: str, corpus: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           stop_words: list[str] | None = None, k1: float = BM25_K1, b: float = BM25_B, buckets: int = postings.BUCKETS,
           segment_docs: int = postings.SEGMENT_DOCS) -> dict:
    """Build the first version; an index that is there raises before any work."""
    if versions.numbers(spark, root):
        raise FileExistsError(f"there is an index at {root}")
    stop = stopwords.english() if stop_words is None else list(stop_words)
    meta = {"buckets": buckets, "segment_docs": segment_docs, "stop_words": stop, "k1": k1, "b": b, "deletes": [],
            "id_type": corpus.schema[id_col].dataType.json()}
    docs = _counted(corpus, id_col, text_col, stop)
    return versions.commit(spark, root, 1, meta | {"deltas": [_write(docs, root, meta)]})


def _read(spark: SparkSession, root: str) -> dict:
    meta = versions.live(spark, root)
    if meta is None:
        raise FileNotFoundError(f"no index at {root}")
    return meta


def _postings(spark: SparkSession, root: str, meta: dict) -> postings.Postings:
    dead = less = None
    if meta["deletes"]:
        names = [os.path.join(root, "deleted", d["name"]) for d in meta["deletes"]]
        dead = (spark.read.schema("delta string, segment long, place int").parquet(*[os.path.join(n, "places") for n in names])
                .groupBy("delta", "segment").agg(F.collect_list("place").alias("places")))  # a segment's documents at most
        less = spark.read.schema("term string, df long").parquet(*[os.path.join(n, "terms") for n in names])
    return postings.Postings(spark, root, [d["name"] for d in meta["deltas"]], meta["buckets"], meta["segment_docs"], dead, less,
                             _id_type(meta))


def _id_type(meta: dict) -> T.DataType:
    return T._parse_datatype_json_string(meta["id_type"])


def live_documents(spark: SparkSession, root: str, meta: dict | None = None) -> DataFrame:
    """(delta, doc_no, doc_id, terms, values, n_words) of all documents that are not deleted."""
    meta = meta or _read(spark, root)
    index = _postings(spark, root, meta)
    docs = index.table("docs")
    if not meta["deletes"]:
        return docs
    at = F.struct(F.floor(F.col("doc_no") / meta["segment_docs"]).cast("long").alias("segment"),
                  (F.col("doc_no") % meta["segment_docs"]).cast("int").alias("place"))
    gone = index.dead.select("delta", "segment", F.explode("places").alias("place"))
    return (docs.withColumn("at", at).join(gone.select("delta", F.struct("segment", "place").alias("at")), ["delta", "at"], "left_anti")
            .select("delta", "doc_no", "doc_id", "terms", "values", "n_words"))


def append(spark: SparkSession, root: str, corpus: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Add documents as a delta; an id that is live already raises and leaves the index as it was."""
    meta = _read(spark, root)
    docs = _counted(corpus, id_col, text_col, meta["stop_words"])
    entry = _write(docs, root, meta)
    checked: set[str] = set()

    def change(now: dict) -> dict:
        fresh = [d for d in now["deltas"] if d["name"] not in checked]
        if fresh:
            there = live_documents(spark, root, now | {"deltas": fresh}).select("doc_id")
            if not there.join(docs.select("doc_id"), "doc_id", "left_semi").isEmpty():
                raise ValueError("document ids are in the index already")
        checked.update(d["name"] for d in fresh)
        return now | {"deltas": [*now["deltas"], entry]}

    return versions.update(spark, root, change)


def delete(spark: SparkSession, root: str, ids: DataFrame, id_col: str = "doc_id") -> dict:
    """Take the documents with these ids out of the live version; unknown ids are ignored."""
    wanted = ids.select(F.col(id_col).alias("doc_id")).distinct()

    def change(now: dict) -> dict:
        gone = materialize(live_documents(spark, root, now).join(wanted, "doc_id", "left_semi"), "gone")
        sums = _sums(gone)
        if not sums["docs"]:
            return now
        name = f"x-{uuid.uuid4().hex}"
        place = (F.col("doc_no") % now["segment_docs"]).cast("int").alias("place")
        segment = F.floor(F.col("doc_no") / now["segment_docs"]).cast("long").alias("segment")
        gone.select("delta", segment, place).write.parquet(os.path.join(root, "deleted", name, "places"))
        gone.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).write.parquet(
            os.path.join(root, "deleted", name, "terms"))
        return now | {"deletes": [*now["deletes"], {"name": name, **sums}]}

    _read(spark, root)
    return versions.update(spark, root, change)


def merge(spark: SparkSession, root: str) -> dict:
    """Rewrite all live documents as one delta without deletes, equal to a rebuild."""

    def change(now: dict) -> dict:
        docs = materialize(live_documents(spark, root, now).select("doc_id", "terms", "values", "n_words"), "live")
        entry = _write(docs, root, now)
        return now | {"deltas": [entry] if entry["docs"] else [], "deletes": []}

    _read(spark, root)
    return versions.update(spark, root, change)


def search(spark: SparkSession, root: str, queries: DataFrame, k: int = DEFAULT_K, id_col: str = "query_id", text_col: str = "text",
           version: int | None = None) -> DataFrame:
    """BM25 top-k over the live documents, each query's distinct terms:
    (query_id, rank, doc_id, score), ties by id."""
    meta = _read(spark, root) if version is None else versions.read(spark, root, version)
    index = _postings(spark, root, meta)
    n_docs, n_words = (sum(d[c] for d in meta["deltas"]) - sum(d[c] for d in meta["deletes"]) for c in ("docs", "words"))
    impact = postings.Saturated(meta["k1"], meta["b"], max(n_words / max(n_docs, 1), 1e-300))
    q = queries.select(F.col(id_col).alias("query_id"), F.col(text_col).alias("text"))
    asked = term_lists(q, "query_id", "text", meta["stop_words"], 1).select("query_id", F.explode("terms").alias("term"))

    def weigh(terms: list[str], buckets: list[int]) -> np.ndarray:
        return postings.idf(float(n_docs), postings.document_frequency(index, terms, buckets))

    return postings.search(index, asked.withColumn("weight", F.lit(1.0)), weigh, impact, k)
