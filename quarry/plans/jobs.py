"""End-to-end jobs: build a persisted index, open it, query it, change it, re-cluster it.

Under ``index_dir`` lie, all as Parquet:

* ``chunks/segment=<s>/cluster=<c>`` - chunk rows with metadata, ids and vector (a search
  in some clusters reads their partitions only);
* ``terms/segment=<s>``, ``totals/segment=<s>`` - the chunks' counted terms and their sums;
* ``gone/<x>`` - per delete: the chunks taken out, and the sums of their terms;
* ``v-<id>``   - the vocabulary, and the mixture (k rows) that clusters were assigned by; of
  a version without pending changes also the TF-IDF vectors and their block-max postings;
* ``_versions`` - see ``plans.versions``: which segments and deletes are live.

``add_documents`` writes a segment and ``delete_documents`` a list; each then sums the
segments' totals to the vocabulary that a rebuild would have.  Vectors of a version with
pending changes are weighed when they are searched; ``merge_index`` rewrites all live rows
as one segment.  Files of earlier versions stay, for their readers; a job that dies or
loses a race leaves the live version as it was.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import stopwords
from quarry.operators import annotate, chunking, dense, hybrid, lexical, mixture, postings
from quarry.plans import versions
from quarry.session import materialize


PRUNED_FROM = 500_000


@dataclass
class Index:
    chunks: DataFrame
    vectors: DataFrame
    vocab: DataFrame
    model: mixture.MixtureModel
    path: str
    stop_words: list[str]
    ngram_max: int = 2
    max_features: int | None = None
    blocks: postings.Postings | None = None  # of a version without pending changes
    n_chunks: int = 0

    def lexical(self) -> lexical.LexicalIndex:
        return lexical.LexicalIndex(self.vectors, self.vocab, self.stop_words, self.ngram_max, self.max_features)


def build_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 1000,
                 overlap: int = 200, min_length: int = 100) -> DataFrame:
    """Annotate documents (on raw text), normalise and chunk them, add ids.

    ``chunk_id`` is the document id (of any type) and the chunk's index, which
    no two chunks share."""
    ann = annotate.annotate_documents(docs, text_col)
    keep = [c for c in ann.columns if c != text_col]
    ch = chunking.chunk_fixed(ann, text_col=text_col, keep=keep, size=size, overlap=overlap, min_length=min_length)
    ch = ch.withColumn("chunk_id", F.concat_ws("#", F.col(id_col).cast("string"), F.col("chunk_index").cast("string")))
    meta = [id_col, "chunk_index", "chunk_size", "chunk_start_char", "chunk_end_char"]
    return annotate.with_content_ids(ch, metadata_cols=meta)


def index_corpus(spark: SparkSession, docs: DataFrame, index_dir: str, id_col: str = "doc_id",
                 text_col: str = "text", n_components: int = 10, max_features: int | None = lexical.MAX_FEATURES,
                 stop_words: list[str] | None = None, embed_dim: int = dense.HASH_DIM,
                 mode: str = "errorifexists") -> Index:
    """Chunk, embed, cluster and index a corpus; write everything under ``index_dir``.

    An existing index raises before any work unless ``mode`` is "overwrite",
    which adds a version and leaves the earlier one to its readers."""
    if mode not in ("errorifexists", "overwrite"):
        raise ValueError(f"unknown mode: {mode}")
    if mode == "errorifexists" and versions.numbers(spark, index_dir):
        raise FileExistsError(f"there is an index at {index_dir}")
    # written once, so that fitting, assignment and indexing read the same rows
    staged = materialize(dense.hash_embed(build_chunks(docs, id_col, text_col), dim=embed_dim), "chunks")
    _check_unique(staged)
    model = mixture.fit_gmm(staged, k=n_components, vec_col="embedding", id_col="chunk_id")
    meta = {"id_col": id_col, "text_col": text_col, "embed_dim": embed_dim, "ngram_max": 2, "max_features": max_features, "deletes": [],
            "stop_words": stopwords.english() if stop_words is None else list(stop_words)}
    meta["segments"] = [_write_segment(spark, index_dir, mixture.assign(staged, model), meta)]
    meta |= _statics(spark, index_dir, meta, model)

    def change(now: dict | None) -> dict:
        if now is not None and mode == "errorifexists":
            raise FileExistsError(f"another writer has made an index at {index_dir}")
        return meta

    _publish(spark, index_dir, change)
    return open_index(spark, index_dir)


def _check_unique(chunks: DataFrame) -> None:
    if not chunks.groupBy("chunk_id").count().where(F.col("count") > 1).isEmpty():
        raise ValueError("document ids are not unique")


def _write_segment(spark: SparkSession, index_dir: str, chunks: DataFrame, meta: dict, lists: DataFrame | None = None) -> dict:
    """A segment of clustered chunks with its counted terms and sums; what a version says of it."""
    name = f"s-{uuid.uuid4().hex}"
    where = {t: os.path.join(index_dir, t, f"segment={name}") for t in ("chunks", "terms", "totals")}
    chunks.write.partitionBy("cluster").parquet(where["chunks"])
    if lists is None:
        rows = spark.read.parquet(where["chunks"]).select(F.col("chunk_id").alias("doc_id"), F.col(meta["id_col"]).alias("document"), "text")
        lists = lexical.term_lists(rows, "doc_id", "text", meta["stop_words"], meta["ngram_max"], ("document",))
    lists.write.parquet(where["terms"])
    written = spark.read.parquet(where["terms"])
    lexical.term_totals(written).write.parquet(where["totals"])
    return {"name": name, "chunks": written.count()}


def _table(spark: SparkSession, index_dir: str, meta: dict, name: str) -> DataFrame:
    """A table over the live segments, deleted chunks included."""
    base = os.path.join(index_dir, name)
    return spark.read.option("basePath", base).parquet(*[os.path.join(base, f"segment={s['name']}") for s in meta["segments"]])


def _gone(spark: SparkSession, index_dir: str, meta: dict, name: str) -> DataFrame:
    return spark.read.parquet(*[os.path.join(index_dir, "gone", x["name"], name) for x in meta["deletes"]])


def _live_rows(spark: SparkSession, index_dir: str, meta: dict, name: str, key: str) -> DataFrame:
    """A table's live rows; ``key`` is its column of chunk ids."""
    rows = _table(spark, index_dir, meta, name)
    if meta["deletes"]:
        gone = _gone(spark, index_dir, meta, "chunks").select("segment", F.col("chunk_id").alias(key))
        rows = rows.join(gone, ["segment", key], "left_anti")
    return rows


def _vocabulary(spark: SparkSession, index_dir: str, meta: dict) -> DataFrame:
    """The vocabulary of the live chunks: the segments' sums less what was deleted."""
    totals = _table(spark, index_dir, meta, "totals").select("term", "df", "cf")
    if meta["deletes"]:
        less = _gone(spark, index_dir, meta, "totals")
        totals = totals.unionByName(less.select("term", (-F.col("df")).alias("df"), (-F.col("cf")).alias("cf")))
    if len(meta["segments"]) > 1 or meta["deletes"]:
        totals = totals.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).where("df > 0")
    n = sum(s["chunks"] for s in meta["segments"]) - sum(x["chunks"] for x in meta["deletes"])
    return lexical.weighted_terms(totals, n, meta["max_features"])


def _statics(spark: SparkSession, index_dir: str, meta: dict, model: mixture.MixtureModel) -> dict:
    """Vocabulary, mixture, vectors and postings of a version without pending changes."""
    version = f"v-{uuid.uuid4().hex}"
    where = os.path.join(index_dir, version)
    _vocabulary(spark, index_dir, meta).write.parquet(os.path.join(where, "vocab"))
    model.to_df(spark).write.parquet(os.path.join(where, "mixture"))
    vocab = spark.read.parquet(os.path.join(where, "vocab"))
    lists = _table(spark, index_dir, meta, "terms").select("doc_id", "terms", "tfs")
    lexical.weigh_lists(lists, vocab, meta["max_features"]).write.parquet(os.path.join(where, "vectors"))
    rows = spark.read.parquet(os.path.join(where, "vectors")).select(
        "doc_id", "terms", F.col("weights").alias("values"), F.lit(0).cast("long").alias("n_words"))
    postings.write_delta(rows, os.path.join(where, "postings"), "all")
    return {"vocab": f"{version}/vocab", "mixture": f"{version}/mixture", "vectors": f"{version}/vectors", "postings": f"{version}/postings"}


def _publish(spark: SparkSession, index_dir: str, change) -> dict:
    return versions.update(spark, index_dir, change)


def _version(spark: SparkSession, index_dir: str) -> dict:
    meta = versions.live(spark, index_dir)
    if meta is None:
        raise FileNotFoundError(f"no index at {index_dir}")
    return meta


def _model(spark: SparkSession, index_dir: str, meta: dict) -> mixture.MixtureModel:
    return mixture.MixtureModel.from_df(spark.read.parquet(os.path.join(index_dir, meta["mixture"])))


def open_index(spark: SparkSession, index_dir: str) -> Index:
    """Reload the live version of a persisted index (nothing is recomputed but the weights of
    a version with pending changes, when it is searched)."""
    meta = _version(spark, index_dir)
    chunks = _live_rows(spark, index_dir, meta, "chunks", "chunk_id").drop("segment")
    vocab = spark.read.parquet(os.path.join(index_dir, meta["vocab"]))
    blocks = None
    if meta["vectors"]:
        vectors = spark.read.parquet(os.path.join(index_dir, meta["vectors"]))
        blocks = postings.Postings(spark, os.path.join(index_dir, meta["postings"]), ["all"], postings.BUCKETS, id_type=T.StringType())
    else:
        lists = _live_rows(spark, index_dir, meta, "terms", "doc_id").select("doc_id", "terms", "tfs")
        vectors = lexical.weigh_lists(lists, vocab, meta["max_features"])
    return Index(chunks, vectors, vocab, _model(spark, index_dir, meta), index_dir, meta["stop_words"], meta["ngram_max"],
                 meta["max_features"], blocks, sum(s["chunks"] for s in meta["segments"]) - sum(x["chunks"] for x in meta["deletes"]))


# --- changes ---------------------------------------------------------------------------------

def _pending(spark: SparkSession, index_dir: str, meta: dict) -> dict:
    """``meta`` with the vocabulary of its segments and deletes, weights pending."""
    vocab = f"v-{uuid.uuid4().hex}/vocab"
    _vocabulary(spark, index_dir, meta).write.parquet(os.path.join(index_dir, vocab))
    return meta | {"vocab": vocab, "vectors": None, "postings": None}


def add_documents(spark: SparkSession, index_dir: str, docs: DataFrame) -> Index:
    """Index further documents; their chunks get the clusters of the present mixture.  An id
    that is live already raises and leaves the index as it was."""
    meta = _version(spark, index_dir)
    staged = materialize(dense.hash_embed(build_chunks(docs, meta["id_col"], meta["text_col"]), dim=meta["embed_dim"]), "chunks")
    _check_unique(staged)
    if staged.isEmpty():  # no document is long enough for a chunk
        return open_index(spark, index_dir)
    added: dict = {}
    checked: set[str] = set()

    def change(now: dict) -> dict:
        fresh = [s for s in now["segments"] if s["name"] not in checked]
        there = _live_rows(spark, index_dir, now | {"segments": fresh}, "terms", "doc_id").select("document") if fresh else None
        if there is not None and not there.join(staged.select(F.col(meta["id_col"]).alias("document")), "document", "left_semi").isEmpty():
            raise ValueError("document ids are in the index already")
        checked.update(s["name"] for s in fresh)
        if added.get("mixture") != now["mixture"]:  # the first time, or clustered anew meanwhile
            model = _model(spark, index_dir, now)
            added.update(mixture=now["mixture"], segment=_write_segment(spark, index_dir, mixture.assign(staged, model), meta))
        return _pending(spark, index_dir, now | {"segments": [*now["segments"], added["segment"]]})

    _publish(spark, index_dir, change)
    return open_index(spark, index_dir)


def delete_documents(spark: SparkSession, index_dir: str, ids: DataFrame) -> Index:
    """Take documents out of the live version; ``ids`` has their id column, unknown ids are ignored."""
    meta = _version(spark, index_dir)
    wanted = ids.select(F.col(meta["id_col"]).alias("document")).distinct()

    def change(now: dict) -> dict:
        rows = materialize(_live_rows(spark, index_dir, now, "terms", "doc_id").join(wanted, "document", "left_semi"), "gone")
        n = rows.count()
        if not n:
            return now
        name = f"x-{uuid.uuid4().hex}"
        where = os.path.join(index_dir, "gone", name)
        rows.select("segment", F.col("doc_id").alias("chunk_id")).write.parquet(os.path.join(where, "chunks"))
        lexical.term_totals(rows).write.parquet(os.path.join(where, "totals"))
        return _pending(spark, index_dir, now | {"deletes": [*now["deletes"], {"name": name, "chunks": n}]})

    _publish(spark, index_dir, change)
    return open_index(spark, index_dir)


def _rewritten(spark: SparkSession, index_dir: str, now: dict, model: mixture.MixtureModel | None) -> dict:
    """All live rows as one segment, clustered anew if a model is given."""
    chunks = _live_rows(spark, index_dir, now, "chunks", "chunk_id").drop("segment")
    if model is not None:
        chunks = mixture.assign(chunks.drop("cluster"), model)
    lists = _live_rows(spark, index_dir, now, "terms", "doc_id").drop("segment")
    if lists.isEmpty():
        raise ValueError(f"no document is left in {index_dir}")
    meta = now | {"segments": [_write_segment(spark, index_dir, chunks, now, lists)], "deletes": []}
    return meta | _statics(spark, index_dir, meta, model or _model(spark, index_dir, now))


def merge_index(spark: SparkSession, index_dir: str) -> Index:
    """Rewrite the live rows as one segment, with the vectors and postings of a fresh build."""
    _version(spark, index_dir)
    _publish(spark, index_dir, lambda now: _rewritten(spark, index_dir, now, None))
    return open_index(spark, index_dir)


def recluster(spark: SparkSession, index_dir: str, n_components: int, from_scratch: bool = False) -> Index:
    """Give the index another number of clusters and rewrite its chunks by them.  The present
    mixture is split or merged (``mixture.refit``), or fitted anew from k-means ``from_scratch``."""
    index = open_index(spark, index_dir)
    if from_scratch:
        model = mixture.fit_gmm(index.chunks, k=n_components, vec_col="embedding", id_col="chunk_id")
    else:
        model = mixture.refit(index.chunks, index.model, n_components, vec_col="embedding", id_col="chunk_id")
    _publish(spark, index_dir, lambda now: _rewritten(spark, index_dir, now, model))
    return open_index(spark, index_dir)


def query_index(index: Index, queries: DataFrame, k: int = 10, methods=("spider", "bm25", "gmm"),
                cluster_filter: int | None = None, include_zero: bool = True, restrict: str | None = None,
                doc_filter: DataFrame | None = None, id_col: str = "doc_id", pruned: bool | None = None) -> dict[str, DataFrame]:
    """Run the chosen methods (fixed order), fuse, score confidence, build context.

    ``restrict`` (a SQL condition on chunk columns, e.g. "chapter = 3") and
    ``doc_filter`` (a DataFrame with document ids) narrow the chunks before
    anything is scored.  Scoring runs once; every output reads its result.
    ``pruned`` says whether the lexical method goes through the postings or scans the
    vectors, with the same result; by default an index of ``PRUNED_FROM`` chunks or more
    does, as the postings' few more jobs cost more than the scan of a small index.

    Returns ``hits`` (query_id, rank, doc_id = chunk id, score, method,
    method_rank, then the chunk's document id, content and metadata),
    ``confidence``, ``context``, ``prompt`` and ``responses`` (one row per query).
    """
    q = queries.select("query_id", "text")
    chunks = index.chunks
    if restrict is not None:
        chunks = chunks.where(restrict)
    if doc_filter is not None:
        chunks = chunks.join(doc_filter.select(id_col).distinct(), id_col, "left_semi")
    per: dict[str, DataFrame] = {}
    corpus = chunks.select(F.col("chunk_id").alias("doc_id"), "embedding", "cluster")
    if "spider" in methods or "gmm" in methods:
        qv = materialize(dense.hash_embed(q), "query-vectors")
    if "spider" in methods:
        per["spider"] = dense.dense_search(corpus, qv, k=k)
    if "bm25" in methods:
        lex = index.lexical()
        if restrict is not None or doc_filter is not None:
            lex.vectors = lex.vectors.join(corpus.select("doc_id"), "doc_id", "left_semi")
        pruned = index.n_chunks >= PRUNED_FROM if pruned is None else pruned
        if pruned and index.blocks is not None and restrict is None and doc_filter is None:
            per["bm25"] = lexical.pruned_search(lex, index.blocks, q, k=k, include_zero=include_zero)
        else:
            per["bm25"] = lexical.tfidf_search(lex, q, k=k, include_zero=include_zero)
    if "gmm" in methods:
        if cluster_filter is not None:
            wanted = int(cluster_filter)
            per["gmm"] = dense.dense_search(corpus.where(F.col("cluster") == wanted), qv, k=k)
        else:
            qc = mixture.assign(qv, index.model)
            per["gmm"] = dense.dense_search(corpus, qc, k=k, group_col="cluster", query_group_col="cluster")
    fused = materialize(hybrid.fuse(per, k), "hits")
    drop = {"embedding", "chunk_id"}
    found = index.chunks.select(F.col("chunk_id").alias("_chunk"), *[
        F.col(c).alias("document_id" if c == id_col else "content" if c == "text" else c) for c in index.chunks.columns if c not in drop])
    hits = materialize(fused.join(found, F.col("doc_id") == F.col("_chunk"), "left").drop("_chunk"), "hit-rows")
    ctx = hybrid.context(fused, hits.select("doc_id", F.col("content").alias("text")).dropDuplicates(["doc_id"]))
    conf = hybrid.confidence(fused, q)
    return {"hits": hits, "confidence": conf, "context": ctx, "prompt": hybrid.prompt(ctx, q),
            "responses": hybrid.responses(hits, conf, q)}
