"""Lexical retrieval: TF-IDF cosine index and search, plus Okapi BM25.

An index is sharded by document: ``vectors(doc_id, terms, weights)`` holds one
row per document with its terms and their weights (the L2-normalised tf·idf, or
BM25's saturated tf), and ``vocab(term, df, cf, idf)`` the vocabulary.  A search
sends blocks of queries to the documents (see ``blocks``), so only the best k
documents per query and task are ever shuffled: neither a common term's postings
nor (query, document) scores.

Tokens are counted per row in Arrow batches.  Counted rows are staged, as both
the vocabulary and the vectors read them.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import stopwords
from quarry.operators import postings
from quarry.operators.blocks import block_top_k
from quarry.operators.slices import ELEMENTS, TEXT_BYTES, parts
from quarry.session import materialize

MAX_FEATURES = 10000
DEFAULT_K = 10
BM25_K1 = 1.2
BM25_B = 0.75
PACK_ROWS = 512
# (document term, query) matches that are expanded at once while scoring
TILE = 1 << 18
# A vocabulary with a bound up to this goes to every task.
SHIPPED_TERMS = 200_000

_TOKEN = re.compile(r"\w\w+")


def term_lists(df: DataFrame, id_col: str, text_col: str, stop_words: list[str], ngram_max: int,
               keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, keep..., terms, tfs, n_words): lower-cased runs of two or more word
    characters, stop words removed, then unigrams plus bigrams of what remains,
    counted per row (terms in order of first occurrence)."""
    stop = frozenset(stop_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "_text", TEXT_BYTES):
            terms, tfs, sizes, n_words = [], [], [], []
            for text in batch.column("_text").to_pylist():
                words = [w for w in _TOKEN.findall(text.lower()) if w not in stop] if text else []
                counts = Counter(words)
                if ngram_max >= 2:
                    counts.update(map(" ".join, itertools.pairwise(words)))
                terms += counts.keys()
                tfs += counts.values()
                sizes.append(len(counts))
                n_words.append(len(words))
            at = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            rest = [n for n in batch.schema.names if n != "_text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in rest), pa.ListArray.from_arrays(at, pa.array(terms, pa.string())),
                 pa.ListArray.from_arrays(at, pa.array(tfs, pa.int64())), pa.array(n_words, pa.int64())],
                [*rest, "terms", "tfs", "n_words"])

    src = df.select(id_col, *keep, F.col(text_col).cast("string").alias("_text"))
    schema = T.StructType([*(f for f in src.schema.fields if f.name != "_text"), T.StructField("terms", T.ArrayType(T.StringType())),
                           T.StructField("tfs", T.ArrayType(T.LongType())), T.StructField("n_words", T.LongType())])
    return src.mapInArrow(run, schema)


def term_totals(lists: DataFrame) -> DataFrame:
    """(term, df, cf) of all terms: no Python worker holds any."""
    pairs = lists.select(F.inline(F.arrays_zip("terms", "tfs"))).toDF("term", "tf")
    return pairs.groupBy("term").agg(F.count("tf").alias("df"), F.sum("tf").alias("cf"))


@dataclass
class LexicalIndex:
    vectors: DataFrame  # doc_id, terms, weights, kept columns
    vocab: DataFrame
    stop_words: list[str] = field(default_factory=list)
    ngram_max: int = 2
    max_features: int | None = None  # the vocabulary's bound

    def postings(self) -> DataFrame:
        """(doc_id, term, weight) in long form."""
        return (self.vectors.select("doc_id", F.explode(F.arrays_zip("terms", "weights")).alias("t"))
                .select("doc_id", F.col("t.terms").alias("term"), F.col("t.weights").alias("weight")))


def _weighted(lists: DataFrame, index_vocab: DataFrame, max_features: int | None, id_col: str,
              keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, keep..., terms, weights): L2-normalised tf·idf over vocabulary terms.

    A vocabulary that its parameter bounds goes to the tasks, and every row is
    weighted where it lies; an unbounded one meets the terms in a join."""
    if max_features is None or max_features > SHIPPED_TERMS:
        return _weighted_by_join(lists, index_vocab, id_col, keep)
    rows = index_vocab.select("term", "idf").collect()  # at most max_features
    shipped = lists.sparkSession.sparkContext.broadcast(([r["term"] for r in rows], np.array([r["idf"] for r in rows], float)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, idf = pa.array(shipped.value[0], pa.string()), shipped.value[1]
        for batch in parts(batches, "terms", ELEMENTS):
            terms = batch.column("terms").flatten()
            at = pc.index_in(terms, value_set=names)
            known = np.asarray(at.is_valid())
            row = np.repeat(np.arange(batch.num_rows), np.asarray(pc.list_value_length(batch.column("terms"))))[known]
            w = batch.column("tfs").flatten().to_numpy()[known] * idf[np.asarray(at.drop_null())]
            norm = np.sqrt(np.bincount(row, weights=w * w, minlength=batch.num_rows))
            starts = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))])
            ends = pa.array(starts, pa.int32())
            rest = [n for n in batch.schema.names if n in (id_col, *keep)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in rest), pa.ListArray.from_arrays(ends, terms.filter(pa.array(known))),
                 pa.ListArray.from_arrays(ends, pa.array(w / norm[row]))], [*rest, "terms", "weights"])

    kept = lists.select(id_col, *keep, "terms", "tfs")
    return kept.mapInArrow(run, T.StructType([
        *(f for f in kept.schema.fields if f.name not in ("terms", "tfs")), T.StructField("terms", T.ArrayType(T.StringType())),
        T.StructField("weights", T.ArrayType(T.DoubleType()))]))


def _weighted_by_join(lists: DataFrame, vocab: DataFrame, id_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``_weighted`` for a vocabulary of any size; a marker row keeps rows without
    any vocabulary term."""
    marked = lists.select(id_col, *keep, F.explode(F.concat(
        F.array(F.lit(None).cast("struct<terms:string,tfs:bigint>")), F.arrays_zip("terms", "tfs"))).alias("t"))
    met = (marked.select(id_col, *keep, F.col("t.terms").alias("term"), F.col("t.tfs").alias("tf"))
           .join(vocab.select("term", "idf"), "term", "left").where("term IS NULL OR idf IS NOT NULL"))
    rows = met.groupBy(id_col, *keep).agg(F.collect_list(F.when(F.col("idf").isNotNull(), F.struct(
        "term", (F.col("tf") * F.col("idf")).alias("w")))).alias("t"))
    # in the order of the terms, so that sums do not depend on the shuffle
    rows = rows.withColumn("t", F.sort_array("t"))
    norm = F.sqrt(F.aggregate("t", F.lit(0.0), lambda s, x: s + x["w"] * x["w"]))
    rows = rows.select(id_col, *keep, "t", norm.alias("norm"))
    return rows.select(id_col, *keep, F.col("t.term").alias("terms"), F.transform("t", lambda x: x["w"] / F.col("norm")).alias("weights"))


def weighted_terms(totals: DataFrame, n_docs: int, max_features: int | None) -> DataFrame:
    """(term, df, cf, idf): the ``max_features`` terms of the highest corpus frequency, ties by term."""
    stats = totals.withColumn("idf", F.log((1.0 + float(n_docs)) / (F.col("df") + 1.0)) + 1.0)
    return stats if max_features is None else stats.orderBy(F.desc("cf"), F.asc("term")).limit(max_features)


def _counted(corpus: DataFrame, id_col: str, text_col: str, max_features: int | None, stop: list[str], ngram_max: int,
             keep: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    docs = corpus.select(F.col(id_col).alias("doc_id"), *keep, F.col(text_col).alias("text"))
    from quarry.operators.heavy import heavy_terms

    lists = materialize(term_lists(docs, "doc_id", "text", stop, ngram_max, keep), "terms")
    # a bounded vocabulary does not shuffle all distinct terms
    bounded = max_features is not None and max_features <= SHIPPED_TERMS
    totals = heavy_terms(lists, max_features) if bounded else term_totals(lists)
    return lists, weighted_terms(totals, lists.count(), max_features)


def vocabulary(corpus: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_features: int | None = MAX_FEATURES,
               stop_words: list[str] | None = None, ngram_max: int = 2) -> DataFrame:
    """(term, df, cf, idf): the ``max_features`` terms of the highest corpus
    frequency (ties by term); ``None`` keeps all."""
    stop = stopwords.english() if stop_words is None else list(stop_words)
    return _counted(corpus, id_col, text_col, max_features, stop, ngram_max, ())[1]


def weigh_lists(lists: DataFrame, vocab: DataFrame, max_features: int | None) -> DataFrame:
    """(doc_id, terms, weights) of counted rows: L2-normalised tf·idf over the vocabulary."""
    return _weighted(lists, vocab, max_features, "doc_id")


def build_tfidf_index(corpus: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      max_features: int | None = MAX_FEATURES, stop_words: list[str] | None = None,
                      ngram_max: int = 2, keep: tuple[str, ...] = ()) -> LexicalIndex:
    """TF-IDF (smooth idf, raw tf, L2 rows) over unigrams and bigrams of the
    ``vocabulary``.  ``keep`` columns stay with the vectors, e.g. a chapter to
    search in.
    """
    stop = stopwords.english() if stop_words is None else list(stop_words)
    lists, stats = _counted(corpus, id_col, text_col, max_features, stop, ngram_max, keep)
    vocab = materialize(stats, "vocab")
    return LexicalIndex(materialize(_weighted(lists, vocab, max_features, "doc_id", keep), "vectors"), vocab, stop, ngram_max,
                        max_features)


# --- scoring ------------------------------------------------------------------------------

def _prepare(rows: pa.Array):
    """Query terms and, per term, the queries that hold it (compressed rows)."""
    terms, weights = rows.field("terms"), rows.field("weights")
    sizes = np.asarray(pc.fill_null(pc.list_value_length(terms), 0))
    names, at = np.unique(np.array(terms.flatten().to_pylist(), dtype=object).astype(str), return_inverse=True)
    query = np.repeat(np.arange(len(rows)), sizes)
    order = np.argsort(at, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(names)))]).astype(np.int64)
    return len(rows), pa.array(names, pa.string()), starts, query[order], weights.flatten().to_numpy(zero_copy_only=False)[order]


def _scorer(zeros: bool):
    def score(ready, docs: pa.Array) -> np.ndarray:
        n_queries, names, starts, query, q_weight = ready
        out = np.zeros((n_queries, len(docs)))
        terms = docs.field("terms")
        doc = np.repeat(np.arange(len(docs)), np.asarray(pc.fill_null(pc.list_value_length(terms), 0)))
        at = pc.index_in(terms.flatten(), value_set=names)
        known = np.asarray(at.is_valid())
        at = np.asarray(at.drop_null()).astype(np.int64)
        doc, weight = doc[known], docs.field("weights").flatten().to_numpy(zero_copy_only=False)[known]
        many = starts[at + 1] - starts[at]
        cuts = np.searchsorted(np.cumsum(many), np.arange(TILE, many.sum() + TILE, TILE)) + 1 if len(many) else []
        lo = 0
        for hi in [*cuts, len(at)]:
            hi = min(int(hi), len(at))
            n = many[lo:hi]
            if n.sum():
                # each (document term) once per query that holds the term
                first = np.repeat(starts[at[lo:hi]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
                k = first + np.arange(n.sum())
                cell = query[k] * len(docs) + np.repeat(doc[lo:hi], n)
                out += np.bincount(cell, weights=q_weight[k] * np.repeat(weight[lo:hi], n), minlength=out.size).reshape(out.shape)
            lo = hi
        return out if zeros else np.where(out > 0, out, -np.inf)
    return score


def _size(q: DataFrame) -> dict:
    """How many queries there are and how many bytes one takes, for ``block_top_k``."""
    r = q.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("terms")).alias("t")).first()
    return {"n_queries": r["n"], "row_bytes": 64 + 32 * (r["t"] or 0) // max(r["n"], 1)}


def _queries(queries: DataFrame, index: LexicalIndex, id_col: str, text_col: str) -> DataFrame:
    q = queries.select(F.col(id_col).alias("query_id"), F.col(text_col).alias("text"))
    lists = term_lists(q, "query_id", "text", index.stop_words, index.ngram_max)
    return materialize(_weighted(lists, index.vocab, index.max_features, "query_id"), "queries")


def tfidf_search(index: LexicalIndex, queries: DataFrame, k: int = DEFAULT_K, id_col: str = "query_id",
                 text_col: str = "text", include_zero: bool = True) -> DataFrame:
    """Cosine top-k for every query: (query_id, rank, doc_id, score).  With
    ``include_zero`` documents that share no term fill short lists up, by id."""
    q = _queries(queries, index, id_col, text_col)
    docs = index.vectors.select(F.col("doc_id").alias("id"), "terms", "weights")
    return block_top_k(docs, q, _prepare, _scorer(include_zero), k, **_size(q), pack_rows=PACK_ROWS)


def pruned_search(index: LexicalIndex, blocks: postings.Postings, queries: DataFrame, k: int = DEFAULT_K, id_col: str = "query_id",
                  text_col: str = "text", include_zero: bool = True) -> DataFrame:
    """``tfidf_search`` through ``blocks``, the postings of the index's weights: only the
    queries' terms are read, and of those only what can reach the top k."""
    q = _queries(queries, index, id_col, text_col)
    asked = (q.select("query_id", F.explode(F.arrays_zip("terms", "weights")).alias("t"))
             .select("query_id", F.col("t.terms").alias("term"), F.col("t.weights").alias("weight")))
    hits = postings.search(blocks, asked, lambda terms, buckets: np.ones(len(terms)), postings.Weights(), k)
    if not include_zero:
        return hits
    # a list of fewer than k matches goes on with the smallest other ids
    first = blocks.table("segments").orderBy("segment").limit(-(-2 * k // blocks.segment_docs)).select("ids").collect()
    ids = [i for r in first for i in r["ids"]][:2 * k]
    if not ids:
        return hits
    short = (q.select("query_id").distinct().join(hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), "query_id", "left")
             .withColumn("n", F.coalesce("n", F.lit(0))).where(F.col("n") < k))
    spare = short.select("query_id", "n", F.explode(F.array(*[F.lit(i) for i in ids])).alias("doc_id"))
    spare = spare.join(hits.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id"))
    spare = spare.withColumn("rank", (F.col("n") + nth).cast("int")).where(F.col("rank") <= k)
    return hits.unionByName(spare.select("query_id", "rank", "doc_id", F.lit(0.0).alias("score")))


def scoped_search(index: LexicalIndex, queries: DataFrame, scope_col: str, k: int = DEFAULT_K, scope=None,
                  id_col: str = "query_id", text_col: str = "text") -> DataFrame:
    """Top-k matching documents per (query, scope), e.g. per chapter:
    (query_id, scope, rank, doc_id, score), positive scores only.  ``scope_col``
    is a kept column of the index; a given ``scope`` restricts the documents
    before anything is scored."""
    q = _queries(queries, index, id_col, text_col)
    docs = index.vectors.select(F.col("doc_id").alias("id"), F.col(scope_col).alias("grp"), "terms", "weights")
    if scope is not None:
        docs = docs.where(F.col("grp") == scope)
    return block_top_k(docs, q, _prepare, _scorer(False), k, **_size(q), per_group=True, pack_rows=PACK_ROWS).withColumnRenamed("grp", "scope")


# --- Okapi BM25 -------------------------------------------------------------------------

@dataclass
class BM25Index:
    vectors: DataFrame  # doc_id, terms, weights (saturated tf)
    totals: DataFrame  # term, df, cf, summed once
    n_docs: float
    stop_words: list[str]


def build_bm25_index(corpus: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     stop_words: list[str] | None = None, k1: float = BM25_K1, b: float = BM25_B) -> BM25Index:
    """Okapi BM25 over unigrams (same tokeniser and stop words); a document's
    length is the number of its kept tokens."""
    stop = stopwords.english() if stop_words is None else list(stop_words)
    docs = corpus.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    lists = materialize(term_lists(docs, "doc_id", "text", stop, 1), "bm25-terms")
    seen = lists.agg(F.count(F.lit(1)).alias("n"), F.sum("n_words").alias("words")).first()
    n_docs, average = float(seen["n"]), max(float(seen["words"] or 0) / max(seen["n"], 1), 1e-300)
    length = k1 * (1 - b + b * F.col("n_words") / average)
    vectors = lists.select("doc_id", "terms", length.alias("length"), "tfs").select(
        "doc_id", "terms", F.transform("tfs", lambda tf: tf * (k1 + 1) / (tf + F.col("length"))).alias("weights"))
    return BM25Index(vectors, materialize(term_totals(lists), "bm25-totals"), n_docs, stop)


def bm25_search(index: BM25Index, queries: DataFrame, k: int = DEFAULT_K, id_col: str = "query_id",
                text_col: str = "text") -> DataFrame:
    """Top-k BM25 per query over distinct query terms: (query_id, rank, doc_id, score).

    idf = ln(1 + (N - df + 0.5) / (df + 0.5)); only the queries' terms get one."""
    q = queries.select(F.col(id_col).alias("query_id"), F.col(text_col).alias("text"))
    terms = term_lists(q, "query_id", "text", index.stop_words, 1).select("query_id", F.explode("terms").alias("term"))
    stats = index.totals.withColumn("idf", F.log(1.0 + (F.lit(index.n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    held = (terms.join(stats.select("term", "idf"), "term").groupBy("query_id")
            .agg(F.sort_array(F.collect_list(F.struct("term", "idf"))).alias("t"))
            .select("query_id", F.col("t.term").alias("terms"), F.col("t.idf").alias("weights")))
    held = materialize(held, "bm25-queries")
    docs = index.vectors.select(F.col("doc_id").alias("id"), "terms", "weights")
    return block_top_k(docs, held, _prepare, _scorer(False), k, **_size(held), pack_rows=PACK_ROWS)
