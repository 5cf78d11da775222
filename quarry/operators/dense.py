"""Dense-vector retrieval.

* ``hash_embed`` — the offline default embedder: feature hashing of lexical
  tokens (MD5 prefix modulo ``dim`` slots), term-frequency weighted, L2
  normalised.  Slots are computed in the JVM; only int arrays reach Python,
  where numpy counts them.  Any other embedder can be plugged in through
  ``embed_texts`` (an Arrow-batched ``texts -> matrix`` callable).
* ``dense_search`` — exact cosine top-k for many queries, block by block (see
  ``blocks``); a group column restricts which blocks meet at all.
* ``dense_search_one`` — single query: a JVM-only cosine expression and a
  global ``orderBy().limit`` (TakeOrderedAndProject).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import text as tx
from quarry.operators.blocks import TIE_DECIMALS, block_top_k
from quarry.operators.slices import ELEMENTS, series_slices
from quarry.session import materialize

HASH_DIM = 64
DEFAULT_K = 10


# --- embedding ---------------------------------------------------------------------------

def hash_slots(text: Column | str, dim: int = HASH_DIM) -> Column:
    """Slot of every lexical token: first 8 hex digits of its MD5, modulo ``dim``."""
    return F.transform(tx.tokens(text), lambda t: F.pmod(
        F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int"))


def _slots_to_vectors(dim: int):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def to_vec(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        # one bincount for a slice of a batch: cell = row * dim + slot
        for slots in series_slices(batches, ELEMENTS):
            lens = np.fromiter((len(x) for x in slots), dtype=np.int64, count=len(slots))
            flat = np.concatenate([np.asarray(x, dtype=np.int64) for x in slots]) if lens.sum() else np.zeros(0, np.int64)
            rows = np.repeat(np.arange(len(slots), dtype=np.int64), lens)
            m = np.bincount(rows * dim + flat, minlength=len(slots) * dim).astype(np.float64).reshape(len(slots), dim)
            yield pd.Series(list(_unit_rows(m)))

    return to_vec


def hash_embed(df: DataFrame, text_col: str = "text", out_col: str = "embedding",
               dim: int = HASH_DIM) -> DataFrame:
    """Add ``out_col`` (array<double>, unit length or all zeros)."""
    staged = df.withColumn("_slots", hash_slots(text_col, dim))
    return staged.withColumn(out_col, _slots_to_vectors(dim)(F.col("_slots"))).drop("_slots")


def embed_texts(df: DataFrame, embed: Callable[[list[str]], np.ndarray], dim: int,
                text_col: str = "text", out_col: str = "embedding") -> DataFrame:
    """Plug-in embedder: ``embed(list_of_texts) -> (n, dim) array`` per Arrow batch."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(texts: pd.Series) -> pd.Series:
        m = np.asarray(embed(texts.fillna("").tolist()), dtype=np.float64).reshape(len(texts), dim)
        return pd.Series(list(m))

    return df.withColumn(out_col, run(F.col(text_col)))


# --- exact search -----------------------------------------------------------------------

def cosine(a: Column, b: Column) -> Column:
    """Cosine of two numeric arrays (doubles), 0 when either has zero length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                      lambda acc, x: acc + x)
    na = F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    nb = F.sqrt(F.aggregate(b, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.when((na > 0) & (nb > 0), dot / (na * nb)).otherwise(F.lit(0.0))


def dense_search_one(corpus: DataFrame, query: list[float], k: int = DEFAULT_K, id_col: str = "doc_id",
                     vec_col: str = "embedding", min_score: float | None = None) -> DataFrame:
    """Single-query exact cosine top-k: (rank, doc_id, score); ties by id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = corpus.select(F.col(id_col).alias("doc_id"), cosine(F.col(vec_col), q).alias("score"))
    if min_score is not None:
        scored = scored.where(F.col("score") >= min_score)
    top = scored.orderBy(F.desc(F.round("score", TIE_DECIMALS)), "doc_id").limit(k)
    return top.withColumn("rank", F.row_number().over(
        Window.orderBy(F.desc(F.round("score", TIE_DECIMALS)), "doc_id"))).select("rank", "doc_id", "score")


def _unit_rows(m: np.ndarray) -> np.ndarray:
    n = np.sqrt(np.einsum("ij,ij->i", m, m))
    out = np.zeros_like(m)
    nz = n > 0
    out[nz] = m[nz] / n[nz, None]
    return out


def usable(vec: Column) -> Column:
    """Whether a vector can be scored: not null, no null and no NaN inside.  Others
    are skipped by the searches; ``rejected_vectors`` lists them."""
    return vec.isNotNull() & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x))


def rejected_vectors(vectors: DataFrame, dim: int, id_col: str = "doc_id", vec_col: str = "embedding") -> DataFrame:
    """(id, reason) of the rows that a search with ``dim`` components skips or refuses."""
    v = F.col(vec_col)
    return (vectors.select(F.col(id_col), F.when(v.isNull(), "missing").when(F.size(v) != dim, "wrong length")
                           .when(~usable(v), "not a number").alias("reason")).where(F.col("reason").isNotNull()))


def _matrix(rows: pa.Array, dim: int) -> np.ndarray:
    vectors = rows.field("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(vectors) != len(rows) * dim or not (np.asarray(pc.list_value_length(rows.field("v"))) == dim).all():
        raise ValueError(f"a vector does not have {dim} components; see rejected_vectors()")
    return _unit_rows(vectors.reshape(len(rows), dim))


# The least value of a group's type: comparing with it holds for all but nulls, and counts
# as a filter where Spark decides whether to prune partitions at run time.
_LEAST = {"tinyint": -2**7, "smallint": -2**15, "int": -2**31, "bigint": -2**63, "string": ""}


def only_groups(corpus: DataFrame, queries: DataFrame, group_col: str, query_group_col: str) -> DataFrame:
    """The documents of the queries' groups, in place.  A corpus that is stored partitioned by
    its group is pruned at run time: files of other groups are not read."""
    kind = queries.schema[query_group_col].dataType.simpleString()
    asked = queries.where(F.col(query_group_col) >= F.lit(_LEAST[kind])) if kind in _LEAST else queries.where(F.col(query_group_col).isNotNull())
    asked = asked.select(F.col(query_group_col).alias("_asked")).distinct()
    return corpus.join(F.broadcast(asked), F.col(group_col) == F.col("_asked"), "left_semi")  # at most one row per group


def dense_search(corpus: DataFrame, queries: DataFrame, k: int = DEFAULT_K, id_col: str = "doc_id",
                 vec_col: str = "embedding", query_id_col: str = "query_id", query_vec_col: str = "embedding",
                 group_col: str | None = None, query_group_col: str | None = None,
                 min_score: float | None = None, skip_other_lengths: bool = False) -> DataFrame:
    """Exact cosine top-k for every query: (query_id, rank, doc_id, score).

    With ``group_col``/``query_group_col`` a document only meets queries of its
    group (cluster-restricted search; an array of groups gives a query several).
    With ``min_score`` only documents at or above the threshold are returned.
    Ids keep their type.  All usable query vectors must have one length; corpus
    vectors of another raise, or are left out if the caller says so.
    """
    q = queries.select(F.col(query_id_col).alias("query_id"), F.col(query_vec_col).cast("array<double>").alias("v"),
                       *([F.col(query_group_col).alias("grp")] if query_group_col else [])).where(usable(F.col("v")))
    if query_group_col and isinstance(q.schema["grp"].dataType, T.ArrayType):
        q = q.select("query_id", "v", F.explode("grp").alias("grp"))
    if group_col:
        q = materialize(q, "query-groups")  # the groups and the vectors are read apart
        corpus = only_groups(corpus, q, group_col, "grp")
    seen = q.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("v")).alias("lo"), F.max(F.size("v")).alias("hi")).first()
    if seen["lo"] != seen["hi"]:
        raise ValueError(f"query vectors have {seen['lo']} to {seen['hi']} components")
    dim = seen["hi"] or 0
    x = corpus.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"),
                      *([F.col(group_col).alias("grp")] if group_col else [])).where(usable(F.col("v")))
    if skip_other_lengths:
        x = x.where(F.size("v") == dim)

    def prepare(rows: pa.Array) -> np.ndarray:
        return _matrix(rows, dim)

    def score(ready: np.ndarray, docs: pa.Array) -> np.ndarray:
        s = ready @ _matrix(docs, dim).T
        return s if min_score is None else np.where(s >= min_score, s, -np.inf)

    return block_top_k(x, q, prepare, score, k, seen["n"], match_group=group_col is not None, row_bytes=8 * dim + 64).select(
        "query_id", "rank", "doc_id", "score")


# --- approximate search (inverted lists) --------------------------------------------------

def nearest_lists(df: DataFrame, centres: np.ndarray, n: int = 1, vec_col: str = "embedding",
                  out_col: str = "list_id") -> DataFrame:
    """Add the ``n`` nearest centres by cosine (int, or array<int> when n > 1)."""
    cn = _unit_rows(np.asarray(centres, dtype=np.float64))
    d = cn.shape[1]
    out_type = T.IntegerType() if n == 1 else T.ArrayType(T.IntegerType())
    schema = T.StructType(list(df.schema.fields) + [T.StructField(out_col, out_type)])

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows == 0:
                continue
            flat = b.column(vec_col).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            s = _unit_rows(flat.reshape(b.num_rows, d)) @ cn.T
            order = np.argsort(-s, axis=1, kind="stable")[:, :n].astype(np.int32)
            arr = pa.array(order[:, 0]) if n == 1 else pa.array(order.tolist(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(list(b.columns) + [arr], names=list(b.schema.names) + [out_col])

    return df.mapInArrow(fn, schema)


def ann_search(corpus: DataFrame, queries: DataFrame, centres: np.ndarray, k: int = DEFAULT_K, nprobe: int = 3,
               id_col: str = "doc_id", vec_col: str = "embedding", query_id_col: str = "query_id",
               query_vec_col: str = "embedding", list_col: str | None = None) -> DataFrame:
    """Approximate cosine top-k: each query meets only the documents of its
    ``nprobe`` nearest lists (inverted-file search), by a join on the list.
    ``corpus`` may already carry its list id in ``list_col`` (e.g. stored
    partitioned by it)."""
    if list_col is None:
        corpus, list_col = nearest_lists(corpus, centres, 1, vec_col, "list_id"), "list_id"
    q = nearest_lists(queries, centres, nprobe, query_vec_col, "_probe")
    return dense_search(corpus, q, k=k, id_col=id_col, vec_col=vec_col, query_id_col=query_id_col,
                        query_vec_col=query_vec_col, group_col=list_col, query_group_col="_probe")


# --- upkeep ------------------------------------------------------------------------------

def vector_audit(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row: rows, distinct ids, min/max dimension, vectors with NaN, zero vectors."""
    v = F.col(vec_col)
    has_nan = F.exists(v, lambda x: F.isnan(x))
    is_zero = F.forall(v, lambda x: x == 0)
    return vectors.agg(
        F.count(F.lit(1)).cast("long").alias("n_rows"),
        F.countDistinct(id_col).cast("long").alias("n_ids"),
        F.min(F.size(v)).cast("long").alias("min_dim"),
        F.max(F.size(v)).cast("long").alias("max_dim"),
        F.sum(F.when(has_nan, 1).otherwise(0)).cast("long").alias("n_nan"),
        F.sum(F.when(is_zero, 1).otherwise(0)).cast("long").alias("n_zero"),
        F.sum(F.when(v.isNull(), 1).otherwise(0)).cast("long").alias("n_null"),
    )
