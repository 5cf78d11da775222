"""Latent semantic vectors: a truncated SVD of the TF-IDF table, learnt from the corpus.

The right singular vectors of the (documents x terms) table are found by randomised subspace
iteration: from a random block of ``dim`` and some spare columns, every round multiplies the
block by the table and by its transpose.  A task does both products for its Arrow batches and
emits one row per term that it has seen; rows are summed by term.  What reaches the driver is
(terms x columns), bounded by the vocabulary's size, and is made orthonormal there.  A
Rayleigh-Ritz step turns the last block into singular values and vectors.

A document or query is embedded as its TF-IDF weights times the ``dim`` vectors, at unit
length: a plug-in for the places that take a vector column.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators import lexical
from quarry.operators.dense import _unit_rows
from quarry.session import materialize

DIM = 64
SPARE = 10
ROUNDS = 4
SEED = 10
ROWS = 2048


@dataclass
class LatentModel:
    terms: list[str]
    vectors: np.ndarray  # (terms, dim), columns by falling singular value
    singular: np.ndarray

    @property
    def dim(self) -> int:
        return self.vectors.shape[1]


def _products(rows: pa.RecordBatch, names: pa.Array, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows: (row, term, weight) of each known entry, and rows x block."""
    terms = rows.column("terms")
    at = pc.index_in(terms.flatten(), value_set=names)
    known = np.asarray(at.is_valid())
    row = np.repeat(np.arange(rows.num_rows), np.asarray(pc.fill_null(pc.list_value_length(terms), 0)))[known]
    term = np.asarray(at.drop_null()).astype(np.int64)
    weight = rows.column("weights").flatten().to_numpy(zero_copy_only=False)[known]
    return row, term, weight, _sums(row, block[term] * weight[:, None], rows.num_rows)


def _sums(where: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of ``values`` that go to one place."""
    out = np.zeros((n, values.shape[1]))
    if len(where):
        order = np.argsort(where, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(where[order]) > 0]))
        out[where[order][first]] = np.add.reduceat(values[order], first, axis=0)
    return out


def _round(sent):
    """One row per term seen by the task: its row of (transpose x table x block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, block = sent.value
        names = pa.array(terms, pa.string())
        out, seen = np.zeros(block.shape), np.zeros(len(block), bool)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                row, term, weight, x = _products(batch.slice(lo, ROWS), names, block)
                out += _sums(term, x[row] * weight[:, None], len(block))
                seen[term] = True
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(out[at, j]) for j in range(block.shape[1]))],
                                         ["term", *(f"x{j}" for j in range(block.shape[1]))])

    return run


def fit(index: lexical.LexicalIndex, dim: int = DIM, spare: int = SPARE, rounds: int = ROUNDS) -> LatentModel:
    """The ``dim`` leading right singular vectors of the index's vectors."""
    if index.max_features is None:
        raise ValueError("the vocabulary must be bounded: (terms x columns) numbers reach the driver")
    spark = index.vectors.sparkSession
    terms = sorted(r["term"] for r in index.vocab.select("term").collect())  # at most max_features
    width = min(dim + spare, len(terms))
    if not width:
        return LatentModel([], np.zeros((0, 0)), np.zeros(0))
    block = np.linalg.qr(np.random.default_rng(SEED).standard_normal((len(terms), width)))[0]
    columns = [f"x{j}" for j in range(width)]
    schema = T.StructType([T.StructField("term", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in columns]])
    table = index.vectors.select("terms", "weights")
    for last in [False] * rounds + [True]:
        sent = spark.sparkContext.broadcast((terms, block))
        sums = table.mapInArrow(_round(sent), schema).groupBy("term").agg(*[F.sum(c).alias(c) for c in columns])
        image = np.zeros_like(block)
        for r in sums.collect():  # the vocabulary's terms
            image[r["term"]] = [r[c] for c in columns]
        if last:  # Rayleigh-Ritz: the block spans the space, its small image tells the vectors apart
            small = block.T @ image
            values, turn = np.linalg.eigh((small + small.T) / 2)
            order = np.argsort(-values)[:dim]
            return LatentModel(terms, _fixed_signs(block @ turn[:, order]), np.sqrt(np.maximum(values[order], 0)))
        block = np.linalg.qr(image)[0]
    raise AssertionError("the last round returns")


def _fixed_signs(vectors: np.ndarray) -> np.ndarray:
    """The largest component of every vector is positive."""
    at = np.argmax(np.abs(vectors), axis=0)
    return vectors * np.where(vectors[at, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)


def embed_weights(rows: DataFrame, model: LatentModel, out_col: str = "embedding") -> DataFrame:
    """Rows with ``terms`` and ``weights`` get their latent vector (unit length, or zeros)."""
    schema = T.StructType([*(f for f in rows.schema.fields if f.name not in ("terms", "weights")),
                           T.StructField(out_col, T.ArrayType(T.DoubleType()))])
    sent, dim = rows.sparkSession.sparkContext.broadcast((model.terms, model.vectors)), model.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(sent.value[0], pa.string())
        for batch in batches:
            rest = [n for n in batch.schema.names if n not in ("terms", "weights")]
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                x = _unit_rows(_products(part, names, sent.value[1])[3])
                ends = pa.array(np.arange(part.num_rows + 1) * dim, pa.int32())
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in rest), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))],
                                                 [*rest, out_col])

    return rows.mapInArrow(run, schema)


def embed_documents(index: lexical.LexicalIndex, model: LatentModel) -> DataFrame:
    """(doc_id, embedding) of the index's documents."""
    return embed_weights(index.vectors.select("doc_id", "terms", "weights"), model)


def embed_queries(index: lexical.LexicalIndex, model: LatentModel, queries: DataFrame, id_col: str = "query_id",
                  text_col: str = "text") -> DataFrame:
    """(query_id, embedding) of texts, folded in by the index's vocabulary."""
    q = queries.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    lists = lexical.term_lists(q, "doc_id", "text", index.stop_words, index.ngram_max)
    weighed = materialize(lexical.weigh_lists(lists.select("doc_id", "terms", "tfs"), index.vocab, index.max_features), "folded")
    return embed_weights(weighed, model).withColumnRenamed("doc_id", "query_id")
