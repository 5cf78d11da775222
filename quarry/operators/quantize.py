"""Approximate cosine search over product-quantised vectors, with an exact re-rank.

Unit vectors are cut into ``parts`` pieces and each piece is coded by the nearest of 256
centres: one byte a piece.  The centres of all pieces are fitted together by Lloyd rounds;
a round is one pass over the training rows whose sums are combined per (piece, code).

``write_store`` keeps codes and vectors as two tables: a search scans the codes, and of the
vectors only the files that hold a shortlisted id (they are partitioned by a hash of it,
and pruned at run time).  A query's inner products with all centres are tables; looking a
code's bytes up in them and adding gives its approximate cosine.  The ``shortlist`` best per
query are scored exactly, in double precision, so scores are exact and only recall is not.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.blocks import TIE_DECIMALS, block_top_k
from quarry.operators.dense import DEFAULT_K, _unit_rows, cosine, usable
from quarry.session import materialize

PARTS = 16
CODES = 256
ROUNDS = 8
TRAIN_ROWS = 100_000
SHORTLIST = 100
FILES = 64
# Cells of a (rows x codes) distance matrix.
CELLS = 1 << 22


@dataclass
class Codebooks:
    centres: np.ndarray  # (parts, codes, components of a part)

    @property
    def dim(self) -> int:
        return self.centres.shape[0] * self.centres.shape[2]

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [(p, c, x.tolist()) for p, part in enumerate(self.centres) for c, x in enumerate(part)]
        return spark.createDataFrame(rows, "part int, code int, centre array<double>")

    @staticmethod
    def from_df(df: DataFrame) -> Codebooks:
        rows = sorted(df.collect())  # parts x 256
        parts, codes = rows[-1]["part"] + 1, rows[-1]["code"] + 1
        return Codebooks(np.array([r["centre"] for r in rows]).reshape(parts, codes, -1))


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return _unit_rows(flat.reshape(len(column), dim))


def encode(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """(rows, parts) codes of unit vectors; ties go to the smaller code."""
    parts, codes, width = centres.shape
    out = np.empty((len(x), parts), np.uint8)
    step = max(1, CELLS // codes)
    for p in range(parts):
        c = centres[p]
        half = (c * c).sum(axis=1) / 2
        for lo in range(0, len(x), step):
            out[lo:lo + step, p] = np.argmax(x[lo:lo + step, p * width:(p + 1) * width] @ c.T - half, axis=1)
    return out


def _piece_sums(sent, dim: int):
    """One row per (piece, code) that a task has seen: its rows and their sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = sent.value
        parts, codes, width = centres.shape
        n, sums = np.zeros(parts * codes, np.int64), np.zeros((parts * codes, width))
        for batch in batches:
            x = _unit(batch.column("v"), dim)
            cell = (encode(x, centres) + np.arange(parts) * codes).ravel()
            n += np.bincount(cell, minlength=parts * codes)
            np.add.at(sums, cell, x.reshape(-1, width))
        at = np.flatnonzero(n)
        columns = [pa.array(at // codes, pa.int32()), pa.array(at % codes, pa.int32()), pa.array(n[at])]
        columns += [pa.array(sums[at, i]) for i in range(width)]
        yield pa.RecordBatch.from_arrays(columns, ["part", "code", "n", *(f"s{i}" for i in range(width))])

    return run


def train(vectors: DataFrame, parts: int = PARTS, vec_col: str = "embedding", id_col: str = "vec_id", rounds: int = ROUNDS,
          train_rows: int = TRAIN_ROWS) -> Codebooks:
    """Fit the codebooks on about ``train_rows`` rows (all, if there are fewer), picked by a hash."""
    x = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(usable(F.col("v")))
    seen = x.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("v")).alias("lo"), F.max(F.size("v")).alias("hi")).first()
    if not seen["n"]:
        raise ValueError("no vector to train on")
    dim = seen["hi"]
    if seen["lo"] != dim or dim % parts:
        raise ValueError(f"vectors must have one length, divisible by {parts}")
    share = max(1, seen["n"] // train_rows)
    sample = x.where(F.pmod(F.xxhash64("id", F.lit("train")), F.lit(share)) == 0) if share > 1 else x
    sample = materialize(sample.select("id", "v"), "quantizer-sample")
    first = sample.orderBy(F.xxhash64("id", F.lit("start")), "id").limit(CODES).collect()
    start = _unit_rows(np.array([r["v"] for r in first], float))
    width = dim // parts
    centres = np.ascontiguousarray(start.reshape(len(first), parts, width).swapaxes(0, 1))
    spark = vectors.sparkSession
    sums = [f"s{i}" for i in range(width)]
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("code", T.IntegerType()), T.StructField("n", T.LongType()),
                           *[T.StructField(c, T.DoubleType()) for c in sums]])
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(centres)
        rows = (sample.select("v").mapInArrow(_piece_sums(sent, dim), schema).groupBy("part", "code")
                .agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in sums]).collect())  # parts x 256
        after = centres.copy()
        for r in rows:
            after[r["part"], r["code"]] = np.array([r[c] for c in sums]) / r["n"]
        moved = np.abs(after - centres).max()
        centres = after
        if moved < 1e-6:
            break
    return Codebooks(centres)


def with_codes(vectors: DataFrame, books: Codebooks, vec_col: str = "embedding") -> DataFrame:
    """Usable vectors of the codebooks' length with their ``code`` (one byte a piece)."""
    x = vectors.where(usable(F.col(vec_col)) & (F.size(vec_col) == books.dim))
    schema = T.StructType([*x.schema.fields, T.StructField("code", T.BinaryType())])
    sent, dim = vectors.sparkSession.sparkContext.broadcast(books.centres), books.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = encode(_unit(batch.column(vec_col), dim), sent.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary())], [*batch.schema.names, "code"])

    return x.mapInArrow(run, schema)


def _file_of(id_col: str, files: int):
    return F.pmod(F.xxhash64(id_col), F.lit(files)).cast("int")


def write_store(vectors: DataFrame, books: Codebooks, path: str, id_col: str = "vec_id", vec_col: str = "embedding", files: int = FILES) -> None:
    """Codes, vectors (partitioned by ``files`` hashes of the id) and codebooks under ``path``."""
    coded = with_codes(vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")), books, "v")
    coded = materialize(coded.withColumn("file", _file_of("id", files)), "coded")
    coded.select("id", "code").write.parquet(os.path.join(path, "codes"))
    (coded.select("id", "v", "file").repartitionByRange("file", "id").sortWithinPartitions("file", "id")
     .write.partitionBy("file").parquet(os.path.join(path, "vectors")))
    spark = vectors.sparkSession
    books.to_df(spark).write.parquet(os.path.join(path, "codebooks"))
    schema = ", ".join(f"{c} {coded.schema[c].dataType.simpleString()}" for c in ("id", "v"))
    spark.createDataFrame([(files, schema)], "files int, schema string").coalesce(1).write.parquet(os.path.join(path, "layout"))


def approximate(codes: DataFrame, books: Codebooks, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, doc_id, score): top-k by approximate cosine; ``codes``: (id, code),
    ``queries``: (query_id, v) of the codebooks' length."""
    parts, _, width = books.centres.shape
    centres, dim = books.centres, books.dim

    def prepare(rows: pa.StructArray) -> np.ndarray:
        q = _unit(rows.field("v"), dim).reshape(len(rows), parts, width)
        return np.einsum("qpw,pcw->pqc", q, centres)

    def score(tables: np.ndarray, docs: pa.StructArray) -> np.ndarray:
        code = np.frombuffer(b"".join(docs.field("code").to_pylist()), np.uint8).reshape(len(docs), parts)
        out = tables[0][:, code[:, 0]]
        for p in range(1, parts):
            out = out + tables[p][:, code[:, p]]
        return out

    return block_top_k(codes, queries, prepare, score, k, queries.count(), query_rows=64, row_bytes=8 * dim + 64)


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = DEFAULT_K, query_id_col: str = "query_id",
           query_vec_col: str = "embedding", shortlist: int = SHORTLIST) -> DataFrame:
    """Cosine top-k of a store: (query_id, rank, doc_id, score), ties by id; scores are exact.
    Of the exact vectors, only files with a shortlisted id are read."""
    books = Codebooks.from_df(spark.read.parquet(os.path.join(path, "codebooks")))
    q = materialize(queries.select(F.col(query_id_col).alias("query_id"), F.col(query_vec_col).cast("array<double>").alias("v"))
                    .where(usable(F.col("v")) & (F.size("v") == books.dim)), "coded-queries")
    short = materialize(approximate(spark.read.parquet(os.path.join(path, "codes")), books, q, max(shortlist, k))
                        .select("query_id", F.col("doc_id").alias("id")), "shortlist")
    scored = candidates(spark, path, short).join(q.withColumnRenamed("v", "q"), "query_id").select(
        "query_id", F.col("id").alias("doc_id"), cosine(F.col("v").cast("array<double>"), F.col("q")).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", TIE_DECIMALS)), "doc_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def candidates(spark: SparkSession, path: str, short: DataFrame) -> DataFrame:
    """(query_id, id, v) of the shortlist (query_id, id), from the files that hold its ids."""
    layout = spark.read.parquet(os.path.join(path, "layout")).first()
    files = layout["files"]
    vectors = spark.read.schema(f"{layout['schema']}, file int").parquet(os.path.join(path, "vectors"))
    wanted = short.withColumn("file", _file_of("id", files))
    held = wanted.where(F.col("file") >= 0).select("file").distinct()  # a filter, so that the scan is pruned at run time
    return vectors.join(F.broadcast(held), "file", "left_semi").join(wanted, ["file", "id"]).select("query_id", "id", "v")
