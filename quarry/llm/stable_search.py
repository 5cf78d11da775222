"""Nearest neighbours by low-dimensional stable projections and kd-trees.

``build_index`` multiplies every vector by a few Gaussian columns.  A normal
distribution is 2-stable: for two vectors at distance r, the squared distance of
their projections over r^2 follows a chi-square law with as many degrees of freedom
as columns.  Each run of rows is put into the order of a kd-tree over its projections;
the index is a stored table of (id, vector, projection, leaf) rows in that order.

``search`` visits, for each query and run, the kd-tree's leaves from the nearest box
outwards.  Projected neighbours are verified by their distance in double precision
until the stopping test holds: the next projected distance, squared and over the
query's k-th distance squared, reaches the chi-square quantile of ``confidence``.  A
neighbour nearer than that k-th distance is then unseen with a probability of at
most 1 - confidence, which bounds the loss of recall.  The k-th distances start from a
search of a sixteenth of the index; every task sees all rows of its part, so no
candidate is capped.

Queries go out in blocks of ``BLOCK_BYTES``, whatever their number.  A task hands on
at most k rows a query; the last step ranks those.

Vectors that are null, zero or hold a null or non-finite component take no part;
a query meets vectors of its own length only.  The own row is left out by its id, so
rows that repeat a query's id are no candidates of it; repeated rows of other ids
are.  Fully repeated query rows are one query; a null id is no query, and as a
candidate comes last among equal distances.  Other columns are not read, so their
names cannot clash.  Empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quarry.llm.common import stage
from quarry.llm.ranked import best_rows

COLUMNS = 16  # projections; an even number, for the chi-square law's closed form
CONFIDENCE = 0.99
LEAF_ROWS = 32
BLOCK_BYTES = 8 << 20
SEED = 20
SEED_SHARE = 16
# (query, vector) pairs that are looked at together
TILE = 1 << 18


def chi_square_cdf(x: float, degrees: int) -> float:
    """For an even number of degrees of freedom."""
    term = total = 1.0
    for i in range(1, degrees // 2):
        term *= x / 2 / i
        total += term
    return 1.0 - math.exp(-x / 2) * total


def chi_square_quantile(p: float, degrees: int) -> float:
    lo, hi = 0.0, 1.0
    while chi_square_cdf(hi, degrees) < p:
        hi *= 2
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square_cdf(mid, degrees) < p else (lo, mid)
    return hi


def projection(length: int, columns: int) -> np.ndarray:
    """The Gaussian columns for vectors of one length, the same in every task."""
    return np.random.default_rng([SEED, length, columns]).standard_normal((length, columns))


def kd_order(points: np.ndarray, leaf_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers in kd-tree order and the leaf of each: halves at the median of the
    widest coordinate until a part is no longer than ``leaf_rows``."""
    order, leaf = np.arange(len(points)), np.zeros(len(points), np.int64)
    parts, leaves = [(0, len(points))], 0
    while parts:
        lo, hi = parts.pop()
        if hi - lo <= leaf_rows:
            leaf[lo:hi] = leaves
            leaves += 1
            continue
        part = points[order[lo:hi]]
        axis = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
        half = (hi - lo) // 2
        order[lo:hi] = order[lo:hi][np.argpartition(part[:, axis], half)]
        parts += [(lo + half, hi), (lo, lo + half)]
    return order, leaf


def _usable(v: str):
    """Not null, of some length, all components finite, not all zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(v).isNotNull() & ~bad & F.exists(v, lambda x: x != 0)


def _rows_of_length(batch: pa.RecordBatch, name: str):
    """(row numbers, matrix) for each length of vector in the batch."""
    lists = batch.column(name)
    sizes = np.asarray(pc.list_value_length(lists))
    starts = np.cumsum(sizes) - sizes
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    for length in np.unique(sizes):
        at = np.flatnonzero(sizes == length)
        yield int(length), at, flat[starts[at][:, None] + np.arange(length)]


def _lists(matrix: np.ndarray) -> pa.ListArray:
    n, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(matrix.ravel()))


def _projected(columns: int, leaf_rows: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, at, matrix in _rows_of_length(batch, "v"):
                low = matrix @ projection(length, columns)
                order, leaf = kd_order(low, leaf_rows)
                rows = batch.take(pa.array(at[order]))
                yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("v"), _lists(low[order]), pa.array(leaf)], schema=schema)

    return run


def build_index(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", columns: int = COLUMNS,
                leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """The stored index (id, v, p, leaf) of all usable vectors."""
    v = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(_usable("v"))
    schema = T.StructType([T.StructField("id", v.schema["id"].dataType), T.StructField("v", T.ArrayType(T.DoubleType())),
                           T.StructField("p", T.ArrayType(T.DoubleType())), T.StructField("leaf", T.LongType())])
    return stage(v.mapInArrow(_projected(columns, leaf_rows, to_arrow_schema(schema)), schema), "stable-index")


def _box_distances(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Squared distance of each query to each box, coordinate by coordinate."""
    out = np.zeros((len(q), len(lo)))
    for j in range(q.shape[1]):
        gap = np.maximum(np.maximum(lo[None, :, j] - q[:, None, j], q[:, None, j] - hi[None, :, j]), 0.0)
        out += gap * gap
    return out


def _distances(q: np.ndarray, x: np.ndarray, qi: np.ndarray, xi: np.ndarray) -> np.ndarray:
    gap = q[qi] - x[xi]
    return (gap * gap).sum(axis=1)


class _Nearest:
    """The best k of each query so far; ``far`` is the k-th distance."""

    def __init__(self, far: np.ndarray, k: int, schema: pa.Schema):
        self.far, self.k, self.schema, self.best = far.copy(), k, schema, schema.empty_table()

    def add(self, query: np.ndarray, ids: pa.Array, score: np.ndarray) -> None:
        found = pa.Table.from_arrays([pa.array(query), ids, pa.array(score)], schema=self.schema)
        again = pa.array(np.isin(np.asarray(self.best.column("query")), np.unique(query)))
        merged = best_rows(pa.concat_tables([self.best.filter(again), found]), "query", [("score", "ascending"), ("id", "ascending")], self.k)
        who, scores = np.asarray(merged.column("query")), np.asarray(merged.column("score"))
        most = np.zeros(len(self.far))
        np.maximum.at(most, who, scores)
        full = np.flatnonzero(np.bincount(who, minlength=len(self.far)) == self.k)
        self.far[full] = np.minimum(self.far[full], most[full])
        self.best = pa.concat_tables([self.best.filter(pc.invert(again)), merged])


def _visit(state: _Nearest, numbers: np.ndarray, q: np.ndarray, low: np.ndarray, own: np.ndarray, x: np.ndarray, p: np.ndarray,
           ids: pa.Array, same: np.ndarray, leaf: np.ndarray, stop: float) -> None:
    """All queries against one run of index rows, leaf by leaf.  ``own`` and ``same`` mark
    rows of a query's own id."""
    first = np.flatnonzero(np.concatenate([[True], leaf[1:] != leaf[:-1]]))
    ends = np.append(first[1:], len(leaf))
    lo, hi = np.minimum.reduceat(p, first), np.maximum.reduceat(p, first)
    step = max(1, TILE // len(first))
    for a in range(0, len(q), step):
        boxes = _box_distances(low[a:a + step], lo, hi)
        order = np.argsort(boxes, axis=1, kind="stable")
        boxes = np.take_along_axis(boxes, order, 1)
        begin, width = 0, 1
        active = np.arange(len(order))
        while begin < order.shape[1] and len(active):
            qi, rank = np.repeat(active, min(width, order.shape[1] - begin)), np.tile(np.arange(begin, min(begin + width, order.shape[1])), len(active))
            # of leaves that the stopping test does not rule out yet
            near = boxes[qi, rank] <= stop * state.far[numbers[a + qi]] ** 2
            qi, at = qi[near], order[qi[near], rank[near]]
            cuts = np.cumsum(ends[at] - first[at])
            lo_pair = 0
            while lo_pair < len(qi):
                hi_pair = max(lo_pair + 1, int(np.searchsorted(cuts, (cuts[lo_pair - 1] if lo_pair else 0) + TILE, "right")))
                leaves = at[lo_pair:hi_pair]
                n = ends[leaves] - first[leaves]
                who = a + np.repeat(qi[lo_pair:hi_pair], n)
                row = np.repeat(first[leaves] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                keep = (_distances(low, p, who, row) <= stop * state.far[numbers[who]] ** 2) & (own[who] != same[row])
                who, row = who[keep], row[keep]
                score = np.sqrt(_distances(q, x, who, row))
                keep = score <= state.far[numbers[who]]
                if keep.any():
                    state.add(numbers[who[keep]], ids.take(pa.array(row[keep])), score[keep])
                lo_pair = hi_pair
            begin += width
            width *= 2
            if begin < order.shape[1]:
                active = active[boxes[active, begin] <= stop * state.far[numbers[a + active]] ** 2]


def _searcher(shipped, stop: float, k: int, schema: pa.Schema):
    """Index rows to each query's best k of the task: (query, id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, far, known = shipped.value
        state = _Nearest(far, k, schema)
        for batch in batches:
            for length, at, matrix in _rows_of_length(batch, "v"):
                if length not in queries:
                    continue
                numbers, q, low, own = queries[length]
                part = batch.take(pa.array(at))
                p = part.column("p").flatten().to_numpy().reshape(len(at), -1)
                same = np.asarray(pc.fill_null(pc.index_in(part.column("id"), value_set=known), -1))
                _visit(state, numbers, q, low, own, matrix, p, part.column("id"), same, part.column("leaf").to_numpy(), stop)
        yield from state.best.combine_chunks().to_batches()

    return run


def _search_block(index: DataFrame, rows: list, k: int, columns: int, confidence: float) -> DataFrame:
    """The ranking of one block of queries, staged."""
    spark = index.sparkSession
    kind = index.schema["id"].dataType
    raw = T.StructType([T.StructField("query", T.LongType()), T.StructField("id", kind), T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(raw)
    known = pa.array(sorted({r["id"] for r in rows}), arrow.field("id").type)
    place = {x: i for i, x in enumerate(known.to_pylist())}
    queries = {}
    for length in {len(r["v"]) for r in rows}:
        numbers = np.array([i for i, r in enumerate(rows) if len(r["v"]) == length], np.int64)
        q = np.array([rows[i]["v"] for i in numbers], np.float64)
        queries[length] = (numbers, q, q @ projection(length, columns), np.array([place[rows[i]["id"]] for i in numbers]))

    def top(part: DataFrame, far: np.ndarray) -> DataFrame:
        sent = spark.sparkContext.broadcast((queries, far, known))
        hits = part.mapInArrow(_searcher(sent, chi_square_quantile(confidence, columns), k, arrow), raw)
        w = Window.partitionBy("query").orderBy("score", F.asc_nulls_last("id"))
        return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    far = np.full(len(rows), np.inf)
    for r in top(index.where(F.pmod(F.xxhash64("id"), F.lit(SEED_SHARE)) == 0), far).where(F.col("rank") == k).collect():
        far[r["query"]] = r["score"]  # a number per query of the block
    ids = spark.createDataFrame([(i, r["id"]) for i, r in enumerate(rows)],
                                T.StructType([T.StructField("query", T.LongType()), T.StructField("query_id", kind)]))
    ranked = top(index, far).join(F.broadcast(ids), "query")  # the block's queries
    return stage(ranked.select("query_id", "rank", F.col("id").alias("vec_id"), "score"), "stable-ranked")


def search(index: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
           columns: int = COLUMNS, confidence: float = CONFIDENCE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest index rows by Euclidean
    distance, ties to the smaller id.  ``columns`` is the index's own number."""
    spark = index.sparkSession
    q = queries.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    q = q.where(F.col("id").isNotNull() & _usable("v")).distinct()
    total = q.agg(F.sum(8 * F.size("v")).alias("b")).first()["b"] or 0
    blocks = max(1, -(-total // block_bytes))
    parts = []
    for b in range(blocks):
        rows = q.where(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)) == b).collect()  # about block_bytes
        if rows:
            parts.append(_search_block(index, rows, k, columns, confidence))
    if parts:
        return reduce(DataFrame.unionByName, parts)
    kind = index.schema["id"].dataType
    return spark.createDataFrame([], T.StructType([T.StructField("query_id", kind), T.StructField("rank", T.IntegerType()),
                                                   T.StructField("vec_id", kind), T.StructField("score", T.DoubleType())]))
