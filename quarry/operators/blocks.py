"""Top-k of queries against documents, block by block.

Queries go to the tasks in shipments of about ``SHIP_BYTES``, whatever their number;
documents stay where they are.  A task cuts its shipment into blocks of at most
``query_rows`` (of one group, where a query only sees documents of its group), scores
each pack of documents against the blocks it can meet with one matrix operation, and
keeps the best k per query.  So neither documents nor scores are shuffled: at most k rows
per query and task leave a task, and the last step ranks those.

Ids and groups may be integers or strings and keep their type.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quarry.session import materialize

QUERY_ROWS = 512
PACK_ROWS = 1024
SHIP_BYTES = 16 << 20
TIE_DECIMALS = 9
# (query block, group) pairs whose running top-k a task keeps where groups are ranked
# apart; the oldest goes out beyond that.
OPEN_BLOCKS = 64


def order_key(ids: pa.Array) -> np.ndarray:
    """Ids as numpy values that sort as Spark sorts them (integers, strings)."""
    if pa.types.is_integer(ids.type):
        return ids.to_numpy(zero_copy_only=False).astype(np.int64)
    return np.array(ids.cast(pa.string()).to_pylist(), dtype=str)


def best_k(ids: np.ndarray, scores: np.ndarray, k: int, decimals: int = TIE_DECIMALS) -> tuple[np.ndarray, np.ndarray]:
    """Row-wise best k of ``scores`` (Q, n) with ``ids`` (Q, n): by rounded score,
    then smaller id.  -inf marks what is not a candidate."""
    if scores.shape[1] > 4 * k:
        rounded = np.round(scores, decimals)
        kth = -np.partition(-rounded, k - 1, axis=1)[:, k - 1:k]
        keep = (rounded >= kth) & np.isfinite(scores)  # all ties with the k-th stay
        width = max(1, int(keep.sum(axis=1).max()))
        at = np.argsort(~keep, axis=1, kind="stable")[:, :width]
        ids, scores = np.take_along_axis(ids, at, 1), np.take_along_axis(np.where(keep, scores, -np.inf), at, 1)
    at = np.argsort(ids, axis=1, kind="stable")
    ids, scores = np.take_along_axis(ids, at, 1), np.take_along_axis(scores, at, 1)
    at = np.argsort(-np.round(scores, decimals), axis=1, kind="stable")[:, :k]
    return np.take_along_axis(ids, at, 1), np.take_along_axis(scores, at, 1)


def _parts(batch: pa.RecordBatch, pack_rows: int, grouped: bool) -> Iterator[tuple[object, pa.StructArray]]:
    """A batch's documents as (group, struct array) packs of at most ``pack_rows``."""
    if grouped:
        batch = batch.filter(batch.column("grp").is_valid())
    if not batch.num_rows:
        return
    if grouped:
        batch = batch.take(pc.sort_indices(batch.column("grp")))
        g = batch.column("grp").to_pylist()
        cuts = [i for i in range(len(g)) if i == 0 or g[i] != g[i - 1]]
    else:
        g, cuts = [None] * batch.num_rows, [0]
    names = [n for n in batch.schema.names if n != "grp"]
    docs = pa.StructArray.from_arrays([batch.column(n) for n in names], fields=[batch.schema.field(n) for n in names])
    for lo, hi in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
        for at in range(lo, hi, pack_rows):
            yield g[at], docs.slice(at, min(pack_rows, hi - at))


def _blocks(shipment: pa.Table, query_rows: int, by_group: bool) -> dict:
    """The shipment's queries as {group: [struct arrays of at most ``query_rows``]}."""
    rest = [n for n in shipment.schema.names if n != "grp"]

    def cut(table: pa.Table) -> list[pa.StructArray]:
        columns = [table.column(n).combine_chunks() for n in rest]
        rows = pa.StructArray.from_arrays(columns, fields=[table.schema.field(n) for n in rest])
        return [rows.slice(lo, query_rows) for lo in range(0, len(rows), query_rows)]

    if not by_group:
        return {None: cut(shipment)}
    groups = shipment.column("grp")
    return {g.as_py(): cut(shipment.filter(pc.equal(groups, g))) for g in groups.unique() if g.is_valid}


def _score(sent, prepare: Callable, score: Callable, k: int, out: pa.Schema, pack_rows: int, query_rows: int, match_group: bool,
           per_group: bool, decimals: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shipment = pa.ipc.open_stream(sent.value).read_all()
        blocks = _blocks(shipment, query_rows, match_group)
        ready: dict = {}  # prepared queries, by (their group, block)
        open_: dict = {}  # the best so far, by (block, the documents' group)

        def close(key):
            qids, ids, scores = open_.pop(key)
            rows, cols = np.nonzero(np.isfinite(scores))
            arrays = [qids.take(pa.array(rows)), pa.array(ids[rows, cols]).cast(out.field("doc_id").type), pa.array(scores[rows, cols])]
            if per_group:
                arrays.append(pa.array([key[1]] * len(rows), out.field("grp").type))
            return pa.RecordBatch.from_arrays(arrays, schema=out)

        for batch in batches:
            for group, docs in _parts(batch, pack_rows, match_group or per_group):
                asking = group if match_group else None
                for i, queries in enumerate(blocks.get(asking, [])):
                    if (asking, i) not in ready:
                        ready[asking, i] = prepare(queries)
                    s = score(ready[asking, i], docs)
                    ids = np.broadcast_to(order_key(docs.field("id")), s.shape)
                    key = (i, group)
                    if key in open_:
                        _, best_ids, best = open_[key]
                        ids, s = np.concatenate([best_ids, ids], axis=1), np.concatenate([best, s], axis=1)
                    elif per_group and len(open_) >= OPEN_BLOCKS:
                        yield close(next(iter(open_)))
                    open_[key] = (queries.field("query_id"), *best_k(ids, s, k, decimals))
        for key in list(open_):
            yield close(key)

    return run


def _shipments(queries: DataFrame, n_queries: int, row_bytes: int) -> Iterator[pa.Table]:
    """The queries as Arrow tables of about ``SHIP_BYTES``."""
    ships = max(1, -(-n_queries * row_bytes // SHIP_BYTES))
    if ships == 1:
        yield queries.toArrow()
        return
    held = materialize(queries, "queries")
    for s in range(ships):
        yield held.where(F.pmod(F.xxhash64("query_id"), F.lit(ships)) == s).toArrow()


def block_top_k(docs: DataFrame, queries: DataFrame, prepare: Callable, score: Callable, k: int, n_queries: int,
                match_group: bool = False, per_group: bool = False, query_rows: int = QUERY_ROWS,
                pack_rows: int = PACK_ROWS, row_bytes: int = 1024, decimals: int = TIE_DECIMALS) -> DataFrame:
    """(query_id, [grp,] rank, doc_id, score).

    ``docs``: id, [grp,] payload; ``queries``: query_id, [grp,] payload.  With
    ``match_group`` a query meets documents of its group only (a query with
    several groups has a row for each); with ``per_group`` it meets all and each
    group is ranked apart.  ``prepare(queries)`` sees a block as an Arrow struct
    array, ``score(prepared, docs)`` returns the (queries x documents) scores
    with -inf where a document is no candidate.  ``n_queries`` rows of about
    ``row_bytes`` decide how many shipments there are.  Scores that agree to
    ``decimals`` places are equal, and ordered by id.
    """
    spark = docs.sparkSession
    fields = {f.name: f for f in docs.schema.fields}
    docs = docs.where(F.col("id").isNotNull())
    result = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("doc_id", fields["id"].dataType),
                           T.StructField("score", T.DoubleType()), *([T.StructField("grp", fields["grp"].dataType)] if per_group else [])])
    found = []
    for shipment in _shipments(queries, n_queries, row_bytes):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, shipment.schema) as writer:
            writer.write_table(shipment)
        sent = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())
        found.append(docs.mapInArrow(_score(sent, prepare, score, k, to_arrow_schema(result), pack_rows, query_rows, match_group, per_group,
                                            decimals),
                                     result))
    hits = reduce(DataFrame.unionByName, found)
    by = ["query_id", "grp"] if per_group else ["query_id"]
    w = Window.partitionBy(*by).orderBy(F.desc(F.round("score", decimals)), "doc_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(*by, "rank", "doc_id", "score")
