"""Term-partitioned postings with block maxima, and a bounded top-k search.

Documents are numbered in the order of their ids and cut into segments of
``SEGMENT_DOCS``.  An index (a *delta*, of which a store may hold several) is three
Parquet tables under one root, each partitioned by ``delta``:

* ``blocks``   - one row per (term, segment): the places of the term's documents in the
                 segment as gaps, their values, and the most that any of them can
                 contribute (``top``, the largest value; ``low``, the fewest words).
                 Partitioned by ``bucket`` (a hash of the term) too, and sorted by term;
* ``segments`` - one row per segment: its documents' ids and word counts, by place;
* ``docs``     - one row per document with its terms and values, for deletes and merges.

A search sends queries out in shipments of about ``SHIP_QUERIES`` (fewer, if they have
more than ``SHIP_TERMS`` terms together), whatever their number.  It reads the buckets of
the shipment's terms only and works in two phases.  The maxima of a segment's blocks,
weighted by the query, bound the score of every document in it.  The first phase scores
each query's ``SEED_SEGMENTS`` segments of the highest bound; its k-th score prunes all
segments whose bound is lower, and the second phase scores the rest.  Nothing that could
be in the top k is pruned, so the result is the exhaustive search's.

What a value contributes is the index's ``impact``: ``Weights`` takes values as they
are (TF-IDF), ``Saturated`` makes Okapi BM25 of term frequencies, word counts and the
corpus's mean length at the time of the search.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quarry.operators.blocks import TIE_DECIMALS
from quarry.operators.numbering import consecutive_numbers
from quarry.session import materialize

SEGMENT_DOCS = 1024
BUCKETS = 64
SHIP_QUERIES = 256
SHIP_TERMS = 1 << 14
SEED_SEGMENTS = 2
# Segments whose blocks of one bucket go to the same file.
RUN_SEGMENTS = 256
# Cells of a (segments x terms) matrix of maxima.
CELLS = 1 << 22
# A shipment of up to so many terms is also pushed to the scan by value.
PUSHED_TERMS = 64
# Sums of the same products in another order may differ in their last digits.
SLACK = 2e-9


@dataclass(frozen=True)
class Weights:
    """A posting's value is its weight."""

    def bound(self, top: np.ndarray, low: np.ndarray) -> np.ndarray:
        return top

    def weight(self, values: np.ndarray, words: np.ndarray) -> np.ndarray:
        return values


@dataclass(frozen=True)
class Saturated:
    """A posting's value is a term frequency; its weight is BM25's saturated one."""

    k1: float
    b: float
    mean_words: float

    def weight(self, values: np.ndarray, words: np.ndarray) -> np.ndarray:
        return values * (self.k1 + 1) / (values + self.k1 * (1 - self.b + self.b * words / self.mean_words))

    def bound(self, top: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The weight grows with the frequency and falls with the words."""
        return self.weight(top, low)


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


# --- building -------------------------------------------------------------------------------

def _segment_blocks(table: pa.Table) -> pa.Table:
    """All documents of a segment to one row per term."""
    table = table.sort_by("doc_no")
    segment = table.column("segment")[0].as_py()
    terms = table.column("terms").combine_chunks()
    words = np.asarray(table.column("n_words"))
    sizes = np.diff(np.asarray(terms.offsets))
    place = np.repeat(np.asarray(table.column("place")).astype(np.int64), sizes)
    row = np.repeat(np.arange(table.num_rows), sizes)
    names = terms.flatten().dictionary_encode()
    code = np.asarray(names.indices).astype(np.int64)
    value = np.asarray(table.column("values").combine_chunks().flatten())
    order = np.argsort(code, kind="stable")  # by term, then place
    code, place, row, value = code[order], place[order], row[order], value[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    gaps = np.diff(place, prepend=0)
    gaps[first] = place[first]
    ends = pa.array(np.append(first, len(code)), pa.int32())
    n = np.diff(np.append(first, len(code)))
    top = np.maximum.reduceat(value, first) if len(first) else value
    low = np.minimum.reduceat(words[row], first) if len(first) else words[row]
    return pa.Table.from_arrays(
        [names.dictionary.take(pa.array(code[first])), pa.array(np.full(len(first), segment)), pa.array(n), pa.array(top, pa.float64()),
         pa.array(low, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(gaps, pa.int32())),
         pa.ListArray.from_arrays(ends, pa.array(value, pa.float64()))],
        names=["term", "segment", "n", "top", "low", "gaps", "values"])


def write_delta(docs: DataFrame, root: str, delta: str, buckets: int = BUCKETS, segment_docs: int = SEGMENT_DOCS) -> None:
    """Write the tables of a delta from ``docs`` (doc_id, terms, values, n_words); the ids
    must be unique and not null."""
    # the ids are numbered alone, so the terms are dealt out once
    numbers = consecutive_numbers(docs.select("doc_id"), ["doc_id"], "doc_no")
    numbered = docs.select("doc_id", "terms", "values", "n_words").join(numbers, "doc_id")
    numbered = numbered.withColumn("segment", F.floor(F.col("doc_no") / segment_docs).cast("long"))
    numbered.select("doc_id", "terms", "values", "n_words", "doc_no").write.parquet(os.path.join(root, "docs", f"delta={delta}"))
    numbered = docs.sparkSession.read.parquet(os.path.join(root, "docs", f"delta={delta}")).withColumn(
        "segment", F.floor(F.col("doc_no") / segment_docs).cast("long"))
    place = (F.col("doc_no") - F.col("segment") * segment_docs).cast("int")
    rows = numbered.select("segment", "doc_no", place.alias("place"), "n_words", "terms", "values")
    blocks = rows.groupBy("segment").applyInArrow(
        _segment_blocks, "term string, segment long, n long, top double, low long, gaps array<int>, values array<double>")
    blocks = blocks.withColumn("bucket", bucket_of(F.col("term"), buckets))
    # by bucket and, as a term has a row per segment, by runs of segments; sorted so that a scan
    # can skip by term.  The keys need no sample, so the blocks are made once and not staged
    (blocks.repartition("bucket", F.floor(F.col("segment") / RUN_SEGMENTS)).sortWithinPartitions("bucket", "term", "segment")
     .write.partitionBy("bucket").parquet(os.path.join(root, "blocks", f"delta={delta}")))
    whole = numbered.groupBy("segment").agg(F.sort_array(F.collect_list(F.struct("doc_no", "doc_id", "n_words"))).alias("d"))
    whole.select("segment", F.col("d.doc_id").alias("ids"), F.col("d.n_words").alias("words")).write.parquet(
        os.path.join(root, "segments", f"delta={delta}"))


# --- searching --------------------------------------------------------------------------------

@dataclass
class Postings:
    """The live deltas of an index, opened for search."""

    spark: SparkSession
    root: str
    deltas: list[str]
    buckets: int
    segment_docs: int = SEGMENT_DOCS
    dead: DataFrame | None = None  # (delta, segment, places array<int>) of deleted documents
    less: DataFrame | None = None  # (term, df) of deleted documents
    id_type: T.DataType = field(default_factory=T.LongType)

    def table(self, name: str) -> DataFrame:
        """A table over all live deltas; files of others are not even listed."""
        kind = self.id_type.simpleString()
        schema = {
            "blocks": "term string, segment long, n long, top double, low long, gaps array<int>, values array<double>, delta string, bucket int",
            "segments": f"segment long, ids array<{kind}>, words array<bigint>, delta string",
            "docs": f"doc_id {kind}, terms array<string>, values array<double>, n_words long, doc_no long, delta string"}[name]
        if not self.deltas:
            return self.spark.createDataFrame([], schema)
        base = os.path.join(self.root, name)
        return self.spark.read.schema(schema).option("basePath", base).parquet(*[os.path.join(base, f"delta={d}") for d in self.deltas])

    def blocks_of(self, terms: list[str], buckets: list[int]) -> DataFrame:
        """The blocks of ``terms`` with each term's number: a scan of their buckets only."""
        found = self.table("blocks").where(F.col("bucket").isin(buckets))
        if len(terms) <= PUSHED_TERMS:
            found = found.where(F.col("term").isin(terms))
        numbers = self.spark.createDataFrame(list(enumerate(terms)), "term_no int, term string")
        return found.join(F.broadcast(numbers), "term")  # a shipment's terms


def document_frequency(index: Postings, terms: list[str], buckets: list[int]) -> np.ndarray:
    """Live documents that hold each term, from the blocks' own counts."""
    df = np.zeros(len(terms), np.int64)
    counts = index.blocks_of(terms, buckets).groupBy("term_no").agg(F.sum("n").alias("n"))
    for r in counts.collect():  # at most a shipment's terms
        df[r["term_no"]] = r["n"]
    if index.less is not None:
        numbers = index.spark.createDataFrame(list(enumerate(terms)), "term_no int, term string")
        for r in index.less.join(F.broadcast(numbers), "term").groupBy("term_no").agg(F.sum("df").alias("n")).collect():
            df[r["term_no"]] -= r["n"]
    return df


def _bounds(shipped):
    """(delta, segment, blocks' maxima) to (delta, segment, query, bound)."""

    def run(batches):
        weights, impact = shipped.value
        for batch in batches:
            blocks = batch.column("b")
            sizes = np.diff(np.asarray(blocks.offsets))
            flat = blocks.flatten()
            row = np.repeat(np.arange(batch.num_rows), sizes)
            col = np.asarray(flat.field("term_no"))
            most = impact.bound(np.asarray(flat.field("top")), np.asarray(flat.field("low")))
            step = max(1, CELLS // weights.shape[1])
            for lo in range(0, batch.num_rows, step):
                a, b = np.searchsorted(row, [lo, lo + step])
                dense = np.zeros((min(step, batch.num_rows - lo), weights.shape[1]))
                np.maximum.at(dense, (row[a:b] - lo, col[a:b]), most[a:b])
                bound = dense @ weights.T
                at, query = np.nonzero(bound > 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("delta").take(pa.array(lo + at)), batch.column("segment").take(pa.array(lo + at)), pa.array(query, pa.int32()),
                     pa.array(bound[at, query])], ["delta", "segment", "query", "bound"])

    return run


def _scores(shipped, k: int, kind: pa.DataType):
    """One segment: its blocks and its row (ids, words, dead places, queries) to (query, doc_id, score)."""

    def run(blocks: pa.Table, segment: pa.Table) -> pa.Table:
        weights, impact, least = shipped.value
        names = ["query", "doc_id", "score"]
        if not blocks.num_rows or not segment.num_rows:
            return pa.table([pa.array([], pa.int32()), pa.array([], kind), pa.array([], pa.float64())], names=names)
        words = np.asarray(segment.column("words").combine_chunks().flatten()).astype(float)
        gaps = blocks.column("gaps").combine_chunks()
        sizes = np.diff(np.asarray(gaps.offsets))
        first = np.cumsum(sizes) - sizes
        run_to = np.cumsum(np.asarray(gaps.flatten()).astype(np.int64))
        place = run_to - np.repeat(run_to[first] - np.asarray(gaps.flatten())[first], sizes)
        # the terms of this segment only, as rows
        held, row = np.unique(np.asarray(blocks.column("term_no")), return_inverse=True)
        dense = np.zeros((len(held), len(words)))
        dense[np.repeat(row, sizes), place] = impact.weight(np.asarray(blocks.column("values").combine_chunks().flatten()), words[place])
        queries = np.asarray(segment.column("queries").combine_chunks().flatten()).astype(np.int64)
        score = weights[np.ix_(queries, held)] @ dense
        dead = segment.column("places").combine_chunks().flatten()
        score[:, np.asarray(dead).astype(np.int64)] = 0.0
        # the k best by rounded score, all that tie with the last in the order of places
        rounded = np.round(score, TIE_DECIMALS)
        rounded[(score <= 0) | (score < least[queries][:, None])] = -1.0
        order = np.argsort(-rounded, axis=1, kind="stable")[:, :k]
        at, nth = np.nonzero(np.take_along_axis(rounded, order, 1) >= 0)
        where = order[at, nth]
        ids = segment.column("ids").combine_chunks().flatten().take(pa.array(where))
        return pa.table([pa.array(queries[at], pa.int32()), ids, pa.array(score[at, where])], names=names)

    return run


def _score(index: Postings, pairs: DataFrame, terms: list[str], buckets: list[int], sent, k: int) -> DataFrame:
    """The best k of each (delta, segment, query) of ``pairs``."""
    wanted = pairs.groupBy("delta", "segment").agg(F.collect_list("query").alias("queries"))  # a shipment's queries at most
    rows = index.table("segments").join(wanted, ["delta", "segment"])
    if index.dead is not None:
        rows = rows.join(index.dead, ["delta", "segment"], "left")
    else:
        rows = rows.withColumn("places", F.lit(None).cast("array<int>"))
    rows = rows.withColumn("places", F.coalesce("places", F.array().cast("array<int>")))
    held = (index.blocks_of(terms, buckets).select("delta", "segment", "term_no", "gaps", "values")
            .join(pairs.select("delta", "segment").distinct(), ["delta", "segment"], "left_semi"))
    out = T.StructType([T.StructField("query", T.IntegerType()), T.StructField("doc_id", index.id_type), T.StructField("score", T.DoubleType())])
    run = _scores(sent, k, to_arrow_schema(out).field("doc_id").type)
    return held.groupBy("delta", "segment").cogroup(rows.groupBy("delta", "segment")).applyInArrow(run, out)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query").orderBy(F.desc(F.round("score", TIE_DECIMALS)), "doc_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _ship(index: Postings, rows: list, id_type: T.DataType, weigh, impact, k: int) -> DataFrame:
    """The ranking of one shipment of queries, staged: (query_id, rank, doc_id, score)."""
    spark = index.spark
    places: dict[str, int] = {}
    buckets = set()
    for r in rows:
        for t in r["t"]:
            places.setdefault(t["term"], len(places))
            buckets.add(t["bucket"])
    terms, buckets = list(places), sorted(buckets)
    weights = np.zeros((len(rows), len(terms)))
    for i, r in enumerate(rows):
        for t in r["t"]:
            weights[i, places[t["term"]]] = t["weight"]
    weights *= weigh(terms, buckets)
    maxima = (index.blocks_of(terms, buckets).groupBy("delta", "segment")
              .agg(F.collect_list(F.struct("term_no", "top", "low")).alias("b")))
    bounds = materialize(maxima.mapInArrow(_bounds(spark.sparkContext.broadcast((weights, impact))),
                                           "delta string, segment long, query int, bound double"), "bounds")
    w = Window.partitionBy("query").orderBy(F.desc("bound"), "delta", "segment")
    seeds = bounds.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= SEED_SEGMENTS)
    seeds = spark.createDataFrame(seeds.select("query", "delta", "segment").collect(), "query int, delta string, segment long")  # few per query
    none = np.zeros(len(rows))
    first = materialize(_score(index, seeds, terms, buckets, spark.sparkContext.broadcast((weights, impact, none)), k), "first-phase")
    least = none.copy()
    for r in _ranked(first, k).where(F.col("rank") == k).collect():  # a number per query
        least[r["query"]] = r["score"] - SLACK
    floors = spark.createDataFrame([(i, float(x)) for i, x in enumerate(least)], "query int, least double")
    left = (bounds.join(F.broadcast(seeds), ["query", "delta", "segment"], "left_anti")  # a shipment's queries
            .join(F.broadcast(floors), "query").where(F.col("bound") + SLACK >= F.col("least")))
    more = _score(index, left, terms, buckets, spark.sparkContext.broadcast((weights, impact, least)), k)
    ids = spark.createDataFrame([(i, r["query_id"]) for i, r in enumerate(rows)], T.StructType([
        T.StructField("query", T.IntegerType()), T.StructField("query_id", id_type)]))
    return materialize(_ranked(first.unionByName(more), k).join(F.broadcast(ids), "query").select("query_id", "rank", "doc_id", "score"), "pruned")


def search(index: Postings, queries: DataFrame, weigh, impact: Weights | Saturated, k: int) -> DataFrame:
    """(query_id, rank, doc_id, score): each query's ``k`` best documents of positive score,
    ties by id.  ``queries``: (query_id, term, weight); ``weigh(terms, buckets)`` gives what
    a term's weight is multiplied by, e.g. its inverse document frequency."""
    spark = index.spark
    id_type = queries.schema["query_id"].dataType
    asked = queries.select("query_id", "term", "weight", bucket_of(F.col("term"), index.buckets).alias("bucket"))
    few = asked.limit(SHIP_TERMS + 1).collect() if index.deltas else []
    held: dict = {}
    for r in few:
        held.setdefault(r["query_id"], {})[r["term"]] = r
    ranked = []
    if len(few) <= SHIP_TERMS and len(held) <= SHIP_QUERIES:  # all of them are one shipment
        rows = [{"query_id": q, "t": [t[x] for x in sorted(t)]} for q, t in held.items()]
        ranked = [_ship(index, rows, id_type, weigh, impact, k)] if rows else []
    else:
        asked = materialize(asked, "asked")
        size = asked.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("query_id").alias("q")).first()
        ships = max(1, -(-size["q"] // SHIP_QUERIES), -(-size["n"] // SHIP_TERMS))
        for s in range(ships):
            rows = (asked.where(F.pmod(F.xxhash64("query_id"), F.lit(ships)) == s).groupBy("query_id")
                    .agg(F.sort_array(F.collect_list(F.struct("term", "bucket", "weight"))).alias("t")).collect())  # about a shipment
            if rows:
                ranked.append(_ship(index, rows, id_type, weigh, impact, k))
    if not ranked:
        return spark.createDataFrame([], T.StructType([T.StructField("query_id", id_type), T.StructField("rank", T.IntegerType()),
                                                       T.StructField("doc_id", index.id_type), T.StructField("score", T.DoubleType())]))
    return reduce(DataFrame.unionByName, ranked)


def idf(n_docs: float, df: np.ndarray) -> np.ndarray:
    """Okapi BM25's inverse document frequency."""
    return np.log(1.0 + (n_docs - df + 0.5) / (df + 0.5))
