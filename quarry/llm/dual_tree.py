"""Ranked lexical search by two trees.

Every item (a query text) and every document becomes a vector over the items'
terms: an item holds each term's weight times its repeats, a document its
saturated term frequency.  All numbers are 64-bit integers:

    weight(t)    = floor(1000 ln((2 N + 2) / (2 df + 1)))
    impact(t, d) = 10^9 tf div (1000 tf + 12 (75 + 25 n N div L))
    score        = sum over the item's terms, repeats included, of weight x impact

N documents with a term, L their terms, n one document's terms.

* Items go out in blocks of about ``BLOCK_BYTES`` of text, whatever their number.
  One pass over the documents counts, per document, the block's terms; the table
  of counts is stored, as N, L, df and the search read it.
* The search builds, in each task, a tree over the items and a tree over each pack
  of documents.  A node holds the coordinate maxima of its members.  Pairs of nodes
  are followed from the roots: the product of the maxima bounds every score below,
  and a pair whose bound is under the weakest k-th score of the items below is
  dropped with all its item-document pairs.  What is left at the leaves is scored.
* The k-th scores start from a search of a sixteenth of the documents and rise
  with every pack.  They only decide what is dropped, never the result.
* A task hands on at most k documents an item; the last step ranks those.

Nulls: a null or empty text has no terms, matches nothing and does not count in N.
A null id is kept; among equal scores it comes last.  Fully repeated items are one
item; repeated documents are documents of their own.  Other columns are not read,
so their names cannot clash.  Empty tables give an empty result.  A very long text
is tokenised whole, in one row.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quarry.llm.common import stage, words
from quarry.llm.ranked import best_rows

TOP_K = 20
BLOCK_BYTES = 4 << 20
# An item tree has at most so many items and terms (a longer item is a tree of its own).
TREE_ITEMS = 256
TREE_TERMS = 1 << 14
# Cells of a pack's (documents x terms) matrix, and its documents.
PACK_CELLS = 1 << 23
PACK_DOCS = 512
FAN = 8
# Products that are formed at once.
TILE = 1 << 21
SEED_SHARE = 16


def _term_counts(vocabulary, schema: pa.Schema):
    """Rows (id, text) to (id, n, terms, tfs) for documents that have a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value.get
        for batch in batches:
            keep, n, sizes, terms, tfs = [], [], [], [], []
            for at, text in enumerate(batch.column("text").to_pylist()):
                found = words(text)
                if not found:
                    continue
                counts = Counter(map(number, found))
                counts.pop(None, None)
                keep.append(at)
                n.append(len(found))
                sizes.append(len(counts))
                terms += counts.keys()
                tfs += counts.values()
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(keep, pa.int64())), pa.array(n, pa.int64()),
                 pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64()))],
                schema=schema)

    return run


def _document_frequency(n_terms: int):
    """One row per term that a task has seen: (term, df)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            df += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=n_terms)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(df[at])], ["term", "df"])

    return run


class ItemTree:
    """Items with neighbours that share their heaviest term; each level's nodes
    hold the maxima of ``FAN`` nodes below, as sparse rows over the tree's terms."""

    def __init__(self, items: list[int], vectors: list[tuple[np.ndarray, np.ndarray]]):
        heaviest = [int(t[np.argmax(w)]) for t, w in vectors]
        order = sorted(range(len(items)), key=lambda i: heaviest[i])
        self.items = np.array([items[i] for i in order], np.int64)
        vectors = [vectors[i] for i in order]
        self.terms = np.unique(np.concatenate([t for t, _ in vectors]))
        node = np.repeat(np.arange(len(vectors)), [len(t) for t, _ in vectors])
        cols = np.searchsorted(self.terms, np.concatenate([t for t, _ in vectors]))
        values = np.concatenate([w for _, w in vectors])
        self.levels = []
        n = len(vectors)
        while True:
            starts = np.concatenate([[0], np.cumsum(np.bincount(node, minlength=n))])
            self.levels.append((n, starts, cols, values))
            if n == 1:
                break
            key = (node // FAN) * len(self.terms) + cols
            at = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], np.diff(key[at]) > 0]))
            values = np.maximum.reduceat(values[at], first)
            node, cols = np.divmod(key[at][first], len(self.terms))
            n = -(-n // FAN)


def item_trees(weighted: list[tuple[np.ndarray, np.ndarray]]) -> list[ItemTree]:
    """Trees over all items that have a term, by heaviest term."""
    with_terms = [i for i, (t, _) in enumerate(weighted) if len(t)]
    with_terms.sort(key=lambda i: int(weighted[i][0][np.argmax(weighted[i][1])]))
    trees, held, n_terms = [], [], 0
    for i in with_terms:
        size = len(weighted[i][0])
        if held and (len(held) >= TREE_ITEMS or n_terms + size > TREE_TERMS):
            trees.append(ItemTree(held, [weighted[j] for j in held]))
            held, n_terms = [], 0
        held.append(i)
        n_terms += size
    if held:
        trees.append(ItemTree(held, [weighted[j] for j in held]))
    return trees


def _products(level, docs: np.ndarray, pi: np.ndarray, pd: np.ndarray) -> np.ndarray:
    """Item node pi's row times document node pd's row, for each pair."""
    _, starts, cols, values = level
    width = docs.shape[1]
    flat = docs.reshape(-1)
    sizes = starts[pi + 1] - starts[pi]
    ends = np.cumsum(sizes)
    out = np.zeros(len(pi), np.int64)
    lo = 0
    while lo < len(pi):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + TILE, "right")))
        n = sizes[lo:hi]
        shift = np.cumsum(n) - n
        at = np.repeat(starts[pi[lo:hi]] - shift, n) + np.arange(n.sum())
        products = values[at] * flat[np.repeat(pd[lo:hi] * width, n) + cols[at]]
        out[lo:hi] = np.add.reduceat(products, shift)  # no node is without terms
        lo = hi
    return out


def _pairs_below(level_sizes, pi: np.ndarray, pd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of children of the given pairs of nodes."""
    n_items, n_docs = level_sizes
    step = np.arange(FAN * FAN)
    ci = (pi[:, None] * FAN + step // FAN).ravel()
    cd = (pd[:, None] * FAN + step % FAN).ravel()
    there = (ci < n_items) & (cd < n_docs)
    return ci[there], cd[there]


def match(tree: ItemTree, docs: np.ndarray, kth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item of the tree, document row, score) of all pairs with a positive score not
    below the item's ``kth``; ``docs`` is (documents x the tree's terms)."""
    doc_levels = [docs]
    while len(doc_levels[-1]) > 1:
        d = doc_levels[-1]
        pad = -len(d) % FAN
        d = np.concatenate([d, np.zeros((pad, d.shape[1]), d.dtype)]) if pad else d
        doc_levels.append(d.reshape(-1, FAN, d.shape[1]).max(axis=1))
    weakest = [kth]
    while len(weakest) < len(tree.levels):
        w = weakest[-1]
        weakest.append(np.minimum.reduceat(w, np.arange(0, len(w), FAN)))
    top = max(len(doc_levels), len(tree.levels)) - 1
    pi = pd = np.zeros(1, np.int64)
    for depth in range(top, -1, -1):
        level = tree.levels[min(depth, len(tree.levels) - 1)]
        d = doc_levels[min(depth, len(doc_levels) - 1)]
        if depth < top:
            pi, pd = _pairs_below((level[0], len(d)), pi, pd)
        bound = _products(level, d, pi, pd)
        keep = bound >= np.maximum(weakest[min(depth, len(weakest) - 1)][pi], 1)
        pi, pd, bound = pi[keep], pd[keep], bound[keep]
    return pi, pd, bound


def _searcher(shipped, n_docs: int, n_terms_all: int, k: int, schema: pa.Schema):
    """Rows (id, n, terms, tfs) to each item's best k of the task: (item, id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, kth, vocabulary_size = shipped.value
        kth = kth.copy()
        best = schema.empty_table()
        local = np.full((1, vocabulary_size), -1, np.int32)  # term to column, one tree at a time
        for batch in batches:
            sizes = np.diff(batch.column("terms").offsets.to_numpy())
            doc = np.repeat(np.arange(batch.num_rows), sizes)
            term = batch.column("terms").flatten().to_numpy().astype(np.int64)
            tf = batch.column("tfs").flatten().to_numpy()
            n = batch.column("n").to_numpy()
            impact = 10**9 * tf // (1000 * tf + 12 * (75 + 25 * n * n_docs // n_terms_all)[doc])
            for tree in trees:
                local[0, tree.terms] = np.arange(len(tree.terms))
                col = local[0, term]
                local[0, tree.terms] = -1
                held = np.flatnonzero(col >= 0)
                # documents whose strongest term is the same stand together
                strong = held[np.lexsort((-impact[held], doc[held]))]
                strong = strong[np.concatenate([[True], np.diff(doc[strong]) > 0])] if len(strong) else strong
                order = doc[strong][np.argsort(col[strong], kind="stable")]
                place = np.full(batch.num_rows, -1, np.int64)
                place[order] = np.arange(len(order))
                rows = max(FAN, min(PACK_DOCS, PACK_CELLS // len(tree.terms)))
                at_place = place[doc[held]]
                by_place = held[np.argsort(at_place, kind="stable")]
                at_place = place[doc[by_place]]
                for lo in range(0, len(order), rows):
                    a, b = np.searchsorted(at_place, [lo, lo + rows])
                    cells = by_place[a:b]
                    docs = np.zeros((min(rows, len(order) - lo), len(tree.terms)), np.int32)
                    docs[at_place[a:b] - lo, col[cells]] = impact[cells]
                    pi, pd, score = match(tree, docs, kth[tree.items])
                    if not len(pi):
                        continue
                    item = tree.items[pi]
                    found = pa.Table.from_arrays([pa.array(item), batch.column("id").take(pa.array(order[lo + pd])), pa.array(score)],
                                                 schema=schema)
                    hit = np.unique(item)
                    mine = np.asarray(best.column("item"))
                    again = np.isin(mine, hit)
                    merged = best_rows(pa.concat_tables([best.filter(pa.array(again)), found]), "item",
                                       [("score", "descending"), ("id", "ascending")], k)
                    who, points = np.asarray(merged.column("item")), np.asarray(merged.column("score"))
                    full = np.flatnonzero(np.bincount(who, minlength=len(kth)) == k)
                    least = np.full(len(kth), np.iinfo(np.int64).max)
                    np.minimum.at(least, who, points)
                    kth[full] = np.maximum(kth[full], least[full])
                    best = pa.concat_tables([best.filter(pa.array(~again)), merged])
        yield from best.combine_chunks().to_batches()

    return run


def _search_block(docs: DataFrame, rows: list, k: int, result: T.StructType) -> DataFrame:
    """The ranking of one block of items, staged."""
    spark = docs.sparkSession
    found = [words(r["text"]) for r in rows]
    names = sorted(set().union(*found))
    number = {w: i for i, w in enumerate(names)}
    counted = T.StructType([T.StructField("id", docs.schema["id"].dataType), T.StructField("n", T.LongType()),
                            T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.LongType()))])
    shipped = spark.sparkContext.broadcast(number)
    vectors = stage(docs.mapInArrow(_term_counts(shipped, to_arrow_schema(counted)), counted), "lexical-terms")
    seen = vectors.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l")).first()
    if not seen["n"]:
        return spark.createDataFrame([], result)
    part = vectors.select("terms").mapInArrow(_document_frequency(len(names)), "term int, df long")
    df = np.zeros(len(names), np.int64)
    for r in part.groupBy("term").agg(F.sum("df").alias("df")).collect():  # at most the block's terms
        df[r["term"]] = r["df"]
    weight = np.array([math.floor(1000 * math.log((2 * seen["n"] + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    weighted = []
    for ws in found:
        counts = Counter(number[w] for w in ws if df[number[w]])
        terms = np.array(sorted(counts), np.int64)
        weights = np.array([counts[t] for t in terms.tolist()], np.int64) * weight[terms]
        weighted.append((terms[weights > 0], weights[weights > 0]))
    trees = item_trees(weighted)
    raw = T.StructType([T.StructField("item", T.LongType()), T.StructField("id", docs.schema["id"].dataType),
                        T.StructField("score", T.LongType())])
    arrow = to_arrow_schema(raw)

    def top(part: DataFrame, kth: np.ndarray) -> DataFrame:
        sent = spark.sparkContext.broadcast((trees, kth, len(names)))
        hits = part.mapInArrow(_searcher(sent, seen["n"], seen["l"], k, arrow), raw)
        w = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
        return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    kth = np.zeros(len(rows), np.int64)
    sample = vectors.where(F.pmod(F.xxhash64("id"), F.lit(SEED_SHARE)) == 0)
    for r in top(sample, kth).where(F.col("rank") == k).collect():  # a number per item of the block
        kth[r["item"]] = r["score"]
    ids = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)],
                                T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", result["item_id"].dataType)]))
    ranked = top(vectors, kth).join(F.broadcast(ids), "item")  # the block's items
    return stage(ranked.select("item_id", "rank", F.col("id").alias("doc_id"), "score"), "lexical-ranked")


def search(docs: DataFrame, items: DataFrame, k: int = TOP_K, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` best documents with a positive
    score, equal scores by ascending id."""
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    q = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).where("text IS NOT NULL").distinct()
    result = T.StructType([T.StructField("item_id", q.schema["item_id"].dataType), T.StructField("rank", T.IntegerType()),
                           T.StructField("doc_id", d.schema["id"].dataType), T.StructField("score", T.LongType())])
    total = q.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    blocks = max(1, -(-total // block_bytes))
    ranked = None
    for b in range(blocks):
        rows = q.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()  # about block_bytes of text
        if rows:
            part = _search_block(d, rows, k, result)
            ranked = part if ranked is None else ranked.unionByName(part)
    return spark.createDataFrame([], result) if ranked is None else ranked


def search_sql(k: int = TOP_K) -> str:
    """Every item against every document, in DuckDB."""
    w = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
         "'[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')")
    return f"""WITH d AS (SELECT doc_id, {w} AS w FROM documents), k AS (SELECT count(*) AS n_docs, sum(len(w)) AS l FROM d WHERE len(w) > 0),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({w}) AS term FROM benchmark) GROUP BY ALL),
s AS (
  SELECT q.item_id, tf.doc_id, sum(times * floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT
         * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // l))))::BIGINT AS score
  FROM q JOIN df USING (term) JOIN tf USING (term), k GROUP BY ALL),
r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= {k}"""
