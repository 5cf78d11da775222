"""Benchmark decontamination with a distributed positional inverted index.

Documents are read once.  Every task cuts its documents into segments of a
bounded number of words, and stores per segment a directory of its documents
and one postings row per test term: the term's positions in the segment.  Windows
with fewer than ``near_share`` of their words in the segment cannot match there, so
the postings that only they need are left out.  The index is a Parquet table in the
shared folder.

Matching groups the index by segment.  For each window it starts with the
shortest postings list and intersects it with the others, each shifted by the
term's place in the window; what remains are the exact occurrences.  A
proximity match is a place of a document at which at least ``near_share`` of the
window's words lie, in that document, within ``slop`` words of where the window
has them.  One of the rarest (words that may be missing + 1) words is then among
those found, so trying these words' positions, shifted by up to ``slop``, loses
nothing, and segments do not change the result.

The test items are a stated query set.  They reach the tasks in blocks of about
``BLOCK_BYTES``; a larger benchmark means more blocks, each run against all
documents, and the blocks' hits are united per document.

Defined results: a null or empty text has no words, hence no hits; an item
without words has no windows; rows of one item id count as one item; a repeated
document row gives its own result row; other columns are not read; an empty
table gives an empty result, an empty benchmark no hits.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import field, stage, words

WINDOW = 10
SEGMENT_WORDS = 400_000
BLOCK_BYTES = 16 << 20
# Proximity candidates tried at once (the occurrences of one word, if more).
CANDIDATES = 1 << 18


def _least(n: int, share: float) -> int:
    """How many of a window's ``n`` words a proximity match has."""
    return min(n, max(1, math.ceil(share * n - 1e-9)))


class Windows:
    """The windows of a block of items, as rows of term numbers."""

    def __init__(self, terms: dict[bytes, int], rows: list[tuple[int, ...]], items: list[list[str]]):
        self.terms, self.rows, self.items = terms, rows, items
        self.sizes = np.array([len(r) for r in rows], np.int64)
        self.flat = np.fromiter(itertools.chain.from_iterable(rows), np.int64, int(self.sizes.sum()))
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)

    @staticmethod
    def of(items: list[tuple[str, str | None]], window: int) -> tuple:
        """Plain values that make the windows of ``items``, for a broadcast."""
        terms: dict[bytes, int] = {}
        rows: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            if item is None:
                continue
            ids = [terms.setdefault(w, len(terms)) for w in words(text)]
            for at in range(max(1, len(ids) - window + 1) if ids else 0):
                rows.setdefault(tuple(ids[at:at + window]), set()).add(item)
        return terms, list(rows), [sorted(x) for x in rows.values()]

    def possible(self, present: np.ndarray, share: float = 1.0) -> np.ndarray:
        """Numbers of the windows with at least ``share`` of their words present."""
        if not len(self.rows):
            return np.zeros(0, np.int64)
        least = np.array([_least(n, share) for n in range(int(self.sizes.max()) + 1)])
        return np.flatnonzero(np.add.reduceat(present[self.flat].astype(np.int64), self.starts[:-1]) >= least[self.sizes])


def _index_tasks(windows, id_type: pa.DataType, share: float):
    directory = pa.list_(pa.struct([("id", id_type), ("row", pa.int64()), ("start", pa.int32()), ("n", pa.int32())]))
    schema = pa.schema([("segment", pa.int64()), ("term", pa.int32()), ("positions", pa.list_(pa.int32())),
                        ("docs", directory)])

    def postings(w: Windows, segment: int, docs: list, parts: list[np.ndarray]):
        ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        at = np.flatnonzero(ids >= 0)
        present = np.zeros(len(w.terms), bool)
        present[ids[at]] = True
        wanted = np.zeros(len(w.terms), bool)
        for k in w.possible(present, share):
            wanted[list(w.rows[k])] = True
        at = at[wanted[ids[at]]] if len(at) else at
        at = at[np.argsort(ids[at], kind="stable")].astype(np.int32)
        terms, first = np.unique(ids[at], return_index=True)
        cuts = np.concatenate([first, [len(at)]]).astype(np.int32)
        n = len(terms)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(n + 1, segment), pa.int64()),
            pa.array(np.concatenate([[-1], terms]), pa.int32()),
            pa.ListArray.from_arrays(pa.array(np.concatenate([[0], cuts]).astype(np.int32)), pa.array(at, pa.int32())),
            pa.array([docs, *[None] * n], directory)], schema=schema)

    def run(batches):
        w = Windows(*windows.value)
        number = itertools.count(TaskContext.get().partitionId() << 32)
        get, none = w.terms.get, itertools.repeat(-1)
        docs, parts, length = [], [], 0
        gap = np.array([-1], np.int32)
        for batch in batches:
            for doc, row, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens = words(text)
                docs.append({"id": doc, "row": row, "start": length, "n": len(tokens)})
                parts += [np.fromiter(map(get, tokens, none), np.int32, len(tokens)), gap]
                length += len(tokens) + 1
                if length >= SEGMENT_WORDS:
                    yield from postings(w, next(number), docs, parts)
                    docs, parts, length = [], [], 0
        if docs:
            yield from postings(w, next(number), docs, parts)
    return run


def _offsets(terms: tuple[int, ...], lists: dict[int, np.ndarray]) -> list[tuple[int, np.ndarray]]:
    """(place in the window, positions) from the rarest term to the commonest."""
    return sorted(((k, lists[t]) for k, t in enumerate(terms)), key=lambda x: len(x[1]))


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values


def _exact(lists: list[tuple[int, np.ndarray]]) -> np.ndarray:
    place, found = lists[0]
    found = found - place
    for place, positions in lists[1:]:
        if not len(found):
            break
        found = found[_among(found + place, positions)]
    return found


def _near(w: Windows, lists: dict[int, np.ndarray], starts: np.ndarray, ends: np.ndarray, exact: set[tuple[int, int]],
          slop: int, share: float) -> list[tuple[int, int]]:
    """(window, document) of the proximity matches; those of ``exact`` are among them."""
    found = {k * len(starts) + d for k, d in exact}
    # all postings as one ordered list of term * wide + position
    wide = int(ends[-1]) + int(w.sizes.max(initial=0)) + 4 * slop + 2
    held = sorted(lists)
    count = np.zeros(len(w.terms), np.int64)
    count[held] = [len(lists[t]) for t in held]
    begin = np.cumsum(count) - count
    keys = np.concatenate([*(t * wide + lists[t] for t in held), [np.iinfo(np.int64).max]])

    for n in np.unique(w.sizes).tolist():
        missing = n - _least(n, share)
        which = np.flatnonzero(w.sizes == n)
        terms = w.flat[w.starts[which][:, None] + np.arange(n)]
        there = (count[terms] > 0).sum(axis=1) >= n - missing
        which, terms = which[there], terms[there]
        rare = np.argsort(count[terms], axis=1, kind="stable")  # places in the window

        def enough(row, doc, base, reach, n=n, missing=missing, terms=terms, rare=rare):
            """Numbers of the candidates with enough words within ``reach`` of their place."""
            left, lost = np.arange(len(row)), np.zeros(len(row), np.int64)
            for r in range(n):
                place = rare[row[left], r]
                term = terms[row[left], place] * wide
                low = np.maximum(base[left] + place - reach, starts[doc[left]])
                high = np.minimum(base[left] + place + reach, ends[doc[left]] - 1)
                lost += keys[np.searchsorted(keys, term + low)] > term + high
                keep = lost <= missing
                left, lost = left[keep], lost[keep]
            return left

        for anchor in range(missing + 1):
            place = rare[:, anchor]
            term = terms[np.arange(len(which)), place]
            total = np.cumsum(count[term])
            cuts = np.flatnonzero(np.diff(total // CANDIDATES)) + 1
            for rows in np.split(np.arange(len(which)), cuts):
                row = np.repeat(rows, count[term[rows]])
                if not len(row):
                    continue
                nth = np.arange(len(row)) - np.repeat(np.cumsum(count[term[rows]]) - count[term[rows]], count[term[rows]])
                at = keys[begin[term[row]] + nth] - term[row] * wide
                doc = np.searchsorted(starts, at, side="right") - 1
                base, pair = at - place[row], which[row] * len(starts) + doc
                new = ~np.isin(pair, np.fromiter(found, np.int64, len(found)))
                row, doc, base, pair = row[new], doc[new], base[new], pair[new]
                left = enough(row, doc, base, 2 * slop)  # whatever the shift
                for shift in sorted(range(-slop, slop + 1), key=abs):
                    hit = left[enough(row[left], doc[left], base[left] + shift, slop)]
                    if len(hit):
                        found.update(pair[hit].tolist())
                        left = left[~np.isin(pair[left], pair[hit])]
    return [divmod(x, len(starts)) for x in found]


def _match_tasks(windows, slop: int, share: float):
    made: list[Windows] = []  # once per task

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if not made:
            made.append(Windows(*windows.value))
        w = made[0]
        is_term = pdf["term"].to_numpy() >= 0
        docs = pdf.loc[~is_term, "docs"].iloc[0]
        lists = {int(t): np.asarray(p, np.int64) for t, p in
                 zip(pdf.loc[is_term, "term"], pdf.loc[is_term, "positions"], strict=True)}
        present = np.zeros(len(w.terms), bool)
        present[list(lists)] = True
        starts = np.array([d["start"] for d in docs], np.int64)
        ends = starts + np.array([d["n"] for d in docs], np.int64)
        spans: list[list[tuple[int, int]]] = [[] for _ in docs]
        hit: list[set[str]] = [set() for _ in docs]
        near: list[set[str]] = [set() for _ in docs]
        exact: set[tuple[int, int]] = set()
        for k in w.possible(present).tolist():
            for at in _exact(_offsets(w.rows[k], lists)).tolist():
                d = int(np.searchsorted(starts, at, side="right")) - 1
                spans[d].append((at - int(starts[d]), int(w.sizes[k])))
                hit[d].update(w.items[k])
                exact.add((k, d))
        for k, d in _near(w, lists, starts, ends, exact, slop, share):
            near[d].update(w.items[k])
        out = []
        for d, s, h, m in zip(docs, spans, hit, near, strict=True):
            merged: list[list[int]] = []
            for at, n in sorted(set(s)):
                if merged and at <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], at + n)
                else:
                    merged.append([at, at + n])
            out.append((d["id"], d["row"], d["n"], [a for a, _ in merged], [b for _, b in merged], sorted(h), sorted(m)))
        return pd.DataFrame(out, columns=["id", "row", "n_words", "starts", "ends", "items", "near_items"])
    return run


def _unite(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row from a document's rows of several item blocks."""
    spans = sorted((a, b) for s, e in zip(pdf["starts"], pdf["ends"], strict=True) for a, b in zip(s, e, strict=True))
    merged: list[list[int]] = []
    for a, b in spans:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    first = pdf.iloc[:1].copy()
    first["starts"], first["ends"] = [[a for a, _ in merged]], [[b for _, b in merged]]
    for c in ("items", "near_items"):
        first[c] = [sorted(set(itertools.chain.from_iterable(pdf[c])))]
    return first


def find_matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, slop: int = 3,
                 near_share: float = 0.8, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: id, n_words, starts and ends (word spans that exact
    windows cover, merged), items and near_items (item ids as sorted strings)."""
    spark = docs.sparkSession
    items = items.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("t"))
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    read = docs.select(F.col(id_col).alias("id"), F.lit(0).cast("long").alias("row"),
                       F.col(text_col).cast("string").alias("t"))
    if blocks > 1:
        read = stage(read.withColumn("row", F.monotonically_increasing_id()), "decontaminate-docs")
    kind = field(docs, id_col)
    directory = T.ArrayType(T.StructType([T.StructField("id", kind), T.StructField("row", T.LongType()),
                                          T.StructField("start", T.IntegerType()), T.StructField("n", T.IntegerType())]))
    index = T.StructType([T.StructField("segment", T.LongType()), T.StructField("term", T.IntegerType()),
                          T.StructField("positions", T.ArrayType(T.IntegerType())), T.StructField("docs", directory)])
    strings, ints = T.ArrayType(T.StringType()), T.ArrayType(T.LongType())
    result = T.StructType([T.StructField("id", kind), T.StructField("row", T.LongType()), T.StructField("n_words", T.LongType()),
                           T.StructField("starts", ints), T.StructField("ends", ints), T.StructField("items", strings),
                           T.StructField("near_items", strings)])
    id_arrow = _arrow_type(docs, id_col)
    found = None
    for block in range(blocks):
        mine = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "t"), F.lit(blocks)) == block)
        # about block_bytes of text, by the number of blocks
        windows = spark.sparkContext.broadcast(Windows.of([tuple(r) for r in mine.collect()], window))
        stored = stage(read.mapInArrow(_index_tasks(windows, id_arrow, near_share), index), "decontaminate-index")
        part = stored.groupBy("segment").applyInPandas(_match_tasks(windows, slop, near_share), result)
        found = part if found is None else found.unionByName(part)
    if blocks > 1:
        found = found.groupBy("row").applyInPandas(_unite, result)
    return found.select(F.col("id").alias(id_col), "n_words", "starts", "ends", "items", "near_items")


def _arrow_type(df: DataFrame, col: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(field(df, col))


def contamination(matches: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digest columns of ``find_matches``."""
    covered = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    return matches.select(id_col, "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                          F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (covered > 0).alias("contaminated"))
