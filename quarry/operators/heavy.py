"""The most frequent terms, exactly, without shuffling all distinct terms.

First pass: every task keeps a summary of at most ``capacity`` counters (Misra and Gries):
when there are more, all are lowered by the largest that has to go, which is added to the
task's error.  Summaries are merged by summing counters and errors: a term's true frequency
lies between its counter and counter + E, E the sum of the errors; a term without a counter
has at most E.  The ``top``-th largest counter T is a lower bound of the ``top``-th frequency.

Second pass: if T > E, no term without a counter and none whose counter + E is under T can be
among the ``top``; the others are counted exactly.  If the bound is not met (frequencies are too
even for the capacity), all terms are counted: slower, and the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.lexical import SHIPPED_TERMS, term_totals
from quarry.operators.slices import ELEMENTS, parts
from quarry.session import materialize

CAPACITY = 100_000
# Counted slices wait until they hold this many times the capacity: the fewer cuts, the smaller
# the error; what a task holds is bounded all the same.
WAITING = 4


def _summed(pairs: pa.Table) -> pa.Table:
    return pairs.group_by("term", use_threads=False).aggregate([("low", "sum")]).rename_columns(["term", "low"])


def _counted(batch: pa.RecordBatch) -> pa.Table:
    return _summed(pa.table({"term": batch.column("terms").flatten(), "low": batch.column("tfs").flatten()}))


def cut(held: pa.Table, capacity: int) -> tuple[pa.Table, int]:
    """At most ``capacity`` counters, and by how much all were lowered for it."""
    if held.num_rows <= capacity:
        return held, 0
    low = held.column("low")
    by = pc.array_sort_indices(low.combine_chunks(), order="descending")[capacity].as_py()
    drop = low[by].as_py()
    left = held.filter(pc.greater(low, drop))
    return left.set_column(1, "low", pc.subtract(left.column("low"), drop)), drop


def _summaries(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, error = pa.table({"term": pa.array([], pa.string()), "low": pa.array([], pa.int64())}), 0
        waiting: list[pa.Table] = []
        for batch in parts(batches, "terms", ELEMENTS):
            waiting.append(_counted(batch))
            if sum(t.num_rows for t in waiting) > WAITING * capacity:
                held, waiting = _summed(pa.concat_tables([held, *waiting])), []
                if held.num_rows > 2 * capacity:
                    held, lowered = cut(held, capacity)
                    error += lowered
        held = _summed(pa.concat_tables([held, *waiting]))
        held, lowered = cut(held, capacity)
        yield from held.combine_chunks().to_batches()
        # the row without a term is the task's error
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([error + lowered], pa.int64())], ["term", "low"])
        del held
        pa.default_memory_pool().release_unused()

    return run


def _counted_exactly(lists: DataFrame, terms: list[str]) -> DataFrame:
    """(term, df, cf) of the given terms."""
    sent = lists.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(sent.value, pa.string())
        for batch in parts(batches, "terms", ELEMENTS):
            term = batch.column("terms").flatten()
            known = pc.is_valid(pc.index_in(term, value_set=names))
            pairs = pa.table({"term": term.filter(known), "tf": batch.column("tfs").flatten().filter(known)})
            sums = pairs.group_by("term", use_threads=False).aggregate([("tf", "count"), ("tf", "sum")])
            yield from sums.select(["term", "tf_count", "tf_sum"]).rename_columns(["term", "df", "cf"]).to_batches()

    part = lists.select("terms", "tfs").mapInArrow(run, "term string, df long, cf long")
    return part.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def candidates(lists: DataFrame, top: int, capacity: int = CAPACITY) -> list[str] | None:
    """Terms that hold all of the ``top`` most frequent ones, ties with the last included; None
    if the summaries cannot prove it, or leave more than a task should hold."""
    merged = materialize(lists.select("terms", "tfs").mapInArrow(_summaries(capacity), "term string, low long")
                         .groupBy("term").agg(F.sum("low").alias("low")), "summary")
    error = merged.where("term IS NULL").agg(F.sum("low")).first()[0] or 0
    known = merged.where("term IS NOT NULL")
    largest = known.orderBy(F.desc("low")).limit(top).agg(F.count(F.lit(1)).alias("n"), F.min("low").alias("low")).first()
    bound = largest["low"] if largest["n"] == top else 0
    if bound <= error and error:
        return None
    chosen = known.where(F.col("low") + error >= bound).select("term")
    if chosen.count() > SHIPPED_TERMS:
        return None
    return [r["term"] for r in chosen.collect()]  # at most SHIPPED_TERMS


def heavy_terms(lists: DataFrame, top: int, capacity: int = CAPACITY) -> DataFrame:
    """(term, df, cf) of the ``top`` terms of the highest corpus frequency, ties by term;
    ``lists``: (terms, tfs) rows, read twice."""
    terms = candidates(lists, top, capacity)
    totals = term_totals(lists) if terms is None else _counted_exactly(lists, terms)
    return totals.orderBy(F.desc("cf"), F.asc("term")).limit(top)
