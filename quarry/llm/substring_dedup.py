"""Removal of repeated passages by hashing lines and their sentences.

A text is cut into units: lines, and within a line sentences, as passages also
repeat inside lines; a sentence of fewer than ``min_unit_words`` words goes with
the next one.  A unit is normalised (its words, A-Z lower-cased, punctuation and
spacing aside) and hashed to 128 bits.  Digests are grouped over the whole table
and the earliest ranked occurrence (smallest id, then row, then place) is kept.
The other occurrences form runs of consecutive units; a run of ``min_words``
words or more is removed, with its offsets in the original text.

Grouping counts on the map side first; the occurrences meet the repeated digests
in a plain shuffle join, so one digest with a large share of all rows is split.

Defined results: a null or empty text has no units and stays as it is; a null id
ranks last; of repeated rows one keeps its text (which one is not fixed when ids
are equal, and does not change the result); other columns are kept by
``remove``; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import field, stage, words

MIN_UNIT_WORDS = 4
MIN_WORDS = 25


def unit_pattern(min_unit_words: int = MIN_UNIT_WORDS) -> str:
    """Units tile the text: enough blank-separated words up to one that ends a
    sentence, or else the rest of the line (with its break)."""
    return rf"(?:[^ \n]* ){{{min_unit_words - 1},}}?[^ \n]*[.!?](?: |\n)|[^\n]+\n?|\n"


def _unit_tasks(id_type: pa.DataType, min_unit_words: int, own_row: bool):
    unit = re.compile(unit_pattern(min_unit_words))
    names = ["h0", "h1", "row", "id", "idx", "start", "stop", "n_words"]

    def run(batches):
        number = itertools.count(TaskContext.get().partitionId() << 40)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            rows = batch.column(1).to_pylist() if own_row else list(itertools.islice(number, len(texts)))
            for lo in range(0, len(texts), 512):
                digests, where, row, idx, start, stop, size = [], [], [], [], [], [], []
                for k in range(lo, min(lo + 512, len(texts))):
                    n = 0
                    for m in unit.finditer(texts[k] or ""):
                        w = words(m.group())
                        if w:
                            digests.append(xxhash.xxh3_128_digest(b" ".join(w)))
                            where.append(k)
                            row.append(rows[k])
                            idx.append(n)
                            start.append(m.start())
                            stop.append(m.end())
                            size.append(len(w))
                            n += 1
                h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([
                    pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(row, pa.int64()), batch.column(0).take(pa.array(where, pa.int64())),
                    *(pa.array(x, pa.int32()) for x in (idx, start, stop, size))], names)
    return run


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
            min_unit_words: int = MIN_UNIT_WORDS, row_col: str | None = None) -> DataFrame:
    """One row per removed passage: id, start and stop (characters of the original
    text), n_words, n_units, first_ids (ids that hold the kept occurrences of its
    units, sorted) and row."""
    from pyspark.sql.pandas.types import to_arrow_type
    kind = field(docs, id_col)
    schema = T.StructType([T.StructField("h0", T.LongType()), T.StructField("h1", T.LongType()), T.StructField("row", T.LongType()),
                           T.StructField("id", kind), *(T.StructField(n, T.IntegerType()) for n in ("idx", "start", "stop", "n_words"))])
    row = F.col(row_col) if row_col else F.lit(None).cast("long")
    read = docs.select(F.col(id_col).alias("id"), row.alias("row"), F.col(text_col).cast("string").alias("t"))
    units = stage(read.mapInArrow(_unit_tasks(to_arrow_type(kind), min_unit_words, row_col is not None), schema), "units")
    rank = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row"), F.col("idx").alias("idx"))
    first = (units.groupBy("h0", "h1").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
             .select("h0", "h1", F.col("first.id").alias("first_id"), F.col("first.row").alias("first_row"),
                     F.col("first.idx").alias("first_idx")))
    first = stage(first, "unit-firsts")
    again = (units.join(first, ["h0", "h1"]).where("row != first_row OR idx != first_idx")
             .select("row", "id", "idx", "start", "stop", "n_words", "first_id"))
    # a text's units only; its own length bounds the group
    run = F.col("idx") - F.row_number().over(Window.partitionBy("row").orderBy("idx"))
    return (again.withColumn("run", run).groupBy("row", "run")
            .agg(F.first("id").alias("id"), F.min("start").alias("start"), F.max("stop").alias("stop"),
                 F.sum("n_words").alias("n_words"), F.count(F.lit(1)).alias("n_units"),
                 F.array_sort(F.collect_set("first_id")).alias("first_ids"))
            .where(F.col("n_words") >= min_words)
            .select(F.col("id").alias(id_col), F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"),
                    "n_words", "n_units", "first_ids", "row"))


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
           min_unit_words: int = MIN_UNIT_WORDS) -> DataFrame:
    """``docs``, all columns, with the removed passages cut out of ``text_col`` and
    their spans in a column ``removed`` (array of struct(start, stop))."""
    # the row's other columns travel as one struct, so that no name can clash
    rest = [c for c in docs.columns if c != text_col]
    doc = F.struct(F.lit(0).alias("none"), *[docs[c].alias(f"c{i}") for i, c in enumerate(rest)])
    kept = stage(docs.select(doc.alias("doc"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"),
                             F.monotonically_increasing_id().alias("at")), "unit-docs")
    spans = repeats(kept, "id", "t", min_words, min_unit_words, row_col="at")
    per_row = spans.groupBy(F.col("row").alias("of")).agg(
        F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(text, spans, strict=True):
            at, parts = 0, []
            for x in s:
                parts.append(t[at:x["start"]])
                at = x["stop"]
            out.append("".join([*parts, t[at:]]))
        return pd.Series(out)

    met = kept.join(per_row, F.col("at") == F.col("of"), "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<start:bigint,stop:bigint>>"))
    left = F.when(F.col("spans").isNull(), F.col("t")).otherwise(cut(F.coalesce("t", F.lit("")), spans))
    done = met.select("doc", F.struct(left.alias("text"), spans.alias("spans")).alias("made"))
    return done.select(*[F.col("made").getField("text").alias(c) if c == text_col else
                         F.col("doc").getField(f"c{rest.index(c)}").alias(c) for c in docs.columns], F.col("made").getField("spans").alias("removed"))


def repeats_sql(min_words: int = MIN_WORDS, min_unit_words: int = MIN_UNIT_WORDS) -> str:
    """DuckDB SQL for the registered query over ``documents``."""
    return f"""WITH cut AS (
  SELECT doc_id, regexp_extract_all(text, '{unit_pattern(min_unit_words)}') AS u FROM documents),
unit AS (
  SELECT doc_id, unnest(u) AS x, unnest(range(1, len(u) + 1)) AS k FROM cut),
placed AS (
  SELECT doc_id, k, x, sum(length(x)) OVER (PARTITION BY doc_id ORDER BY k) AS stop,
         regexp_extract_all(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM unit),
hashed AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS idx, stop - length(x) AS start, stop, len(w) AS n,
         array_to_string(w, ' ') AS h FROM placed WHERE len(w) > 0),
ranked AS (
  SELECT *, row_number() OVER same AS nth, first_value(doc_id) OVER same AS first_id
  FROM hashed WINDOW same AS (PARTITION BY h ORDER BY doc_id, idx)),
again AS (SELECT *, idx - row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS run FROM ranked WHERE nth > 1)
SELECT doc_id, min(start)::BIGINT AS start, max(stop)::BIGINT AS stop, sum(n)::BIGINT AS n_words, count(*)::BIGINT AS n_units,
       string_agg(DISTINCT first_id::VARCHAR, ',' ORDER BY first_id::VARCHAR) AS first_doc_ids
FROM again GROUP BY doc_id, run HAVING sum(n) >= {min_words}"""
