"""Chunkers: one document row in, many chunk rows out.

All chunkers are narrow (no shuffle).  Chunk numbering (``chunk_number``,
``total_chunks``) is computed inside the row before the explode, so the
per-document window the numbering implies never needs a shuffle.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import text as tx
from quarry.operators.slices import TEXT_BYTES, series_slices

CHUNK_SIZE = 1000
CHUNK_OVERLAP = 200
MIN_CHUNK_LENGTH = 100
SENTENCE_MAX_WORDS = 100
SENTENCE_SPLIT = r"(?<=[.!?])" + tx.WS_RUN


def _check(size: int, overlap: int) -> None:
    if size <= 0:
        raise ValueError("chunk size must be positive")
    if not 0 <= overlap < size:
        raise ValueError("overlap must satisfy 0 <= overlap < chunk size")


def _number_and_explode(df: DataFrame, pieces: Column, keep: list[str], min_length: int,
                        source: Column | None, strip=F.trim) -> DataFrame:
    """``pieces`` is an array<struct<window_start int, at int, text string>> in order.

    chunk_index  — position among non-empty pieces (before the length filter)
    chunk_number — 1-based position after the length filter; total_chunks its count
    chunk_start_char — ``at``, where the text starts; or, when ``source`` is given,
    its first occurrence there (a search from the start for every chunk)
    """
    indexed = F.transform(pieces, lambda p, i: F.struct(
        i.alias("chunk_index"), p["window_start"].alias("window_start"), p["text"].alias("text"),
        (p["at"] if source is None else F.instr(source, p["text"]) - 1).alias("chunk_start_char")))
    kept = F.filter(indexed, lambda p: F.length(strip(p["text"])) >= min_length)
    staged = df.select(*keep, kept.alias("_chunks"))
    # posexplode_outer + null filter keeps the optimizer from inferring a
    # size() > 0 filter that would evaluate the chunk array twice.
    out = staged.select(*keep, F.posexplode_outer("_chunks").alias("_pos", "_c"),
                        F.size("_chunks").alias("total_chunks")).where(F.col("_c").isNotNull())
    return out.select(
        *keep,
        F.col("_c.chunk_index").alias("chunk_index"),
        (F.col("_pos") + 1).alias("chunk_number"),
        "total_chunks",
        F.col("_c.text").alias("text"),
        F.length("_c.text").alias("chunk_size"),
        F.col("_c.chunk_start_char").alias("chunk_start_char"),
        (F.col("_c.chunk_start_char") + F.length("_c.text")).alias("chunk_end_char"),
        F.col("_c.window_start").alias("window_start"),
    )


def chunk_fixed(df: DataFrame, text_col: str = "text", keep: list[str] | None = None,
                size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, min_length: int = MIN_CHUNK_LENGTH,
                normalise: bool = True, first_occurrence: bool = False) -> DataFrame:
    """Fixed-stride overlapping character windows over (normalised) text.

    Text no longer than ``size`` is one chunk; otherwise windows start at
    0, size-overlap, 2(size-overlap), … while the start is inside the text,
    each window stripped and empty ones skipped.  Chunks shorter than
    ``min_length`` (after stripping) are dropped.

    The text is cut once into strides and a window is a few strides joined, so
    the work is linear in the text.  ``first_occurrence`` reports where a chunk's
    text first occurs instead of where it was cut; that search is not linear.
    """
    _check(size, overlap)
    keep = list(keep if keep is not None else [c for c in df.columns if c != text_col])
    src = tx.normalize(text_col) if normalise else F.col(text_col)
    # after normalisation only plain spaces remain, so the cheap trim is exact
    strip, lead = (F.trim, F.ltrim) if normalise else (tx.strip_ws, tx.lstrip_ws)
    step = size - overlap
    staged = df.select(*keep, src.alias("_src")).select(
        *keep, "_src", F.regexp_extract_all("_src", F.lit(f"(?s).{{1,{step}}}"), 0).alias("_strides"))
    s = F.col("_src")
    single = F.array(F.struct(F.lit(0).alias("window_start"), F.lit(0).alias("at"), s.alias("text")))
    raw = F.transform("_strides", lambda x, i: F.struct(
        (i * step).alias("start"),
        F.substring(F.array_join(F.slice("_strides", i + 1, -(-size // step)), ""), 1, size).alias("raw")))
    windows = F.filter(
        F.transform(raw, lambda w: F.struct(
            w["start"].alias("window_start"), (w["start"] + F.length(w["raw"]) - F.length(lead(w["raw"]))).alias("at"),
            strip(w["raw"]).alias("text"))),
        lambda p: p["text"] != F.lit(""))
    pieces = F.when(F.length(s) <= size, single).otherwise(windows)
    return _number_and_explode(staged, pieces, keep, min_length, s if first_occurrence else None, strip)


# --- separator-aware windows (raw text) --------------------------------------------

_PIECES = T.ArrayType(T.StructType([T.StructField("window_start", T.IntegerType()), T.StructField("at", T.IntegerType()),
                                    T.StructField("text", T.StringType())]))


def _chain(step, n: int) -> list[int]:
    """0, step(0), step(step(0)), ... as long as they are below ``n``."""
    return list(itertools.takewhile(lambda x: x < n, itertools.accumulate(itertools.repeat(0), lambda x, _: step(x))))


def _separator_pieces(size: int, overlap: int, separator: str):
    mark = re.compile(re.escape(separator))

    def cut(text: str | None):
        if text is None:
            return None
        if len(text) <= size:
            return [(0, 0, text)]
        marks = [m.start() for m in mark.finditer(text)]

        def stop(start: int) -> int:
            """Just after the last separator of the window's second half, or the window's end."""
            i = bisect.bisect_right(marks, start + size - len(separator)) - 1
            return marks[i] + 1 if start + size < len(text) and i >= 0 and marks[i] > start + size // 2 else start + size

        starts = _chain(lambda x: stop(x) - overlap, len(text))
        windows = ((x, text[x:stop(x)]) for x in starts)
        return [(x, x + len(w) - len(w.lstrip()), w.strip()) for x, w in windows if w.strip()]

    @F.pandas_udf(_PIECES)
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = ("window_start", "at", "text")
        for texts in series_slices(batches, TEXT_BYTES):
            yield texts.map(lambda t: None if t is None else [dict(zip(names, p, strict=True)) for p in cut(t)])

    return pieces


def chunk_separator(df: DataFrame, text_col: str = "text", keep: list[str] | None = None,
                    size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, min_length: int = MIN_CHUNK_LENGTH,
                    separator: str = "\n", first_occurrence: bool = False) -> DataFrame:
    """Windows that end just after the last separator in their second half.

    The next window starts ``overlap`` characters before the previous end, so
    each boundary depends on the previous one: a small per-row helper looks the
    separators up in their sorted positions and cuts the text in one go.
    """
    _check(size, overlap)
    if overlap >= size - size // 2:
        raise ValueError("separator-aware chunking needs overlap < chunk size / 2")
    keep = list(keep if keep is not None else [c for c in df.columns if c != text_col])
    staged = df.select(*keep, F.col(text_col).alias("_src"),
                       _separator_pieces(size, overlap, separator)(F.col(text_col)).alias("_p"))
    return _number_and_explode(staged, F.col("_p"), keep, min_length, F.col("_src") if first_occurrence else None, tx.strip_ws)


# --- sentence packing ------------------------------------------------------------------

_GROUPS = T.ArrayType(T.StructType([
    T.StructField("first", T.IntegerType()),
    T.StructField("count", T.IntegerType()),
]))


def _pack_groups(max_words: int):
    def groups(counts):
        """Runs of sentences whose words fit the budget; a longer sentence is a run alone."""
        total = np.concatenate([[0], np.cumsum(counts)])

        def end(first: int) -> int:
            return max(first + 1, int(np.searchsorted(total, total[first] + max_words, side="right")) - 1)

        return [{"first": x, "count": end(x) - x} for x in _chain(end, len(counts))]

    @F.pandas_udf(_GROUPS)
    def pack(counts: pd.Series) -> pd.Series:
        return counts.map(lambda c: None if c is None else groups(c))

    return pack


def chunk_sentences(df: DataFrame, text_col: str = "text", keep: list[str] | None = None,
                    max_words: int = SENTENCE_MAX_WORDS, sentences: Column | None = None) -> DataFrame:
    """Greedy sentence packing up to ``max_words`` whitespace words per chunk.

    Sentences are split after ``.``, ``!`` or ``?`` followed by whitespace (or are those
    of the column ``sentences``, e.g. from learnt boundaries, see ``operators.sentences``)
    and joined back with one space; empty chunks are dropped.  Only the sentence
    word counts cross into Python (the packing walk is sequential); the text
    stays in the JVM and no shuffle is needed.
    """
    keep = list(keep if keep is not None else [c for c in df.columns if c != text_col])
    split = F.split(F.col(text_col), SENTENCE_SPLIT) if sentences is None else sentences
    staged = df.select(*keep, split.alias("_s"))
    staged = staged.select(*keep, "_s", _pack_groups(max_words)(
        F.transform("_s", lambda x: tx.word_count(x))).alias("_g"))
    chunks = F.filter(
        F.transform("_g", lambda g: F.array_join(F.slice("_s", g["first"] + 1, g["count"]), " ")),
        lambda c: c != F.lit(""))
    out = (staged.select(*keep, F.posexplode_outer(chunks).alias("chunk_index", "text"))
           .where(F.col("text").isNotNull()))
    return out.withColumn("n_words", tx.word_count("text"))
