"""Chunkers: edge lengths, numbering, offsets, separators, sentences."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import chunking


def chunks_of(spark, text, **kw):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    out = chunking.chunk_fixed(df, keep=["doc_id"], **kw).orderBy("chunk_index").collect()
    return out


@pytest.mark.parametrize("n,expected", [
    (0, []), (99, []), (100, [100]), (999, [999]), (1000, [1000]), (1001, [1000, 201]),
    (1800, [1000, 1000, 200]), (1801, [1000, 1000, 201]), (2599, [1000, 1000, 999, 199]),
])
def test_edge_lengths(spark, n, expected):
    text = ("abcdefghij" * 300)[:n]
    got = [r["chunk_size"] for r in chunks_of(spark, text)]
    # windows shorter than 100 characters are dropped
    assert got == [e for e in expected if e >= 100]


def test_long_repeated_text(spark):
    out = chunks_of(spark, "This is a very long text. " * 100, first_occurrence=True)
    # the third window starts on a space, which stripping removes
    assert [r["chunk_size"] for r in out] == [1000, 1000, 998, 199]
    assert [r["chunk_number"] for r in out] == [1, 2, 3, 4]
    assert {r["total_chunks"] for r in out} == {4}
    # offsets are first occurrences of the chunk text (repeated text quirk)
    assert out[0]["chunk_start_char"] == 0
    assert all(r["chunk_start_char"] <= r["window_start"] for r in out)


def test_offsets_are_where_the_text_was_cut(spark):
    text = "This is a very long text. " * 100
    for r in chunks_of(spark, text):
        assert text[r["chunk_start_char"]:r["chunk_end_char"]] == r["text"]
    assert [r["chunk_start_char"] for r in chunks_of(spark, text)] == [0, 800, 1601, 2400]


def test_a_very_long_document(spark):
    """Twenty million characters: the work is linear in the text."""
    df = spark.range(1).select(F.lit(1).alias("doc_id"), F.repeat(F.lit("wörd and more. "), 1_333_334).alias("text"))
    got = chunking.chunk_fixed(df, keep=["doc_id"]).agg(F.count("*").alias("n"), F.max("window_start").alias("last")).first()
    assert (got["n"], got["last"]) == (25_000, 24_999 * 800)  # the last nine characters are too short a chunk
    part = df.select("doc_id", F.substring("text", 1, 3_000_000).alias("text"))
    assert chunking.chunk_separator(part, keep=["doc_id"], separator=".").count() > 3_700
    assert chunking.chunk_sentences(part, keep=["doc_id"]).count() > 5_900


def test_numbering_after_filter(spark):
    text = ("word " * 190).strip() + " " + "z" * 5  # 955 chars: one chunk
    assert len(chunks_of(spark, text)) == 1
    # 1850 chars: windows at 0, 800, 1600; the last (250) stays, numbering is dense
    long = "x" * 1850
    out = chunks_of(spark, long)
    assert [(r["chunk_index"], r["chunk_number"], r["total_chunks"]) for r in out] == [(0, 1, 3), (1, 2, 3), (2, 3, 3)]
    out = chunks_of(spark, "y" * 1650)  # tail window of 50 chars is dropped after indexing
    assert [(r["chunk_index"], r["chunk_number"], r["total_chunks"]) for r in out] == [(0, 1, 2), (1, 2, 2)]


def test_overlap_zero_and_invalid(spark):
    out = chunks_of(spark, "q" * 2500, overlap=0)
    assert [r["chunk_size"] for r in out] == [1000, 1000, 500]
    with pytest.raises(ValueError):
        chunks_of(spark, "q" * 10, overlap=1000)
    with pytest.raises(ValueError):
        chunks_of(spark, "q" * 10, overlap=-1)


def test_separator_chunks(spark):
    para = ("a" * 599 + "\n") * 3  # 1800 chars, breaks after each 600
    df = spark.createDataFrame([(1, para)], "doc_id long, text string")
    out = chunking.chunk_separator(df, keep=["doc_id"]).orderBy("chunk_index").collect()
    # window 1 [0,1000) cuts after the newline at 599 -> [0,600); next start 400
    assert [r["window_start"] for r in out] == [0, 400, 1000]
    assert [r["chunk_size"] for r in out] == [599, 799, 799]
    with pytest.raises(ValueError):
        chunking.chunk_separator(df, overlap=600)


def test_sentence_packing(spark):
    long_first = " ".join(["w"] * 120) + ". Short one. Another short."
    df = spark.createDataFrame([(1, long_first), (2, "no terminator here"), (3, "")], "doc_id long, text string")
    out = chunking.chunk_sentences(df, keep=["doc_id"]).orderBy("doc_id", "chunk_index").collect()
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append((r["chunk_index"], r["n_words"]))
    # the empty chunk before an over-budget first sentence is dropped
    assert by[1] == [(0, 120), (1, 4)]
    assert by[2] == [(0, 3)]
    assert 3 not in by
