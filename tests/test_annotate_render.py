"""Topics, page and block assembly, table rendering."""

from quarry.operators import annotate
from quarry.sources import render


def topics(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return annotate.with_topics(df).collect()[0]["potential_topics"]


def test_topics_rules(spark):
    t = "Alpha Beta went. Alpha Beta came. Gamma is here. Gamma again. Delta once."
    assert topics(spark, t) == ["Alpha Beta", "Gamma"]  # ties by first appearance; single ones dropped
    # five-word phrases are ignored entirely, four-word ones counted
    t = "One Two Three Four Five x One Two Three Four Five y Ab Cd Ef Gh z Ab Cd Ef Gh"
    assert topics(spark, t) == ["Ab Cd Ef Gh"]
    # a capitalised word glued to a digit or an inner capital is not a phrase word
    assert topics(spark, "Word2 Word2 McDonald McDonald") == []
    # more than ten candidates: the ten most frequent
    words = [f"W{c}" for c in "abcdefghijkl"]
    t = " . ".join(w for i, w in enumerate(words) for _ in range(12 - i))
    assert topics(spark, t) == words[:10]


def test_assemble_pages(spark):
    pages = spark.createDataFrame(
        [("d1", 1, "first"), ("d1", 2, "  \n "), ("d1", 3, "third"), ("d2", 1, " "), ("d2", 2, "")],
        "doc_id string, page_no int, text string")
    docs, rejects = render.assemble_pages(pages)
    got = {r["doc_id"]: r for r in docs.collect()}
    assert got["d1"]["text"] == "\n--- Page 1 ---\nfirst\n\n--- Page 3 ---\nthird\n"
    assert got["d1"]["n_pages"] == 2
    assert [r["doc_id"] for r in rejects.collect()] == ["d2"]


def test_assemble_blocks(spark):
    blocks = spark.createDataFrame([
        ("d", 2, "row", ["a", " ", "b"]),
        ("d", 0, "paragraph", ["Intro"]),
        ("d", 1, "paragraph", ["   "]),
        ("d", 3, "row", ["", " "]),
        ("d", 4, "paragraph", ["End"]),
        ("e", 0, "paragraph", [" "]),
    ], "doc_id string, seq int, kind string, cells array<string>")
    docs, rejects = render.assemble_blocks(blocks)
    got = {r["doc_id"]: r for r in docs.collect()}
    assert got["d"]["text"] == "Intro\nEnd\na | b\n"  # paragraphs first, then table rows
    assert (got["d"]["n_paragraphs"], got["d"]["n_rows"]) == (2, 1)
    assert [r["doc_id"] for r in rejects.collect()] == ["e"]


def test_render_table_and_groups(spark):
    df = spark.createDataFrame([(i, "g" + str(i % 2), None if i == 3 else float(i)) for i in range(1, 8)],
                               "id int, g string, v double")
    t = render.render_table(df, ["id"], limit=5).collect()[0]
    assert t["text"].startswith("Columns: id, g, v\n\nRow 1: 1 | g1 | 1.0\n")
    assert "Row 3: 3 | g1 | nan\n" in t["text"]
    assert t["text"].endswith("Row 5: 5 | g1 | 5.0\n\n... and 2 more rows\n")
    groups = {r["group"]: r for r in render.render_groups(df, "g", ["id"], limit=3).collect()}
    assert groups["g0"]["text"] == "\n--- Sheet: g0 ---\nColumns: id, v\n\nRow 1: 2 | 2.0\nRow 2: 4 | 4.0\nRow 3: 6 | 6.0\n"
    assert groups["g1"]["text"].endswith("\n... and 1 more rows\n")


def test_corpus_stats_empty_and_filled(spark):
    from quarry.operators import reports

    empty = spark.createDataFrame([], "doc_id long, text string")
    assert reports.corpus_stats(empty).count() == 0
    full = spark.createDataFrame([(1, "a b c"), (2, "dd ee")], "doc_id long, text string")
    r = reports.corpus_stats(full).collect()[0]
    assert (r["total_chunks"], r["chunk_characters"], r["total_words"], r["min_chunk_size"], r["max_chunk_size"]) == (
        2, 10, 5, 5, 5)
