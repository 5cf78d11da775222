"""Fusion, confidence, context, multi-turn queries."""

import pytest

from quarry.operators import hybrid

SCHEMA = "query_id long, rank int, doc_id long, score double"


def hits(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_first_method_wins_then_stable_rank(spark):
    spider = hits(spark, [(1, 1, 10, 0.5), (1, 2, 11, 0.4)])
    bm25 = hits(spark, [(1, 1, 11, 0.9), (1, 2, 12, 0.4)])  # better score later: spider's 0.4 is kept
    gmm = hits(spark, [(1, 1, 10, 0.99), (1, 2, 13, 0.5)])
    out = hybrid.fuse({"gmm": gmm, "bm25": bm25, "spider": spider}, k=10).orderBy("rank").collect()
    assert [(r["doc_id"], r["method"], r["score"]) for r in out] == [
        (10, "SPIDER", 0.5), (13, "GMM", 0.5), (11, "SPIDER", 0.4), (12, "BM25", 0.4)]
    # ties: method order first (spider 10 before gmm 13), then method rank


def test_empty_method_and_limit(spark):
    spider = hits(spark, [(1, i, 100 + i, 1.0 - i / 10) for i in range(1, 6)])
    bm25 = hits(spark, [])
    out = hybrid.fuse({"spider": spider, "bm25": bm25}, k=3).collect()
    assert sorted(r["doc_id"] for r in out) == [101, 102, 103]
    with pytest.raises(ValueError):
        hybrid.fuse({"other": spider}, k=3)


def test_confidence(spark):
    queries = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "query_id long, text string")
    fused = spark.createDataFrame(
        [(1, 1, 5, 0.4, "SPIDER", 1)]
        + [(2, i, i, 0.9, m, i) for i, m in zip(range(1, 11), ["SPIDER", "BM25", "GMM"] * 4)],
        "query_id long, rank int, doc_id long, score double, method string, method_rank int")
    got = {r["query_id"]: r for r in hybrid.confidence(fused, queries).collect()}
    assert got[3]["confidence"] == 0.0 and got[3]["n_results"] == 0
    assert got[1]["confidence"] == pytest.approx(0.4 + 0.1 + 0.05)
    assert got[2]["confidence"] == 1.0  # 0.9 + 0.3 + 0.2 capped


def test_context_and_prompt(spark):
    fused = spark.createDataFrame([(1, r, r, 0.5 / r, "BM25", r) for r in range(1, 8)],
                                  "query_id long, rank int, doc_id long, score double, method string, method_rank int")
    docs = spark.createDataFrame([(i, "x" * 600) for i in range(1, 8)], "doc_id long, text string")
    ctx = hybrid.context(fused, docs).collect()[0]
    assert ctx["n_context"] == 5
    blocks = ctx["context_text"].split("\n\n")
    assert blocks[0] == "Document 1 (Score: 0.500):\n" + "x" * 500 + "..."
    assert blocks[1].startswith("Document 2 (Score: 0.250):")
    q = spark.createDataFrame([(1, "why?")], "query_id long, text string")
    p = hybrid.prompt(hybrid.context(fused, docs), q).collect()[0]["prompt"]
    assert "Question: why?" in p and blocks[0] in p


def test_conversation_queries(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "x"), (1, 2, "user", "b"),
                                   (1, 3, "user", "c"), (1, 4, "user", "d"), (2, 0, "user", "z")],
                                  "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): r["query_text"] for r in hybrid.conversation_queries(turns, 2).collect()}
    assert got == {(1, 0): "a", (1, 2): "a\nb", (1, 3): "a\nb\nc", (1, 4): "b\nc\nd", (2, 0): "z"}


def test_answer_plugin(spark):
    prompts = spark.createDataFrame([(1, "p one"), (2, "p two")], "query_id long, prompt string")
    got = {r["query_id"]: r["answer"] for r in hybrid.answer(prompts, lambda ps: [p.upper() for p in ps]).collect()}
    assert got == {1: "P ONE", 2: "P TWO"}
