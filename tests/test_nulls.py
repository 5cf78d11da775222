"""Null and empty texts flow through the main operators without errors."""

from pyspark.sql import functions as F

from quarry.operators import annotate, chunking, dense, lexical
from quarry.operators import similarity as sim


def test_null_texts(spark):
    docs = spark.createDataFrame([(1, "Alpha beta gamma delta " * 40), (2, None), (3, "")],
                                 "doc_id long, text string")
    assert chunking.chunk_fixed(docs, keep=["doc_id"]).select("doc_id").distinct().collect() == [(1,)]
    assert chunking.chunk_separator(docs, keep=["doc_id"]).where(F.col("doc_id") == 2).count() == 0
    assert chunking.chunk_sentences(docs, keep=["doc_id"]).where(F.col("doc_id") == 2).count() == 0
    idx = lexical.build_tfidf_index(docs)
    q = spark.createDataFrame([(0, "alpha beta"), (1, None)], "query_id long, text string")
    hits = lexical.tfidf_search(idx, q, k=2).collect()
    assert {r["query_id"] for r in hits} == {0, 1}
    bm = lexical.bm25_search(lexical.build_bm25_index(docs), q, k=2).collect()
    assert {r["query_id"] for r in bm} == {0}
    vec = {r["doc_id"]: r["embedding"] for r in dense.hash_embed(docs).collect()}
    assert sum(vec[2]) == 0 and sum(vec[3]) == 0
    assert annotate.with_topics(docs).count() == 3
    assert annotate.annotate_documents(docs).count() == 3
    pairs = sim.similarity_join(docs, None, "jaccard", 0.5, left_id="doc_id").collect()
    assert all(r["left_id"] != 2 and r["right_id"] != 2 for r in pairs)
