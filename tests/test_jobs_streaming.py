"""End-to-end index job, reload, query, recluster; streaming ingest."""

import os

import pytest
from pyspark.sql import functions as F

from quarry.operators import chunking, lexical
from quarry.plans import jobs
from quarry.streaming import ingest, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("index"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    idx = jobs.index_corpus(spark, docs, root, n_components=5)
    return root, idx


def test_index_persisted_and_reloaded(spark, built):
    root, idx = built
    again = jobs.open_index(spark, root)
    n = again.chunks.count()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert n == chunking.chunk_fixed(docs, keep=["doc_id"]).count()
    assert again.chunks.select("chunk_uid").distinct().count() == n
    assert again.vocab.count() <= 10000
    assert set(r["cluster"] for r in again.chunks.select("cluster").distinct().collect()) <= set(range(5))
    # the cluster column is a partition column: a literal filter prunes the scan
    plan = again.chunks.where(F.col("cluster") == 1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "cluster" in plan


def test_query_index(spark, built):
    root, idx = built
    q = spark.read.parquet(f"{SF}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text").limit(3)
    out = jobs.query_index(idx, q, k=5)
    hits = out["hits"].collect()
    assert len(hits) == 15 and {r["method"] for r in hits} <= {"SPIDER", "BM25", "GMM"}
    conf = out["confidence"].collect()
    assert len(conf) == 3 and all(0 < r["confidence"] <= 1 for r in conf)
    assert all(r["n_context"] == 5 for r in out["context"].collect())
    only = jobs.query_index(idx, q, k=5, methods=("bm25",))["hits"].collect()
    assert {r["method"] for r in only} == {"BM25"}


def test_recluster(spark, built):
    root, _ = built
    idx = jobs.recluster(spark, root, 3)
    assert idx.model.k == 3
    assert set(r["cluster"] for r in idx.chunks.select("cluster").distinct().collect()) <= {0, 1, 2}


def test_streaming_ingest(spark, scratch):
    out, ckpt = os.path.join(scratch, "out"), os.path.join(scratch, "ckpt")
    q = ingest.start_ingest(spark, SF, out, ckpt, glob="documents.parquet")
    q.awaitTermination(300)
    got = spark.read.parquet(out)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want = chunking.chunk_fixed(docs, keep=["doc_id"])
    assert got.count() == want.count()
    assert got.select("doc_id", "chunk_index").exceptAll(want.select("doc_id", "chunk_index")).count() == 0


def test_cluster_filter(spark, built):
    _, idx = built
    q = spark.read.parquet(f"{SF}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text").limit(2)
    hits = jobs.query_index(idx, q, k=5, methods=("gmm",), cluster_filter=1)["hits"]
    ids = [r["doc_id"] for r in hits.collect()]
    clusters = {r["cluster"] for r in idx.chunks.where(F.col("chunk_id").isin(ids)).select("cluster").collect()}
    assert ids and clusters == {1}


def test_streaming_queries(spark, built, scratch):
    root, _ = built
    out, ckpt = os.path.join(scratch, "hits"), os.path.join(scratch, "qckpt")
    q = queries.start_query_stream(spark, root, SF, out, ckpt, glob="benchmark.parquet", k=3)
    q.awaitTermination(600)
    hits = spark.read.parquet(out)
    n_q = spark.read.parquet(f"{SF}/benchmark.parquet").count()
    assert hits.select("query_id").distinct().count() == n_q
    assert hits.groupBy("query_id").count().where("count > 3").count() == 0


def test_an_existing_index_raises_before_any_work(spark, built, monkeypatch):
    root, _ = built
    monkeypatch.setattr(jobs, "build_chunks", lambda *a, **k: pytest.fail("work was done"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    with pytest.raises(FileExistsError):
        jobs.index_corpus(spark, docs, root)
    with pytest.raises(ValueError):
        jobs.index_corpus(spark, docs, root, mode="append")
    with pytest.raises(FileNotFoundError):
        jobs.open_index(spark, os.path.join(root, "nowhere"))


def test_interrupted_reclustering_leaves_the_live_version(spark, built, monkeypatch):
    root, _ = built
    before = jobs.open_index(spark, root)
    k, n = before.model.k, before.chunks.count()

    def broken(*a, **kw):
        raise RuntimeError("the job died")

    monkeypatch.setattr(jobs, "_publish", broken)
    with pytest.raises(RuntimeError):
        jobs.recluster(spark, root, 2)
    after = jobs.open_index(spark, root)
    assert after.model.k == k and after.chunks.count() == n


def test_overwrite_leaves_earlier_readers_their_rows(spark, scratch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").limit(30)
    text = docs.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    first = jobs.index_corpus(spark, text, scratch, n_components=2)
    n = first.chunks.count()
    second = jobs.index_corpus(spark, text.where("doc_id < 'd2'"), scratch, n_components=2, mode="overwrite")
    assert first.chunks.count() == n > second.chunks.count() == jobs.open_index(spark, scratch).chunks.count()
    # string ids reach the hits, with content and metadata
    q = spark.createDataFrame([("q1", first.chunks.first()["text"][:200])], "query_id string, text string")
    out = jobs.query_index(first, q, k=3)
    hit = out["hits"].orderBy("rank").first()
    assert hit["query_id"] == "q1" and hit["document_id"].startswith("d") and hit["doc_id"].startswith(hit["document_id"] + "#")
    assert hit["content"] and hit["lang"]
    answer = out["responses"].collect()
    assert len(answer) == 1 and answer[0]["total_results"] == 3 and len(answer[0]["documents"]) == 3
    # a restriction holds before scoring: the list is still full
    some = hit["source"]
    only = jobs.query_index(first, q, k=3, restrict=f"source = '{some}'")["hits"].collect()
    assert {r["source"] for r in only} == {some}
    ids = spark.createDataFrame([(hit["document_id"],)], "doc_id string")
    assert {r["document_id"] for r in jobs.query_index(first, q, k=3, doc_filter=ids)["hits"].collect()} == {hit["document_id"]}


def _rows(df, *without):
    return sorted(str(r) for r in df.select(*[c for c in df.columns if c not in without]).collect())


def test_add_delete_merge_equal_a_rebuild(spark, scratch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").where("doc_id < 45")
    first, more = docs.where("doc_id < 30"), docs.where("doc_id >= 30")
    gone = docs.where("doc_id % 4 = 1").select("doc_id")
    root, again = os.path.join(scratch, "a"), os.path.join(scratch, "b")
    q = spark.read.parquet(f"{SF}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text").limit(4)
    old = jobs.index_corpus(spark, first, root, n_components=2)
    n_old = old.chunks.count()
    jobs.add_documents(spark, root, more)
    changed = jobs.delete_documents(spark, root, gone)
    with pytest.raises(ValueError):
        jobs.add_documents(spark, root, more.where("doc_id < 40"))  # 32 is live
    left = docs.join(gone, "doc_id", "left_anti")
    want = jobs.index_corpus(spark, left, again, n_components=2)
    merged = jobs.merge_index(spark, root)
    # the mixture is the first build's: all but the clusters equal the rebuild's
    for index in (changed, merged):
        assert _rows(index.chunks, "cluster") == _rows(want.chunks.select(index.chunks.columns), "cluster")
        assert _rows(index.vocab) == _rows(want.vocab) and _rows(index.vectors) == _rows(want.vectors)
    assert changed.blocks is None and merged.blocks is not None
    found = [_rows(jobs.query_index(index, q, k=5, methods=("bm25",), pruned=True)["hits"].select("query_id", "rank", "doc_id", F.round("score", 9)))
             for index in (changed, merged, want)]
    assert found[0] == found[1] == found[2] and len(found[0]) == 20
    assert old.chunks.count() == n_old  # an index opened earlier keeps its rows
    ids = jobs.add_documents(spark, root, docs.where("doc_id = 1"))  # a deleted id may come back
    assert ids.chunks.where("doc_id = 1").count() == old.chunks.where("doc_id = 1").count() > 0
    assert jobs.recluster(spark, root, 3).chunks.count() == ids.chunks.count()


def test_short_lists_are_filled_up(spark, scratch):
    text = [(i, f"alpha{i % 3} " * 40 + "common words here") for i in range(12)]
    docs = spark.createDataFrame(text, "doc_id long, text string")
    index = jobs.index_corpus(spark, docs, scratch, n_components=2)
    q = spark.createDataFrame([(1, "alpha1"), (2, "nothing"), (3, None)], "query_id long, text string")
    for zero in (True, False):
        a = lexical.pruned_search(index.lexical(), index.blocks, q, k=7, include_zero=zero)
        b = lexical.tfidf_search(index.lexical(), q, k=7, include_zero=zero)
        a, b = (x.select("query_id", "rank", "doc_id", F.round("score", 9)) for x in (a, b))
        assert _rows(a) == _rows(b) and a.count() == (21 if zero else 4)


def test_far_apart_document_ids_share_no_chunk_id(spark):
    text = "word " * 100
    docs = spark.createDataFrame([(5, text), (5 + 2**44, text)], "doc_id long, text string")
    assert jobs.build_chunks(docs).select("chunk_id").distinct().count() == 2
