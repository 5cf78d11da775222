"""Dense search against numpy, approximate recall, audits, mixture invariants."""

import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import blocks, dense, mixture

SF = "/root/testdata/sf0.001"


def brute_top(corpus, queries, k):
    c = np.array([v for _, v in corpus]) / np.linalg.norm([v for _, v in corpus], axis=1)[:, None]
    out = {}
    for qid, qv in queries:
        s = c @ (np.asarray(qv) / np.linalg.norm(qv))
        order = sorted(range(len(corpus)), key=lambda i: (-round(s[i], 9), corpus[i][0]))[:k]
        out[qid] = [corpus[i][0] for i in order]
    return out


def test_dense_search_matches_numpy(spark):
    emb = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), "embedding")
    rows = [(r["doc_id"], r["embedding"]) for r in emb.collect()]
    q = emb.where(F.col("doc_id") % 50 == 0).select(F.col("doc_id").alias("query_id"), "embedding")
    qrows = [(r["query_id"], r["embedding"]) for r in q.collect()]
    got = {}
    for r in dense.dense_search(emb.repartition(3), q, k=7).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["doc_id"]))
    want = brute_top(rows, qrows, 7)
    assert {k: [d for _, d in sorted(v)] for k, v in got.items()} == want
    one = dense.dense_search_one(emb, qrows[0][1], k=7).orderBy("rank").collect()
    assert [r["doc_id"] for r in one] == want[qrows[0][0]]


def test_ann_recall(spark):
    emb = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), "embedding")
    centres = mixture.kmeans(emb, 8, id_col="doc_id")
    q = emb.select(F.col("doc_id").alias("query_id"), "embedding")
    exact = {(r["query_id"], r["doc_id"]) for r in dense.dense_search(emb, q, k=10).collect()}
    approx = {(r["query_id"], r["doc_id"]) for r in dense.ann_search(emb, q, centres, k=10, nprobe=3).collect()}
    recall = len(exact & approx) / len(exact)
    assert recall >= 0.6, recall
    full = {(r["query_id"], r["doc_id"]) for r in dense.ann_search(emb, q, centres, k=10, nprobe=8).collect()}
    assert full == exact  # probing every list is exact


def test_hash_embed_unit_length(spark):
    df = spark.createDataFrame([(1, "alpha beta beta"), (2, "")], "doc_id long, text string")
    got = {r["doc_id"]: np.array(r["embedding"]) for r in dense.hash_embed(df).collect()}
    assert got[1].shape == (64,) and np.isclose(np.linalg.norm(got[1]), 1.0)
    assert not got[2].any()


def test_vector_audit(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, float("nan")]), (2, [1.0, 2.0, 3.0]), (3, None)],
                               "vec_id long, embedding array<float>")
    r = dense.vector_audit(df).collect()[0]
    assert (r["n_rows"], r["n_ids"], r["min_dim"], r["max_dim"], r["n_nan"], r["n_zero"], r["n_null"]) == (
        4, 3, 2, 3, 1, 1, 1)


def test_gmm_invariants(spark):
    emb = spark.read.parquet(f"{SF}/embeddings.parquet")
    m = mixture.fit_gmm(emb, k=4, max_iter=30)
    assert m.k == 4 and np.isclose(m.weights.sum(), 1.0)
    assert all(np.all(np.linalg.eigvalsh(c) > 0) for c in m.covariances)
    # EM never lowers the likelihood (up to the covariance floor)
    m2 = mixture.fit_gmm(emb, k=4, max_iter=m.n_iter + 3)
    assert m2.log_likelihood >= m.log_likelihood - 1e-6
    a = {r["vec_id"]: r["cluster"] for r in mixture.assign(emb, m).collect()}
    b = {r["vec_id"]: r["cluster"] for r in mixture.assign(emb.repartition(5), m).collect()}
    assert a == b and set(a.values()) <= set(range(4))
    with pytest.raises(ValueError):
        mixture.fit_gmm(emb.limit(3), k=4)


def test_diagonal_tie_and_cluster_info(spark):
    df = spark.createDataFrame([(1, [0.0], 0), (2, [2.0], 1), (3, [1.0], 0), (4, [1.0], 1)],
                               "vec_id long, embedding array<double>, label int")
    params = mixture.diagonal_from_labels(df)
    a = {r["vec_id"]: r["cluster"] for r in mixture.assign_diagonal(df, params).collect()}
    assert a[1] == 0 and a[2] == 1
    info = {r["cluster"]: r["document_count"] for r in mixture.cluster_info(
        mixture.assign_diagonal(df, params), 3).collect()}
    assert info[2] == 0 and sum(info.values()) == 4


def test_query_blocks_agree(spark, monkeypatch):
    emb = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), "embedding")
    q = emb.where(F.col("doc_id") % 20 == 0).select(F.col("doc_id").alias("query_id"), "embedding")

    def run(**kw):
        d = emb.select(F.col("doc_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
        qq = q.select("query_id", F.col("embedding").cast("array<double>").alias("v"))
        hits = blocks.block_top_k(d.repartition(3), qq, lambda r: dense._matrix(r, 64), lambda a, x: a @ dense._matrix(x, 64).T,
                                  5, qq.count(), **kw)
        return sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in hits.collect())

    one = run()
    assert run(query_rows=3, pack_rows=7) == one  # many blocks and packs, same answer
    monkeypatch.setattr(blocks, "OPEN_BLOCKS", 1)
    assert run(query_rows=2) == one
    monkeypatch.setattr(blocks, "SHIP_BYTES", 4096)  # several shipments
    assert run(query_rows=2) == one
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert run(query_rows=3) == one
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_string_ids_and_groups(spark):
    rows = [(f"d{i}", [float(i % 4), 1.0], "g%d" % (i % 2)) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id string, embedding array<float>, lang string")
    q = spark.createDataFrame([("q1", [1.0, 0.0], "g1"), ("q2", [0.0, 1.0], "g0")], "query_id string, embedding array<double>, lang string")
    got = dense.dense_search(df, q, k=2).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["doc_id"]) for r in got] == [("q1", "d11"), ("q1", "d3"), ("q2", "d0"), ("q2", "d4")]
    got = dense.dense_search(df, q, k=1, group_col="lang", query_group_col="lang").orderBy("query_id").collect()
    assert [(r["query_id"], r["doc_id"]) for r in got] == [("q1", "d11"), ("q2", "d0")]


def test_searched_groups_are_pruned_at_run_time(spark, scratch):
    """Files of clusters that no query has are spoilt; the plan has the dynamic filter."""
    emb = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    path = os.path.join(scratch, "v")
    emb.write.partitionBy("label").parquet(path)
    stored = spark.read.parquet(path)
    q = emb.where("label IN (2, 5) AND doc_id % 7 = 0").withColumnRenamed("doc_id", "query_id")

    def run():
        hits = dense.dense_search(stored, q, k=4, group_col="label", query_group_col="label")
        return sorted((r["query_id"], r["rank"], r["doc_id"]) for r in hits.collect())

    want = run()
    for f in glob.glob(os.path.join(path, "label=*", "*.parquet")):
        if "label=2" not in f and "label=5" not in f:
            with open(f, "wb") as out:
                out.write(b"not parquet")
    assert want and run() == want
    asked = q.select("query_id", F.col("label").alias("grp"))
    plan = dense.only_groups(stored, asked, "label", "grp")._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan


def test_vectors_that_cannot_be_scored(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.0, 0.0, 0.0]), (4, [1.0, float("nan"), 0.0]),
            (5, [1.0, 1.0]), (6, [0.9, 0.1, 0.0]), (6, [0.8, 0.2, 0.0]), (7, None)] + [(10 + i, [float(i % 3), 1.0, 0.5])
                                                                                      for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, embedding array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.0, 0.0])], "query_id long, embedding array<double>")
    got = [r["doc_id"] for r in dense.dense_search(df, q, k=3, skip_other_lengths=True).orderBy("rank").collect()]
    assert got == [1, 6, 6]
    with pytest.raises(Exception, match="does not have 3 components"):
        dense.dense_search(df, q, k=3).collect()
    with pytest.raises(ValueError, match="query vectors have 2 to 3"):
        dense.dense_search(df, df.where("doc_id in (1, 5)").withColumnRenamed("doc_id", "query_id"), k=3)
    assert sorted(tuple(r) for r in dense.rejected_vectors(df, 3).collect()) == [(4, "not a number"), (5, "wrong length"), (7, "missing")]
    vec = df.withColumnRenamed("doc_id", "vec_id")
    with pytest.raises(ValueError, match="2 to 3 components"):
        mixture.fit_gmm(vec, k=2, max_iter=5)
    m = mixture.fit_gmm(vec.where("vec_id <> 5"), k=2, max_iter=5)
    assert m.means.shape == (2, 3) and np.all(np.isfinite(m.means))
    labels = {r["vec_id"]: r["cluster"] for r in mixture.assign(vec, m).collect()}
    assert labels[4] is None and labels[5] is None and labels[7] is None and labels[1] is not None


def test_large_means_keep_their_precision(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(1e6, 1, (200, 2)), rng.normal(1e6 + 50, 2, (200, 2))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    m = mixture.fit_gmm(df, k=2)
    got = sorted(float(np.sqrt(np.trace(c) / 2)) for c in m.covariances)
    assert got[0] == pytest.approx(1, rel=0.2) and got[1] == pytest.approx(2, rel=0.2)


def test_registered_approximate_search_recall(spark):
    from quarry.plans import catalog, catalog_more
    sf = "/root/testdata/sf0.01"
    emb = spark.read.parquet(f"{sf}/embeddings.parquet").withColumnRenamed("vec_id", "doc_id")
    exact = {(r["query_id"], r["doc_id"]) for r in dense.dense_search(emb, catalog_more._every_twentieth(spark, sf), k=catalog.K).collect()}
    approx = {(r["query_id"], r["vec_id"]) for r in catalog.queries()["dense_ann"](spark, sf).collect()}
    assert len(exact & approx) / len(exact) >= 0.9


def test_em_step_against_numpy(spark):
    from quarry.plans.catalog_more import _fixed_model
    rng = np.random.default_rng(3)
    x = rng.normal(0, 0.2, (300, 2))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    m = _fixed_model()
    p = np.stack([w * np.exp(-0.5 * np.einsum("ij,jk,ik->i", x - mu, np.linalg.inv(c), x - mu)) / (2 * np.pi * np.sqrt(np.linalg.det(c)))
                  for w, mu, c in zip(m.weights, m.means, m.covariances)], axis=1)
    r = p / p.sum(axis=1, keepdims=True)
    got = mixture.em_step(df, m)
    means = (r.T @ x) / r.sum(0)[:, None]
    assert np.allclose(got.weights, r.mean(0)) and np.allclose(got.means, means)
    cov = [((x - means[j]) * r[:, j:j + 1]).T @ (x - means[j]) / r[:, j].sum() + 1e-6 * np.eye(2) for j in range(3)]
    assert np.allclose(got.covariances, cov) and got.log_likelihood == pytest.approx(np.log(p.sum(axis=1)).mean())
    labels = {q["vec_id"]: q["cluster"] for q in mixture.assign(df, m).collect()}
    assert [labels[i] for i in range(300)] == p.argmax(axis=1).tolist()


def test_refitted_mixtures_reach_a_fresh_fit(spark):
    """Fewer, as many and more components from a fitted mixture, and going on with more rows."""
    rng = np.random.default_rng(6)
    centres = np.array([[0, 0, 0], [6, 0, 0], [0, 6, 0], [0, 0, 6], [6, 6, 6]], float)
    x = np.concatenate([c + rng.standard_normal((150, 3)) * 0.7 for c in centres])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    three = mixture.fit_gmm(df, k=3)
    for k in (2, 3, 5):
        fresh, again = mixture.fit_gmm(df, k=k), mixture.refit(df, three, k)
        assert again.k == k and np.isclose(again.weights.sum(), 1)
        assert again.log_likelihood >= fresh.log_likelihood - 0.01 * abs(fresh.log_likelihood)
    part = mixture.fit_gmm(df.where("vec_id % 2 = 0"), k=5)
    assert mixture.refit(df, part).log_likelihood >= mixture.fit_gmm(df, k=5).log_likelihood * 1.01
    with pytest.raises(ValueError):
        mixture.refit(df.limit(2), three, 3)


def test_splits_and_merges_keep_the_moments():
    rng = np.random.default_rng(7)
    a = rng.standard_normal((3, 4, 4))
    model = mixture.MixtureModel(np.array([0.2, 0.5, 0.3]), rng.standard_normal((3, 4)), a @ a.transpose(0, 2, 1) + np.eye(4))

    def moments(m):
        mean = m.weights @ m.means
        gap = m.means - mean
        return mean, np.einsum("k,kij->ij", m.weights, m.covariances) + np.einsum("k,ki,kj->ij", m.weights, gap, gap)

    for changed in (mixture.split_once(model), mixture.split_once(model, 2), mixture.merge_once(model)):
        assert all(np.allclose(x, y) for x, y in zip(moments(changed), moments(model), strict=True))
        assert (np.linalg.eigvalsh(changed.covariances) > 0).all()
    # halves that were split are the cheapest to merge again
    assert np.allclose(sorted(mixture.merge_once(mixture.split_once(model, 0)).weights), sorted(model.weights))
