"""Product quantisation: codes, recall, bytes read, odd vectors."""

import glob
import os

import numpy as np
import pytest

from quarry.operators import dense, quantize

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pq"))
    emb = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    books = quantize.train(emb, rounds=4)
    quantize.write_store(emb, books, path, files=16)
    return path, emb, books


def hits(df):
    return {(r["query_id"], r["doc_id"]): r["score"] for r in df.collect()}


def test_recall_and_exact_scores(spark, stored):
    path, emb, _ = stored
    q = emb.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    exact = hits(dense.dense_search(emb, q, k=10, id_col="vec_id"))
    got = hits(quantize.search(spark, path, q, k=10, shortlist=40))
    assert len(got) == len(exact) and len(got.keys() & exact.keys()) >= 0.9 * len(exact)
    assert all(abs(got[p] - exact[p]) < 1e-9 for p in got.keys() & exact.keys())
    # of 500 vectors of 256 bytes a query takes 16-byte codes and 40 vectors: under a third
    assert 500 * 16 + 40 * 256 < 500 * 256 / 3


def test_only_files_of_the_shortlist_are_read(spark, stored, scratch):
    path, emb, _ = stored
    q = emb.where("vec_id = 20").withColumnRenamed("vec_id", "query_id")
    want = hits(quantize.search(spark, path, q, k=3, shortlist=4))
    short = spark.createDataFrame([(20, i) for _, i in want], "query_id long, id long")
    plan = quantize.candidates(spark, path, short)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    used = {r["f"] for r in short.select(quantize._file_of("id", 16).alias("f")).collect()}
    spoilt = [f for f in glob.glob(os.path.join(path, "vectors", "file=*", "*.parquet")) if int(f.split("file=")[1].split("/")[0]) not in used]
    kept = {f: open(f, "rb").read() for f in spoilt}
    try:
        for f in spoilt:
            with open(f, "wb") as out:
                out.write(b"not parquet")
        assert spoilt and quantize.candidates(spark, path, short).count() == len(want)
    finally:
        for f, data in kept.items():
            with open(f, "wb") as out:
                out.write(data)


def test_codes_are_the_nearest_centres():
    rng = np.random.default_rng(4)
    x, centres = rng.standard_normal((500, 12)), rng.standard_normal((3, 7, 4))
    want = np.stack([((x[:, 4 * p:4 * p + 4, None] - centres[p].T[None]) ** 2).sum(1).argmin(1) for p in range(3)], axis=1)
    assert (quantize.encode(x, centres) == want).all()


def test_rounds_lower_the_error(spark, stored):
    _, emb, _ = stored
    x = np.array([r["embedding"] for r in emb.collect()], float)
    x /= np.linalg.norm(x, axis=1)[:, None]

    def error(books):
        code = quantize.encode(x, books.centres)
        return sum(((x[:, p * 4:p * 4 + 4] - books.centres[p][code[:, p]]) ** 2).sum() for p in range(16))

    assert error(quantize.train(emb, rounds=4)) < error(quantize.train(emb, rounds=1)) < error(quantize.train(emb, rounds=0))


def test_odd_vectors_and_empty_tables(spark, scratch):
    nan = float("nan")
    rows = [(i, [float(i % 5), 1.0, 0.5, float(i % 3)]) for i in range(20)]
    odd = [(100, None), (101, [nan, 1.0, 1.0, 1.0]), (102, [1.0, None, 1.0, 1.0]), (103, [0.0] * 4)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    books = quantize.train(df, parts=2)
    path = os.path.join(scratch, "s")
    quantize.write_store(df, books, path, files=3)
    q = spark.createDataFrame([(1, [1.0, 1.0, 0.5, 0.0]), (2, None), (3, [1.0])], "query_id long, embedding array<double>")
    got = quantize.search(spark, path, q, k=4)
    want = dense.dense_search(df.where("vec_id <> 103"), q.where("query_id = 1"), k=4, id_col="vec_id")
    assert sorted(map(tuple, got.select("query_id", "rank", "doc_id").collect())) == sorted(map(tuple, want.select("query_id", "rank", "doc_id").collect()))
    assert quantize.search(spark, path, q.limit(0), k=4).count() == 0
    again = quantize.Codebooks.from_df(books.to_df(spark))
    assert (again.centres == books.centres).all()
    with pytest.raises(ValueError):
        quantize.train(df, parts=3)
    with pytest.raises(ValueError):
        quantize.train(df.limit(0))
