"""Metadata maps and the MLlib mixture option."""

from pyspark.sql import functions as F

from quarry.functions import maps
from quarry.operators import mixture


def test_merge_lookup_json(spark):
    df = spark.createDataFrame([({"filename": "a.txt", "page": "1"}, {"filename": "a", "chapter": "3"})],
                               "m1 map<string,string>, m2 map<string,string>")
    r = df.select(maps.merge_last_wins(F.col("m1"), F.col("m2")).alias("m")).select(
        "m", maps.lookup(F.col("m"), "page").alias("p"), maps.lookup(F.col("m"), "missing", "x").alias("d"),
        maps.json_sorted(F.col("m")).alias("j")).collect()[0]
    assert r["m"] == {"filename": "a", "page": "1", "chapter": "3"}  # later wins: filename is the stem
    assert (r["p"], r["d"]) == ("1", "x")
    assert r["j"] == '{"chapter":"3","filename":"a","page":"1"}'


def test_mllib_mixture_after_pca(spark):
    emb = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    out = mixture.fit_gmm_mllib(emb, k=4, pca_dims=8)
    rows = out.select("vec_id", "cluster").collect()
    assert len(rows) == emb.count() and {r["cluster"] for r in rows} <= {0, 1, 2, 3}
