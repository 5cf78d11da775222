"""Block-max postings and the incremental index: equality with rebuilds, pruning, commits."""

import glob
import os
import random
import shutil
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import lexical, postings
from quarry.plans import lexical_store as store
from quarry.plans import versions

WORDS = [f"w{i}" for i in range(60)]


def corpus(spark, n, seed=0, first=0, strings=False):
    rnd = random.Random(seed)
    rows = []
    for i in range(first, first + n):
        words = rnd.choices(WORDS, weights=[1 / (j + 1) for j in range(60)], k=rnd.randint(0, 25))
        rows.append((f"d{i:04d}" if strings else i, rnd.choice([" ".join(words)] * 9 + [None, ""]), 7))
    return spark.createDataFrame(rows, f"doc_id {'string' if strings else 'long'}, text string, segment long").repartition(3)


QUERIES = [(0, "w0 w1 w2"), (1, "w40 w0"), (2, "w59"), (3, "nothing here"), (4, None), (5, " ".join(WORDS)), (6, "w7 w7 w8")]


def queries(spark):
    return spark.createDataFrame(QUERIES, "query_id long, text string")


def rows(df):
    return sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 6)) for r in df.collect())


def exhaustive(docs, q, k):
    return rows(lexical.bm25_search(lexical.build_bm25_index(docs), q, k=k))


@pytest.mark.parametrize("strings", [False, True])
@pytest.mark.parametrize("segment_docs", [4, 64, 1024])
def test_pruned_search_equals_the_exhaustive_one(spark, scratch, segment_docs, strings):
    docs = corpus(spark, 300, strings=strings)
    store.create(spark, scratch, docs, segment_docs=segment_docs, buckets=5)
    assert rows(store.search(spark, scratch, queries(spark), k=7)) == exhaustive(docs, queries(spark), 7)


def test_many_shipments(spark, scratch, monkeypatch):
    monkeypatch.setattr(postings, "SHIP_QUERIES", 2)
    monkeypatch.setattr(postings, "PUSHED_TERMS", 1)
    docs = corpus(spark, 80)
    store.create(spark, scratch, docs, segment_docs=8)
    assert rows(store.search(spark, scratch, queries(spark), k=3)) == exhaustive(docs, queries(spark), 3)


def test_bounds_prune_segments(spark, scratch, monkeypatch):
    """A rare word's query scores its few segments only."""
    docs = spark.createDataFrame([(i, "common word" + (" rare rare" if i >= 990 else "")) for i in range(1000)], "doc_id long, text string")
    store.create(spark, scratch, docs, segment_docs=10)
    scored = []
    plain = postings._score

    def counting(index, pairs, *rest):
        scored.append(pairs.count())
        return plain(index, pairs, *rest)

    monkeypatch.setattr(postings, "_score", counting)
    q = spark.createDataFrame([(1, "rare common")], "query_id long, text string")
    got = rows(store.search(spark, scratch, q, k=5))
    assert [r[2] for r in got] == [990, 991, 992, 993, 994] and sum(scored) <= postings.SEED_SEGMENTS


def test_a_search_reads_its_terms_buckets_only(spark, scratch):
    """All files of other buckets are spoilt; the plan names the buckets as partition filters."""
    store.create(spark, scratch, corpus(spark, 200), buckets=16)
    q = spark.createDataFrame([(1, "w3 w20")], "query_id long, text string")
    want = rows(store.search(spark, scratch, q, k=5))
    mine = {r["b"] for r in spark.createDataFrame([("w3",), ("w20",)], "t string").select(postings.bucket_of(F.col("t"), 16).alias("b")).collect()}
    spoilt = 0
    for path in glob.glob(os.path.join(scratch, "blocks", "*", "bucket=*", "*.parquet")):
        if int(path.split("bucket=")[1].split("/")[0]) not in mine:
            with open(path, "wb") as f:
                f.write(b"not parquet")
            spoilt += 1
    assert spoilt and rows(store.search(spark, scratch, q, k=5)) == want
    index = store._postings(spark, scratch, versions.live(spark, scratch))
    plan = index.blocks_of(["w3", "w20"], sorted(mine))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "PushedFilters: [In(term" in plan


def tables(spark, root):
    index = store._postings(spark, root, versions.live(spark, root))
    out = {}
    for name in ("blocks", "segments", "docs"):
        out[name] = sorted(str(r) for r in index.table(name).drop("delta").collect())
    return out


def test_append_delete_merge_equal_a_rebuild(spark, scratch):
    first, second = corpus(spark, 120, seed=1), corpus(spark, 90, seed=2, first=120)
    root, rebuilt = os.path.join(scratch, "a"), os.path.join(scratch, "b")
    store.create(spark, root, first, segment_docs=16, buckets=4)
    store.append(spark, root, second)
    gone = spark.createDataFrame([(i,) for i in range(0, 210, 3)] + [(999,)], "doc_id long")
    store.delete(spark, root, gone)
    again = first.where("doc_id % 6 = 0")  # deleted ids may come back
    store.append(spark, root, again)
    left = first.unionByName(second).where("doc_id % 3 <> 0 OR (doc_id % 6 = 0 AND doc_id < 120)")
    want = exhaustive(left, queries(spark), 6)
    assert rows(store.search(spark, root, queries(spark), k=6)) == want
    assert sorted(r["doc_id"] for r in store.live_documents(spark, root).collect()) == sorted(r["doc_id"] for r in left.collect())
    store.merge(spark, root)
    store.create(spark, rebuilt, left, segment_docs=16, buckets=4)
    assert tables(spark, root) == tables(spark, rebuilt)
    assert rows(store.search(spark, root, queries(spark), k=6)) == want
    # an earlier version is still whole
    assert rows(store.search(spark, root, queries(spark), k=6, version=1)) == exhaustive(first, queries(spark), 6)


def test_ids_are_unique(spark, scratch):
    store.create(spark, scratch, corpus(spark, 20))
    with pytest.raises(ValueError):
        store.append(spark, scratch, corpus(spark, 2, first=19))
    with pytest.raises(ValueError):
        store.append(spark, scratch, corpus(spark, 2, first=50).unionByName(corpus(spark, 2, first=51)))
    with pytest.raises(FileExistsError):
        store.create(spark, scratch, corpus(spark, 2))
    assert versions.live(spark, scratch)["number"] == 1
    with pytest.raises(FileNotFoundError):
        store.search(spark, os.path.join(scratch, "nowhere"), queries(spark))


def test_everything_deleted(spark, scratch):
    docs = corpus(spark, 30)
    store.create(spark, scratch, docs)
    store.delete(spark, scratch, docs)
    assert store.search(spark, scratch, queries(spark)).count() == 0
    store.merge(spark, scratch)
    assert store.search(spark, scratch, queries(spark)).count() == 0 and store.live_documents(spark, scratch).count() == 0
    store.append(spark, scratch, docs)
    assert rows(store.search(spark, scratch, queries(spark), k=4)) == exhaustive(docs, queries(spark), 4)


def test_empty_corpus(spark, scratch):
    store.create(spark, scratch, corpus(spark, 5).limit(0))
    assert store.search(spark, scratch, queries(spark)).count() == 0


# --- commits ---------------------------------------------------------------------------------

def test_two_writers_never_share_a_version(spark, scratch):
    won, lost = [], []
    gate = threading.Barrier(8)

    def write(i):
        gate.wait()
        try:
            won.append(versions.commit(spark, scratch, 1, {"writer": i})["writer"])
        except versions.LostRace:
            lost.append(i)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and len(lost) == 7 and versions.live(spark, scratch) == {"writer": won[0], "number": 1}
    assert os.listdir(os.path.join(scratch, versions.FOLDER)) == ["000000000001.json"]  # no drafts stay


def test_a_lost_race_is_run_again_on_the_winner(spark, scratch):
    versions.commit(spark, scratch, 1, {"items": []})

    def add(x, overtaken):
        def change(now):
            if overtaken:
                overtaken.pop()()
            return now | {"items": [*now["items"], x]}
        return change

    versions.update(spark, scratch, add("b", [lambda: versions.update(spark, scratch, add("a", []))]))
    assert versions.live(spark, scratch) == {"items": ["a", "b"], "number": 3}
    assert versions.read(spark, scratch, 2) == {"items": ["a"]}


def test_overtaken_append_keeps_both_and_checks_ids(spark, scratch, monkeypatch):
    store.create(spark, scratch, corpus(spark, 40))
    plain, other = versions.commit, [100]

    def overtaken(s, folder, number, content):
        if other:
            store_first = other.pop()
            store.append(spark, scratch, corpus(spark, 10, first=store_first))
        return plain(s, folder, number, content)

    monkeypatch.setattr(versions, "commit", overtaken)
    store.append(spark, scratch, corpus(spark, 10, first=200))
    assert store.live_documents(spark, scratch).count() == 60 and versions.live(spark, scratch)["number"] == 3
    other.append(300)
    with pytest.raises(ValueError):  # the winner has added some of the same ids
        store.append(spark, scratch, corpus(spark, 10, first=305))
    assert store.live_documents(spark, scratch).count() == 70


def test_overtaken_delete_sees_the_other_writers_rows(spark, scratch, monkeypatch):
    store.create(spark, scratch, corpus(spark, 40))
    plain, first = versions.commit, [True]

    def overtaken(s, folder, number, content):
        if first:
            first.clear()
            store.append(spark, scratch, corpus(spark, 10, first=100))
        return plain(s, folder, number, content)

    monkeypatch.setattr(versions, "commit", overtaken)
    store.delete(spark, scratch, spark.createDataFrame([(1,), (101,)], "doc_id long"))
    assert sorted(r["doc_id"] for r in store.live_documents(spark, scratch).collect()) == [0, *range(2, 40), 100, *range(102, 110)]


def test_copied_folder_opens_elsewhere(spark, scratch):
    """Versions name their tables relative to the index."""
    docs = corpus(spark, 30)
    store.create(spark, os.path.join(scratch, "a"), docs)
    shutil.copytree(os.path.join(scratch, "a"), os.path.join(scratch, "b"))
    assert rows(store.search(spark, os.path.join(scratch, "b"), queries(spark), k=3)) == exhaustive(docs, queries(spark), 3)


def test_impacts_bound_their_weights():
    rng = np.random.default_rng(0)
    tf, words = rng.integers(1, 20, 500).astype(float), rng.integers(1, 400, 500).astype(float)
    impact = postings.Saturated(1.2, 0.75, 80.0)
    assert (impact.weight(tf, words) <= impact.bound(np.array([tf.max()]), np.array([words.min()]))).all()
