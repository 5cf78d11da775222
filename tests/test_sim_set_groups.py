"""Similarity joins verify pairs where groups of records meet: nothing is sent once for each pair."""

import random

import pytest

from quarry.operators import similarity
from tests.bruteforce import brute_force_pairs


def _spied(monkeypatch):
    seen = {}
    keep = similarity.materialize

    def spy(df, name="table"):
        out = keep(df, name)
        seen.setdefault(name, []).append(out)
        return out

    monkeypatch.setattr(similarity, "materialize", spy)
    return seen


def _rows(df):
    return sorted((r["left_id"], r["right_id"], round(r["similarity"], 9), r["left_copies"], r["right_copies"]) for r in df.collect())


def _copies(n, words=60):
    return [(i, " ".join(f"w{j}" if j != i else f"x{i}" for j in range(words))) for i in range(n)]


def test_sets_are_sent_to_groups_not_to_pairs(spark, monkeypatch):
    """40 near copies are 780 pairs; before, each pair had two sets sent to it."""
    seen = _spied(monkeypatch)
    df = spark.createDataFrame(_copies(40), "id long, text string")
    got = similarity.similarity_join(df, None, "jaccard", 0.8)
    assert got.count() == seen["pairs"][0].count() == 780
    members = seen["members"][0].collect()
    assert len(members) == 40 and sum(len(r["groups"]) for r in members) <= 200
    # the sets are not staged, nor shuffled to find representatives
    assert not {"toks", "key", "text"} & set(seen["records"][0].columns)


def test_few_bits_keep_other_texts_from_the_pairs(spark, monkeypatch):
    """records that share a rare token alone do not become pairs."""
    seen = _spied(monkeypatch)
    texts = [(i, " ".join(["rare", *(f"t{i}_{j // 2}_{j % 2}" for j in range(80)), *(f"t{(i + 1) % 30}_{j}_0" for j in range(4))])) for i in range(30)]
    df = spark.createDataFrame(texts, "id long, text string")
    assert similarity.similarity_join(df, None, "jaccard", 0.8).count() == 0
    assert seen["pairs"][0].count() == 0


@pytest.mark.parametrize("method,t", [("jaccard", 0.8), ("jaccard", 0.3), ("cosine", 0.7)])
@pytest.mark.parametrize("small", [True, False])
def test_set_groups_in_parts_equal_brute_force(spark, monkeypatch, method, t, small):
    if small:
        for name, value in (("GROUP_PAIRS", 2), ("GROUP_BYTES", 1), ("SIEVE", 1)):
            monkeypatch.setattr(similarity, name, value)
    rnd = random.Random(3)
    rows = _copies(12, 20) + [(100 + i, " ".join(rnd.sample([f"w{j}" for j in range(25)], rnd.randint(0, 14)))) for i in range(25)]
    rows += [(200, "W1 w2"), (201, "w2 w1"), (201, "w2 w1"), (202, None), (None, "w1 w2 w3"), (203, "é ü")]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    right = df.selectExpr("id + 1000 AS id", "text").where("id % 2 = 0")
    for args in ((df, None), (df, right)):
        named = [x if x is None else x.where("id IS NOT NULL AND text IS NOT NULL") for x in args]
        got = _rows(similarity.similarity_join(*args, method, t))
        if args[1] is None:  # a record without an id counts as a copy, and is in no pair
            got = [(*r[:3], 1, 1) for r in got]
            want = [(*r[:3], 1, 1) for r in brute_force_pairs(*named, method, t)]
        else:
            want = brute_force_pairs(*named, method, t)
        assert got == want
