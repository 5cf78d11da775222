"""Similarity functions and joins against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import similarity as sim
from tests.bruteforce import brute_force_pairs


def test_scalar_cases(spark):
    pairs = [("", ""), ("abc", "abc"), ("abc", "xyz"), ("Hello World", "hello world"), ("çà", "Çb")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select(*[sim.text_similarity(F.col("a"), F.col("b"), m).alias(m) for m in sim.METHODS]).collect()
    assert [tuple(r) for r in got][0] == (0.0, 0.0, 1.0)  # both empty
    assert [tuple(r) for r in got][1] == (1.0, 1.0, 1.0)
    assert got[2]["cosine"] == 0.0 and got[2]["levenshtein"] == 0.0
    assert got[3]["jaccard"] == 1.0 and got[3]["levenshtein"] == pytest.approx(1 - 2 / 11)
    assert got[4]["cosine"] == pytest.approx(1 / 3)
    with pytest.raises(ValueError):
        sim.text_similarity(F.col("a"), F.col("b"), "nope")


TEXTS = [
    "the quick brown fox jumps", "the quick brown fox jumped", "a quick brown dog", "", "",
    "lorem ipsum dolor", "lorem ipsum dolor sit", "completely different words here", "the the the",
    "abcdefghij", "abcdefghik", "abc", "ab", "b",
]


@pytest.mark.parametrize("method,t", [("jaccard", 0.5), ("jaccard", 0.8), ("cosine", 0.7), ("cosine", 0.95),
                                      ("levenshtein", 0.6), ("levenshtein", 0.3), ("levenshtein", 0.9)])
def test_self_join_matches_brute_force(spark, method, t):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    got = sorted((r["left_id"], r["right_id"], round(r["similarity"], 9), r["left_copies"], r["right_copies"])
                 for r in sim.similarity_join(df, None, method, t).collect())
    assert got == brute_force_pairs(df, None, method, t)


def test_copies_collapse(spark):
    rows = [(i, "same words here") for i in range(50)] + [(100, "same words there"), (101, "other")]
    df = spark.createDataFrame(rows, "id long, text string")
    got = [tuple(r) for r in sim.similarity_join(df, None, "jaccard", 0.5).collect()]
    # fifty copies are one representative (id 0), not 1225 pairs
    assert got == [(0, 100, 0.5, 50, 1)]
    links = sorted(tuple(r) for r in sim.duplicate_groups(df, "jaccard").collect())
    assert links == [(0, i) for i in range(1, 50)]


def test_two_sided_join(spark):
    left = spark.createDataFrame([(0, "alpha beta"), (1, "gamma delta epsilon")], "id long, text string")
    right = spark.createDataFrame([(10, "alpha beta"), (11, "gamma delta"), (12, "zeta")], "id long, text string")
    got = sorted((r["left_id"], r["right_id"]) for r in sim.similarity_join(left, right, "jaccard", 0.6).collect())
    assert got == [(0, 10), (1, 11)]
    assert sorted(brute_force_pairs(left, right, "jaccard", 0.6)) == [(0, 10, 1.0, 1, 1), (1, 11, round(2 / 3, 9), 1, 1)]
    with pytest.raises(ValueError):
        sim.similarity_join(left, right, "jaccard", 0.0)


def test_partners_per_left(spark):
    left = spark.createDataFrame([(0, "a b c d"), (1, "x y")], "id long, text string")
    right = spark.createDataFrame([(10, "a b c d"), (11, "a b c"), (12, "a b c e"), (13, "x y")], "id long, text string")
    got = sim.similarity_join(left, right, "jaccard", 0.5, per_left=2).collect()
    assert sorted((r["left_id"], r["right_id"]) for r in got) == [(0, 10), (0, 11), (1, 13)]


@pytest.mark.parametrize("method", ["jaccard", "cosine", "levenshtein"])
@pytest.mark.parametrize("self_join", [True, False])
def test_top_k_equals_all_pairs(spark, method, self_join):
    """Near and far partners, copies, ties, empty and null texts."""
    rnd = random.Random(len(method))
    vocabulary = [f"t{i}" for i in range(25)]
    texts = [" ".join(rnd.sample(vocabulary, rnd.randint(1, 8))) for _ in range(30)]
    texts += [texts[0], texts[0], texts[1].upper(), "", None, "zzz", "q", texts[2] + " extra"]
    rows = list(enumerate(texts))
    other = [(100 + i, t) for i, t in enumerate(texts[::-1][:20] + ["t1 t2 t3", "t1 t2 t3"])]
    left = spark.createDataFrame(rows, "id long, text string")
    right = None if self_join else spark.createDataFrame(other, "id long, text string")
    k = 4
    got = {}
    for r in sim.similarity_top_k(left, right, method, k=k).collect():
        got.setdefault(r["left_id"], []).append((r["rank"], r["right_id"], round(r["similarity"], 9), r["left_copies"], r["right_copies"]))

    def key(t):
        return t if method == "levenshtein" else tuple(sorted(set(t.lower().split() if method == "jaccard" else t.lower())))

    def groups(pairs):
        out = {}
        for i, t in pairs:
            if t is not None:
                out.setdefault(key(t), []).append(i)
        return {min(v): (kk, len(v)) for kk, v in out.items()}

    def edit(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    def alike(a, b):
        if method == "levenshtein":
            return 1 - edit(a, b) / max(len(a), len(b), 1)
        return len(set(a) & set(b)) / max(1, len(set(a) | set(b)))

    lg, rg = groups(rows), groups(rows if self_join else other)
    want = {}
    for i, (a, n) in lg.items():
        found = sorted((-alike(a, b), j, m) for j, (b, m) in rg.items() if not (self_join and i == j) and alike(a, b) > 0)[:k]
        if found:
            want[i] = [(r, j, round(-s, 9), n, m) for r, (s, j, m) in enumerate(found, 1)]
    assert {i: sorted(v) for i, v in got.items()} == want
