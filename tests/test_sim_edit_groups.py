"""Similarity joins verify pairs where groups of records meet: nothing is sent once for each pair."""

import random

import numpy as np
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


def _urls(seed, n):
    rnd = random.Random(seed)
    out = [f"https://{rnd.choice(['www.', 'm.', ''])}h{rnd.randrange(3)}.example/{rnd.choice(['en', 'dé'])}/{rnd.randrange(300)}" for _ in range(n)]
    long = "/".join(f"part{i}" for i in range(30))
    out += [long, long + "x", long[:127], long[:126], long[:128], long.replace("part1", "pärt1"), "", "a", "ab", "aaaa", "aaaaa", "😀" * 12, "😀" * 11 + "x"]
    return [*enumerate(out), (n + 50, out[0]), (n + 51, None), (None, "ab")]


@pytest.mark.parametrize("t", [0.9, 0.85, 0.6, 0.3])
@pytest.mark.parametrize("small", [True, False])
def test_edit_groups_in_parts_equal_brute_force(spark, monkeypatch, t, small):
    if small:
        for name, value in (("GROUP_RECORDS", 3), ("GROUP_BYTES", 4), ("FREQUENT", 50)):
            monkeypatch.setattr(similarity, name, value)
    df = spark.createDataFrame(_urls(5, 50), "id long, text string").repartition(3)
    named = df.where("id IS NOT NULL AND text IS NOT NULL")
    got = [r[:3] for r in _rows(similarity.similarity_join(df, None, "levenshtein", t))]
    assert got == [r[:3] for r in brute_force_pairs(named, None, "levenshtein", t)]
    right = named.selectExpr("id + 1000 AS id", "text").where("id % 2 = 0")
    assert _rows(similarity.similarity_join(named, right, "levenshtein", t)) == brute_force_pairs(named, right, "levenshtein", t)


def test_edit_candidates_are_verified_where_they_meet(spark, monkeypatch):
    """before, all candidate pairs were staged and both texts sent to each."""
    seen = _spied(monkeypatch)
    rows = [(i, f"https://www.host.example/en/{i * 7919}.html") for i in range(150)]
    df = spark.createDataFrame(rows, "id long, text string")
    got = _rows(similarity.similarity_join(df, None, "levenshtein", 0.9))
    assert got == brute_force_pairs(df, None, "levenshtein", 0.9) and len(got) > 100
    assert "pairs" not in seen and "prefixes" not in seen


def test_a_pair_meets_once(spark):
    """Equal tokens before this one, next to it or not, are where a pair has met."""
    rows = [(i, f"abcdefghij{i}klmnopqrstuvwxyzabcdefghij") for i in range(9)]
    df = spark.createDataFrame(rows, "id long, text string")
    got = _rows(similarity.similarity_join(df, None, "levenshtein", 0.9))
    assert len(got) == len({r[:2] for r in got}) == 36


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("most", [0, 1, 4, 40, 127])
def test_distances_of_many_pairs(most):
    rnd = random.Random(most)
    texts = ["".join(rnd.choices("abc", k=rnd.choice([0, 1, 5, 9, 10, 30, 127]))) for _ in range(40)]
    texts += ["".join(c for c in x if rnd.random() < 0.95) for x in texts]
    n = np.array([len(x) for x in texts], np.int64)
    codes = np.zeros((len(texts), 127), np.uint8)
    for i, x in enumerate(texts):
        codes[i, :len(x)] = [ord(c) for c in x]
    pairs = [(i, j) for i in range(80) for j in ([i - 40, rnd.randrange(80), rnd.randrange(80)] if i >= 40 else [])]
    a, b = (np.array(x) for x in zip(*pairs))
    found = similarity._edit_distances(codes, n, a, b, np.full(len(a), most))
    for i, j, d in zip(a, b, found):
        want = _distance(texts[i], texts[j])
        assert d == want if want <= most else d > most
    letters = [similarity._letters(np.array([ord(c) for c in x], np.uint32), np.zeros(len(x), np.int64), 1) for x in texts]
    for i, j in pairs:
        more = sum(int(similarity._excess(x, y)[0]) for x, y in zip(letters[i], letters[j]))
        assert max(more, more - len(texts[i]) + len(texts[j])) <= _distance(texts[i], texts[j])
