"""The joins and the index do not carry more through a shuffle than they need, with the same results."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import numbering, postings, similarity


def _texts(seed, n, words=12):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(300)}" for _ in range(rng.randrange(1, words))] for _ in range(n // 4)]
    out = []
    for i in range(n):
        row = list(rng.choice(base))
        if row and rng.random() < 0.7:
            row[rng.randrange(len(row))] = f"x{rng.randrange(40)}"
        out.append((i, " ".join(row)))
    return [*out, (n, ""), (n + 1, None), (n + 2, " ".join(f"w{i}" for i in range(400))), (n + 3, " ".join(f"w{i}" for i in range(20, 400)))]


def _pairs(rows, t):
    sets = {}
    for i, text in rows:
        if text is not None:
            sets.setdefault(frozenset(text.split()), []).append(i)
    reps = [(min(v), k) for k, v in sets.items()]
    return {(min(a, b), max(a, b)) for a, x in reps for b, y in reps if a < b and x | y and len(x & y) / len(x | y) >= t - 1e-12}


@pytest.mark.parametrize("t", [0.5, 0.8, 1.0])
@pytest.mark.parametrize("frequent", [0, 7, 1 << 19])
def test_set_pairs_do_not_depend_on_the_frequent_tokens(spark, monkeypatch, t, frequent):
    monkeypatch.setattr(similarity, "FREQUENT", frequent)
    rows = _texts(1, 160)
    df = spark.createDataFrame(rows, "id long, text string").repartition(4)
    got = [(r["left_id"], r["right_id"]) for r in similarity.similarity_join(df, None, "jaccard", t).collect()]
    assert len(got) == len(set(got)) and set(got) == _pairs(rows, t)


def test_runs_of_shared_tokens_meet_once(spark, monkeypatch):
    """Two near copies share all of their prefix but one token: few rows of candidates are left."""
    seen = {}
    keep = similarity.materialize

    def spy(df, name="table"):
        out = keep(df, name)
        seen[name] = out.count()
        return out

    monkeypatch.setattr(similarity, "materialize", spy)
    df = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(300) if j != i)) for i in range(6)], "id long, text string")
    assert similarity.similarity_join(df, None, "jaccard", 0.8).count() == 15
    assert seen["pairs"] == 15


def _edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("t", [0.6, 0.85, 0.9])
def test_edit_pairs_by_longer_grams(spark, t):
    assert similarity.gram_size(0.9) > similarity.gram_size(0.6)
    rng = random.Random(2)
    rows = [(i, f"https://h{rng.randrange(3)}.example/{rng.choice(['en', 'de'])}/{rng.randrange(400)}") for i in range(120)] + [(120, ""), (121, "aa"), (122, "aaa")]
    texts = {}
    for i, x in rows:
        texts[x] = min(i, texts.get(x, i))
    want = {(min(a, b), max(a, b)) for x, a in texts.items() for y, b in texts.items()
            if a < b and 1 - _edit(x, y) / max(len(x), len(y)) >= t - 1e-12}
    df = spark.createDataFrame(rows, "id long, text string")
    assert {(r["left_id"], r["right_id"]) for r in similarity.similarity_join(df, None, "levenshtein", t).collect()} == want


@pytest.mark.parametrize("other", [True, False])
def test_few_left_sets_go_to_the_right_ones(spark, monkeypatch, other):
    df = spark.createDataFrame(_texts(3, 120), "id long, text string").repartition(3)
    left = df.where("id < 30") if other else df
    args = (left, df) if other else (left, None)
    monkeypatch.setattr(similarity, "SHIPPED_RECORDS", 0)
    want = sorted(map(tuple, similarity.similarity_top_k(*args, "jaccard", k=4).collect()))
    monkeypatch.setattr(similarity, "SHIPPED_RECORDS", 2048)
    monkeypatch.setattr(similarity, "_prefix_top_k", lambda *a: pytest.fail("rounds of prefixes"))
    assert sorted(map(tuple, similarity.similarity_top_k(*args, "jaccard", k=4).collect())) == want


def test_an_index_numbers_ids_alone_and_stages_no_blocks(spark, monkeypatch, scratch):
    seen = []
    keep = numbering.materialize
    monkeypatch.setattr(numbering, "materialize", lambda df, name="table": seen.append(df.columns) or keep(df, name))
    docs = spark.createDataFrame([(i * 3, ["a", f"t{i % 5}"], [1.0, 2.0], 3) for i in range(40)],
                                 "doc_id long, terms array<string>, values array<double>, n_words long").repartition(4)
    monkeypatch.setattr(postings, "materialize", lambda *a: pytest.fail("staged"))
    postings.write_delta(docs, scratch, "d", buckets=4, segment_docs=8)
    assert seen and all("terms" not in c for c in seen)
    index = postings.Postings(spark, scratch, ["d"], 4, 8)
    assert [r["doc_id"] for r in index.table("docs").orderBy("doc_no").collect()] == [i * 3 for i in range(40)]
    assert index.table("blocks").where(F.col("term") == "a").agg(F.sum("n")).first()[0] == 40
