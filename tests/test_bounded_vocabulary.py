"""The vocabulary of a parameter's size, and what its workers hold."""

import random
from collections import Counter

import pyarrow as pa

from quarry.operators import heavy, lexical, slices


def _texts(n):
    rng = random.Random(11)
    return [(i, " ".join(f"w{min(int(rng.paretovariate(0.9)), 400)}" for _ in range(30))) for i in range(n)] + [(n, None), (n + 1, "")]


def test_a_bounded_vocabulary_does_not_total_all_terms(spark, monkeypatch):
    rows = _texts(300)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    lists = lexical.term_lists(df, "doc_id", "text", [], 2)
    want = sorted(((r["cf"], r["term"], r["df"]) for r in lexical.term_totals(lists).collect()), key=lambda x: (-x[0], x[1]))
    monkeypatch.setattr(lexical, "term_totals", lambda *a: (_ for _ in ()).throw(AssertionError("all terms were shuffled")))
    for top in (5, 40):
        got = [(r["cf"], r["term"], r["df"]) for r in lexical.vocabulary(df, max_features=top, stop_words=[]).collect()]
        assert sorted(got) == sorted(want[:top])
    index = lexical.build_tfidf_index(df, max_features=40, stop_words=[])
    assert {r["term"] for r in index.vocab.collect()} == {t for _, t, _ in want[:40]} and index.vectors.count() == len(rows)


def test_terms_are_totalled_without_python(spark, capsys):
    lists = spark.createDataFrame([(1, ["a", "b"], [2, 1]), (2, ["a"], [5]), (3, [], []), (4, None, None)],
                                  "doc_id long, terms array<string>, tfs array<long>")
    totals = lexical.term_totals(lists)
    assert sorted(map(tuple, totals.collect())) == [("a", 2, 7), ("b", 1, 1)]
    totals.explain()
    assert "InArrow" not in capsys.readouterr().out


def test_summaries_count_a_batch_in_slices(monkeypatch):
    monkeypatch.setattr(heavy, "ELEMENTS", 6)
    seen = []
    counted = heavy._counted
    monkeypatch.setattr(heavy, "_counted", lambda batch: seen.append(len(batch.column("terms").flatten())) or counted(batch))
    rng = random.Random(4)
    terms = [[f"t{rng.randrange(9)}" for _ in range(3)] for _ in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(terms), pa.array([[1] * 3] * 40, pa.list_(pa.int64()))], ["terms", "tfs"])
    truth = Counter(t for row in terms for t in row)
    for capacity in (2, 20):
        seen.clear()
        out = pa.Table.from_batches(list(heavy._summaries(capacity)(iter([batch, batch.slice(0, 0)])))).to_pylist()
        error = next(r["low"] for r in out if r["term"] is None)
        low = {r["term"]: r["low"] for r in out if r["term"] is not None}
        assert max(seen) <= 6 and sum(seen) == 120
        assert len(low) <= capacity and all(low.get(t, 0) <= n <= low.get(t, 0) + error for t, n in truth.items())


def test_parts_give_memory_back_after_every_batch(monkeypatch):
    released = []

    class Pool:
        def release_unused(self):
            released.append(1)

    monkeypatch.setattr(slices.pa, "default_memory_pool", Pool)
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 5, None, "b" * 5])], ["x"])
    got = [x for p in slices.parts(iter([batch, batch]), "x", 6) for x in p.column("x").to_pylist()]
    assert got == ["a" * 5, None, "b" * 5] * 2 and len(released) == 2
