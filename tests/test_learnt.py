"""Models learnt from the corpus: languages and sentence boundaries."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import chunking, dense, heavy, language, latent, lexical, sentences

SF = "/root/testdata/sf0.01"


def test_held_out_documents_are_recognised(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    profiles = language.learn_profiles(docs.where("doc_id % 5 <> 0"))
    found = language.identify(docs.where("doc_id % 5 = 0 AND lang IS NOT NULL AND length(text) > 0"), profiles)
    n, right = found.agg(F.count(F.lit(1)), F.sum((F.col("language") == F.col("lang")).cast("int"))).first()
    assert n > 150 and right >= 0.9 * n


def brute_grams(text):
    words, word = [], ""
    for c in (text or "").lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            words.append(word)
            word = ""
    s = "_" + "_".join(words) + "_"
    return [s[i:i + 3] for i in range(len(s) - 2)]


def test_profiles_and_scores_by_hand(spark):
    texts = [(1, "the theme there", "en"), (2, "de la dela", "fr"), (3, None, "en"), (4, "", None), (5, "été 12 déjà-vu", "fr"), (6, "the", None)]
    df = spark.createDataFrame([(*t, "clash", 1) for t in texts], "doc_id long, text string, lang string, gram string, rank int")
    size = 6
    profiles = {}
    for lang in ("en", "fr"):
        counts = Counter(g for _, t, la in texts if la == lang for g in brute_grams(t))
        profiles[lang] = {g: r for r, (g, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:size])}
    got = language.learn_profiles(df, size=size)
    assert {(r["lang"], r["gram"], r["rank"]) for r in got.collect()} == {(la, g, r) for la, p in profiles.items() for g, r in p.items()}
    ask = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(texts)] + [(10, "1234"), (11, "x" * 100_000 + " the")], "id long, text string")
    for r in language.identify(ask, got, size=size).collect():
        grams = brute_grams(r["text"])
        total = {la: sum(size - p[g] for g in grams if g in p) for la, p in profiles.items()}
        best = max(sorted(total), key=total.get)
        assert (r["language"], r["language_score"]) == ((best, pytest.approx(total[best] / (len(grams) * size))) if total[best] else (None, 0.0))
    none = language.identify(ask, got.limit(0))
    assert none.where("language IS NOT NULL").count() == 0


def abbreviated(spark):
    """A corpus in which "dr", "e.g" and "approx" stand with their stops within sentences."""
    nouns = ["house", "river", "garden", "letter", "winter", "morning", "village", "bridge", "market", "song"]
    rows = []
    for i in range(300):
        a, b, c = nouns[i % 10], nouns[(i * 3 + 1) % 10], nouns[(i * 7 + 2) % 10]
        rows.append((i, f"Yesterday Dr. Miller saw the {a} near the {b}. The {c} was old! He bought fruit, e.g. plums, at the {a}. "
                        f"The {b} cost approx. ten coins. The {c} had no {a}? Some coins and {b} were left."))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_abbreviations_are_learnt(spark):
    docs = abbreviated(spark)
    known = sentences.learn(docs)
    assert {"dr", "e.g", "approx"} <= known.abbreviations
    assert not known.abbreviations & {"house", "river", "garden", "coins", "market"}
    assert "the" in known.starters and "miller" not in known.starters
    scores = {r["type"]: r for r in sentences.abbreviation_scores(docs).collect()}
    n_stop = sum(r["n_stop"] for r in scores.values())
    total = docs.select(F.sum(F.size(F.split("text", " ")))).first()[0]
    p, n = n_stop / total, 300
    ratio = -2 * (n * math.log(p) - n * math.log(0.99))
    assert (scores["dr"]["n_stop"], scores["dr"]["n_plain"]) == (300, 0)
    assert scores["dr"]["score"] == pytest.approx(ratio * math.exp(-2)) and scores["e.g"]["score"] == pytest.approx(ratio * 2 * math.exp(-2))


def test_texts_are_cut_at_sentences_only(spark):
    known = sentences.Boundaries(frozenset({"dr", "e.g", "etc"}), frozenset({"the"}))
    cases = {
        "Dr. Miller came. He left.": ["Dr. Miller came.", "He left."],
        "Plums, e.g. ripe ones. Good!": ["Plums, e.g. ripe ones.", "Good!"],
        "Plums, pears etc. The end came. So.": ["Plums, pears etc.", "The end came.", "So."],  # a capitalised starter ends it
        "Plums, pears etc. the end.": ["Plums, pears etc. the end."],
        "No abbreviation. here": ["No abbreviation.", "here"],
        "": [""], "one": ["one"], "Dr.": ["Dr."], "What? (Dr. Who) \"e.g. this\"": ["What?", "(Dr. Who) \"e.g. this\""]}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "text string")
    got = {r["text"]: r["s"] for r in df.select("text", sentences.split_sentences(F.col("text"), known).alias("s")).collect()}
    assert got.pop(None) is None and got == cases


def test_sentence_chunks_by_learnt_boundaries(spark):
    df = spark.createDataFrame([(1, "Then Dr. Miller came home. He slept.")], "id long, text string")
    plain = [r["text"] for r in chunking.chunk_sentences(df, max_words=3).collect()]
    known = sentences.Boundaries(frozenset({"dr"}))
    learnt = [r["text"] for r in chunking.chunk_sentences(df, max_words=3, sentences=sentences.split_sentences(F.col("text"), known)).collect()]
    assert plain == ["Then Dr.", "Miller came home.", "He slept."] and learnt == ["Then Dr. Miller came home.", "He slept."]


def test_scores_of_an_empty_corpus(spark):
    none = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sentences.abbreviation_scores(none).count() == 0
    assert sentences.learn(none) == sentences.Boundaries(frozenset(), frozenset())


# --- latent semantic vectors --------------------------------------------------------------------

def test_subspace_matches_a_dense_svd(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("doc_id < 120")
    index = lexical.build_tfidf_index(docs, max_features=400)
    model = latent.fit(index, dim=8, rounds=12)
    rows = {r["doc_id"]: dict(zip(r["terms"], r["weights"], strict=True)) for r in index.vectors.collect()}
    ids = sorted(rows)
    table = np.array([[rows[i].get(t, 0.0) for t in model.terms] for i in ids])
    u, s, vt = np.linalg.svd(table, full_matrices=False)
    assert np.allclose(model.singular, s[:8], rtol=2e-2)
    # the best approximation of rank 8 loses no more than the dense one, but for 1 %
    ours = table - table @ model.vectors @ model.vectors.T
    assert np.linalg.norm(ours) <= 1.01 * np.linalg.norm(s[8:])
    assert np.allclose(model.vectors.T @ model.vectors, np.eye(8), atol=1e-9)
    got = {r["doc_id"]: r["embedding"] for r in latent.embed_documents(index, model).collect()}
    want = table @ model.vectors
    want /= np.maximum(np.linalg.norm(want, axis=1), 1e-300)[:, None]
    assert np.allclose(np.array([got[i] for i in ids]), want, atol=1e-9)
    # a document asked as a query finds itself first
    q = docs.where("doc_id IN (3, 50)").select(F.col("doc_id").alias("query_id"), "text")
    hits = dense.dense_search(latent.embed_documents(index, model), latent.embed_queries(index, model, q), k=1).collect()
    assert {(r["query_id"], r["doc_id"]) for r in hits} == {(3, 3), (50, 50)}


def test_latent_vectors_of_nothing(spark):
    none = spark.createDataFrame([(1, None)], "doc_id long, text string")
    index = lexical.build_tfidf_index(none)
    model = latent.fit(index)
    assert model.dim == 0 and [r["embedding"] for r in latent.embed_documents(index, model).collect()] == [[]]
    with pytest.raises(ValueError):
        latent.fit(lexical.build_tfidf_index(none, max_features=None))


# --- heavy terms --------------------------------------------------------------------------------

def test_heavy_terms_equal_a_full_count(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(400):
        words = [f"t{int(x)}" for x in np.minimum(rng.zipf(1.3, 60), 5000)]
        counts = Counter(words)
        rows.append((i, list(counts), list(counts.values())))
    lists = spark.createDataFrame(rows, "doc_id long, terms array<string>, tfs array<long>").repartition(4)
    full = sorted((r["term"], r["df"], r["cf"]) for r in lexical.term_totals(lists).collect())
    for top, capacity, proven in ((50, 400, True), (10, 20, None), (2000, 30, False)):
        want = sorted(full, key=lambda x: (-x[2], x[0]))[:top]
        got = [(r["term"], r["df"], r["cf"]) for r in heavy.heavy_terms(lists, top, capacity).collect()]
        assert sorted(got) == sorted(want)
        terms = heavy.candidates(lists, top, capacity)
        assert proven is None or (terms is not None) == proven
        if terms is not None and capacity < 1000:  # far fewer terms are counted than there are
            assert {t for t, _, _ in want} <= set(terms) and len(terms) < len(full) / 2
    assert heavy.heavy_terms(lists.limit(0), 5).count() == 0


def test_counters_and_errors_enclose_the_truth():
    import pyarrow as pa
    rng = np.random.default_rng(10)
    counts = {f"x{i}": int(n) for i, n in enumerate(rng.zipf(1.5, 500))}
    left, error = heavy.cut(pa.table({"term": list(counts), "low": list(counts.values())}), 40)
    low = dict(zip(left.column("term").to_pylist(), left.column("low").to_pylist(), strict=True))
    assert len(low) <= 40 and all(low.get(t, 0) <= n <= low.get(t, 0) + error for t, n in counts.items())
