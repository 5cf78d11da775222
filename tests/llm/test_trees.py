"""Dual-tree search, stable projections and the prefix trie against brute force."""
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import dual_tree, prefix_trie, stable_search
from tests.llm.helpers import edge_docs, no_docs, words


# --- ranked lexical search ------------------------------------------------------------------

def brute_ranking(docs, items, k):
    """``docs``: (id, text), ``items``: (id, text), by the definition."""
    counted = [(i, Counter(words(t)), len(words(t))) for i, t in docs]
    n_docs, total = sum(n > 0 for _, _, n in counted), sum(n for _, _, n in counted)
    df = Counter(w for _, c, _ in counted for w in c)
    out = []
    for item, text in items:
        asked = Counter(words(text))
        scored = []
        for doc, counts, n in counted:
            score = 0
            for w, times in asked.items():
                if tf := counts[w]:
                    m = 100 - 25 + (25 * n * n_docs) // total
                    score += times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * tf) // (1000 * tf + 12 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


ITEMS = [(0, "alpha beta zeta"), (1, None), (2, ""), (3, "MIT license"), (4, "gamma gamma Gamma naïve x1"), (None, "theta é"), (5, "no such word here"),
         (0, "alpha beta zeta"), (6, "straße " * 40 + "mu")]


@pytest.mark.parametrize("block_bytes", [dual_tree.BLOCK_BYTES, 40])
@pytest.mark.parametrize("tree_items", [dual_tree.TREE_ITEMS, 2])
def test_ranking_equals_all_pairs(spark, monkeypatch, block_bytes, tree_items):
    """Nulls, empty and very long texts, repeated rows, ties, clashing columns; one and many blocks and trees."""
    monkeypatch.setattr(dual_tree, "TREE_ITEMS", tree_items)
    monkeypatch.setattr(dual_tree, "PACK_DOCS", 8)
    docs = edge_docs(spark)
    items = spark.createDataFrame([(i, t, "x", 1) for i, t in ITEMS], "item_id long, text string, score string, rank int")
    got = dual_tree.search(docs, items, k=5, block_bytes=block_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    want = brute_ranking([(r["doc_id"], r["text"]) for r in docs.collect()], list(dict.fromkeys(ITEMS)), 5)
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_no_documents_or_items(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert dual_tree.search(no_docs(spark), items).count() == 0
    assert dual_tree.search(edge_docs(spark), items.limit(0)).count() == 0


def test_pairs_of_nodes_lose_nothing():
    """Random vectors and k-th scores: all pairs at or above theirs, whatever the shapes."""
    rng = np.random.default_rng(3)
    for n_items, n_docs in [(1, 1), (1, 700), (200, 3), (70, 130)]:
        vectors = []
        for _ in range(n_items):
            t = np.sort(rng.choice(50, rng.integers(1, 9), replace=False))
            vectors.append((t, rng.integers(1, 9000, len(t))))
        tree = dual_tree.ItemTree(list(range(n_items)), vectors)
        docs = (rng.integers(0, 10**6, (n_docs, len(tree.terms))) * (rng.random((n_docs, len(tree.terms))) < 0.1)).astype(np.int32)
        kth = rng.integers(0, 2 * 10**9, n_items)[tree.items]
        pi, pd, score = dual_tree.match(tree, docs, kth)
        dense = np.zeros((n_items, len(tree.terms)), np.int64)
        for place, item in enumerate(tree.items):
            t, w = vectors[item]
            dense[place, np.searchsorted(tree.terms, t)] = w
        full = dense @ docs.T.astype(np.int64)
        want = {(i, d): int(full[i, d]) for i, d in zip(*np.nonzero((full >= kth[:, None]) & (full > 0)), strict=True)}
        assert {(int(a), int(b)): int(s) for a, b, s in zip(pi, pd, score, strict=True)} == want


# --- stable projections ---------------------------------------------------------------------

def test_chi_square_law():
    rng = np.random.default_rng(1)
    draws = (rng.standard_normal((200_000, 12)) ** 2).sum(axis=1)
    for p in (0.1, 0.5, 0.99):
        assert abs((draws <= stable_search.chi_square_quantile(p, 12)).mean() - p) < 0.005


def brute_nearest(rows, k, own):
    """``rows``: (id, vector or None) usable or not; queries are the ids that ``own`` accepts."""
    good = [(i, np.array(v, float)) for i, v in rows
            if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in {(i, tuple(v)) for i, v in good if i is not None and own(i)}:
        found = [(float(np.sqrt(((np.array(x) - v) ** 2).sum())), i is None, i or 0, i) for i, v in good if i != q and len(v) == len(x)]
        out[q] = [(s, i) for s, _, _, i in sorted(found, key=lambda f: f[:3])[:k]]
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.standard_normal((1500, 24)), rng.standard_normal((500, 24)) * 0.05 + 1])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = defaultdict(list)
    for r in stable_search.search(stable_search.build_index(df), df.where("vec_id % 100 = 0"), k=10).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    want = brute_nearest(rows, 10, lambda i: i % 100 == 0)
    assert got.keys() == want.keys() and all(len(v) == 10 and v == sorted(v) for v in got.values())
    hits = sum(len(set(got[q]) & set(want[q])) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))
    exact = {i: v for i, v in enumerate(x)}
    assert all(abs(s - np.sqrt(((exact[q] - exact[i]) ** 2).sum())) < 1e-12 for q in got for s, i in got[q])


@pytest.mark.parametrize("block_bytes", [stable_search.BLOCK_BYTES, 100])
def test_odd_vectors(spark, block_bytes):
    """Nulls, zero, non-finite, other lengths, copies, repeated rows and ids, clashing columns."""
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]),
            (8, [1.0, 0.0]), (None, [1.0, 0.0]), (9, [1.0, 0.5]), (10, [1.0, 0.0, 3.0]), (11, [2.0, 0.0, 3.0]), (100, [1.0, 0.25]), (-100, [5.0, 5.0]),
            (200, None), (300, [0.0, 0.0])] + [(400 + i, [3.0, 1.0]) for i in range(1, 50)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, leaf int, score string").repartition(3)
    got = defaultdict(list)
    index = stable_search.build_index(df, leaf_rows=2)
    for r in stable_search.search(index, df.where("vec_id % 100 = 0 OR vec_id = 10"), k=5, confidence=1 - 1e-12, block_bytes=block_bytes).collect():
        got[r["query_id"]].append((r["rank"], r["score"], r["vec_id"]))
    want = brute_nearest(rows, 5, lambda i: i % 100 == 0 or i == 10)
    assert {q: [(s, i) for _, s, i in sorted(v)] for q, v in got.items()} == {q: v for q, v in want.items() if v}


def test_kd_order_is_a_permutation():
    x = np.random.default_rng(2).standard_normal((1001, 3))
    x[:400] = 1.0  # copies
    order, leaf = stable_search.kd_order(x, 16)
    assert sorted(order.tolist()) == list(range(1001))
    assert (np.diff(leaf) >= 0).all() and np.bincount(leaf).max() <= 16


# --- prefix trie ----------------------------------------------------------------------------

def brute_trie(rows, heads=True):
    """``rows``: (conv, turn, role, text); nodes by grouping all prefixes."""
    turns = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            digest = hashlib.sha256(f"{len(r)}:{r}{x}".encode()).hexdigest()[:32]
            turns[c].append(((t is not None, t or 0), digest, len(x.encode()), (r, x)))
    own = {c: [t[3] for t in sorted(v, key=lambda t: t[:3])] for c, v in turns.items()}
    made = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9 if heads else 0
        made[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + v[h:]
    members = defaultdict(list)
    for c, v in made.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)

    def below(p):
        todo, found = [p], []
        while todo:
            found.append(todo.pop())
            todo += kids[found[-1]]
        return found

    out = []
    for p, m in members.items():
        sub = below(p)
        ends = ",".join(map(str, sorted(c for c in m if len(made[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), sum(not kids[s] for s in sub),
                    sum((len(members[s]) - 1) * len(s[-1][1].encode()) for s in sub if s), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def chats(seed, n=120):
    rnd = random.Random(seed)
    rows = []
    for c in range(n):
        k = rnd.choice([1, 1, 2, 3, 5, 9])
        rows += [(c, t, rnd.choice(["user", "assistant"]), rnd.choice(["hi", "ja", "é" * 3, "", None])) for t in range(k)]
    rows += [(1000 + i, t, "user", f"hot {t}") for i in range(60) for t in range(6)]  # copies
    rows += [(2000 + 5 * i, t, "user", f"hot {t}") for i in range(40) for t in range(6 + i % 4)]
    rows += [(3000, t, "user", "x" * (t % 7)) for t in range(300)]  # a long one, twice
    rows += [(3005, t, "user", "x" * (t % 7)) for t in range(300)]
    rows += [(None, 0, "user", "lost"), (4000, None, None, None), (4000, 1, None, "b"), (4000, None, "user", None), (4001, 2, "u", "t"), (4001, 2, "u", "t"),
             (4001, 2, "a", "t"), (-7, 0, "user", "neg"), (4002, 0, "user", "long " * 50_000)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("block_turns", [1, 7, 100, 4096])
def test_trie_equals_grouping_all_prefixes(spark, block_turns):
    rows = chats(block_turns)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, home int, path string").repartition(5)
    convs = prefix_trie.with_shared_heads(prefix_trie.conversations(df))
    got = prefix_trie.trie(convs, block_turns=block_turns).select(*TRIE)
    assert sorted(map(tuple, got.collect()), key=str) == brute_trie(rows)


def test_trie_of_empty_and_turnless(spark):
    schema = "conv_id long, turn long, role string, text string"
    none = prefix_trie.conversations(spark.createDataFrame([], schema))
    assert prefix_trie.trie(prefix_trie.with_shared_heads(none)).count() == 0
    some = prefix_trie.conversations(spark.createDataFrame([(i, 0, "u", "a") for i in range(9)], schema))
    turnless = some.withColumn("turns", F.slice("turns", 1, 0))
    empty = hashlib.sha256(b"").hexdigest()
    for block_turns in (1, 100):
        got = prefix_trie.trie(turnless, block_turns=block_turns).select(*TRIE).collect()
        ends = hashlib.sha256(",".join(map(str, range(9))).encode()).hexdigest()
        assert [tuple(r) for r in got] == [(0, 0, None, 9, 0, 1, 0, ends)] and ends != empty
