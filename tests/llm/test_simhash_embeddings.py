"""SimHash and embedding near-duplicates against brute force."""
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quarry.llm import common, embedding_dedup, simhash
from tests.llm.helpers import Groups, edge_docs, no_docs, spaced


def brute_fingerprint(text):
    w = spaced(text)
    if not w:
        return 0
    s = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_groups_of_whole_texts(spark):
    docs = edge_docs(spark)
    rows = docs.collect()
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    prints = [brute_fingerprint(r["text"]) for r in rows]
    g = Groups(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                g.join(i, j)
    want = []
    for i, r in enumerate(rows):
        ids = [rows[j]["doc_id"] for j in range(len(rows)) if g.find(j) == g.find(i) and rows[j]["doc_id"] is not None]
        want.append((r["doc_id"], f"{prints[i]:016x}", min(ids, default=None)))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_the_hash_is_sparks_own(spark):
    df = spark.createDataFrame([("alpha beta gamma",), ("été à la",)], "s string")
    for s, h in df.select("s", F.xxhash64("s")).collect():
        assert h % 2**64 == xxhash.xxh64_intdigest(s.encode(), 42)


def test_empty_table(spark):
    assert simhash.near_duplicates(no_docs(spark)).count() == 0


@pytest.mark.parametrize("distance", [1, 2, 3])
@pytest.mark.parametrize("dense", [2, 128])
def test_links_lose_no_component(spark, monkeypatch, distance, dense):
    """Chains and both ways of linking against all pairs, with a dense neighbourhood."""
    monkeypatch.setattr(simhash, "DENSE_KEY", dense)
    rng = np.random.default_rng(distance)
    centre = [int(x) for x in rng.integers(0, 2**63, 12)]
    prints = set(centre)
    for c in centre[:8]:
        for _ in range(40):
            x = c
            for b in rng.choice(64, rng.integers(1, 5), replace=False):
                x ^= 1 << int(b)
            prints.add(x)
    signed = sorted(x - 2**64 if x >> 63 else x for x in prints)
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = Groups(signed)
    for a, b in simhash.links(df, distance).collect():
        assert bin((a ^ b) % 2**64).count("1") <= distance
        got.join(a, b)
    want = Groups(signed)
    for i, a in enumerate(signed):
        for b in signed[:i]:
            if bin((a ^ b) % 2**64).count("1") <= distance:
                want.join(a, b)
    assert [got.find(x) for x in signed] == [want.find(x) for x in signed]


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1400)] + [(7, 7), (1000, 1001)]
    df = spark.createDataFrame(chain, "a long, b long").repartition(7)
    got = dict(common.connected_components(df, "t").collect())
    assert got == {**{i: 0 for i in range(1, 201)}, **{i: 1000 for i in range(1001, 1400)}}
    assert common.connected_components(df.where("a < 0"), "t").count() == 0


def brute_vectors(rows, threshold):
    def usable(v):
        return (v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v))

    unit = {i: np.array(r[1], float) / np.linalg.norm(np.array(r[1], float)) for i, r in enumerate(rows) if usable(r[1])}
    n, g = [0] * len(rows), Groups(range(len(rows)))
    for i, x in unit.items():
        for j, y in unit.items():
            if j < i and len(x) == len(y) and x @ y >= threshold:
                n[i] += 1
                n[j] += 1
                g.join(i, j)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if g.find(j) == g.find(i)]
        least = min((x for x in ids if x is not None), default=None)
        out.append((r[0], n[i], least, r[0] == least))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [4, 512])
def test_vectors_against_all_pairs(spark, window):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 16)).astype("float32")
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    for k in range(60):  # near copies of a few, a dense run of near copies of one
        v = base[k % 5 if k < 20 else 0] + rng.normal(0, 0.08, 16).astype("float32")
        rows.append((100 + k, [float(x) for x in v.astype("float32")]))
    rows += [(200 + k, rows[3][1]) for k in range(30)]  # one vector many times
    rows += [(300, None), (301, [0.0] * 16), (302, [float("nan")] * 16), (303, [None] * 16), (304, []),
             (305, [float("inf")] + [1.0] * 15), (306, [1.0, 2.0]), (307, [2.0, 4.0]), (308, [-0.0, 1.0]), (309, [0.0, 3.0]),
             (3, rows[9][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr(
        "*", "1 AS id", "'x' AS v", "2 AS rid", "0 AS label").repartition(3)
    got = embedding_dedup.link_vectors(df, window=window).collect()
    exact = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    assert sorted(map(tuple, got), key=str) == brute_vectors(exact, 0.95)


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_dedup.link_vectors(df).count() == 0


def test_recall_on_the_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = embedding_dedup.link_vectors(df).collect()
    assert sorted(map(tuple, got), key=str) == brute_vectors(rows, 0.95)


def test_passes_bound_the_miss_rate():
    for size in (16, 64, 256):
        for rows in (1000, 10**6, 10**9):
            lead, depth, passes = embedding_dedup.plan(size, rows, 0.95, 1e-6, 17)
            assert 1 <= lead <= depth and passes >= 1
    assert embedding_dedup.plan(64, 10**9, 0.95, 1e-6, 17)[0] > embedding_dedup.plan(64, 1000, 0.95, 1e-6, 17)[0]
