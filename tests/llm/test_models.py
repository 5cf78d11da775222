"""Language model, classifier, packing, tool calls and the pipeline."""
import functools
import json
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quarry.llm import cnn_quality, decontaminate, hmm_lm, packing, queries, simhash, tool_chat
from tests.llm.helpers import edge_docs, no_docs, spaced

SMALL = "/root/testdata/sf0.001"


def test_base_scores_against_brute_force(spark):
    docs = edge_docs(spark)
    rows = docs.collect()
    held = [r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2 for r in rows]
    count = Counter()
    for r, h in zip(rows, held, strict=True):
        if not h:
            count.update([*spaced(r["text"]), None])
    n, v = sum(count.values()), len(count)
    want = []
    for r, h in zip(rows, held, strict=True):
        w = [*spaced(r["text"]), None]
        want.append((str(r["doc_id"]), h, len(w), sum(count[x] > 0 for x in w), n, round(sum(np.log10((count[x] + 1) / (n + v + 1)) for x in w), 6)))
    got = hmm_lm.score(docs).collect()
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6))
                  for r in got) == sorted(want)
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert hmm_lm.score(no_docs(spark)).count() == 0


def test_forward_is_the_sum_over_all_paths():
    import itertools
    chain = hmm_lm.first_chain(np.ones(hmm_lm.CLASSES), states=3, seed=1)
    for text in ([5], [5, 9, 0], [1, 2, 3, 2, 1, 0]):
        total = 0.0
        for path in itertools.product(range(3), repeat=len(text)):
            p = chain.start[path[0]] * chain.emit[path[0], text[0]]
            for a, b, c in zip(path, path[1:], text[1:], strict=False):
                p *= chain.step[a, b] * chain.emit[b, c]
            total += p
        got = hmm_lm.forward(chain, [np.array(text, np.uint8), np.array([7], np.uint8)])[0]
        assert got == pytest.approx(np.log(total))


def test_baum_welch_raises_the_likelihood(spark):
    rng = np.random.default_rng(0)
    texts = [np.append(rng.integers(1, 20, 150) if i % 2 else rng.integers(15, 40, 90), 0).astype(np.uint8) for i in range(60)]
    df = spark.createDataFrame([(bytearray(t.tobytes()),) for t in texts], "classes binary").repartition(3)
    chain = hmm_lm.first_chain(np.bincount(np.concatenate(texts), minlength=256), states=2)
    likely = [hmm_lm.forward(chain, texts).sum()]
    for _ in range(5):
        chain = hmm_lm.baum_welch(df, chain, rounds=1)
        likely.append(hmm_lm.forward(chain, texts).sum())
    assert likely[-1] > likely[0] + 100 and all(b > a - 1 for a, b in zip(likely, likely[1:], strict=False))


def test_the_chain_beats_the_unigram_base_on_held_out_texts(spark):
    got = queries.op5_hmm_scores(spark, "/root/testdata/sf0.01").where("held_out").agg(
        F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert got["s"] > got["b"]


def test_classifier_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op7_cnn_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    right = got.where("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert right >= 0.9


def test_classifier_edges(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(None, 1), (5, None)], "doc_id long, quality int")
    net = cnn_quality.fit(docs, labels, epochs=1)
    got = cnn_quality.scores(docs, net).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    one = cnn_quality.fit(docs, labels.where("quality = 1"))
    assert {r["score"] for r in cnn_quality.scores(docs, one).collect()} == {1.0}
    none = cnn_quality.fit(docs, labels.where("1 = 0"))
    assert {r["score"] for r in cnn_quality.scores(docs, none).collect()} == {0.5}
    assert cnn_quality.scores(no_docs(spark), net).count() == 0
    assert cnn_quality.keep_good(docs, one).columns == docs.columns and cnn_quality.keep_good(docs, one).count() == docs.count()


def test_chunks_cover_the_text_and_batches_do_not_matter():
    for n in (0, 1, 511, 512, 513, 960, 961, 5000):
        data = bytes(np.random.default_rng(n).integers(1, 256, n, dtype=np.uint8))
        got = cnn_quality.chunks(data)
        whole = b"".join([got[0].tobytes(), *(c[cnn_quality.CHUNK - cnn_quality.STRIDE:].tobytes() for c in got[1:])])
        assert whole.rstrip(b"\0") == data.rstrip(b"\0") and len(whole) - len(data) < cnn_quality.CHUNK + 1


def encode_plain(text):
    return [*fresh_tokenizer().encode(text or "", add_special_tokens=False).ids, 0]


@functools.cache
def fresh_tokenizer():
    return Tokenizer.from_file(queries.tokenizer_path())


def test_word_cache_encodes_like_the_library():
    texts = ["", None, "a", " a", "a ", "a  b", "a\nb", "a\n\nb", "a \nb", "\n", "it's 12 o'clock\tnow", "x y z", "don't 'll <|endoftext|> end",
             "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y  z", "<|endoftext|", "été 12.5%   b", "A" * 5000, "!!! ??? a.b,c"]
    got = packing.encode(texts, queries.tokenizer_path())
    assert [[*x.tolist(), 0] for x in got] == [encode_plain(t) for t in texts]


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packing_is_exact_and_gapless(spark, capacity):
    docs = edge_docs(spark)
    rows = packing.pack(docs, queries.tokenizer_path(), capacity=capacity, keep_ids=True).collect()
    whole = Counter(tuple(encode_plain(r["text"])) for r in docs.collect())
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] and zlib.crc32(ids.tobytes()) == r["ids_crc32"]
        assert r["length"] == capacity or r["piece"] == 0
    for s in by.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(len(t) * n for t, n in whole.items())
    assert sum(r["length"] for r in rows) == total
    assert sum(n * -(-len(t) // capacity) for t, n in whole.items()) == len(rows)
    assert packing.pack(no_docs(spark), queries.tokenizer_path()).count() == 0


def test_configurations_cover_the_histogram_exactly():
    rng = np.random.default_rng(2)
    for counts in ({2048: 3, 1: 5000}, {1024: 7, 1025: 2}, {700: 1000}, dict(Counter(rng.integers(1, 2049, 3000).tolist()))):
        plan = packing.configurations(counts)
        got = Counter()
        for config, n in plan:
            assert sum(k * c for k, c in config.items()) <= 2048
            for k, c in config.items():
                got[k] += c * n
        assert got == Counter(counts)
        least = -(-sum(k * n for k, n in counts.items()) // 2048)
        best = sum(n for _, n in packing.best_fit(counts))
        assert least <= sum(n for _, n in plan) <= best * 1.002 + 1


def test_scores_equal_a_naive_convolution():
    """Byte by byte, chunk by chunk, for empty, short, long and non-ASCII texts."""
    rng = np.random.default_rng(8)
    c = cnn_quality
    net = c.Network(rng.normal(0, 0.3, (c.WIDTH, 256, c.FILTERS)).astype(np.float32), rng.normal(0, 0.3, c.FILTERS).astype(np.float32),
                    rng.normal(0, 0.3, 2 * c.FILTERS + 1).astype(np.float32), 0.1, np.array([0.2, 1.0, -0.5, 0.4]))
    texts = [None, "", "a", "é" * 300, "word " * 103, "x" * 448, "x" * 513, "".join(map(chr, rng.integers(32, 900, 1500)))]
    got = c.score(net, texts)
    for text, p in zip(texts, got, strict=True):
        data = (text or "").encode()
        logits, begin = [], 0
        while True:
            part = (data[begin:begin + c.CHUNK] + bytes(c.CHUNK))[:c.CHUNK]
            empty = 1 - sum(b != 0 for b in part) / c.CHUNK
            seen = []
            for f in range(c.FILTERS):
                best = max(sum(float(net.filters[k, part[at + k], f]) for k in range(c.WIDTH))
                           for at in range(0, c.CHUNK - c.WIDTH + 1, c.STEP))
                seen.append(max(best + float(net.bias[f]), 0.0))
            seen = [*seen, *(x * empty for x in seen), empty]
            logits.append(sum(x * float(w) for x, w in zip(seen, net.weight, strict=True)) + net.offset)
            begin += c.STRIDE
            if begin + (c.CHUNK - c.STRIDE) >= len(data):
                break
        z = np.dot([1, np.mean(logits), min(logits), max(logits)], net.combine)
        assert p == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4)


def test_the_program_places_the_pieces():
    """At least 95 % of the pieces come from the program, in as few sequences as best fit needs."""
    rng = np.random.default_rng(4)
    lengths = np.minimum(rng.lognormal(6, 1.2, 12_000).astype(int) + 2, 2048)
    for times in (1, 40):
        counts = {k: times * v for k, v in Counter(lengths.tolist()).items()}
        placed = sum(often * sum(config.values()) for config, often in packing.solve(counts))
        assert placed >= 0.95 * sum(counts.values())
        least = -(-sum(k * n for k, n in counts.items()) // 2048)
        assert sum(n for _, n in packing.configurations(counts)) <= least * 1.001 + 1


SCHEMAS = {"f": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 1}}, "additionalProperties": False}}


def link(spark, calls, results):
    c = spark.createDataFrame(calls, "conv long, turn long, call_id string, name string, arguments string, needs array<string>")
    r = spark.createDataFrame(results, "conv long, turn long, call_id string, content string")
    rows = tool_chat.link(c.withColumn("json", F.lit("clash")).withColumn("place", F.lit(9)), r.withColumn("n", F.lit(1)), SCHEMAS).collect()
    return {(x["call_id"], x["kind"]): x for x in rows}, rows


def test_calls_are_linked_ordered_validated_and_serialised(spark):
    calls = [(1, 0, "a", "f", '{"a": 1}', []), (1, 2, "b", "f", '{"b":2,"a":0}', ["a", "zz"]), (1, 4, "c", "g", "nonsense", ["b"]),
             (2, 0, "d", "f", '{"a":5}', ["e"]), (2, 2, "e", "f", '{"a":6}', []), (2, 4, "h", "f", "", ["d"]),
             (3, 0, "x", "f", '{"a":1}', ["y"]), (3, 2, "y", "f", '{"a":1}', ["x"]), (3, 4, "z", "f", '{"a":1}', []),
             (None, 0, None, None, None, None), (4, None, "q", "f", '{"a":1}', ["q"])]
    results = [(1, 1, "a", "é\n\"q\""), (1, 3, "a", "second"), (1, 5, "b", None), (9, 0, "lost", "r"), (9, 1, None, "r")]
    got, rows = link(spark, calls, results)
    assert len(rows) == len(calls) + 3
    extra = got["a", "extra"]
    assert (extra["turn"], extra["name"], extra["place"], extra["n_results"], extra["valid"], extra["errors"], extra["json"]) == (
        3, "f", 0, 2, True, "", '{"call_id":"a","result":"second"}')
    assert got["a", "call"]["json"] == '{"arguments":{"a":1},"call_id":"a","depends_on":[],"name":"f","result":"é\\n\\"q\\""}'
    assert (got["a", "call"]["n_results"], got["a", "call"]["valid"]) == (2, True)
    assert got["b", "call"]["errors"] == "$.a: minimum; $.b: additional" and got["b", "call"]["missing"] == 1
    assert got["c", "call"]["errors"] == "$: not an object" and json.loads(got["c", "call"]["json"])["arguments"] == "nonsense"
    assert [got[k, "call"]["place"] for k in "abc"] == [0, 2, 4]
    assert [got[k, "call"]["place"] for k in "edh"] == [0, 1, 2]
    assert [got[k, "call"]["place"] for k in "xyz"] == [None, None, 0]
    assert got["h", "call"]["errors"] == "$.a: required" and got[None, "call"]["errors"] == "unknown tool"
    assert got["lost", "orphan"]["errors"] == "no call" and (None, "orphan") in got


def test_no_calls_and_repeated_calls(spark):
    assert link(spark, [], [])[1] == []
    calls = [(1, 0, "a", "f", '{"a":1}', [])] * 2
    rows = link(spark, calls, [(1, 1, "a", "r")])[1]
    assert len(rows) == 2 and len({r["json"] for r in rows}) == 1
    # a repeated result is the linked one; others are rows of their own, nulls too
    rows = link(spark, calls, [(1, 1, "a", "r"), (1, 1, "a", "r"), (1, 1, "a", "s"), (1, None, "a", None)])[1]
    linked = [r for r in rows if r["kind"] == "call"]
    assert {(r["n_results"], json.loads(r["json"])["result"]) for r in linked} == {(4, None)}
    assert sorted((str(r["turn"]), json.loads(r["json"])["result"]) for r in rows if r["kind"] == "extra") == [("1", "r"), ("1", "r"), ("1", "s")]


def test_pipeline_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality_classifier", "line_dedup", "simhash_dedup", "decontamination", "best_fit_packing"]
    good = steps["quality_classifier"](spark, docs, SMALL)
    net = cnn_quality.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    want = {r["doc_id"] for r in cnn_quality.scores(docs, net).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in good.collect()} == want and good.schema == docs.schema
    lines = steps["line_dedup"](spark, good, SMALL)
    assert lines.schema == good.schema and lines.count() == good.count()
    assert lines.where("n_chars <> length(text)").count() == good.where("n_chars <> length(text)").count()
    single = steps["simhash_dedup"](spark, lines, SMALL)
    groups = simhash.near_duplicates(lines).collect()
    assert sorted(r["doc_id"] for r in single.collect()) == sorted({r["component_id"] for r in groups})
    clean = steps["decontamination"](spark, single, SMALL)
    hit = decontaminate.contamination(decontaminate.find_matches(single, spark.read.parquet(f"{SMALL}/benchmark.parquet")))
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(r["doc_id"] for r in hit.where("NOT contaminated").collect())
    packed = steps["best_fit_packing"](spark, clean, SMALL)
    whole = corpus_pipeline.run(spark, SMALL)
    assert whole.schema == packed.schema
    assert sorted(r[:5] for r in map(tuple, whole.collect())) == sorted(r[:5] for r in map(tuple, packed.collect()))


def test_pipeline_stages_take_odd_rows_and_empty_tables(spark):
    docs = edge_docs(spark).select("doc_id", "text", "lang", "source", "n_chars", F.lit(1).alias("key"), F.lit("x").alias("row"),
                                   F.lit(2).alias("_drop"), F.lit(3).alias("copies"))
    for name, step in corpus_pipeline.STAGES:
        for table in (docs, docs.where("1 = 0")):
            out = step(spark, table, SMALL)
            assert name == "best_fit_packing" or out.columns == docs.columns
            n = out.count()
            assert n == 0 if table is not docs else n > 0
    kept = dict(corpus_pipeline.STAGES)["simhash_dedup"](spark, docs, SMALL).collect()
    assert len({simhash.fingerprint(r["text"]) for r in kept}) == len(kept)


def test_pipeline_keeps_the_text_of_a_document_with_many_copies(spark):
    def text(kind, i):
        r = random.Random(f"{kind}{i}")
        return "\n".join(" ".join(f"w{r.randrange(10**6)}" for _ in range(20)) for _ in range(4)) + "\nsite footer"

    rows = [(i, text("own", i), "en", "s", 0) for i in range(60)]
    for g in range(2):  # two originals, each with copies on more than 2 % of the rows
        rows += [(100 + 100 * g + c, text("hot", g), "en", "s", 0) for c in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    steps = dict(corpus_pipeline.STAGES)
    left = steps["line_dedup"](spark, docs, SMALL)
    assert {r["doc_id"]: r["text"] for r in left.collect()} == {i: t.removesuffix("\nsite footer") for i, t, *_ in rows}
    kept = steps["simhash_dedup"](spark, left, SMALL).collect()
    assert sorted(r["doc_id"] for r in kept) == [*range(60), 100, 200] and all(r["text"] for r in kept)
