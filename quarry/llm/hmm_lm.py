"""Language-model scoring with a hidden Markov model.

Tokens are the words ``[^\\x20\\x09-\\x0D]+`` in lower-cased (A-Z) texts and one
end.  Each token belongs to a class that its spelling decides (its last three
characters, hashed; the end is a class of its own), so unseen tokens have one
too.  Latent states emit classes, a class emits its tokens by add-one counts:

    P(text) = sum over state paths of prod A[s', s] B[s, class] * P(token | class)

Baum-Welch: every task runs scaled forward-backward over its training texts'
segments of ``SEGMENT`` tokens and emits expected counts, which Spark sums; the
sums (states x classes numbers) make the next model.  Scoring runs the scaled
forward recursion over each whole text's class sequence, so the likelihood is
exact for texts of any length.

Token counts cover all training texts and are far too many to send to every
task.  Each task numbers its tokens by block (about ``BLOCK_TOKENS`` tokens of
its texts); (block, token) rows are shuffled by token to be counted, and
return by block, where they meet the block's texts as token numbers.

Defined results: a null or empty text is the end alone; a null id is learnt from
(its remainder is unknown, so it is not held out); repeated rows are learnt from
and scored each; without training texts every count is zero; other columns are
not read; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import field, spaced_words, stage

CLASSES = 256  # 0 is the end, 255 fills up segments
END, PAD = 0, 255
STATES = 6
ROUNDS = 4
SEGMENT = 64
BLOCK_TOKENS = 2_000_000
SMOOTH = 0.1


def token_class(token: bytes) -> int:
    """The class of a word: by its last three characters."""
    return 1 + zlib.crc32(token.decode("utf-8", "replace")[-3:].encode("utf-8", "replace")) % (PAD - 1)


# --- texts to numbers -----------------------------------------------------------------

def _encode(id_type: pa.DataType):
    schema = pa.schema([("block", pa.int64()), ("row", pa.int64()), ("id", id_type), ("held_out", pa.bool_()),
                        ("n_tokens", pa.int64()), ("classes", pa.binary()), ("common", pa.binary()), ("rare", pa.binary()),
                        ("local", pa.int32()), ("token", pa.binary()), ("cls", pa.int32()), ("c", pa.int64())])
    names = schema.names

    def batch_of(n: int, **cols):
        return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(n, f.type)
                                           for f in schema], names)

    def block_rows(block: int, rows: list, ids: list, held: list, texts: list[list[bytes]]):
        total: Counter = Counter()
        for w in texts:
            total.update(w)
        # commonest first, so that nearly all numbers take two bytes
        order = [t for t, _ in total.most_common()]
        number = {t: i for i, t in enumerate(order)}
        cls = np.fromiter(map(token_class, order), np.int32, len(order))
        learnt = np.zeros(len(order), np.int64)
        classes, common, rare = [], [], []
        for w, out in zip(texts, held, strict=True):
            seq = np.fromiter(map(number.__getitem__, w), np.int64, len(w))
            classes.append(np.append(cls[seq], END).astype(np.uint8).tobytes())
            seq.sort()
            cut = np.searchsorted(seq, 65536)
            common.append(seq[:cut].astype("<u2").tobytes())
            rare.append(seq[cut:].astype("<u4").tobytes())
            if not out:
                np.add.at(learnt, seq, 1)
        n = len(rows)
        for at in range(0, n, 512):
            cut = slice(at, at + 512)
            yield batch_of(len(rows[cut]), block=np.full(len(rows[cut]), block), row=rows[cut], id=ids[cut], held_out=held[cut],
                           n_tokens=[len(w) + 1 for w in texts[cut]], classes=classes[cut], common=common[cut], rare=rare[cut])
        for at in range(0, len(order), 32768):
            some = order[at:at + 32768]
            yield batch_of(len(some), block=np.full(len(some), block), local=np.arange(at, at + len(some)), token=some,
                           cls=cls[at:at + 32768], c=learnt[at:at + 32768])

    def run(batches):
        start = TaskContext.get().partitionId() << 32
        number, rows_at = itertools.count(start), itertools.count(start)
        rows, ids, held, texts, room = [], [], [], [], 0
        for batch in batches:
            for who, out, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                w = spaced_words(text)
                rows.append(next(rows_at))
                ids.append(who)
                held.append(out)
                texts.append(w)
                room += len(w)
                if room >= BLOCK_TOKENS:
                    yield from block_rows(next(number), rows, ids, held, texts)
                    rows, ids, held, texts, room = [], [], [], [], 0
        if rows:
            yield from block_rows(next(number), rows, ids, held, texts)
    return run


# --- the latent chain -------------------------------------------------------------------

@dataclass(frozen=True)
class Chain:
    """start[s] at a text's begin, inner[s] at a later segment's, step[s', s], emit[s, class]."""

    start: np.ndarray
    inner: np.ndarray
    step: np.ndarray
    emit: np.ndarray

    def plain(self) -> tuple:
        """The fields, for a broadcast."""
        return self.start, self.inner, self.step, self.emit


def first_chain(seen: np.ndarray, states: int = STATES, seed: int = 3) -> Chain:
    """A start for Baum-Welch: the classes' shares, varied at random per state."""
    rng = np.random.default_rng(seed)
    emit = (seen + 1.0) * rng.gamma(2.0, 1.0, (states, CLASSES))
    emit[:, PAD] = 0
    step = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(step, 0.9 if states > 1 else 1.0)
    even = np.full(states, 1 / states)
    return Chain(even, even, step, emit / emit.sum(axis=1, keepdims=True))


def forward(chain: Chain, texts: list[np.ndarray]) -> np.ndarray:
    """Natural log-likelihood of each class sequence, by the scaled forward recursion."""
    order = np.argsort([-len(t) for t in texts], kind="stable")
    sizes = np.array([len(texts[i]) for i in order])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    flat = np.concatenate([texts[i] for i in order]) if len(texts) else np.zeros(0, np.uint8)
    emit = np.ascontiguousarray(chain.emit.T)
    log = np.zeros(len(texts))
    alpha = None
    active = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), side="left")  # texts longer than t
    for t, n in enumerate(active):
        here = emit[flat[starts[:n] + t]]
        alpha = chain.start * here if t == 0 else (alpha[:n] @ chain.step) * here
        scale = alpha.sum(axis=1)
        alpha /= scale[:, None]
        log[:n] += np.log(scale)
    out = np.empty(len(texts))
    out[order] = log
    return out


def expected(chain: Chain, texts: list[np.ndarray], segment: int = SEGMENT) -> tuple[np.ndarray, ...]:
    """Baum-Welch counts (start, inner, step, emit) over the texts' segments, and the log-likelihood."""
    k = len(chain.start)
    start, inner, step, emit = np.zeros(k), np.zeros(k), np.zeros((k, k)), np.zeros((k, CLASSES))
    total = 0.0
    rows = np.array([-(-len(t) // segment) for t in texts])
    table = np.full((int(rows.sum()), segment), PAD, np.uint8)
    at = 0
    for t, n in zip(texts, rows, strict=True):
        table[at:at + n].reshape(-1)[:len(t)] = t
        at += n
    begins = np.zeros(len(table), bool)
    begins[np.concatenate([[0], np.cumsum(rows)[:-1]]).astype(int)] = True
    view = chain.emit.T.copy()
    view[PAD] = 1.0
    for lo in range(0, len(table), 4096):
        part, first = np.ascontiguousarray(table[lo:lo + 4096].T), begins[lo:lo + 4096]
        real = part != PAD
        here = view[part]
        alpha, scale = np.empty_like(here), np.empty(part.shape)
        for t in range(segment):
            a = np.where(first[:, None], chain.start, chain.inner) * here[0] if t == 0 else (alpha[t - 1] @ chain.step) * here[t]
            scale[t] = a.sum(axis=1)
            alpha[t] = a / scale[t][:, None]
        total += float((np.log(scale) * real).sum())
        beta = np.ones_like(here[0])
        for t in range(segment - 1, -1, -1):
            gamma = alpha[t] * beta
            gamma /= gamma.sum(axis=1, keepdims=True)
            for s in range(k):
                emit[s] += np.bincount(part[t], weights=gamma[:, s], minlength=CLASSES)
            if t == 0:
                start += gamma[first].sum(axis=0)
                inner += gamma[~first].sum(axis=0)
            else:
                ahead = here[t] * beta / scale[t][:, None]
                step += chain.step * ((alpha[t - 1] * real[t][:, None]).T @ ahead)
                beta = ahead @ chain.step.T
    emit[:, PAD] = 0
    return start, inner, step, emit, total


def _count_tasks(chain):
    names = ("start", "inner", "step", "emit", "log")

    def run(batches):
        sums = None
        for batch in batches:
            texts = [np.frombuffer(x, np.uint8) for x in batch.column(0).to_pylist()]
            if texts:
                got = expected(Chain(*chain.value), texts)
                sums = got if sums is None else tuple(a + b for a, b in zip(sums, got, strict=True))
        if sums is not None:
            flat = [np.atleast_1d(np.asarray(x, float)).ravel() for x in sums]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(names, [len(x) for x in flat])),
                pa.array(np.concatenate([np.arange(len(x)) for x in flat]), pa.int64()), pa.array(np.concatenate(flat))],
                ["part", "at", "x"])
    return run


def baum_welch(classes: DataFrame, chain: Chain, rounds: int = ROUNDS) -> Chain:
    """``rounds`` rounds over all rows of ``classes`` (one binary column)."""
    sc, k = classes.sparkSession.sparkContext, len(chain.start)
    for _ in range(rounds):
        tasks = classes.mapInArrow(_count_tasks(sc.broadcast(chain.plain())), "part string, at long, x double")
        # states * (states + classes + 2) + 1 rows, whatever the corpus
        rows = tasks.groupBy("part", "at").agg(F.sum("x").alias("x")).collect()
        if not rows:
            return chain
        got = {"start": np.zeros(k), "inner": np.zeros(k), "step": np.zeros(k * k), "emit": np.zeros(k * CLASSES), "log": np.zeros(1)}
        for r in rows:
            got[r["part"]][r["at"]] = r["x"]

        def shares(x, spare=None):
            x = x + SMOOTH
            if spare is not None:
                x[:, spare] = 0
            return x / x.sum(axis=-1, keepdims=True)

        chain = Chain(shares(got["start"]), shares(got["inner"]), shares(got["step"].reshape(k, k)),
                      shares(got["emit"].reshape(k, CLASSES), PAD))
    return chain


# --- scoring ----------------------------------------------------------------------------

def _meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """A block's texts (token numbers) with its tokens' counts: the sums per text."""
    count = np.zeros(int(right["local"].max()) + 1 if len(right) else 0)
    count[right["local"].to_numpy()] = right["total"].to_numpy()
    log, known = np.log10(count + 1), count > 0
    rows = []
    for common, rare in zip(left["common"], left["rare"], strict=True):
        seq = np.concatenate([np.frombuffer(common, "<u2").astype(np.int64), np.frombuffer(rare, "<u4").astype(np.int64)])
        rows.append((log[seq].sum(), known[seq].sum()))
    return pd.DataFrame({"row": left["row"], "log_counts": [a for a, _ in rows], "known": [int(b) for _, b in rows]})


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 7 == 2, F.lit(False))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = STATES,
          rounds: int = ROUNDS) -> DataFrame:
    """One row per text: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    from pyspark.sql.pandas.types import to_arrow_type
    spark, kind = docs.sparkSession, field(docs, id_col)
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("row", T.LongType()), T.StructField("id", kind),
        T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()),
        *(T.StructField(n, T.BinaryType()) for n in ("classes", "common", "rare")), T.StructField("local", T.IntegerType()),
        T.StructField("token", T.BinaryType()), T.StructField("cls", T.IntegerType()), T.StructField("c", T.LongType())])
    read = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("t"))
    both = stage(read.mapInArrow(_encode(to_arrow_type(kind)), schema), "lm-encoded")
    texts, tokens = both.where("local IS NULL"), both.where("local IS NOT NULL")

    counts = stage(tokens.groupBy("token", "cls").agg(F.sum("c").alias("total")), "lm-counts")
    # one row per class
    sums = {r["cls"]: (r["n"], r["v"]) for r in counts.groupBy("cls").agg(
        F.sum("total").alias("n"), F.count(F.when(F.col("total") > 0, True)).alias("v")).collect()}
    ends = texts.where("NOT held_out").count()
    n_all = sum(n for n, _ in sums.values()) + ends
    v_all = sum(v for _, v in sums.values()) + (ends > 0)
    seen, spread = np.zeros(CLASSES), np.zeros(CLASSES)
    for c, (n, v) in sums.items():
        seen[c], spread[c] = n, n + v + 1
    spread = np.maximum(spread, 1)
    seen[END], spread[END] = ends, ends + 1  # a class with one member, never unseen

    chain = baum_welch(texts.where("NOT held_out").select("classes"), first_chain(seen, states), rounds)
    model = spark.sparkContext.broadcast((chain.plain(), np.log10(spread)))

    def run(batches):
        fields, log_spread = model.value
        model_chain = Chain(*fields)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                seqs = [np.frombuffer(x, np.uint8) for x in part.column(1).to_pylist()]
                log = forward(model_chain, seqs) / np.log(10) - np.array([log_spread[s].sum() for s in seqs])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(log)], ["row", "chain"])

    chained = texts.select("row", "classes").mapInArrow(run, "row long, chain double")
    back = tokens.select("block", "local", "token").join(counts.select("token", "total"), "token").select(
        F.col("block").alias("of_block"), "local", "total")
    met = (texts.select("block", "row", "common", "rare").groupBy("block").cogroup(back.groupBy("of_block"))
           .applyInPandas(_meet, "row long, log_counts double, known long"))
    end_log = float(np.log10(ends + 1))
    whole = (texts.select("row", "id", "held_out", "n_tokens").join(met, "row").join(chained, "row"))
    return whole.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("known") + F.lit(int(ends > 0))).cast("long").alias("n_known"),
        F.lit(int(n_all)).cast("long").alias("train_tokens"),
        (F.col("log_counts") + F.lit(end_log) - F.col("n_tokens") * F.lit(float(np.log10(n_all + v_all + 1)))).alias("base_score"),
        (F.col("log_counts") + F.lit(end_log) + F.col("chain")).alias("score"))
