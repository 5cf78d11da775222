"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it.  In
each chunk learned filters slide over the bytes; each filter's largest answer
(max-pooling) goes through a logistic unit that also sees how much of the chunk
is filled, as short texts have lower maxima; the chunks' logits (their mean,
least and largest) combine into one probability.

The network is trained on the driver on a bounded sample: at most
``sample_per_class`` labelled documents of each class in a hashed order, and of
each at most ``sample_chunks`` chunks spread over the whole text.  The classes'
true shares, counted over all rows that may be learnt from, set the prior.
Scoring covers every byte of every text.

Defined results: a null or empty text is one chunk of padding and has a score; a
null id is never held out; repeated rows score alike; labels of null quality or
unknown documents teach nothing; with labels of one class or none the score is
that class's share (one half without labels); other columns are not read; an
empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import field

CHUNK, STRIDE = 512, 448
WIDTH, STEP, FILTERS = 6, 2, 16
SAMPLE_PER_CLASS = 1000
SAMPLE_CHUNKS = 8
EPOCHS = 16
THRESHOLD = 0.3


@dataclass(frozen=True)
class Network:
    """filters[k, byte, f]: the answer of filter f to a byte at place k; the pooled
    filters' bias; the logistic unit's weight (of the filters, of the filters times
    the empty share of the chunk, of that share); how the chunks' logits combine."""

    filters: np.ndarray
    bias: np.ndarray
    weight: np.ndarray
    offset: float
    combine: np.ndarray
    share: float | None = None  # set when there was nothing to tell apart

    def plain(self) -> tuple:
        """The fields, for a broadcast."""
        return self.filters, self.bias, self.weight, self.offset, self.combine, self.share


def chunks(data: bytes) -> np.ndarray:
    """All chunks of a text's bytes, the last filled up with zero bytes."""
    n = max(1, -(-(len(data) - (CHUNK - STRIDE)) // STRIDE))
    room = np.zeros((n - 1) * STRIDE + CHUNK, np.uint8)
    room[:len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(room, CHUNK)[::STRIDE]


def _answers(net_filters: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Filter answers (chunk, place, filter)."""
    places = (CHUNK - WIDTH) // STEP + 1
    total = None
    for k in range(WIDTH):
        got = net_filters[k].take(part[:, k:k + STEP * places:STEP], axis=0)
        total = got if total is None else np.add(total, got, out=total)
    return total


def _logits(net: Network, parts: np.ndarray, block: int = 128) -> np.ndarray:
    out = np.empty(len(parts), np.float32)
    for at in range(0, len(parts), block):
        part = parts[at:at + block]
        top = _answers(net.filters, part).max(axis=1) + net.bias
        out[at:at + block] = _inputs(np.maximum(top, 0), part) @ net.weight + net.offset
    return out


def _inputs(act: np.ndarray, part: np.ndarray) -> np.ndarray:
    """What the logistic unit sees of each chunk."""
    empty = (1 - np.count_nonzero(part, axis=1) / CHUNK).astype(np.float32)[:, None]
    return np.concatenate([act, act * empty, empty], axis=1)


def _spread(logit: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Per document 1, mean, least and largest of its chunks' logits."""
    n = np.diff(np.append(starts, len(logit)))
    return np.stack([np.ones(len(starts)), np.add.reduceat(logit, starts) / n, np.minimum.reduceat(logit, starts),
                     np.maximum.reduceat(logit, starts)], axis=1)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score(net: Network, texts: list[str | None]) -> np.ndarray:
    """Probability of label 1 for each text."""
    if net.share is not None or not texts:
        return np.full(len(texts), net.share if net.share is not None else 0.5)
    out = np.empty((len(texts), 4))
    group: list[np.ndarray] = []
    first = room = 0
    for k, text in enumerate(texts):
        group.append(chunks(text.encode("utf-8", "replace") if text else b""))
        room += len(group[-1])
        if room >= 4096 or k == len(texts) - 1:
            logit = np.concatenate([_logits(net, g) for g in group]) if room > 8192 else _logits(net, np.concatenate(group))
            starts = np.concatenate([[0], np.cumsum([len(g) for g in group])[:-1]]).astype(int)
            out[first:k + 1] = _spread(logit, starts)
            group, first, room = [], k + 1, 0
    return _sigmoid(out @ net.combine)


def train(parts: np.ndarray, doc: np.ndarray, label: np.ndarray, prior: float, epochs: int = EPOCHS, seed: int = 5) -> Network:
    """Fit on chunks ``parts``; ``doc`` numbers each chunk's document (sorted), ``label`` is by document."""
    rng = np.random.default_rng(seed)
    w = {"filters": rng.normal(0, 0.3, (WIDTH, 256, FILTERS)), "bias": np.full(FILTERS, 0.1),
         "weight": np.concatenate([rng.normal(0, 0.3, FILTERS), np.zeros(FILTERS + 1)]), "offset": np.zeros(1)}
    w = {k: v.astype(np.float32) for k, v in w.items()}
    w["filters"][:, 0] = 0
    mean = {k: np.zeros_like(v) for k, v in w.items()}
    square = {k: np.zeros_like(v) for k, v in w.items()}
    target = label[doc].astype(np.float32)
    weight = 0.5 / np.where(target == 1, max(target.mean(), 1e-6), max(1 - target.mean(), 1e-6)).astype(np.float32)
    turn = 0
    for _ in range(epochs):
        order = rng.permutation(len(parts))
        for at in range(0, len(order), 64):
            rows = order[at:at + 64]
            part = parts[rows]
            # a third of the chunks are cut short at random, so that short texts are known
            cut = np.where(rng.random(len(rows)) < 1 / 3, rng.integers(8, CHUNK, len(rows)), CHUNK)
            part = np.where(np.arange(CHUNK) < cut[:, None], part, np.uint8(0))
            answer = _answers(w["filters"], part)
            place = answer.argmax(axis=1)
            top = np.take_along_axis(answer, place[:, None, :], 1)[:, 0] + w["bias"]
            act = np.maximum(top, 0)
            seen = _inputs(act, part)
            z = seen @ w["weight"] + w["offset"][0]
            err = (_sigmoid(z) - target[rows]) * weight[rows] / len(rows)
            back = err[:, None] * (w["weight"][:FILTERS] + seen[:, -1:] * w["weight"][FILTERS:-1]) * (top > 0)
            grad = {"filters": np.zeros_like(w["filters"]), "bias": back.sum(0), "weight": seen.T @ err,
                    "offset": np.array([err.sum()])}
            f = np.broadcast_to(np.arange(FILTERS), place.shape)
            for k in range(WIDTH):
                byte = np.take_along_axis(part, place * STEP + k, 1)
                np.add.at(grad["filters"][k], (byte, f), back)
            grad["filters"][:, 0] = 0
            turn += 1
            for k, g in grad.items():  # Adam
                mean[k] += 0.1 * (g - mean[k])
                square[k] += 0.001 * (g * g - square[k])
                w[k] -= 0.01 * (mean[k] / (1 - 0.9 ** turn)) / (np.sqrt(square[k] / (1 - 0.999 ** turn)) + 1e-8)
    net = Network(w["filters"], w["bias"], w["weight"], float(w["offset"][0]), np.zeros(4))
    starts = np.flatnonzero(np.diff(doc, prepend=-1))
    x = _spread(_logits(net, parts).astype(float), starts)
    y = label.astype(float)
    size = np.where(y == 1, prior / max(y.mean(), 1e-9), (1 - prior) / max(1 - y.mean(), 1e-9))
    combine = np.array([0.0, 1.0, 0.0, 0.0])
    for _ in range(50):  # Newton steps of a ridge logistic regression
        p = _sigmoid(x @ combine)
        step = np.linalg.solve((x * (size * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 0.5 * np.eye(4),
                               x.T @ (size * (p - y)) + 0.5 * (combine - [0, 1, 0, 0]))
        combine = combine - np.clip(step, -2, 2)
    return Network(net.filters, net.bias, net.weight, net.offset, combine)


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        sample_per_class: int = SAMPLE_PER_CLASS, sample_chunks: int = SAMPLE_CHUNKS, epochs: int = EPOCHS) -> Network:
    """Train on at most 2 * ``sample_per_class`` documents, none of them held out."""
    known = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
             .where(~held_out("id") & F.col("id").isNotNull() & F.col("y").isin(0, 1)))
    share = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    prior = share.get(1, 0) / max(1, sum(share.values()))
    nothing = Network(np.zeros(0), np.zeros(0), np.zeros(0), 0.0, np.zeros(4), prior if share else 0.5)
    if len(share) < 2:
        return nothing
    chosen = None
    for y in (0, 1):
        some = known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample_per_class)
        chosen = some if chosen is None else chosen.unionByName(some)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))

    def sample(batches):
        for batch in batches:
            got = []
            for text in batch.column(2).to_pylist():
                all_ = chunks(text.encode("utf-8", "replace") if text else b"")
                pick = np.unique(np.linspace(0, len(all_) - 1, min(len(all_), sample_chunks)).round().astype(int))
                got.append(all_[pick].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), batch.column(1), pa.array(got, pa.binary())],
                                             ["y", "h", "part"])

    # at most 2 * sample_per_class rows on the small side
    met = texts.join(F.broadcast(chosen), "id").select("y", F.xxhash64("id", "t").alias("h"), "t")
    rows = met.mapInArrow(sample, "y int, h long, part binary").orderBy("h", "y").limit(2 * sample_per_class).collect()
    label = np.array([r["y"] for r in rows], np.int64)
    if len(set(label.tolist())) < 2:
        return nothing
    each = [np.frombuffer(r["part"], np.uint8).reshape(-1, CHUNK) for r in rows]
    return train(np.concatenate(each), np.repeat(np.arange(len(each)), [len(e) for e in each]), label, prior, epochs)


def scores(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text",
           threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, held_out, score, predicted."""
    model = docs.sparkSession.sparkContext.broadcast(net.plain())
    schema = T.StructType([T.StructField("id", field(docs, id_col)), T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(Network(*model.value), batch.column(1).to_pylist()))],
                                             ["id", "score"])

    made = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, schema)
    return made.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score",
                       (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, net: Network, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores ``threshold`` or more."""
    model = docs.sparkSession.sparkContext.broadcast(net.plain())
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = batch.column(at).cast(pa.string()).to_pylist()
            yield batch.filter(pa.array(score(Network(*model.value), texts) >= threshold))

    return docs.mapInArrow(run, docs.schema)
