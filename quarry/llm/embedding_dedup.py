"""Embedding near-duplicates by sorted projection passes.

Each pass orders the distinct vectors lexicographically by concatenated
random hashes (the nearest signed axis under random Gaussian maps), cuts the
order into blocks of ``window`` rows and compares every block with itself and
the next one.  A run of equal leading hashes that is longer than that is
compared block by block, so no partner inside a run is missed.  Pairs are
verified by their cosine in double precision and united across passes.

The number of leading hashes grows with the number of vectors; the number of
passes follows from it, such that a pair exactly at the threshold shares its
leading hashes in no pass with probability ``miss`` or less (measured by a
simulation on the driver with a fixed seed).  A pair that meets in several
passes is counted in the first of them, which both rows' hashes tell, so pairs
need no shuffle to be counted once.

Defined results: a vector that is null, zero, empty or holds null or non-finite
components links with nothing; vectors of different lengths never link; equal
vectors (repeated rows too) are one representative with a multiplicity; extra
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import component_ids, field, forest, global_rank, per_process, stage

WINDOW = 512
MISS = 1e-6
RUN = 256  # rows that should share their leading hashes, about


def _maps(*key: int) -> np.ndarray:
    """The random map of (seed, size, pass, depth)."""
    known = per_process("maps")
    if key not in known:
        known[key] = np.random.default_rng(key).standard_normal((key[1], key[1]))
    return known[key]


def _nearest_axis(x: np.ndarray, turn: np.ndarray) -> np.ndarray:
    y = x @ turn
    at = np.abs(y).argmax(axis=1)
    return 2 * at + (y[np.arange(len(y)), at] < 0)


@functools.lru_cache(maxsize=256)
def plan(size: int, rows: int, threshold: float, miss: float, seed: int) -> tuple[int, int, int]:
    """(leading hashes, hashes in all, passes) for so many vectors of so many components."""
    signs = 2 * size
    depth = max(1, int(62 // np.log2(signs)))
    lead = int(np.clip(round(np.log(max(rows, 1) / RUN) / np.log(signs)), 1, max(1, depth - 1)))
    rng = np.random.default_rng([seed, size])
    x = rng.standard_normal((4000, size))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((4000, size))
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
    y = threshold * x + np.sqrt(max(0.0, 1 - threshold * threshold)) * y
    turn = _maps(seed, size, 0, 0)
    same = min(0.999, (np.sum(_nearest_axis(x, turn) == _nearest_axis(y, turn)) + 1) / 4001) ** lead
    return lead, min(depth, lead + 2), int(np.ceil(np.log(miss) / np.log1p(-same)))


def _hash_rows(kind: str, plans: dict[int, tuple[int, int, int]], seed: int):
    def run(batches):
        for batch in batches:
            sizes = np.asarray(batch.column(1))
            lead_all, rest_all = [None] * len(sizes), [None] * len(sizes)
            raw = batch.column(0).to_pylist()
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                x = np.stack([np.frombuffer(raw[i], kind) for i in rows]).astype(np.float64)
                x /= np.abs(x).max(axis=1, keepdims=True)
                lead, depth, passes = plans[int(size)]
                key = np.zeros((len(rows), passes, 2), np.int64)
                for turn in range(passes):
                    for d in range(depth):
                        at = key[:, turn, 0 if d < lead else 1]
                        at *= 2 * int(size)
                        at += _nearest_axis(x, _maps(seed, int(size), turn, d))
                for i, k in zip(rows, key, strict=True):
                    lead_all[i], rest_all[i] = k[:, 0], k[:, 1]
            big = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lead_all, big), pa.array(rest_all, big)],
                                             [*batch.schema.names, "leads", "rests"])
    return run


def _compare(kind: str, threshold: float):
    out = ["kind", "a", "b", "wa", "wb"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        for (turn, _), part in pdf.groupby(["turn", "size"]):
            left = np.flatnonzero((part["side"] == 0).to_numpy())
            if not len(left):
                continue
            right = np.flatnonzero((part["side"] == 1).to_numpy())
            own = bool(part["own"].iloc[0])
            x = np.stack([np.frombuffer(v, kind) for v in part["v"]]).astype(np.float64)
            x /= np.abs(x).max(axis=1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            lead = np.stack(part["leads"].to_numpy())
            rid, many = part["rid"].to_numpy(), part["many"].to_numpy()
            other = np.concatenate([left, right]) if own else right
            for at in range(0, len(left), 256):
                rows = left[at:at + 256]
                hit = x[rows] @ x[other].T >= threshold
                if own:  # inside the block each pair once
                    hit &= np.arange(len(other))[None, :] > (at + np.arange(len(rows)))[:, None]
                i, j = np.nonzero(hit)
                if not len(i):
                    continue
                i, j = rows[i], other[j]
                same = lead[i] == lead[j]
                met = same.any(axis=1)
                first = met & (same.argmax(axis=1) == turn)
                n, w = np.concatenate([i[first], j[first]]), np.concatenate([many[j[first]], many[i[first]]])
                total = np.bincount(n, weights=w, minlength=len(rid)).astype(np.int64)
                for k in np.flatnonzero(total):
                    found.append((0, rid[k], 0, total[k], 0))
                found.extend((1, a, b, 0, 0) for a, b in zip(*forest(rid[i], rid[j]), strict=True))
                found.extend((2, min(a, b), max(a, b), *((p, q) if a < b else (q, p)))
                             for a, b, p, q in zip(rid[i[~met]], rid[j[~met]], many[i[~met]], many[j[~met]], strict=True))
        return pd.DataFrame(found, columns=out).astype("int64")
    return run


def link_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95,
                 window: int = WINDOW, miss: float = MISS, seed: int = 17) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept."""
    if not 0 < threshold < 1:
        raise ValueError("the threshold must lie between 0 and 1")
    item = field(df, vec_col)
    kind = "<f4" if isinstance(item, T.ArrayType) and isinstance(item.elementType, T.FloatType) else "<f8"
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast(
        "array<float>" if kind == "<f4" else "array<double>").alias("vec"))
    fit = (F.col("vec").isNotNull()
           & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
           & F.exists("vec", lambda x: x != 0))
    rows = rows.withColumn("fit", F.coalesce(fit, F.lit(False)))
    good = rows.where("fit").mapInArrow(_to_bytes(kind), T.StructType([
        T.StructField("id", field(df, id_col)), T.StructField("v", T.BinaryType()), T.StructField("size", T.LongType())]))
    good = stage(good, "vectors")
    distinct = good.groupBy("v", "size").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("many"))
    # one row per vector length, a handful
    plans = {r["size"]: plan(r["size"], r["count"], threshold, miss, seed)
             for r in good.groupBy("size").count().collect()}
    keys = T.ArrayType(T.LongType())
    hashed = distinct.mapInArrow(_hash_rows(kind, plans, seed),
                                 T.StructType([*distinct.schema.fields, T.StructField("leads", keys), T.StructField("rests", keys)]))
    reps = stage(hashed.withColumn("rid", F.monotonically_increasing_id()), "vector-reps")

    passes = (reps.select("rid", "size", F.posexplode(F.arrays_zip("leads", "rests")).alias("turn", "k"))
              .select("rid", "size", "turn", F.col("k.leads").alias("lead"), F.col("k.rests").alias("rest")))
    ranked = global_rank(passes, ["turn", "size", "lead", "rest", "rid"], "vector-order")
    ranked = ranked.withColumn("block", F.expr(f"rank div {int(window)}")).drop("rest", "rank")
    long_runs = stage(ranked.groupBy("turn", "size", "lead").agg(F.min("block").alias("first"), F.max("block").alias("last"))
                      .where("last - first > 1"), "vector-runs")
    plain = ranked.select("rid", "turn", F.explode(F.array(
        F.struct(F.col("block").alias("t1"), F.col("block").alias("t2"), F.lit(0).alias("side")),
        F.struct((F.col("block") - 1).alias("t1"), (F.col("block") - 1).alias("t2"), F.lit(1).alias("side")))).alias("t"))
    far = ranked.join(long_runs, ["turn", "size", "lead"]).select("rid", "turn", F.explode(F.expr("""concat(
        if(last >= block + 2, transform(sequence(block + 2, greatest(last, block + 2)),
            j -> named_struct('t1', block, 't2', j, 'side', 0)), array()),
        if(first <= block - 2, transform(sequence(least(first, block - 2), block - 2),
            j -> named_struct('t1', j, 't2', block, 'side', 1)), array()))""")).alias("t"))
    tasks = plain.unionByName(far).select("rid", "turn", "t.t1", "t.t2", "t.side")
    tasks = tasks.withColumn("own", F.col("t1") == F.col("t2"))
    full = tasks.join(reps.select("rid", "v", "size", "many", "leads"), "rid")
    found = stage(full.groupBy("t1", "t2").applyInPandas(_compare(kind, threshold),
                                                         "kind long, a long, b long, wa long, wb long"), "vector-links")
    stray = found.where("kind = 2").distinct()
    counts = (found.where("kind = 0").select(F.col("a").alias("rid"), F.col("wa").alias("n"))
              .unionByName(stray.select(F.col("a").alias("rid"), F.col("wb").alias("n")))
              .unionByName(stray.select(F.col("b").alias("rid"), F.col("wa").alias("n")))
              .groupBy("rid").agg(F.sum("n").alias("n")))
    edges = found.where("kind > 0").select("a", "b")
    placed = component_ids(reps.select(F.col("rid").alias("node"), "least"), edges, "vectors")
    per_rep = (reps.select("rid", "v", "many").join(counts, "rid", "left")
               .join(placed.select(F.col("node").alias("rid"), "component_id"), "rid")
               .select("v", (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links"), "component_id"))
    linked = good.join(per_rep, "v").select("id", "n_links", "component_id")
    alone = rows.where("NOT fit").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return (linked.unionByName(alone)
            .select(F.col("id").alias(id_col), "n_links", "component_id",
                    F.col("id").eqNullSafe(F.col("component_id")).alias("kept")))


def _to_bytes(kind: str):
    def run(batches):
        for batch in batches:
            col = batch.column(1)
            at = np.asarray(col.offsets)
            flat = np.asarray(col.values).astype(kind) + 0.0  # -0 becomes 0
            v = [flat[a:b].astype(kind).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(v, pa.binary()), pa.array(np.diff(at), pa.int64())],
                                             ["id", "v", "size"])
    return run
