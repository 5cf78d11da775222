"""Gaussian mixtures over vector tables.

Fitting (``fit_gmm``) is expectation-maximisation where each iteration is one
Spark job: every task turns its partition into sufficient statistics
(Σr, Σr·y, Σr·y·yᵀ with y the offset from the present mean, and the
log-likelihood) with numpy, MLlib's ``Summarizer`` sums them across tasks in
two levels (no row ever reaches the driver), and the driver only updates k·d² numbers.  The
starting point is deterministic: k-means++ seeds drawn with a seeded hash,
refined by Lloyd steps computed the same way.

Assignment (``assign``) ships the fitted parameters with the task and
labels each row by its most probable component (ties to the smaller index).
``diagonal_from_labels`` estimates a diagonal mixture in one pass from given
labels; ``assign_diagonal`` scores rows against it the same way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators import dense

REG_COVAR = 1e-6
TOL = 1e-3
MAX_ITER = 100
LLOYD_STEPS = 10
SEED = 42
LOG_2PI = float(np.log(2 * np.pi))


@dataclass
class MixtureModel:
    weights: np.ndarray  # (k,)
    means: np.ndarray  # (k, d)
    covariances: np.ndarray  # (k, d, d)
    n_iter: int = 0
    log_likelihood: float = float("nan")
    converged: bool = False

    @property
    def k(self) -> int:
        return len(self.weights)

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [(i, float(self.weights[i]), self.means[i].tolist(), self.covariances[i].tolist())
                for i in range(self.k)]
        return spark.createDataFrame(
            rows, "component int, weight double, mean array<double>, covariance array<array<double>>")

    @staticmethod
    def from_df(df: DataFrame) -> MixtureModel:
        rows = sorted(df.collect(), key=lambda r: r["component"])  # k rows
        return MixtureModel(np.array([r["weight"] for r in rows]), np.array([r["mean"] for r in rows]),
                            np.array([r["covariance"] for r in rows]))


def _factors(model: MixtureModel) -> tuple[np.ndarray, np.ndarray]:
    """Inverse Cholesky factors and log-determinants, once per model (k·d³)."""
    chols = [np.linalg.cholesky(c) for c in model.covariances]
    inv = np.array([np.linalg.inv(c) for c in chols])
    logdet = np.array([2.0 * np.sum(np.log(np.diag(c))) for c in chols])
    return inv, logdet


def _log_resp(x: np.ndarray, weights: np.ndarray, means: np.ndarray, inv_chols: np.ndarray,
              logdets: np.ndarray) -> np.ndarray:
    """log(w_k) + log N(x | mean_k, cov_k) for every row and component."""
    n, d = x.shape
    out = np.empty((n, len(weights)))
    for j in range(len(weights)):
        y = (x - means[j]) @ inv_chols[j].T  # L^-1 (x - mu), as one matrix product
        maha = np.einsum("ij,ij->i", y, y)
        out[:, j] = np.log(weights[j]) - 0.5 * (d * LOG_2PI + logdets[j] + maha)
    return out


def _logsumexp(a: np.ndarray) -> np.ndarray:
    m = a.max(axis=1, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis=1, keepdims=True))).ravel()


def _second_moments(r: np.ndarray, x: np.ndarray, about: np.ndarray) -> np.ndarray:
    """Σ_n r[n, j] (x_n - a_j)(x_n - a_j)ᵀ for every component j, one BLAS product
    each; about the present means, so that large means cost no precision."""
    out = []
    for j in range(r.shape[1]):
        y = x - about[j]
        out.append((y * r[:, j:j + 1]).T @ y)
    return np.stack(out)


def _vectors(df: DataFrame, vec_col: str, id_col: str) -> DataFrame:
    """(id, v) of the rows with a vector free of nulls and NaN; mixed lengths raise.

    ``id`` is a long: the id itself, or a hash of an id of another type (it only
    decides how seeds are drawn)."""
    number = dict(df.dtypes)[id_col] in ("bigint", "int", "smallint", "tinyint")
    key = F.col(id_col).cast("long") if number else F.xxhash64(id_col)
    v = df.select(key.alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(dense.usable(F.col("v")))
    seen = v.agg(F.min(F.size("v")).alias("lo"), F.max(F.size("v")).alias("hi")).first()
    if seen["lo"] != seen["hi"]:
        raise ValueError(f"vectors have {seen['lo']} to {seen['hi']} components; see dense.rejected_vectors()")
    return v


def _usable(col: pa.Array, d: int) -> np.ndarray:
    """Rows with a vector of length ``d`` without nulls and NaN (others get a null assignment)."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(col), 0))
    values = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    odd = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    ends = np.cumsum(lengths)
    return (lengths == d) & (odd[ends] == odd[ends - lengths])


def _batch_matrix(b: pa.RecordBatch, d: int) -> np.ndarray:
    flat = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(b.num_rows, d)


def _stat_rows(stats: np.ndarray, rest: float | None = None) -> pa.RecordBatch:
    """One row per component of a task's statistics; ``rest`` is a last row of one number."""
    rows = list(stats) if rest is None else [*stats, np.array([rest])]
    ends = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in rows])]), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(rows)))],
                                      ["component", "s"])


def _sum_stats(x: DataFrame, fn, k: int, width: int) -> tuple[np.ndarray, float]:
    """Run ``fn`` per partition (yields ``_stat_rows``) and sum by component in two levels, so
    that a row is one component's statistics and no task reads those of all others:
    ((k, width) sums, sum of the rest)."""
    parts = x.rdd.getNumPartitions()
    group = F.pmod(F.spark_partition_id(), F.lit(max(1, round(parts ** 0.5)))).alias("g")
    stats = x.mapInArrow(fn, "component int, s array<double>").select("component", array_to_vector("s").alias("s"), group)
    middle = stats.groupBy("component", "g").agg(Summarizer.sum(F.col("s")).alias("s"))
    total = middle.groupBy("component").agg(vector_to_array(Summarizer.sum(F.col("s"))).alias("t"))
    out, rest = np.zeros((k, width)), 0.0
    for r in total.collect():  # a row per component, never data rows
        if r["component"] < k:
            out[r["component"]] = r["t"]
        else:
            rest = r["t"][0]
    return out, rest


def _parts(t: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, sums and, where there are any, second moments of summed statistics."""
    return t[:, 0], t[:, 1:1 + d], t[:, 1 + d:].reshape(len(t), -1, d)


def _em_stats_fn(model: MixtureModel, d: int):
    k = model.k
    inv, logdet = _factors(model)
    w, mu = model.weights, model.means

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nk, sx, sxx, ll = np.zeros(k), np.zeros((k, d)), np.zeros((k, d, d)), 0.0
        for b in batches:
            if b.num_rows == 0:
                continue
            x = _batch_matrix(b, d)
            lr = _log_resp(x, w, mu, inv, logdet)
            norm = _logsumexp(lr)
            r = np.exp(lr - norm[:, None])
            ll += norm.sum()
            nk += r.sum(axis=0)
            sx += r.T @ x - r.sum(axis=0)[:, None] * mu
            sxx += _second_moments(r, x, mu)
        yield _stat_rows(np.concatenate([nk[:, None], sx, sxx.reshape(k, -1)], axis=1), ll)

    return fn


def _hard_stats_fn(centres: np.ndarray, d: int, second_moments: bool = True):
    """Counts and sums (and, when asked, second moments), all about the centre, of
    the rows nearest to each centre; Lloyd steps only need the first two."""
    k = len(centres)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nk, sx = np.zeros(k), np.zeros((k, d))
        sxx = np.zeros((k, d, d)) if second_moments else np.zeros((k, 0))
        for b in batches:
            if b.num_rows == 0:
                continue
            x = _batch_matrix(b, d)
            dist = (x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)[None, :]
            lab = np.argmin(dist, axis=1)
            r = np.zeros((len(x), k))
            r[np.arange(len(x)), lab] = 1.0
            nk += r.sum(axis=0)
            sx += r.T @ x - r.sum(axis=0)[:, None] * centres
            if second_moments:
                sxx += _second_moments(r, x, centres)
        yield _stat_rows(np.concatenate([nk[:, None], sx, sxx.reshape(k, -1)], axis=1))

    return fn


def _uniform(ids: np.ndarray, salt: int) -> np.ndarray:
    """Deterministic uniforms in (0, 1) from ids (splitmix64 of id and salt)."""
    with np.errstate(over="ignore"):
        z = ids.astype(np.uint64) + np.uint64(salt) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return ((z >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def _seed_key_fn(centres: np.ndarray, d: int, salt: int):
    """Weighted-sampling key per row: -ln(u) / D², where D is the distance
    to the nearest chosen centre; the smallest key is a draw ∝ D²."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for b in batches:
            if b.num_rows == 0:
                continue
            x = _batch_matrix(b, d)
            ids = b.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
            d2 = ((x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)[None, :]).min(axis=1)
            key = -np.log(_uniform(ids, salt)) / np.maximum(d2, 1e-300)
            i = int(np.lexsort((ids, key))[0])
            if best is None or (key[i], ids[i]) < best[:2]:
                best = (float(key[i]), int(ids[i]), x[i].tolist())
        if best is not None:  # one row per task
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in best], names=["key", "id", "v"])

    return fn


def kmeanspp_seeds(x: DataFrame, k: int, seed: int = SEED) -> np.ndarray:
    """k-means++ starting centres over (id, v) rows, deterministic for a seed.

    The first centre is the row with the smallest id hash; each further one
    is one job whose tasks key every row and keep the smallest key
    (TakeOrderedAndProject), so only one row per step reaches the driver.
    """
    first = x.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(1).collect()[0]
    centres = [np.asarray(first["v"], dtype=np.float64)]
    d = len(centres[0])
    for step in range(1, k):
        keyed = x.mapInArrow(_seed_key_fn(np.array(centres), d, seed * 1000 + step),
                             "key double, id long, v array<double>")
        row = keyed.orderBy("key", "id").limit(1).collect()[0]
        centres.append(np.asarray(row["v"], dtype=np.float64))
    return np.array(centres)


def kmeans(vectors: DataFrame, k: int, vec_col: str = "embedding", id_col: str = "vec_id", seed: int = SEED,
           max_iter: int = 20, tol: float = 1e-4) -> np.ndarray:
    """Lloyd's k-means; returns the (k, d) centres.  Seeds are the k rows with
    the smallest hash of the id; each step is one job of per-task sums."""
    x = _vectors(vectors, vec_col, id_col).persist()
    try:
        centres = kmeanspp_seeds(x, k, seed)
        kk, d = centres.shape
        for _ in range(max_iter):
            nk, sx, _none = _parts(_sum_stats(x, _hard_stats_fn(centres, d, False), kk, 1 + d)[0], d)
            new = centres + sx / np.maximum(nk, 1)[:, None]
            shift = float(np.sum((new - centres) ** 2))
            centres = new
            if shift <= tol * max(float(np.sum(centres ** 2)), 1e-12):
                break
        return centres
    finally:
        x.unpersist()


def _m_step(nk: np.ndarray, sx: np.ndarray, sxx: np.ndarray, n: int, reg: float, about: np.ndarray) -> MixtureModel:
    """New parameters from statistics taken about the points ``about``."""
    d = sx.shape[1]
    nk_safe = nk + 10 * np.finfo(float).eps
    shift = sx / nk_safe[:, None]
    means = about + shift
    covs = sxx / nk_safe[:, None, None] - np.einsum("ki,kj->kij", shift, shift)
    covs = 0.5 * (covs + np.transpose(covs, (0, 2, 1))) + reg * np.eye(d)[None]
    return MixtureModel(nk_safe / n, means, covs)


def _em_step(x: DataFrame, model: MixtureModel, n: int, reg: float) -> tuple[MixtureModel, float]:
    k, d = model.means.shape
    t, ll = _sum_stats(x, _em_stats_fn(model, d), k, 1 + d + d * d)
    return _m_step(*_parts(t, d), n, reg, model.means), ll / n


def em_step(vectors: DataFrame, model: MixtureModel, vec_col: str = "embedding", id_col: str = "vec_id",
            reg: float = REG_COVAR) -> MixtureModel:
    """One step of expectation-maximisation from given parameters; the returned
    model's log-likelihood is the mean under the given ones."""
    x = _vectors(vectors, vec_col, id_col)
    after, ll = _em_step(x, model, x.count(), reg)
    after.n_iter, after.log_likelihood = model.n_iter + 1, ll
    return after


def fit_gmm(vectors: DataFrame, k: int = 10, vec_col: str = "embedding", id_col: str = "vec_id",
            seed: int = SEED, tol: float = TOL, max_iter: int = MAX_ITER, reg: float = REG_COVAR,
            lloyd_steps: int = LLOYD_STEPS) -> MixtureModel:
    """Full-covariance Gaussian mixture by EM (see module docstring)."""
    x = _vectors(vectors, vec_col, id_col).persist()
    try:
        n = x.count()
        if k > n:
            raise ValueError(f"n_components={k} must be <= number of rows ({n})")
        centres = kmeanspp_seeds(x, k, seed)
        d = centres.shape[1]
        for _ in range(max(1, lloyd_steps)):
            nk, sx, _none = _parts(_sum_stats(x, _hard_stats_fn(centres, d, False), k, 1 + d)[0], d)
            new = centres + sx / np.maximum(nk, 1)[:, None]
            done = np.allclose(new, centres)
            centres = new
            if done:
                break
        # the starting mixture: one hard assignment to the final centres
        t, _none = _sum_stats(x, _hard_stats_fn(centres, d, True), k, 1 + d + d * d)
        return _canonical(_iterate(x, _m_step(*_parts(t, d), n, reg, centres), n, reg, tol, max_iter))
    finally:
        x.unpersist()


def _iterate(x: DataFrame, model: MixtureModel, n: int, reg: float, tol: float, max_iter: int) -> MixtureModel:
    """EM steps until the mean log-likelihood moves by less than ``tol``."""
    prev = -np.inf
    for it in range(1, max_iter + 1):
        model, ll = _em_step(x, model, n, reg)
        model.n_iter, model.log_likelihood = it, ll
        if abs(ll - prev) < tol:
            model.converged = True
            break
        prev = ll
    return model


# --- another number of components, from the fitted ones ------------------------------------------

def _merged(model: MixtureModel, i: int, j: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Weight, mean and covariance of two components taken as one (moments kept)."""
    w = model.weights[i] + model.weights[j]
    a, b = model.weights[i] / w, model.weights[j] / w
    gap = model.means[i] - model.means[j]
    return w, a * model.means[i] + b * model.means[j], a * model.covariances[i] + b * model.covariances[j] + a * b * np.outer(gap, gap)


def _merge_loss(model: MixtureModel, i: int, j: int) -> float:
    """Upper bound of what the mean log-likelihood loses if two components become one."""
    w, _, cov = _merged(model, i, j)
    logdet = [np.linalg.slogdet(c)[1] for c in (cov, model.covariances[i], model.covariances[j])]
    return 0.5 * (w * logdet[0] - model.weights[i] * logdet[1] - model.weights[j] * logdet[2])


def merge_once(model: MixtureModel) -> MixtureModel:
    """One component less: the two whose merging loses least become one."""
    pairs = [(i, j) for i in range(model.k) for j in range(i)]
    i, j = min(pairs, key=lambda p: (_merge_loss(model, *p), p))
    w, mean, cov = _merged(model, i, j)
    rest = [m for m in range(model.k) if m not in (i, j)]
    return MixtureModel(np.append(model.weights[rest], w), np.vstack([model.means[rest], mean]),
                        np.concatenate([model.covariances[rest], cov[None]]))


def split_once(model: MixtureModel, at: int | None = None) -> MixtureModel:
    """One component more: the one with the largest spread along one axis, by weight (or the
    given one), is halved across its principal axis; its mean and covariance are kept."""
    spread, axis = np.linalg.eigh(model.covariances)
    if at is None:
        at = int(np.argmax(model.weights * spread[:, -1]))
    u = axis[at][:, -1]
    u = u * np.sign(u[np.argmax(np.abs(u))])
    # the halves of a normal distribution: means at sqrt(2 / pi) deviations, variance 1 - 2 / pi
    step = np.sqrt(2 / np.pi * spread[at, -1]) * u
    cov = model.covariances[at] - np.outer(step, step)
    rest = [m for m in range(model.k) if m != at]
    half = model.weights[at] / 2
    return MixtureModel(np.append(model.weights[rest], [half, half]), np.vstack([model.means[rest], model.means[at] - step, model.means[at] + step]),
                        np.concatenate([model.covariances[rest], cov[None], cov[None]]))


def refit(vectors: DataFrame, model: MixtureModel, k: int | None = None, vec_col: str = "embedding", id_col: str = "vec_id",
          tol: float = TOL, max_iter: int = MAX_ITER, reg: float = REG_COVAR, settle: int = 3) -> MixtureModel:
    """Go on from a fitted mixture, e.g. for other rows or another ``k``: components are split
    or merged one at a time, ``settle`` EM steps after each, then EM runs to its end.  No seeds
    and no k-means: each step is one pass over the rows."""
    k = model.k if k is None else k
    x = _vectors(vectors, vec_col, id_col).persist()
    try:
        n = x.count()
        if not 1 <= k <= n:
            raise ValueError(f"n_components={k} must be from 1 to the number of rows ({n})")
        while model.k != k:
            model = split_once(model) if model.k < k else merge_once(model)
            model = _iterate(x, model, n, reg, tol, settle)
        return _canonical(_iterate(x, model, n, reg, tol, max_iter))
    finally:
        x.unpersist()


def _canonical(model: MixtureModel) -> MixtureModel:
    """Order components by weight (desc), then mean (lexicographic)."""
    keys = [(-model.weights[i], tuple(np.round(model.means[i], 12))) for i in range(model.k)]
    order = sorted(range(model.k), key=lambda i: keys[i])
    return MixtureModel(model.weights[order], model.means[order], model.covariances[order],
                        model.n_iter, model.log_likelihood, model.converged)


def assign(vectors: DataFrame, model: MixtureModel, vec_col: str = "embedding",
           out_col: str = "cluster") -> DataFrame:
    """Add the most probable component (hard assignment) as ``out_col``.

    The parameters (k·d² numbers) travel with the task; the vectors stay put.
    """
    d = model.means.shape[1]
    inv, logdet = _factors(model)
    w, mu = model.weights, model.means
    out_schema = T.StructType(list(vectors.schema.fields) + [T.StructField(out_col, T.IntegerType())])

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows == 0:
                continue
            col = b.column(vec_col)
            valid = _usable(col, d)
            lab = np.full(b.num_rows, -1, dtype=np.int32)
            if valid.any():
                x = _batch_matrix(pa.RecordBatch.from_arrays([col.filter(pa.array(valid))], names=["v"]), d)
                lab[valid] = np.argmax(_log_resp(x, w, mu, inv, logdet), axis=1).astype(np.int32)
            arr = pa.array(lab, pa.int32(), mask=~valid)
            yield pa.RecordBatch.from_arrays(list(b.columns) + [arr], names=list(b.schema.names) + [out_col])

    return vectors.mapInArrow(fn, out_schema)


def log_likelihood(vectors: DataFrame, model: MixtureModel, vec_col: str = "embedding",
                   id_col: str = "vec_id") -> float:
    """Mean log-likelihood of the rows under ``model``."""
    x = _vectors(vectors, vec_col, id_col)
    d = model.means.shape[1]
    k = model.k
    t = _sum_stats(x, _em_stats_fn(model, d), k + k * d + k * d * d + 1)
    return float(t[-1] / max(t[:k].sum(), 1e-300))


# --- MLlib alternative on reduced vectors ----------------------------------------------

def fit_gmm_mllib(vectors: DataFrame, k: int = 10, vec_col: str = "embedding", pca_dims: int | None = 16,
                  seed: int = SEED, out_col: str = "cluster") -> DataFrame:
    """MLlib's GaussianMixture, optionally after PCA (MLlib has no covariance
    floor, so full-dimensional fits with few rows per component can fail).
    Returns the rows with their component in ``out_col``."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import PCA

    data = vectors.withColumn("_v", array_to_vector(F.col(vec_col).cast("array<double>")))
    feat = "_v"
    if pca_dims:
        data = PCA(k=pca_dims, inputCol="_v", outputCol="_p").fit(data).transform(data)
        feat = "_p"
    gm = GaussianMixture(k=k, seed=seed, featuresCol=feat, predictionCol=out_col, probabilityCol="_prob")
    out = gm.fit(data).transform(data)
    return out.drop("_v", "_p", "_prob")


# --- diagonal mixture from given labels ---------------------------------------------------

def diagonal_from_labels(vectors: DataFrame, label_col: str = "label", vec_col: str = "embedding",
                         reg: float = REG_COVAR) -> DataFrame:
    """(component, label, weight, mean array<double>, var array<double>) — one pass.

    Per-label sample variance plus ``reg``; weight = label share; components
    are numbered 0.. in label order.  MLlib's ``Summarizer`` aggregates the
    vectors with partial aggregation (one small row per label per task).
    """
    v = array_to_vector(F.col(vec_col).cast("array<double>"))
    rows = vectors.where(F.col(vec_col).isNotNull())
    s = (rows.groupBy(F.col(label_col).alias("label"))
         .agg(Summarizer.metrics("mean", "variance", "count").summary(v).alias("m")))
    total = rows.select(F.count("*").cast("double")).scalar()
    # k rows only: a global window over them is harmless.
    order = Window.orderBy("label")
    return s.select(
        (F.dense_rank().over(order) - 1).cast("int").alias("component"),
        "label",
        (F.col("m.count") / total).alias("weight"),
        vector_to_array("m.mean").alias("mean"),
        F.transform(vector_to_array("m.variance"), lambda x: x + reg).alias("var"))


def assign_diagonal(vectors: DataFrame, params: DataFrame | list, vec_col: str = "embedding",
                    out_col: str = "cluster") -> DataFrame:
    """Most probable component under diagonal parameters (ties to the smaller id).

    The k parameter rows are collected (k·d numbers) and travel with the
    task; each Arrow batch is scored with numpy, so plan size does not grow
    with k or d and no join is needed.
    """
    collected = params if isinstance(params, list) else params.collect()  # k parameter rows
    rows = sorted(collected, key=lambda r: r["component"])
    comp = np.array([int(r["component"]) for r in rows], dtype=np.int32)
    logw = np.log(np.array([float(r["weight"]) for r in rows]))
    mean = np.array([r["mean"] for r in rows], dtype=np.float64)
    var = np.array([r["var"] for r in rows], dtype=np.float64)
    const = logw - 0.5 * np.log(2 * np.pi * var).sum(axis=1)
    d = mean.shape[1]
    out_schema = T.StructType(list(vectors.schema.fields) + [T.StructField(out_col, T.IntegerType())])

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows == 0:
                continue
            col = b.column(vec_col)
            ok = _usable(col, d)
            lab = np.full(b.num_rows, -1, dtype=np.int32)
            if ok.any():
                x = _batch_matrix(pa.RecordBatch.from_arrays([col.filter(pa.array(ok))], names=["v"]), d)
                ld = np.stack([const[j] - 0.5 * (((x - mean[j]) ** 2) / var[j]).sum(axis=1)
                               for j in range(len(comp))], axis=1)
                lab[ok] = comp[np.argmax(ld, axis=1)]
            yield pa.RecordBatch.from_arrays(list(b.columns) + [pa.array(lab, pa.int32(), mask=~ok)],
                                             names=list(b.schema.names) + [out_col])

    return vectors.mapInArrow(fn, out_schema)


# --- reports --------------------------------------------------------------------------------

def cluster_info(assigned: DataFrame, k: int, cluster_col: str = "cluster") -> DataFrame:
    """(cluster, document_count) for every component 0..k-1, empty ones included."""
    counts = assigned.groupBy(F.col(cluster_col).alias("cluster")).agg(F.count("*").alias("n"))
    spark = assigned.sparkSession
    return (spark.range(k).select(F.col("id").cast("int").alias("cluster"))
            .join(counts, "cluster", "left")
            .select("cluster", F.coalesce("n", F.lit(0)).cast("long").alias("document_count")))


def cluster_members(assigned: DataFrame, id_col: str = "doc_id", cluster_col: str = "cluster") -> DataFrame:
    """Members in long form (cluster, doc_id), globally ordered.

    A list per cluster would put a hot cluster into one row; the ordered
    long form is range-partitioned instead, so skew splits across tasks.
    """
    return assigned.select(F.col(cluster_col).alias("cluster"), F.col(id_col).alias("doc_id")).orderBy(
        "cluster", "doc_id")
