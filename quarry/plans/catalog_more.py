"""Registered queries beyond the minimum slice: dense vectors and mixtures."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from quarry.operators import dense, mixture
from quarry.plans import sqlparts as sq
from quarry.plans.catalog import K, all_benchmark, register
from quarry.plans.tables import load

DENSE_THRESHOLD = 0.5
N_COMPONENTS = 10


# --- hashing embedder -------------------------------------------------------------------

def hash_vec_sql(source: str, id_expr: str, name: str) -> str:
    """CTE ``name(id, slot, v)``: sparse unit-length hash vectors."""
    return f"""
_{name}_tok AS (SELECT {id_expr} AS id, unnest({sq.tokens('text')}) AS t FROM {source}),
_{name}_cnt AS (SELECT id, (('0x' || substring(md5(t), 1, 8))::BIGINT % {dense.HASH_DIM}) AS slot, count(*) AS c
              FROM _{name}_tok GROUP BY ALL),
{name} AS (SELECT id, slot, c / sqrt(sum(c * c) OVER (PARTITION BY id)) AS v FROM _{name}_cnt)"""


def _hash_embed_sql() -> str:
    return f"""WITH {hash_vec_sql('documents', 'doc_id', 'dv')}
SELECT id AS doc_id, slot::BIGINT AS slot, round(v, 6) AS value FROM dv"""


@register("hash_embed", _hash_embed_sql)
def q_hash_embed(spark, sf_dir):
    docs = dense.hash_embed(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return (docs.select("doc_id", F.posexplode_outer("embedding").alias("slot", "value"))
            .where(F.col("value") != 0)
            .select("doc_id", F.col("slot").cast("long").alias("slot"), F.round("value", 6).alias("value")))


def _dense_hash_sql(min_score: float | None) -> str:
    where = "" if min_score is None else f"WHERE score >= {min_score}"
    return f"""WITH {hash_vec_sql('documents', 'doc_id', 'dv')},
{hash_vec_sql('benchmark', 'item_id', 'qv')},
_dots AS (SELECT q.id AS query_id, d.id AS doc_id, sum(q.v * d.v) AS score
          FROM qv q JOIN dv d USING (slot) GROUP BY ALL),
_scores AS (
  SELECT q.query_id, d.doc_id, coalesce(m.score, 0.0) AS score
  FROM (SELECT item_id AS query_id FROM benchmark) q CROSS JOIN (SELECT doc_id FROM documents) d
  LEFT JOIN _dots m ON m.query_id = q.query_id AND m.doc_id = d.doc_id),
_kept AS (SELECT * FROM _scores {where})
SELECT query_id, rank::BIGINT AS rank, doc_id, round(score, 6) AS score FROM {sq.ranked('_kept', K)}"""


def _dense_hash(spark, sf_dir, min_score=None):
    docs = dense.hash_embed(load(spark, sf_dir, "documents").select("doc_id", "text"))
    qs = dense.hash_embed(all_benchmark(spark, sf_dir))
    hits = dense.dense_search(docs, qs, k=K, min_score=min_score)
    return hits.select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id",
                       F.round("score", 6).alias("score"))


@register("dense_batch", lambda: _dense_hash_sql(None))
def q_dense_batch(spark, sf_dir):
    return _dense_hash(spark, sf_dir)


@register("dense_threshold", lambda: _dense_hash_sql(DENSE_THRESHOLD))
def q_dense_threshold(spark, sf_dir):
    return _dense_hash(spark, sf_dir, DENSE_THRESHOLD)


# --- embeddings table -------------------------------------------------------------------

def _first_vector(emb):
    row = emb.orderBy("vec_id").limit(1).collect()[0]  # one query vector (d numbers)
    return row


def _dense_topk_sql() -> str:
    return f"""WITH q AS (SELECT embedding AS qv FROM embeddings ORDER BY vec_id LIMIT 1),
s AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], qv::DOUBLE[]) AS score FROM embeddings, q)
SELECT row_number() OVER (ORDER BY round(score, 9) DESC, vec_id)::BIGINT AS rank, vec_id, round(score, 6) AS score
FROM s ORDER BY round(score, 9) DESC, vec_id LIMIT {K}"""


@register("dense_topk", _dense_topk_sql)
def q_dense_topk(spark, sf_dir):
    emb = load(spark, sf_dir, "embeddings")
    q = _first_vector(emb)
    top = dense.dense_search_one(emb, q["embedding"], k=K, id_col="vec_id")
    return top.select(F.col("rank").cast("long").alias("rank"), F.col("doc_id").alias("vec_id"),
                      F.round("score", 6).alias("score"))


def _audit_sql() -> str:
    return """SELECT count(*)::BIGINT AS n_rows, count(DISTINCT vec_id)::BIGINT AS n_ids,
  min(len(embedding))::BIGINT AS min_dim, max(len(embedding))::BIGINT AS max_dim,
  sum(CASE WHEN list_bool_or(list_transform(embedding, lambda x: isnan(x))) THEN 1 ELSE 0 END)::BIGINT AS n_nan,
  sum(CASE WHEN list_bool_and(list_transform(embedding, lambda x: x = 0)) THEN 1 ELSE 0 END)::BIGINT AS n_zero,
  sum(CASE WHEN embedding IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_null
FROM embeddings"""


@register("vector_audit", _audit_sql)
def q_vector_audit(spark, sf_dir):
    return dense.vector_audit(load(spark, sf_dir, "embeddings"))


# --- mixtures -----------------------------------------------------------------------------

def diag_fit_sql(grid: str, p: str) -> str:
    """``grid(id, label, dim, x)`` -> CTEs ``{p}_lab``, ``{p}_params(component, dim, m, v)``, ``{p}_w``."""
    return f"""
{p}_lab AS (SELECT label, (dense_rank() OVER (ORDER BY label) - 1) AS component
            FROM (SELECT DISTINCT label FROM {grid})),
{p}_params AS (SELECT l.component, g.dim, avg(g.x) AS m, var_samp(g.x) + {mixture.REG_COVAR} AS v
               FROM {grid} g JOIN {p}_lab l USING (label) GROUP BY ALL),
{p}_w AS (SELECT l.component, count(DISTINCT g.id)::DOUBLE / (SELECT count(DISTINCT id) FROM {grid}) AS w
          FROM {grid} g JOIN {p}_lab l USING (label) GROUP BY ALL)"""


def diag_predict_sql(grid: str, p: str, out: str) -> str:
    """``grid(id, dim, x)`` -> CTE ``{out}(id, cluster)``: most probable component."""
    return f"""
{out}_ld AS (SELECT g.id, pr.component,
                    ln(any_value(w.w)) - 0.5 * sum(ln(2 * pi() * pr.v) + (g.x - pr.m) * (g.x - pr.m) / pr.v) AS ld
             FROM {grid} g JOIN {p}_params pr USING (dim) JOIN {p}_w w USING (component)
             GROUP BY g.id, pr.component),
{out} AS (SELECT id, component AS cluster FROM
          (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ld DESC, component) AS rn FROM {out}_ld)
          WHERE rn = 1)"""


def diag_assign_sql() -> str:
    """CTE ``assigned(vec_id, label, cluster, embedding)`` for the embeddings table."""
    return f"""
_grid AS (SELECT vec_id AS id, label, generate_subscripts(embedding, 1) AS dim, unnest(embedding)::DOUBLE AS x
          FROM embeddings WHERE embedding IS NOT NULL),
{diag_fit_sql('_grid', '_emb')},
{diag_predict_sql('_grid', '_emb', '_best')},
assigned AS (SELECT e.vec_id, e.label, b.cluster, e.embedding FROM embeddings e JOIN _best b ON b.id = e.vec_id)"""


def _assigned(spark, sf_dir):
    emb = load(spark, sf_dir, "embeddings")
    params = mixture.diagonal_from_labels(emb)
    return mixture.assign_diagonal(emb, params)


@register("gmm_assign", lambda: f"""WITH {diag_assign_sql()}
SELECT vec_id, label::BIGINT AS label, cluster::BIGINT AS cluster FROM assigned""")
def q_gmm_assign(spark, sf_dir):
    a = _assigned(spark, sf_dir)
    return a.select("vec_id", F.col("label").cast("long").alias("label"), F.col("cluster").cast("long").alias("cluster"))


@register("cluster_info", lambda: f"""WITH {diag_assign_sql()},
_n AS (SELECT cluster, count(*) AS n FROM assigned GROUP BY cluster)
SELECT r.range::INT AS cluster, coalesce(n, 0)::BIGINT AS document_count
FROM range({N_COMPONENTS}) r LEFT JOIN _n ON _n.cluster = r.range""")
def q_cluster_info(spark, sf_dir):
    return mixture.cluster_info(_assigned(spark, sf_dir), N_COMPONENTS)


@register("cluster_members", lambda: f"""WITH {diag_assign_sql()}
SELECT cluster::INT AS cluster, vec_id AS doc_id FROM assigned""")
def q_cluster_members(spark, sf_dir):
    return mixture.cluster_members(_assigned(spark, sf_dir), id_col="vec_id")


@register("cluster_search", lambda: f"""WITH {diag_assign_sql()},
q AS (SELECT embedding AS qv, cluster AS qc FROM assigned ORDER BY vec_id LIMIT 1),
s AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], qv::DOUBLE[]) AS score
      FROM assigned, q WHERE cluster = qc)
SELECT row_number() OVER (ORDER BY round(score, 9) DESC, vec_id)::BIGINT AS rank, vec_id, round(score, 6) AS score
FROM s ORDER BY round(score, 9) DESC, vec_id LIMIT {K}""")
def q_cluster_search(spark, sf_dir):
    a = _assigned(spark, sf_dir)
    q = a.orderBy("vec_id").limit(1).collect()[0]  # the query row (one vector)
    top = dense.dense_search_one(a.where(F.col("cluster") == q["cluster"]), q["embedding"], k=K, id_col="vec_id")
    return top.select(F.col("rank").cast("long").alias("rank"), F.col("doc_id").alias("vec_id"),
                      F.round("score", 6).alias("score"))


@register("gmm_fit")
def q_gmm_fit(spark, sf_dir):
    emb = load(spark, sf_dir, "embeddings")
    model = mixture.fit_gmm(emb, k=N_COMPONENTS)
    params = model.to_df(spark)
    return params.select(
        F.col("component").cast("long").alias("component"), F.round("weight", 6).alias("weight"),
        F.lit(model.n_iter).cast("long").alias("n_iter"),
        F.lit(round(model.log_likelihood, 6)).alias("log_likelihood"))


# --- full-covariance mixture from fixed parameters, on all components of the vectors -------

# The mixture that the queries below start from.  A component's covariance is
# ``own`` on the diagonal plus ``common`` everywhere, so that SQL knows its inverse.
FIXED_WEIGHTS = [0.3, 0.3, 0.4]
FIXED_OWN = [0.0156, 0.012, 0.02]
FIXED_COMMON = [0.0005, 0.0002, 0.001]
FIXED_SHIFT = 0.03
# Components of the vectors of `embeddings`.
FIXED_DIM = 64
FIXED_CLUSTER = 1


def _fixed_mean(j: int, d: int) -> list[float]:
    """0: nothing; 1: up and down in turn; 2: up in the first half, down in the second."""
    sign = [lambda i: 0, lambda i: 1 if i % 2 == 0 else -1, lambda i: 1 if i < d // 2 else -1][j]
    return [FIXED_SHIFT * sign(i) for i in range(d)]


def _fixed_model(d: int = 2) -> mixture.MixtureModel:
    covariances = [own * np.eye(d) + common for own, common in zip(FIXED_OWN, FIXED_COMMON, strict=True)]
    return mixture.MixtureModel(np.array(FIXED_WEIGHTS), np.array([_fixed_mean(j, d) for j in range(3)]), np.array(covariances))


def _fixed_ctes(split: bool = False, d: int = FIXED_DIM) -> str:
    """The fixed mixture; ``split``: its last component halved along its principal axis, which is
    the diagonal of the space, as far as a half of a normal distribution has its mean."""
    rows = [(j, w, own, common, j, "0") for j, (w, own, common) in enumerate(zip(FIXED_WEIGHTS, FIXED_OWN, FIXED_COMMON, strict=True))]
    if split:
        j, w, own, common, base, _ = rows.pop()
        far = f"sqrt(2 / pi() * ({own} + {d} * {common}) / {d})"
        rows += [(j + n, w / 2, own, f"{common} - {far} * {far}", base, f"{sign}{far}") for n, sign in enumerate("-+")]
    values = ", ".join(f"({', '.join(map(str, r))})" for r in rows)
    return f"""p AS (SELECT j, w::DOUBLE AS w, own::DOUBLE AS own, (common)::DOUBLE AS common, base, (far)::DOUBLE AS far
      FROM (VALUES {values}) t(j, w, own, common, base, far)),
mu AS (SELECT j, i, far + {FIXED_SHIFT}::DOUBLE * CASE base WHEN 0 THEN 0 WHEN 1 THEN CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END
                ELSE CASE WHEN i <= {d // 2} THEN 1 ELSE -1 END END AS m FROM p, (SELECT unnest(range(1, {d + 1})) AS i)),
x AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
form AS (SELECT vec_id, j, sum((v - m) ** 2) AS s2, sum(v - m) AS s1 FROM x JOIN mu USING (i) GROUP BY ALL),
ld AS (
  SELECT vec_id, j, ln(w) - 0.5 * ({d} * ln(2 * pi()) + {d - 1} * ln(own) + ln(own + {d} * common)
         + (s2 - common / (own + {d} * common) * s1 * s1) / own) AS l FROM form JOIN p USING (j))"""


def _step_sql(split: bool = False) -> str:
    return f"""WITH {_fixed_ctes(split)},
top AS (SELECT *, max(l) OVER (PARTITION BY vec_id) AS most FROM ld),
r AS (SELECT vec_id, j, exp(l - most) / sum(exp(l - most)) OVER (PARTITION BY vec_id) AS r,
             most + ln(sum(exp(l - most)) OVER (PARTITION BY vec_id)) AS ll FROM top),
n AS (SELECT count(DISTINCT vec_id)::DOUBLE AS n, avg(ll) AS ll FROM r),
k AS (SELECT j, sum(r) AS nk FROM r GROUP BY j),
m AS (SELECT j, i, sum(r * v) / any_value(nk) AS m FROM r JOIN x USING (vec_id) JOIN k USING (j) GROUP BY j, i),
y AS (SELECT j, i, vec_id, v - m AS y FROM x JOIN m USING (i)),
c AS (SELECT a.j, a.i, b.i AS h, sum(r.r * a.y * b.y) AS s FROM y a JOIN y b ON a.j = b.j AND a.vec_id = b.vec_id AND a.i <= b.i
      JOIN r ON r.j = a.j AND r.vec_id = a.vec_id GROUP BY ALL)
SELECT c.j::BIGINT AS component, c.i::BIGINT AS row, c.h::BIGINT AS col, round(nk / n.n, 6) AS weight, round(m.m, 6) AS mean,
       round(s / nk + CASE WHEN c.i = c.h THEN {mixture.REG_COVAR} ELSE 0 END, 6) AS covariance, round(n.ll, 6) AS log_likelihood
FROM c JOIN k USING (j) JOIN m ON m.j = c.j AND m.i = c.i, n"""


def _step(spark, sf_dir, model: mixture.MixtureModel):
    """One EM step over all vectors; the upper half of the covariances."""
    after = mixture.em_step(load(spark, sf_dir, "embeddings"), model)
    p = after.to_df(spark).select("component", "weight", "mean", F.posexplode("covariance").alias("i", "line"))
    p = p.select("component", "weight", "mean", "i", F.posexplode("line").alias("h", "covariance")).where("i <= h")
    return p.select(F.col("component").cast("long").alias("component"), (F.col("i") + 1).cast("long").alias("row"),
                    (F.col("h") + 1).cast("long").alias("col"), F.round("weight", 6).alias("weight"),
                    F.round(F.get("mean", F.col("i")), 6).alias("mean"), F.round("covariance", 6).alias("covariance"),
                    F.lit(round(float(after.log_likelihood), 6)).alias("log_likelihood"))


@register("gmm_step", _step_sql)
def q_gmm_step(spark, sf_dir):
    """One full-covariance EM step over all vectors and components from fixed parameters."""
    return _step(spark, sf_dir, _fixed_model(FIXED_DIM))


@register("gmm_split", lambda: _step_sql(split=True))
def q_gmm_split(spark, sf_dir):
    """A component split in two, as a mixture gets another one, and one EM step of all."""
    return _step(spark, sf_dir, mixture.split_once(_fixed_model(FIXED_DIM), at=2))


@register("gmm_search", lambda: f"""WITH {_fixed_ctes()},
best AS (SELECT vec_id FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY l DESC, j) AS rn FROM ld) WHERE rn = 1 AND j = {FIXED_CLUSTER}),
q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id, list_cosine_similarity(embedding::DOUBLE[], qv::DOUBLE[]) AS score
      FROM best JOIN embeddings USING (vec_id), q)
SELECT query_id, rank::BIGINT AS rank, vec_id, round(score, 6) AS score
FROM {sq.ranked('s', K, ids='vec_id')}""")
def q_gmm_search(spark, sf_dir):
    """Search in one explicitly given cluster of a full-covariance assignment."""
    x = mixture.assign(load(spark, sf_dir, "embeddings"), _fixed_model(FIXED_DIM)).where(F.col("cluster") == FIXED_CLUSTER)
    return _hits(dense.dense_search(x, _every_twentieth(spark, sf_dir), k=K, id_col="vec_id"))


# --- approximate search ---------------------------------------------------------------------

ANN_PROBE = 8


def _every_twentieth(spark, sf_dir):
    """The searches' query set: the vectors whose id is divisible by 20."""
    emb = load(spark, sf_dir, "embeddings")
    return emb.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), "embedding")


def _hits(df):
    return df.select("query_id", F.col("rank").cast("long").alias("rank"), F.col("doc_id").alias("vec_id"),
                     F.round("score", 6).alias("score"))


def label_centres(emb) -> np.ndarray:
    """The mean vector of each label, in label order (one row per label)."""
    v = array_to_vector(F.col("embedding").cast("array<double>"))
    rows = emb.groupBy("label").agg(vector_to_array(Summarizer.mean(v)).alias("m")).orderBy("label").collect()
    return np.array([r["m"] for r in rows])


@register("dense_ann", lambda: f"""WITH g AS (
  SELECT vec_id, label, generate_subscripts(embedding, 1) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings),
centre AS (SELECT label, list(m ORDER BY d) AS c FROM (SELECT label, d, avg(x) AS m FROM g GROUP BY ALL) GROUP BY label),
near AS (
  SELECT vec_id, embedding, label, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) AS nth FROM (
    SELECT e.vec_id, e.embedding, c.label, list_cosine_similarity(e.embedding::DOUBLE[], c.c) AS s FROM embeddings e, centre c)),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_cosine_similarity(d.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score
  FROM near q JOIN near d ON q.label = d.label WHERE q.vec_id % 20 = 0 AND q.nth <= {ANN_PROBE} AND d.nth = 1)
SELECT query_id, rank::BIGINT AS rank, vec_id, round(score, 6) AS score FROM {sq.ranked('s', K, ids='vec_id')}""")
def q_dense_ann(spark, sf_dir):
    """Approximate top-k neighbours by inverted lists: one list per label centre,
    the ``ANN_PROBE`` nearest are probed.  The vectors are close to uniform in
    direction, so a recall of 0.9 needs most lists (measured in tests)."""
    emb = load(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return _hits(dense.ann_search(emb, _every_twentieth(spark, sf_dir), label_centres(emb), k=K, nprobe=ANN_PROBE, id_col="vec_id"))
