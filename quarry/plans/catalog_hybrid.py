"""Registered hybrid queries: every benchmark item is a query over the documents.

Methods (fixed order): SPIDER = cosine over hashed vectors, BM25 = TF-IDF
cosine with zero-score fill, GMM = cosine inside the query's cluster, where
clusters come from a diagonal mixture estimated per document language.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import dense, hybrid, lexical, mixture
from quarry.plans import sqlparts as sq
from quarry.plans.catalog import K, all_benchmark, register
from quarry.plans.catalog_more import diag_fit_sql, diag_predict_sql, hash_vec_sql
from quarry.plans.tables import load
from quarry.session import materialize
from quarry.sinks import export

HISTORY_TURNS = 2


# --- Spark side -----------------------------------------------------------------------------

def method_hits(spark, sf_dir, methods=("spider", "bm25", "gmm"), doc_filter: DataFrame | None = None,
                string_ids: bool = False) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """Per-method top-k for every benchmark query (FLT-5 picks the methods).

    ``doc_filter`` (a DataFrame of doc_ids) restricts the corpus before
    scoring (left-semi join); ``string_ids`` names documents and queries by
    strings.  Returns (hits by method, queries, documents).
    """
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    if doc_filter is not None:
        docs = docs.join(doc_filter.select("doc_id").distinct(), "doc_id", "left_semi")
    queries = all_benchmark(spark, sf_dir)
    if string_ids:
        docs = docs.withColumn("doc_id", F.concat(F.lit("doc"), F.col("doc_id").cast("string")))
        queries = queries.withColumn("query_id", F.concat(F.lit("q"), F.col("query_id").cast("string")))
    out: dict[str, DataFrame] = {}
    need_vec = "spider" in methods or "gmm" in methods
    if need_vec:
        # document vectors feed the dense search, the mixture estimate and the
        # cluster assignment: computed once
        dvec = materialize(dense.hash_embed(docs.select("doc_id", "text", "lang")).select(
            "doc_id", "lang", "embedding"), "document-vectors")
        qvec = materialize(dense.hash_embed(queries), "query-vectors")
    if "spider" in methods:
        out["spider"] = dense.dense_search(dvec, qvec, k=K)
    if "bm25" in methods:
        idx = lexical.build_tfidf_index(docs)
        out["bm25"] = lexical.tfidf_search(idx, queries, k=K)
    if "gmm" in methods:
        params = mixture.diagonal_from_labels(dvec, label_col="lang").collect()  # k rows, used twice
        dcl = mixture.assign_diagonal(dvec, params)
        qcl = mixture.assign_diagonal(qvec, params)
        out["gmm"] = dense.dense_search(dcl, qcl, k=K, group_col="cluster", query_group_col="cluster")
    return out, queries, docs


def fused(spark, sf_dir, **kw) -> tuple[DataFrame, DataFrame, DataFrame]:
    hits, queries, docs = method_hits(spark, sf_dir, **kw)
    return hybrid.fuse(hits, K), queries, docs


def _out(df: DataFrame, *more) -> DataFrame:
    return df.select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id",
                     F.round("score", 6).alias("score"), "method", *more)


# --- SQL side -------------------------------------------------------------------------------

def _hybrid_ctes(doc_source: str = "documents", query_id: str = "item_id") -> str:
    """CTEs: ``m_spider``, ``m_bm25``, ``m_gmm`` (query_id, doc_id, score, method_rank)."""
    d = dense.HASH_DIM
    return f"""
corpus AS (SELECT doc_id, text, lang FROM {doc_source}),
queries AS (SELECT {query_id} AS query_id, text FROM benchmark),
{hash_vec_sql('corpus', 'doc_id', 'dv')},
{hash_vec_sql('queries', 'query_id', 'qv')},
_vdots AS (SELECT q.id AS query_id, d.id AS doc_id, sum(q.v * d.v) AS score FROM qv q JOIN dv d USING (slot) GROUP BY ALL),
_vscores AS (
  SELECT q.query_id, d.doc_id, coalesce(m.score, 0.0) AS score
  FROM (SELECT query_id FROM queries) q CROSS JOIN (SELECT doc_id FROM corpus) d
  LEFT JOIN _vdots m ON m.query_id = q.query_id AND m.doc_id = d.doc_id),
m_spider AS (SELECT query_id, doc_id, score, rank AS method_rank FROM {sq.ranked('_vscores', K)}),
{sq.tfidf_ctes('corpus', 'queries')},
m_bm25 AS (SELECT query_id, doc_id, score, rank AS method_rank FROM {sq.ranked('_scores', K)}),
_dgrid AS (SELECT c.doc_id AS id, c.lang AS label, r.range AS dim, coalesce(v.v, 0.0) AS x
           FROM corpus c CROSS JOIN range({d}) r LEFT JOIN dv v ON v.id = c.doc_id AND v.slot = r.range),
_qgrid AS (SELECT q.query_id AS id, r.range AS dim, coalesce(v.v, 0.0) AS x
           FROM queries q CROSS JOIN range({d}) r LEFT JOIN qv v ON v.id = q.query_id AND v.slot = r.range),
{diag_fit_sql('_dgrid', '_hm')},
{diag_predict_sql('_dgrid', '_hm', '_dcl')},
{diag_predict_sql('_qgrid', '_hm', '_qcl')},
_gscores AS (SELECT s.query_id, s.doc_id, s.score FROM _vscores s
             JOIN _qcl qc ON qc.id = s.query_id JOIN _dcl dc ON dc.id = s.doc_id WHERE qc.cluster = dc.cluster),
m_gmm AS (SELECT query_id, doc_id, score, rank AS method_rank FROM {sq.ranked('_gscores', K)}),
h_union AS (
  SELECT query_id, doc_id, score, method_rank, 'SPIDER' AS method, 0 AS method_order FROM m_spider
  UNION ALL SELECT query_id, doc_id, score, method_rank, 'BM25', 1 FROM m_bm25
  UNION ALL SELECT query_id, doc_id, score, method_rank, 'GMM', 2 FROM m_gmm),
h_dedup AS (SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY method_order, method_rank) AS rn
  FROM h_union) WHERE rn = 1),
h_top AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, method_order, method_rank) AS rank
  FROM h_dedup) WHERE rank <= {K})"""


def _conf_sql() -> str:
    return f"""
h_conf AS (
  SELECT q.query_id, coalesce(a.n_results, 0)::BIGINT AS n_results, coalesce(a.n_methods, 0)::BIGINT AS n_methods,
         coalesce(least(a.avg_s + least(a.n_methods * {hybrid.METHOD_BONUS}, {hybrid.METHOD_BONUS_CAP})
                        + least(a.n_results * {hybrid.COUNT_BONUS}, {hybrid.COUNT_BONUS_CAP}), 1.0), 0.0) AS confidence
  FROM (SELECT DISTINCT query_id FROM queries) q LEFT JOIN (
    SELECT query_id, avg(score) AS avg_s, count(DISTINCT method) AS n_methods, count(*) AS n_results
    FROM h_top GROUP BY query_id) a USING (query_id))"""


def _context_sql() -> str:
    return f"""
h_ctx AS (
  SELECT query_id, count(*)::BIGINT AS n_context,
         string_agg('Document ' || rank || ' (Score: ' || printf('%.3f', score) || '):' || chr(10)
                    || substring(coalesce(c.text, ''), 1, {hybrid.CONTEXT_CHARS}) || '...',
                    chr(10) || chr(10) ORDER BY rank) AS context_text
  FROM h_top t LEFT JOIN corpus c USING (doc_id) WHERE rank <= {hybrid.CONTEXT_HITS} GROUP BY query_id)"""


# --- registered -----------------------------------------------------------------------------

@register("hybrid_union", lambda: f"""WITH {_hybrid_ctes()}
SELECT query_id, doc_id, round(score, 6) AS score, method_rank::BIGINT AS method_rank, method FROM h_union""")
def q_hybrid_union(spark, sf_dir):
    hits, _, _ = method_hits(spark, sf_dir)
    u = hybrid.union_hits(hits)
    return u.select("query_id", "doc_id", F.round("score", 6).alias("score"),
                    F.col("method_rank").cast("long").alias("method_rank"), "method")


@register("hybrid_dedup", lambda: f"""WITH {_hybrid_ctes()}
SELECT query_id, doc_id, round(score, 6) AS score, method_rank::BIGINT AS method_rank, method FROM h_dedup""")
def q_hybrid_dedup(spark, sf_dir):
    hits, _, _ = method_hits(spark, sf_dir)
    d = hybrid.dedup_first(hybrid.union_hits(hits))
    return d.select("query_id", "doc_id", F.round("score", 6).alias("score"),
                    F.col("method_rank").cast("long").alias("method_rank"), "method")


@register("hybrid_topk", lambda: f"""WITH {_hybrid_ctes()}
SELECT query_id, rank::BIGINT AS rank, doc_id, round(score, 6) AS score, method FROM h_top""")
def q_hybrid_topk(spark, sf_dir):
    top, _, _ = fused(spark, sf_dir)
    return _out(top)


@register("hybrid_lexical_dense", lambda: f"""WITH {_hybrid_ctes()},
l_top AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, method_order, method_rank) AS rank
  FROM (SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY method_order, method_rank) AS rn
    FROM h_union WHERE method IN ('SPIDER', 'BM25')) WHERE rn = 1)) WHERE rank <= {K})
SELECT query_id, rank::BIGINT AS rank, doc_id, round(score, 6) AS score, method FROM l_top""")
def q_hybrid_lexical_dense(spark, sf_dir):
    top, _, _ = fused(spark, sf_dir, methods=("bm25", "spider"))
    return _out(top)


@register("confidence", lambda: f"""WITH {_hybrid_ctes()}, {_conf_sql()}
SELECT query_id, n_results, n_methods, round(confidence, 6) AS confidence FROM h_conf""")
def q_confidence(spark, sf_dir):
    top, queries, _ = fused(spark, sf_dir)
    c = hybrid.confidence(top, queries)
    return c.select("query_id", "n_results", "n_methods", F.round("confidence", 6).alias("confidence"))


@register("rag_context", lambda: f"""WITH {_hybrid_ctes()}, {_context_sql()}
SELECT query_id, n_context, md5(context_text) AS context_md5, length(context_text)::BIGINT AS context_len
FROM h_ctx""")
def q_rag_context(spark, sf_dir):
    top, _, docs = fused(spark, sf_dir)
    ctx = hybrid.context(top, docs)
    return ctx.select("query_id", F.col("n_context").cast("long").alias("n_context"),
                      F.md5("context_text").alias("context_md5"),
                      F.length("context_text").cast("long").alias("context_len"))


def _prompt_sql() -> str:
    head, rest = hybrid.PROMPT_TEMPLATE.split("{context}")
    mid, tail = rest.split("{question}")
    return f"""WITH {_hybrid_ctes()}, {_context_sql()}
SELECT q.query_id, md5({sq.lit(head)} || coalesce(c.context_text, '') || {sq.lit(mid)} || q.text || {sq.lit(tail)})
       AS prompt_md5
FROM queries q LEFT JOIN h_ctx c USING (query_id)"""


@register("rag_prompt", _prompt_sql)
def q_rag_prompt(spark, sf_dir):
    top, queries, docs = fused(spark, sf_dir)
    p = hybrid.prompt(hybrid.context(top, docs), queries)
    return p.select("query_id", F.md5("prompt").alias("prompt_md5"))


def _doc_set_sql() -> str:
    src = "(SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1))"
    return f"""WITH {_hybrid_ctes(src)}
SELECT query_id, rank::BIGINT AS rank, doc_id, round(score, 6) AS score, method FROM h_top"""


@register("doc_set_search", _doc_set_sql)
def q_doc_set_search(spark, sf_dir):
    keep = load(spark, sf_dir, "labels").where(F.col("quality") == 1)
    top, _, _ = fused(spark, sf_dir, doc_filter=keep)
    return _out(top)


@register("hybrid_string_ids", lambda: f"""WITH {_hybrid_ctes("(SELECT 'doc' || doc_id AS doc_id, text, lang FROM documents)", "'q' || item_id")}
SELECT query_id, rank::BIGINT AS rank, doc_id, round(score, 6) AS score, method FROM h_top""")
def q_hybrid_string_ids(spark, sf_dir):
    top, _, _ = fused(spark, sf_dir, string_ids=True)
    return _out(top)


@register("hit_rows", lambda: f"""WITH {_hybrid_ctes()}
SELECT t.query_id, t.rank::BIGINT AS rank, t.doc_id, round(t.score, 6) AS score, t.method, md5(d.text) AS content_md5, d.lang, d.source
FROM h_top t LEFT JOIN documents d USING (doc_id)""")
def q_hit_rows(spark, sf_dir):
    """Ranked hits with their content and metadata, attributable to their query."""
    top, _, docs = fused(spark, sf_dir)
    rows = export.hit_records(top, docs, ["lang", "source"])
    return _out(rows.select("query_id", "rank", "doc_id", "score", "method", "content", "lang", "source"),
                F.md5("content").alias("content_md5"), "lang", "source")


def _scoped_sql() -> str:
    return f"""WITH queries AS (SELECT item_id AS query_id, text FROM benchmark),
corpus AS (SELECT doc_id, text, source FROM documents), {sq.tfidf_ctes('corpus', 'queries')},
_sc AS (SELECT m.query_id, m.doc_id, m.score, c.source FROM _matched m JOIN corpus c USING (doc_id))
SELECT query_id, source, rank::BIGINT AS rank, doc_id, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY round(score, 9) DESC, doc_id) AS rank FROM _sc)
WHERE rank <= {K}"""


@register("chapter_search", _scoped_sql)
def q_chapter_search(spark, sf_dir):
    """Scope-restricted lexical search for every scope value at once: documents
    are packed by source and each source's best k are kept where it is scored."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "source")
    idx = lexical.build_tfidf_index(docs, keep=("source",))
    hits = lexical.scoped_search(idx, all_benchmark(spark, sf_dir), "source", k=K)
    return hits.select("query_id", F.col("scope").alias("source"), F.col("rank").cast("long").alias("rank"),
                       "doc_id", F.round("score", 6).alias("score"))


@register("conv_context", lambda: f"""SELECT conv_id, turn, n_turns::BIGINT AS n_turns, md5(query_text) AS query_md5 FROM (
  SELECT conv_id, turn,
         count(*) OVER w AS n_turns,
         array_to_string(list(text) OVER w, chr(10)) AS query_text
  FROM conversations WHERE role = 'user'
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN {HISTORY_TURNS} PRECEDING AND CURRENT ROW))""")
def q_conv_context(spark, sf_dir):
    c = hybrid.conversation_queries(load(spark, sf_dir, "conversations"), history=HISTORY_TURNS)
    return c.select("conv_id", "turn", F.col("n_turns").cast("long").alias("n_turns"),
                    F.md5("query_text").alias("query_md5"))


# --- lexical extras --------------------------------------------------------------------------

@register("tfidf_weights", lambda: f"""WITH corpus AS (SELECT doc_id, text FROM documents),
queries AS (SELECT item_id AS query_id, text FROM benchmark), {sq.tfidf_ctes('corpus', 'queries')}
SELECT doc_id, term, round(weight, 6) AS weight FROM _post""")
def q_tfidf_weights(spark, sf_dir):
    idx = lexical.build_tfidf_index(load(spark, sf_dir, "documents"))
    return idx.postings().select("doc_id", "term", F.round("weight", 6).alias("weight"))


def bm25_sql(corpus: str = "SELECT doc_id, text FROM documents") -> str:
    return f"""WITH corpus AS ({corpus}),
queries AS (SELECT item_id AS query_id, text FROM benchmark),
_dt AS (SELECT doc_id, {sq.kept_tokens('text')} AS w FROM corpus),
_dl AS (SELECT doc_id, len(w) AS dl FROM _dt),
_tf AS (SELECT doc_id, t AS term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM _dt) GROUP BY ALL),
_n AS (SELECT count(*)::DOUBLE AS n, (SELECT sum(dl) FROM _dl)::DOUBLE / count(*) AS avgdl FROM corpus),
_df AS (SELECT term, count(*) AS df FROM _tf GROUP BY term),
_qt AS (SELECT DISTINCT query_id, unnest({sq.kept_tokens('text')}) AS term FROM queries),
_s AS (SELECT q.query_id, t.doc_id,
              sum(ln(1 + (_n.n - f.df + 0.5) / (f.df + 0.5)) * t.tf * ({lexical.BM25_K1} + 1)
                  / (t.tf + {lexical.BM25_K1} * (1 - {lexical.BM25_B} + {lexical.BM25_B} * l.dl / _n.avgdl))) AS score
       FROM _qt q JOIN _tf t USING (term) JOIN _df f USING (term) JOIN _dl l USING (doc_id), _n
       GROUP BY q.query_id, t.doc_id)
SELECT query_id, rank::BIGINT AS rank, doc_id, round(score, 6) AS score FROM {sq.ranked('_s', K)}"""


@register("bm25_topk", bm25_sql)
def q_bm25_topk(spark, sf_dir):
    idx = lexical.build_bm25_index(load(spark, sf_dir, "documents"))
    hits = lexical.bm25_search(idx, all_benchmark(spark, sf_dir), k=K)
    return hits.select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id",
                       F.round("score", 6).alias("score"))
