"""Registered similarity joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import similarity
from quarry.plans import sqlparts as sq
from quarry.plans.catalog import register
from quarry.plans.tables import load

WORDS_T, CHARS_T, EDIT_T = 0.8, 0.9, 0.9


def _out(df):
    return df.select("left_id", "right_id", F.round("similarity", 6).alias("similarity"), "left_copies",
                     "right_copies")


def _reps_sql(records: str) -> str:
    """``records(id, s)`` -> representatives (id = smallest id, s, copies) per distinct set."""
    return f"SELECT min(id) AS id, s, count(*) AS copies FROM ({records}) GROUP BY s"


def _set_pairs_sql(left: str, right: str, t: float, self_join: bool) -> str:
    cond = "a.id < b.id AND " if self_join else ""
    return f"""WITH a AS ({_reps_sql(left)}), b AS ({_reps_sql(right)}),
p AS (SELECT a.id AS left_id, b.id AS right_id,
             len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) AS similarity,
             a.copies AS left_copies, b.copies AS right_copies
      FROM a, b WHERE {cond}len(a.s) >= {t} * len(b.s) - 1e-9 AND len(b.s) >= {t} * len(a.s) - 1e-9
        AND len(list_distinct(list_concat(a.s, b.s))) > 0)
SELECT left_id, right_id, round(similarity, 6) AS similarity, left_copies::BIGINT AS left_copies,
       right_copies::BIGINT AS right_copies FROM p WHERE similarity >= {t} - 1e-12"""


@register("sim_join_words", lambda: _set_pairs_sql(
    f"SELECT doc_id AS id, list_sort(list_distinct({sq.split_words('lower(text)')})) AS s FROM documents",
    f"SELECT doc_id AS id, list_sort(list_distinct({sq.split_words('lower(text)')})) AS s FROM documents",
    WORDS_T, True))
def q_sim_words(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    return _out(similarity.similarity_join(docs, None, "jaccard", WORDS_T, left_id="doc_id"))


@register("sim_join_chars", lambda: _set_pairs_sql(
    "SELECT item_id AS id, list_sort(list_distinct(regexp_extract_all(lower(text), '(?s).'))) AS s FROM benchmark",
    "SELECT doc_id AS id, list_sort(list_distinct(regexp_extract_all(lower(text), '(?s).'))) AS s FROM documents",
    CHARS_T, False))
def q_sim_chars(spark, sf_dir):
    bench = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return _out(similarity.similarity_join(bench, docs, "cosine", CHARS_T))


@register("sim_join_edit", lambda: f"""WITH u AS (SELECT min(page_id) AS id, url, count(*) AS copies FROM pages GROUP BY url),
p AS (SELECT a.id AS left_id, b.id AS right_id,
             CASE WHEN greatest(length(a.url), length(b.url)) = 0 THEN 1.0
                  ELSE 1 - levenshtein(a.url, b.url) / greatest(length(a.url), length(b.url)) END AS similarity,
             a.copies AS left_copies, b.copies AS right_copies
      FROM u a, u b WHERE a.id < b.id)
SELECT left_id, right_id, round(similarity, 6) AS similarity, left_copies::BIGINT AS left_copies,
       right_copies::BIGINT AS right_copies FROM p WHERE similarity >= {EDIT_T} - 1e-12""")
def q_sim_edit(spark, sf_dir):
    pages = load(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("text"))
    return _out(similarity.similarity_join(pages, None, "levenshtein", EDIT_T))


@register("dup_groups", lambda: f"""WITH s AS (
  SELECT doc_id AS id, list_sort(list_distinct({sq.split_words('lower(text)')})) AS k FROM documents),
g AS (SELECT k, min(id) AS rep_id, count(*) AS n FROM s GROUP BY k HAVING count(*) > 1)
SELECT g.rep_id, s.id AS member_id FROM s JOIN g USING (k) WHERE s.id <> g.rep_id""")
def q_dup_groups(spark, sf_dir):
    """Copies (identical word sets) linked to their representative document."""
    docs = load(spark, sf_dir, "documents")
    return similarity.duplicate_groups(docs, "jaccard", id_col="doc_id")


TOP_PARTNERS = 5


@register("sim_topk_words", lambda: f"""WITH
a AS ({_reps_sql(f"SELECT item_id AS id, list_sort(list_distinct({sq.split_words('lower(text)')})) AS s FROM benchmark")}),
b AS ({_reps_sql(f"SELECT doc_id AS id, list_sort(list_distinct({sq.split_words('lower(text)')})) AS s FROM documents")}),
p AS (SELECT a.id AS left_id, b.id AS right_id, len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) AS similarity,
             a.copies AS left_copies, b.copies AS right_copies FROM a, b WHERE len(a.s) > 0 AND len(b.s) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY similarity DESC, right_id) AS rank FROM p WHERE similarity > 0)
SELECT left_id, rank::BIGINT AS rank, right_id, round(similarity, 6) AS similarity, left_copies::BIGINT AS left_copies,
       right_copies::BIGINT AS right_copies FROM r WHERE rank <= {TOP_PARTNERS}""")
def q_sim_topk_words(spark, sf_dir):
    """The documents most similar to each benchmark item, however little."""
    bench = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    top = similarity.similarity_top_k(bench, docs, "jaccard", k=TOP_PARTNERS)
    return top.select("left_id", F.col("rank").cast("long").alias("rank"), "right_id", F.round("similarity", 6).alias("similarity"),
                      "left_copies", "right_copies")
