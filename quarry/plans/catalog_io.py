"""Registered source/sink queries: table rendering, page and block assembly, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.plans import sqlparts as sq
from quarry.plans.catalog import register
from quarry.plans.catalog_hybrid import _hybrid_ctes, fused
from quarry.plans.tables import load
from quarry.sinks import export
from quarry.sources import render

ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def _cells_sql(cols: list[str]) -> str:
    return "concat_ws(' | ', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), 'nan')" for c in cols) + ")"


@register("render_table", lambda: f"""WITH f AS (
  SELECT row_number() OVER (ORDER BY o_orderkey) AS i, {_cells_sql(ORDER_COLS)} AS cells
  FROM orders ORDER BY o_orderkey LIMIT {render.TABLE_ROWS}),
n AS (SELECT count(*) AS n FROM orders),
t AS (SELECT {sq.lit('Columns: ' + ', '.join(ORDER_COLS))} || chr(10) || chr(10)
             || string_agg('Row ' || i || ': ' || cells || chr(10), '' ORDER BY i)
             || CASE WHEN (SELECT n FROM n) > {render.TABLE_ROWS}
                     THEN chr(10) || '... and ' || ((SELECT n FROM n) - {render.TABLE_ROWS}) || ' more rows' || chr(10)
                     ELSE '' END AS text, count(*) AS n_rendered FROM f)
SELECT md5(text) AS text_md5, length(text)::BIGINT AS text_len, (SELECT n FROM n)::BIGINT AS n_rows,
       n_rendered::BIGINT AS n_rendered FROM t""")
def q_render_table(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select(*ORDER_COLS)
    r = render.render_table(o, ["o_orderkey"])
    return r.select(F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("text_len"),
                    "n_rows", "n_rendered")


_SHEET_COLS = [c for c in ORDER_COLS if c != "o_orderstatus"]


@register("render_groups", lambda: f"""WITH f AS (
  SELECT o_orderstatus AS g, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS i,
         {_cells_sql(_SHEET_COLS)} AS cells FROM orders),
n AS (SELECT o_orderstatus AS g, count(*) AS n FROM orders GROUP BY 1),
t AS (SELECT g, chr(10) || '--- Sheet: ' || g || ' ---' || chr(10)
             || {sq.lit('Columns: ' + ', '.join(_SHEET_COLS))} || chr(10) || chr(10)
             || string_agg('Row ' || i || ': ' || cells || chr(10), '' ORDER BY i) AS body, count(*) AS n_rendered
      FROM f WHERE i <= {render.SHEET_ROWS} GROUP BY g)
SELECT t.g AS "group", md5(body || CASE WHEN n.n > {render.SHEET_ROWS}
         THEN chr(10) || '... and ' || (n.n - {render.SHEET_ROWS}) || ' more rows' || chr(10) ELSE '' END) AS text_md5,
       n.n::BIGINT AS n_rows, n_rendered::BIGINT AS n_rendered
FROM t JOIN n USING (g)""")
def q_render_groups(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select(*ORDER_COLS)
    r = render.render_groups(o, "o_orderstatus", ["o_orderkey"])
    return r.select("group", F.md5("text").alias("text_md5"), "n_rows", "n_rendered")


@register("assemble_pages", lambda: f"""WITH p AS (
  SELECT conv_id AS doc_id, turn + 1 AS page_no, text FROM conversations
  WHERE text IS NOT NULL AND regexp_matches(text, '[^{sq.WS[1:-1]}]')),
d AS (SELECT doc_id, count(*) AS n_pages,
             string_agg(chr(10) || '--- Page ' || page_no || ' ---' || chr(10) || text || chr(10), '' ORDER BY page_no)
             AS text FROM p GROUP BY doc_id)
SELECT doc_id, n_pages::BIGINT AS n_pages, md5(text) AS text_md5, length(text)::BIGINT AS text_len FROM d""")
def q_assemble_pages(spark, sf_dir):
    c = load(spark, sf_dir, "conversations")
    pages = c.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page_no"), "text")
    docs, _ = render.assemble_pages(pages)
    return docs.select("doc_id", "n_pages", F.md5("text").alias("text_md5"),
                       F.length("text").cast("long").alias("text_len"))


def _blocks_sql() -> str:
    nb = f"'[^{sq.WS[1:-1]}]'"
    strip = "regexp_replace({x}, '<[^>]*>', '', 'g')"
    return f"""WITH para AS (
  SELECT page_id AS doc_id, 0 AS k, generate_subscripts(ps, 1) AS s, unnest(ps) AS line
  FROM (SELECT page_id, list_transform(regexp_extract_all(html, '{render.PARAGRAPH_HTML}', 1),
                                       lambda p: {strip.format(x='p')}) AS ps FROM pages)),
rws AS (
  SELECT page_id AS doc_id, 1 AS k, generate_subscripts(rs, 1) AS s, unnest(rs) AS r
  FROM (SELECT page_id, list_concat(regexp_extract_all(html, '{render.ROW_HTML}', 1),
                                    regexp_extract_all(html, '{render.LIST_HTML}', 1)) AS rs FROM pages)),
rowl AS (
  SELECT doc_id, k, s, array_to_string(list_filter(list_transform(
           list_concat(regexp_extract_all(r, '{render.CELL_HTML}', 1), regexp_extract_all(r, '{render.ITEM_HTML}', 1)),
           lambda c: {strip.format(x='c')}), lambda c: regexp_matches(c, {nb})), ' | ') AS line FROM rws),
allb AS (SELECT * FROM para UNION ALL SELECT * FROM rowl),
kept AS (SELECT * FROM allb WHERE line IS NOT NULL AND regexp_matches(line, {nb})),
d AS (SELECT doc_id, sum(1 - k) AS n_paragraphs, sum(k) AS n_rows,
             string_agg(line || chr(10), '' ORDER BY k, s) AS text FROM kept GROUP BY doc_id)
SELECT doc_id, n_paragraphs::BIGINT AS n_paragraphs, n_rows::BIGINT AS n_rows, md5(text) AS text_md5 FROM d"""


@register("assemble_blocks", _blocks_sql)
def q_assemble_blocks(spark, sf_dir):
    blocks = render.html_blocks(load(spark, sf_dir, "pages"))
    docs, _ = render.assemble_blocks(blocks)
    return docs.select("doc_id", "n_paragraphs", "n_rows", F.md5("text").alias("text_md5"))


# --- exports of the hybrid hits ---------------------------------------------------------------

_META = ["lang", "source"]


def _records(spark, sf_dir):
    top, _, _ = fused(spark, sf_dir)
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", *_META)
    return export.hit_records(top.withColumn("score", F.round("score", 6)), docs, _META)


def _export_ctes() -> str:
    return f"""{_hybrid_ctes()},
rec AS (SELECT t.query_id, t.rank, t.doc_id, round(t.score, 6) AS score, t.method, d.text AS content, d.lang, d.source
        FROM h_top t LEFT JOIN documents d USING (doc_id))"""


@register("export_json", lambda: f"""WITH {_export_ctes()}
SELECT query_id, rank::BIGINT AS rank, md5(to_json(struct_pack(content := content, document_id := doc_id::VARCHAR,
  similarity_score := score, retrieval_method := method, metadata := struct_pack(lang := lang, source := source))))
  AS json_md5 FROM rec""")
def q_export_json(spark, sf_dir):
    j = export.json_lines(_records(spark, sf_dir), _META)
    return j.select("query_id", F.col("rank").cast("long").alias("rank"), F.md5("json").alias("json_md5"))


@register("export_csv", lambda: f"""WITH {_export_ctes()}
SELECT query_id, rank::BIGINT AS rank, substring(content, 1, {export.CSV_PREVIEW}) || '...' AS "Content",
  doc_id::VARCHAR AS "Document ID", score AS "Score", method AS "Method",
  '{{''lang'': ''' || lang || ''', ''source'': ''' || source || '''}}' AS "Metadata" FROM rec""")
def q_export_csv(spark, sf_dir):
    c = export.csv_rows(_records(spark, sf_dir), _META)
    return c.withColumn("rank", F.col("rank").cast("long"))


@register("report_txt", lambda: f"""WITH {_export_ctes()}
SELECT query_id, md5(string_agg('Result ' || rank || ':' || chr(10) || '  document_id: ' || doc_id || chr(10)
  || '  similarity_score: ' || CAST(score AS VARCHAR) || chr(10) || '  retrieval_method: ' || method || chr(10) || chr(10),
  '' ORDER BY rank)) AS report_md5 FROM rec GROUP BY query_id""")
def q_report_txt(spark, sf_dir):
    rec = (_records(spark, sf_dir).withColumnRenamed("doc_id", "document_id")
           .withColumnRenamed("score", "similarity_score").withColumnRenamed("method", "retrieval_method"))
    rep = export.txt_report(rec, "query_id", "rank", ["document_id", "similarity_score", "retrieval_method"])
    return rep.select("query_id", F.md5("report").alias("report_md5"))

