"""Table-to-text rendering and ordered assembly of document parts.

* ``render_table`` — a table as text: ``Columns: a, b``, a blank line, then
  ``Row i: v1 | v2`` for the first ``limit`` rows and ``... and N more rows``.
  The first rows come from an ordered limit (TakeOrderedAndProject) and the
  row count from an aggregate, so nothing gathers the whole table.
* ``render_groups`` — the same per group (workbook sheets): a
  ``--- Sheet: name ---`` header and the first ``limit`` rows of each group,
  chosen by a window whose row limit Spark applies before the shuffle.
* ``assemble_pages`` — ``--- Page n ---`` blocks of non-blank pages in order.
* ``assemble_blocks`` — non-blank paragraphs, then table rows of non-blank
  cells joined by `` | ``.

A document's parts are collected into its one output row; the size of that
row is the size of the document itself (bounded by the maximum file size).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as tx

# Text layout of rendered tables, pages and blocks.
TABLE_ROWS = 100
SHEET_ROWS = 50
CELL_SEP = " | "
NULL_CELL = "nan"


def _cells(df: DataFrame, cols: list[str]) -> Column:
    return F.concat_ws(CELL_SEP, *[F.coalesce(F.col(c).cast("string"), F.lit(NULL_CELL)) for c in cols])


def _header(cols: list[str]) -> str:
    return "Columns: " + ", ".join(cols) + "\n\n"


def render_table(df: DataFrame, order_by: list[str], limit: int = TABLE_ROWS) -> DataFrame:
    """One row: (text, n_rows, n_rendered)."""
    cols = df.columns
    first = df.orderBy(*order_by).limit(limit)
    w = Window.orderBy(*order_by)  # over at most ``limit`` rows
    lines = first.select(F.row_number().over(w).alias("i"), _cells(first, cols).alias("cells"))
    body = lines.agg(
        F.count(F.lit(1)).alias("n_rendered"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "cells"))), lambda s: F.concat(
            F.lit("Row "), s["i"].cast("string"), F.lit(": "), s["cells"], F.lit("\n"))), "").alias("rows"))
    n = df.select(F.count(F.lit(1))).scalar()
    more = F.when(n > limit, F.concat(F.lit("\n... and "), (n - limit).cast("string"), F.lit(" more rows\n"))
                  ).otherwise(F.lit(""))
    return body.select(F.concat(F.lit(_header(cols)), F.coalesce("rows", F.lit("")), more).alias("text"),
                       n.cast("long").alias("n_rows"), F.col("n_rendered").cast("long").alias("n_rendered"))


def render_groups(df: DataFrame, group_col: str, order_by: list[str], limit: int = SHEET_ROWS) -> DataFrame:
    """One row per group: (group, text, n_rows, n_rendered)."""
    cols = [c for c in df.columns if c != group_col]
    w = Window.partitionBy(group_col).orderBy(*order_by)
    firsts = (df.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= limit)
              .select(group_col, "_i", _cells(df, cols).alias("_cells")))
    body = firsts.groupBy(group_col).agg(
        F.count(F.lit(1)).alias("n_rendered"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_cells"))), lambda s: F.concat(
            F.lit("Row "), s["_i"].cast("string"), F.lit(": "), s["_cells"], F.lit("\n"))), "").alias("_rows"))
    counts = df.groupBy(group_col).agg(F.count(F.lit(1)).alias("n_rows"))
    j = body.join(counts, group_col)
    more = F.when(F.col("n_rows") > limit, F.concat(
        F.lit("\n... and "), (F.col("n_rows") - limit).cast("string"), F.lit(" more rows\n"))).otherwise(F.lit(""))
    text = F.concat(F.lit("\n--- Sheet: "), F.col(group_col).cast("string"), F.lit(" ---\n"),
                    F.lit(_header(cols)), F.col("_rows"), more)
    return j.select(F.col(group_col).alias("group"), text.alias("text"), F.col("n_rows").cast("long").alias("n_rows"),
                    F.col("n_rendered").cast("long").alias("n_rendered"))


def _not_blank(c: Column) -> Column:
    return c.isNotNull() & c.rlike("[^" + tx.WS_CLASS[1:-1] + "]")


def assemble_pages(pages: DataFrame, doc_col: str = "doc_id", page_col: str = "page_no",
                   text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents(doc_id, text, n_pages), rejects(doc_id, error)).

    Blank pages are skipped but keep their number; a document whose pages are
    all blank is rejected.
    """
    t = F.col(text_col)
    piece = F.concat(F.lit("\n--- Page "), F.col(page_col).cast("string"), F.lit(" ---\n"), t, F.lit("\n"))
    kept = pages.where(_not_blank(t)).select(F.col(doc_col).alias("doc_id"), F.col(page_col).alias("_p"),
                                             piece.alias("_piece"))
    docs = kept.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_pages"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_p", "_piece"))), lambda s: s["_piece"]),
                     "").alias("text"))
    all_ids = pages.select(F.col(doc_col).alias("doc_id")).distinct()
    rejects = all_ids.join(docs, "doc_id", "left_anti").withColumn("error", F.lit("no text content"))
    return docs.select("doc_id", "text", F.col("n_pages").cast("long").alias("n_pages")), rejects


def assemble_blocks(blocks: DataFrame, doc_col: str = "doc_id", seq_col: str = "seq", kind_col: str = "kind",
                    cells_col: str = "cells") -> tuple[DataFrame, DataFrame]:
    """(documents(doc_id, text, n_paragraphs, n_rows), rejects(doc_id, error)).

    ``kind`` is ``paragraph`` (text in ``cells[0]``) or ``row`` (cells).
    Paragraphs come first, then table rows, each in ``seq`` order.
    """
    para = F.col(cells_col)[0]
    row_text = F.array_join(F.filter(F.col(cells_col), lambda c: _not_blank(c)), CELL_SEP)
    is_para = F.col(kind_col) == F.lit("paragraph")
    line = F.when(is_para, para).otherwise(row_text)
    keep = F.when(is_para, _not_blank(para)).otherwise(_not_blank(row_text))
    parts = (blocks.select(F.col(doc_col).alias("doc_id"), F.when(is_para, 0).otherwise(1).alias("_k"),
                           F.col(seq_col).alias("_s"), line.alias("_line"), keep.alias("_keep"))
             .where("_keep"))
    docs = parts.groupBy("doc_id").agg(
        F.sum(1 - F.col("_k")).alias("n_paragraphs"), F.sum("_k").alias("n_rows"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_k", "_s", "_line"))),
                                 lambda s: F.concat(s["_line"], F.lit("\n"))), "").alias("text"))
    all_ids = blocks.select(F.col(doc_col).alias("doc_id")).distinct()
    rejects = all_ids.join(docs, "doc_id", "left_anti").withColumn("error", F.lit("no text content"))
    return (docs.select("doc_id", "text", F.col("n_paragraphs").cast("long").alias("n_paragraphs"),
                        F.col("n_rows").cast("long").alias("n_rows")), rejects)


# --- HTML pages to blocks --------------------------------------------------------------------

PARAGRAPH_HTML = r"(?s)<p[^>]*>(.*?)</p>"
LIST_HTML = r"(?s)<ul[^>]*>(.*?)</ul>"
ITEM_HTML = r"(?s)<li[^>]*>(.*?)</li>"
ROW_HTML = r"(?s)<tr[^>]*>(.*?)</tr>"
CELL_HTML = r"(?s)<t[dh][^>]*>(.*?)</t[dh]>"
TAG = r"<[^>]*>"


def html_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Blocks from HTML: ``<p>`` paragraphs, and table rows from ``<tr>`` (cells
    ``<td>/<th>``) and ``<ul>`` lists (cells ``<li>``); tags are stripped."""
    h = F.col(html_col)

    def strip(c: Column) -> Column:
        return F.regexp_replace(c, TAG, "")

    paras = F.transform(F.regexp_extract_all(h, F.lit(PARAGRAPH_HTML), 1), lambda p: F.array(strip(p)))
    rows = F.concat(F.regexp_extract_all(h, F.lit(ROW_HTML), 1), F.regexp_extract_all(h, F.lit(LIST_HTML), 1))
    staged = pages.select(F.col(id_col).alias("doc_id"), paras.alias("_p"), rows.alias("_r"))
    # explode_outer + null filter: a plain explode lets the optimizer push an
    # inferred size() > 0 filter below the projections and evaluate them twice
    p = (staged.select("doc_id", F.posexplode_outer("_p").alias("seq", "cells")).where(F.col("cells").isNotNull())
         .withColumn("kind", F.lit("paragraph")))
    r = staged.select("doc_id", F.posexplode_outer("_r").alias("seq", "_row")).where(F.col("_row").isNotNull())
    r = r.select("doc_id", "seq", F.lit("row").alias("kind"), F.transform(
        F.concat(F.regexp_extract_all("_row", F.lit(CELL_HTML), 1), F.regexp_extract_all("_row", F.lit(ITEM_HTML), 1)),
        strip).alias("cells"))
    return p.select("doc_id", "seq", "kind", "cells").unionByName(r)
