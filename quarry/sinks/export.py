"""Sinks: hit exports (JSON, CSV, text report) and generic result saving.

Every writer is a DataFrame writer, so output is produced by the executors
in parallel, one file per partition, into a directory the caller names.
Unknown formats raise before anything is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("json", "csv", "txt")
# CSV export header names and preview length.
CSV_HEADERS = ["Content", "Document ID", "Score", "Method", "Metadata"]
CSV_PREVIEW = 200


def _check(fmt: str) -> None:
    if fmt not in FORMATS:
        raise ValueError(f"cannot export as {fmt!r}; choose one of {', '.join(FORMATS)}")


def plain_columns(df: DataFrame) -> DataFrame:
    """Arrays and structs as JSON text, for sinks that hold plain values only."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema.fields])


def _py_dict_repr(cols: list[str]) -> Column:
    """``{'a': 'x', 'b': 'y'}`` for string-valued metadata columns."""
    parts = []
    for i, c in enumerate(cols):
        parts += [F.lit(("" if i == 0 else ", ") + f"'{c}': '"), F.coalesce(F.col(c).cast("string"), F.lit("None")),
                  F.lit("'")]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def hit_records(hits: DataFrame, docs: DataFrame, metadata_cols: list[str], content_col: str = "text") -> DataFrame:
    """Join hits to their documents after top-k (only k rows per query are looked up)."""
    d = docs.select("doc_id", F.col(content_col).alias("content"), *metadata_cols)
    return hits.join(d, "doc_id", "left")


def json_lines(records: DataFrame, metadata_cols: list[str], attributed: bool = False) -> DataFrame:
    """(query_id, rank, json) — content, document_id, similarity_score,
    retrieval_method, metadata; with ``attributed`` the object starts with
    query_id and rank."""
    obj = F.struct(
        *([F.col("query_id"), F.col("rank")] if attributed else []),
        F.col("content").alias("content"),
        F.col("doc_id").cast("string").alias("document_id"),
        F.col("score").alias("similarity_score"),
        F.col("method").alias("retrieval_method"),
        F.struct(*[F.col(c) for c in metadata_cols]).alias("metadata"))
    return records.select("query_id", "rank", F.to_json(obj).alias("json"))


def csv_rows(records: DataFrame, metadata_cols: list[str]) -> DataFrame:
    """CSV export columns; content cut to 200 characters and ``...`` always appended."""
    return records.select(
        "query_id", "rank",
        F.concat(F.substring("content", 1, CSV_PREVIEW), F.lit("...")).alias(CSV_HEADERS[0]),
        F.col("doc_id").cast("string").alias(CSV_HEADERS[1]),
        F.col("score").alias(CSV_HEADERS[2]),
        F.col("method").alias(CSV_HEADERS[3]),
        _py_dict_repr(metadata_cols).alias(CSV_HEADERS[4]))


def txt_report(rows: DataFrame, group_col: str, order_col: str, fields: list[str]) -> DataFrame:
    """(group, report): ``Result i:`` then ``  key: value`` lines and a blank
    line per row, in ``order_col`` order within each group."""
    w = Window.partitionBy(group_col).orderBy(order_col)
    body = F.concat(*[F.concat(F.lit(f"  {f}: "), F.coalesce(F.col(f).cast("string"), F.lit("None")), F.lit("\n"))
                      for f in fields])
    blocks = rows.select(group_col, F.row_number().over(w).alias("_i"), body.alias("_b"))
    block = F.concat(F.lit("Result "), F.col("_i").cast("string"), F.lit(":\n"), F.col("_b"), F.lit("\n"))
    return blocks.select(group_col, "_i", block.alias("_blk")).groupBy(group_col).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_blk"))), lambda s: s["_blk"]),
                     "").alias("report"))


def save_rows(df: DataFrame, path: str, fmt: str = "json", mode: str = "errorifexists") -> str:
    """Write rows as JSON lines, CSV with header, or a text report; returns ``path``."""
    _check(fmt)
    if fmt == "json":
        df.write.mode(mode).json(path)
    elif fmt == "csv":
        plain_columns(df).write.mode(mode).option("header", True).option("escape", "\"").csv(path)
    else:
        # consecutive numbering in the rows' current order, computed in the
        # JVM from per-partition counts (no gathering, no Python round trip)
        from quarry.operators.numbering import consecutive_numbers

        fields = df.columns
        indexed = consecutive_numbers(df, None, "_i", start=1)
        body = F.concat(*[F.concat(F.lit(f"  {f}: "), F.coalesce(F.col(f).cast("string"), F.lit("None")),
                                   F.lit("\n")) for f in fields])
        block = F.concat(F.lit("Result "), F.col("_i").cast("string"), F.lit(":\n"), body)
        indexed.select(block.alias("value")).write.mode(mode).text(path)
    return path


def export_hits(hits: DataFrame, docs: DataFrame, path: str, fmt: str = "json",
                metadata_cols: list[str] | None = None, mode: str = "errorifexists") -> str:
    """Export search hits with their content in one of json / csv / txt.

    Every record names its query and rank: json and csv as fields of each row,
    txt as the heading of each query's report."""
    _check(fmt)
    meta = metadata_cols or []
    rec = hit_records(hits, docs, meta)
    if fmt == "json":
        json_lines(rec, meta, attributed=True).select("json").write.mode(mode).text(path)
    elif fmt == "csv":
        plain_columns(csv_rows(rec, meta)).write.mode(mode).option("header", True).option("escape", "\"").csv(path)
    else:
        rep = txt_report(rec.withColumnRenamed("doc_id", "document_id").withColumnRenamed("score", "similarity_score")
                         .withColumnRenamed("method", "retrieval_method"),
                         "query_id", "rank", ["document_id", "similarity_score", "retrieval_method"])
        heading = F.concat(F.lit("Query "), F.col("query_id").cast("string"), F.lit("\n"), F.col("report"))
        rep.select(heading.alias("report")).write.mode(mode).text(path)
    return path
