"""File sources: directory scans into a documents table, with a rejects table.

``scan_files`` reads every file under a path with Spark's ``binaryFile``
source (recursive), classifies it by lower-cased suffix and returns the
supported files plus a ``rejects(path, error)`` DataFrame instead of failing
the job on one bad file.  ``extract_documents`` turns the bytes into text:
plain text is decoded in the JVM (strict UTF-8, blank files rejected); the
other formats go through small per-file extractors in an Arrow-batched
``mapInPandas`` step (CSV via pandas, XLSX/DOCX via the zip/XML standard
library, PDF only through a user-supplied extractor).
"""

from __future__ import annotations

import io
import itertools
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.session import materialize
from quarry.sources import render

# Supported suffixes (lower-cased) and bytes per megabyte.
SUPPORTED = (".pdf", ".docx", ".txt", ".csv", ".xlsx")
MB = 1024 * 1024


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def scan_files(spark: SparkSession, path: str, supported=SUPPORTED,
               max_mb: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(files(path, file_type, length, modificationTime, content), rejects(path, error)).

    Files of any size are read unless the caller gives ``max_mb``; larger ones are
    then rejects.  Spark's file sources skip names that start with ``_`` or ``.``."""
    if not _exists(spark, path):
        raise FileNotFoundError(f"nothing to read at {path}")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    typed = raw.withColumn("file_type", tx.path_suffix("path"))
    ok_type = F.col("file_type").isin(*supported)
    ok_size = F.lit(True) if max_mb is None else F.col("length") <= F.lit(int(max_mb * MB))
    files = typed.where(ok_type & ok_size)
    rejects = typed.where(~(ok_type & ok_size)).select(
        "path", F.when(~ok_type, F.concat(F.lit("no reader for files of type "), F.col("file_type")))
        .otherwise(F.lit("larger than the caller allows")).alias("error"))
    return files, rejects


def file_metadata(files: DataFrame) -> DataFrame:
    """source_file, filename (stem), file_size_mb, file_type, chapter, page, date,
    processing_timestamp (run-time value: never part of a content id)."""
    p = F.col("path")
    return files.select(
        "*",
        p.alias("source_file"),
        tx.path_stem(p).alias("filename"),
        (F.col("length") / MB).alias("file_size_mb"),
        tx.chapter_from_name(p).alias("chapter"),
        tx.page_from_name(p).alias("page"),
        tx.date_from_name(p).alias("date"),
        F.current_timestamp().alias("processing_timestamp"),
    )


# --- per-file extractors (small helpers; the job around them is Spark's) ----------------

def _csv_text(data: bytes) -> str:
    df = pd.read_csv(io.BytesIO(data))
    return _frame_text(df, render.TABLE_ROWS)


def _frame_text(df: pd.DataFrame, limit: int) -> str:
    """The table rendering of ``render.render_table`` for a frame in memory."""
    cells = df.head(limit).astype(object).map(str)
    rows = [f"Row {i}: {render.CELL_SEP.join(r)}" for i, r in enumerate(cells.itertuples(index=False, name=None), 1)]
    more = [f"\n... and {len(df) - limit} more rows"] if len(df) > limit else []
    return "\n".join([f"Columns: {', '.join(map(str, df.columns))}\n", *rows, *more, ""])


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
       "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
       "w": "http://schemas.openxmlformats.org/wordprocessingml/2006/main"}


def _col_index(ref: str) -> int:
    letters = re.match(r"[A-Z]+", ref).group(0)
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _xlsx_text(data: bytes) -> str:
    z = zipfile.ZipFile(io.BytesIO(data))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        root = ElementTree.fromstring(z.read("xl/sharedStrings.xml"))
        shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in root.findall("m:si", _NS)]
    wb = ElementTree.fromstring(z.read("xl/workbook.xml"))
    rels = ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))
    target = {r.get("Id"): r.get("Target") for r in rels}
    out = ""
    for sheet in wb.find("m:sheets", _NS):
        rid = sheet.get(f"{{{_NS['r']}}}id")
        name = sheet.get("name")
        xml = ElementTree.fromstring(z.read("xl/" + target[rid].lstrip("/").removeprefix("xl/")))
        rows = []
        for r in xml.iter(f"{{{_NS['m']}}}row"):
            cells = {}
            for c in r.findall("m:c", _NS):
                v = c.find("m:v", _NS)
                val = None if v is None else v.text
                if c.get("t") == "s" and val is not None:
                    val = shared[int(val)]
                elif c.get("t") == "inlineStr":
                    val = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
                cells[_col_index(c.get("r"))] = val
            width = max(cells) + 1 if cells else 0
            rows.append([cells.get(i) for i in range(width)])
        header, body = (rows[0], rows[1:]) if rows else ([], [])
        frame = pd.DataFrame(body, columns=header if body else None) if header else pd.DataFrame()
        if header and not body:
            frame = pd.DataFrame(columns=header)
        out += f"\n--- Sheet: {name} ---\n" + _frame_text(frame, render.SHEET_ROWS)
    return out


def _docx_text(data: bytes) -> str:
    """Paragraph lines, then one line per table row; blank ones left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find("w:body", _NS)

    def words(element) -> str:
        return "".join(t.text or "" for t in element.iterfind(".//w:t", _NS))

    paragraphs = map(words, body.iterfind("w:p", _NS))
    rows = (render.CELL_SEP.join(filter(str.strip, map(words, row.iterfind("w:tc", _NS)))) for row in body.iterfind(".//w:tr", _NS))
    lines = [x for x in itertools.chain(paragraphs, rows) if x.strip()]
    if not lines:
        raise ValueError("the document holds no text")
    return "\n".join([*lines, ""])


DEFAULT_EXTRACTORS: dict[str, Callable[[bytes], str]] = {".csv": _csv_text, ".xlsx": _xlsx_text, ".docx": _docx_text}


def extract_documents(files: DataFrame, extractors: dict[str, Callable[[bytes], str]] | None = None
                      ) -> tuple[DataFrame, DataFrame]:
    """(documents(path, file_type, length, text), rejects(path, error))."""
    ex = dict(DEFAULT_EXTRACTORS)
    ex.update(extractors or {})
    txt = files.where(F.col("file_type") == ".txt").select(
        "path", "file_type", "length", F.regexp_replace(
            F.try_validate_utf8(F.col("content").cast("string")), "\r\n?", "\n").alias("text"))
    txt_ok = txt.where(F.col("text").isNotNull() & F.col("text").rlike("[^" + tx.WS_CLASS[1:-1] + "]"))
    txt_bad = txt.where(F.col("text").isNull() | ~F.col("text").rlike("[^" + tx.WS_CLASS[1:-1] + "]")).select(
        "path", F.when(F.col("text").isNull(), F.lit("not valid UTF-8"))
        .otherwise(F.lit("blank file")).alias("error"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, errors = [], []
            for suffix, data in zip(b["file_type"], b["content"]):
                fn = ex.get(suffix)
                try:
                    if fn is None:
                        raise ValueError(f"no extractor configured for {suffix}")
                    texts.append(fn(bytes(data)))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001 — becomes a reject row
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"path": b["path"], "file_type": b["file_type"], "length": b["length"],
                                "text": texts, "error": errors})

    other = files.where(F.col("file_type") != ".txt").select("path", "file_type", "length", "content")
    # written once: documents and rejects both read it
    done = materialize(other.mapInPandas(run, "path string, file_type string, length long, text string, error string"), "files")
    docs = txt_ok.unionByName(done.where(F.col("error").isNull()).drop("error"))
    rejects = txt_bad.unionByName(done.where(F.col("error").isNotNull()).select("path", "error"))
    return docs, rejects


def read_documents(spark: SparkSession, path: str, extractors=None, max_mb: float | None = None
                   ) -> tuple[DataFrame, DataFrame]:
    """Scan + extract + file metadata: (documents, rejects).  ``doc_id`` is the path."""
    files, rej1 = scan_files(spark, path, max_mb=max_mb)
    docs, rej2 = extract_documents(files, extractors)
    meta = file_metadata(docs).withColumn("doc_id", F.col("path"))
    return meta, rej1.unionByName(rej2)


__all__ = ["scan_files", "extract_documents", "read_documents", "file_metadata"]
