"""File scans with rejects, extractors, and sinks."""

import io
import json
import os
import zipfile

import pytest

from quarry.sinks import export
from quarry.sources import files


def _write(path, data: bytes):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def _docx(paragraphs, rows) -> bytes:
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    body += "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>" for c in r)
                                + "</w:tr>" for r in rows) + "</w:tbl>"
    xml = f'<?xml version="1.0"?><w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", xml)
    return buf.getvalue()


def _xlsx(sheets) -> bytes:
    m = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    r = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{m}" xmlns:r="{r}"><sheets>' + "".join(
            f'<sheet name="{n}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, (n, _) in enumerate(sheets))
            + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x">' + "".join(
            f'<Relationship Id="rId{i + 1}" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(sheets)))
            + "</Relationships>")
        for i, (_, rows) in enumerate(sheets):
            xml = f'<worksheet xmlns="{m}"><sheetData>'
            for ri, row in enumerate(rows):
                xml += f'<row r="{ri + 1}">' + "".join(
                    f'<c r="{chr(65 + ci)}{ri + 1}" t="inlineStr"><is><t>{v}</t></is></c>' for ci, v in enumerate(row))
                xml += "</row>"
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", xml + "</sheetData></worksheet>")
    return buf.getvalue()


def test_scan_and_extract(spark, scratch):
    root = os.path.join(scratch, "docs")
    sample = "This is a sample document for testing. It contains multiple sentences. Machine learning is fun."
    _write(f"{root}/sample.txt", sample.encode())
    _write(f"{root}/sub/Notes_Chapter_2.TXT", ("chapter text " * 20).encode())
    _write(f"{root}/blank.txt", b"  \n ")
    _write(f"{root}/bad.txt", b"\xff\xfe\xfa")
    _write(f"{root}/test.xyz", b"test content")
    _write(f"{root}/t.csv", b"a,b\n1,x\n2,y\n")
    _write(f"{root}/w.docx", _docx(["Hello", " ", "World"], [["c1", " ", "c2"], [" ", ""]]))
    _write(f"{root}/s.xlsx", _xlsx([("S1", [["h1", "h2"], ["1", "2"]]), ("S2", [["k"], ["v"]])]))
    _write(f"{root}/p.pdf", b"%PDF-1.4")
    docs, rejects = files.read_documents(spark, root)
    got = {os.path.basename(r["path"]): r for r in docs.collect()}
    rej = {os.path.basename(r["path"]): r["error"] for r in rejects.collect()}
    assert got["sample.txt"]["text"] == sample and got["sample.txt"]["file_type"] == ".txt"
    assert got["Notes_Chapter_2.TXT"]["chapter"] == 2 and got["Notes_Chapter_2.TXT"]["filename"] == "Notes_Chapter_2"
    assert got["t.csv"]["text"] == "Columns: a, b\n\nRow 1: 1 | x\nRow 2: 2 | y\n"
    assert got["w.docx"]["text"] == "Hello\nWorld\nc1 | c2\n"
    assert got["s.xlsx"]["text"] == ("\n--- Sheet: S1 ---\nColumns: h1, h2\n\nRow 1: 1 | 2\n"
                                     "\n--- Sheet: S2 ---\nColumns: k\n\nRow 1: v\n")
    assert set(rej) == {"blank.txt", "bad.txt", "test.xyz", "p.pdf"}
    assert rej["test.xyz"].endswith(".xyz")


def test_line_endings_and_large_files(spark, scratch):
    root = os.path.join(scratch, "in")
    os.makedirs(root)
    _write(f"{root}/dos.txt", b"one\r\ntwo\rthree\n")
    with open(f"{root}/large.txt", "wb") as f:
        for _ in range(101):
            f.write(b"a" * (1 << 20))
    files_, rejects = files.scan_files(spark, root)
    assert {os.path.basename(r["path"]) for r in files_.select("path").collect()} == {"dos.txt", "large.txt"} and rejects.isEmpty()
    files_, rejects = files.scan_files(spark, root, max_mb=100)
    assert [os.path.basename(r["path"]) for r in rejects.collect()] == ["large.txt"]
    docs, _ = files.extract_documents(files_)
    assert [r["text"] for r in docs.select("text").collect()] == ["one\ntwo\nthree\n"]


def test_missing_path(spark):
    with pytest.raises(FileNotFoundError):
        files.scan_files(spark, "/nonexistent/nowhere.txt")


def test_exports(spark, scratch):
    hits = spark.createDataFrame([(1, 1, 7, 0.85, "SPIDER")], "query_id long, rank int, doc_id long, score double, method string")
    docs = spark.createDataFrame([(7, "Sample content " * 20, "en")], "doc_id long, text string, lang string")
    p = export.export_hits(hits, docs, os.path.join(scratch, "j"), "json", ["lang"])
    line = json.loads(spark.read.text(p).collect()[0]["value"])
    assert line == {"query_id": 1, "rank": 1, "content": "Sample content " * 20, "document_id": "7", "similarity_score": 0.85,
                    "retrieval_method": "SPIDER", "metadata": {"lang": "en"}}
    p = export.export_hits(hits, docs, os.path.join(scratch, "c"), "csv", ["lang"])
    row = spark.read.option("header", True).csv(p).collect()[0]
    assert (row["query_id"], row["rank"]) == ("1", "1")
    assert row["Content"].endswith("...") and len(row["Content"]) == 203 and row["Metadata"] == "{'lang': 'en'}"
    p = export.export_hits(hits, docs, os.path.join(scratch, "t"), "txt")
    text = "\n".join(r["value"] for r in spark.read.text(p).collect())
    assert text.startswith("Query 1\nResult 1:\n  document_id: 7\n  similarity_score: 0.85\n  retrieval_method: SPIDER\n")
    with pytest.raises(ValueError):
        export.export_hits(hits, docs, os.path.join(scratch, "x"), "xml")
    assert not os.path.exists(os.path.join(scratch, "x"))


def test_save_rows(spark, scratch):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string").coalesce(1)
    p = export.save_rows(df.orderBy("id"), os.path.join(scratch, "r"), "txt")
    text = "\n".join(r["value"] for r in spark.read.text(p).collect())
    assert text == "Result 1:\n  id: 1\n  v: a\n\nResult 2:\n  id: 2\n  v: b\n"
    with pytest.raises(ValueError):
        export.save_rows(df, os.path.join(scratch, "q"), "yaml")


def test_nested_columns_in_csv(spark, scratch):
    df = spark.createDataFrame([(1, ["x", "y"], {"k": 2})], "id long, topics array<string>, m map<string,int>")
    p = export.save_rows(df, os.path.join(scratch, "n"), "csv")
    assert [tuple(r) for r in spark.read.option("header", True).option("escape", "\"").csv(p).collect()] == [("1", '["x","y"]', '{"k":2}')]
