"""Scalar text functions against hand-computed values."""

from pyspark.sql import functions as F

from quarry.functions import text as tx


def one(spark, expr, value):
    df = spark.createDataFrame([(value,)], "t string")
    return df.select(expr(F.col("t")).alias("x")).collect()[0]["x"]


def test_normalize_cases(spark):
    cases = {
        "  Café   crème\t\nbrûlée  ": "Café crème brûlée",
        "e\u0301te\u0301": "ete",  # combining marks are not word characters: dropped
        "½ cup": "½ cup",  # fraction sign is numeric: kept
        "“quoted” — dash": "quoted  dash",  # quotes/dash deleted, double space stays
        "a\u00a0b\x1fc": "a b c",  # no-break space and unit separator are whitespace
        "": "",
        "***": "",
        "keep: (this) [and] {that}; ok? yes! -x.": "keep: (this) [and] {that}; ok? yes! -x.",
    }
    for raw, want in cases.items():
        assert one(spark, tx.normalize, raw) == want, raw


def test_counts_and_pages(spark):
    assert one(spark, tx.word_count, " a  b c\n") == 3
    assert one(spark, tx.word_count, "") == 0
    assert one(spark, tx.estimated_pages, "x" * 2499) == 1
    assert one(spark, tx.estimated_pages, "x" * 7500) == 3
    assert one(spark, lambda c: tx.preview(c, 3), "abcdef") == "abc..."
    assert one(spark, lambda c: tx.preview(c, 10), "ab") == "ab..."


def test_safe_name(spark):
    assert one(spark, tx.safe_name, ' a<b>c:d"e/f\\g|h?i*j. ') == "a_b_c_d_e_f_g_h_i_j"
    assert one(spark, tx.safe_name, "..x..") == "x"
    assert len(one(spark, tx.safe_name, "y" * 300)) == 200


def test_path_metadata(spark):
    from quarry.operators import annotate

    df = spark.createDataFrame([(p,) for p in [
        "/data/Chapter_3 page 12.PDF", "notes_2024_01_31.txt", "x20249999.csv", "README", "a.b.c.tar.gz",
        ".bashrc", "dir/a..b", "dir/sub/"]], "path string")
    got = {r["path"]: r for r in annotate.path_metadata(df).collect()}
    r = got["/data/Chapter_3 page 12.PDF"]
    assert (r["file_type"], r["filename"], r["chapter"], r["page"], r["date"]) == (
        ".pdf", "Chapter_3 page 12", 3, 12, None)
    r = got["notes_2024_01_31.txt"]
    assert (r["file_type"], r["date"], str(r["date_value"])) == (".txt", "2024-01-31", "2024-01-31")
    r = got["x20249999.csv"]
    assert (r["date"], r["date_value"]) == ("2024-99-99", None)
    assert (got["README"]["file_type"], got["README"]["filename"]) == ("", "README")
    assert (got["a.b.c.tar.gz"]["file_type"], got["a.b.c.tar.gz"]["filename"]) == (".gz", "a.b.c.tar")
    assert (got[".bashrc"]["file_type"], got[".bashrc"]["filename"]) == ("", ".bashrc")
    assert (got["dir/a..b"]["file_type"], got["dir/a..b"]["filename"]) == (".b", "a.")
    assert got["dir/sub/"]["filename"] == "sub"


def test_academic_flags(spark):
    def flags(t):
        return one(spark, tx.academic_indicators, t)

    assert flags("The Introduction explains") == ["academic_structure"]
    assert flags("introductions are long") == []  # part of a word
    assert flags("in 1999 we") == ["year_references"]
    assert flags("in a1999 or 19999") == []  # year beside a letter, five digits
    assert flags("as et al. said") == []  # marker followed by a space: no match
    assert flags("et al.x") == ["citation_style"]
    assert flags("Smith et al. showed") == ["author_citations"]
    assert flags("Conclusion: Smith et al.2020") == [
        "academic_structure", "year_references", "citation_style", "author_citations"]


def test_language_guess(spark):
    en = "the cat and the dog of the house to sit in a box is that it with"
    assert one(spark, tx.language_guess, en) == "english"
    assert one(spark, tx.language_guess, "the and of to in") == "unknown"  # five is not > 5
    assert one(spark, tx.language_guess, "the and of to in a") == "english"


def test_content_id(spark):
    import hashlib

    df = spark.createDataFrame([("hello", 1, "x")], "t string, b int, a string")
    got = df.select(tx.content_id("t").alias("i"), tx.content_id("t", tx.sorted_struct("b", "a")).alias("j")).collect()[0]
    assert got["i"] == hashlib.md5(b"hello").hexdigest()[:16]
    meta = hashlib.md5(b'{"a":"x","b":1}').hexdigest()[:8]
    assert got["j"] == got["i"] + "_" + meta
