"""Document and chunk annotation: counts, language guess, academic indicators,
capitalised topic phrases, path metadata, content ids.

Everything is a narrow projection; topics are counted and ranked inside the
row (sort + run lengths), so no per-document shuffle is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as tx

# Topic phrase pattern, phrase length limit, list size, minimum count.
TOPIC_PATTERN = (tx.NOT_WORD_BEFORE + r"[A-Z][a-z]+(?:" + tx.WS_RUN + r"[A-Z][a-z]+)*" + tx.NOT_WORD_AFTER)
TOPIC_MAX_WORDS = 4
TOPIC_LIMIT = 10
TOPIC_MIN_COUNT = 2


def with_topics(df: DataFrame, text_col: str = "text", out_col: str = "potential_topics") -> DataFrame:
    """Add the ten most frequent capitalised phrases (<= 4 words, seen more
    than once), most frequent first, ties by first appearance."""
    keep = df.columns
    phrases = F.regexp_extract_all(F.col(text_col), F.lit(TOPIC_PATTERN), 0)
    tagged = F.filter(F.transform(phrases, lambda p, i: F.struct(p.alias("phrase"), i.alias("pos"))),
                      lambda e: tx.word_count(e["phrase"]) <= TOPIC_MAX_WORDS)
    s1 = df.select(*keep, F.sort_array(tagged).alias("_s"))
    prev = F.slice(F.concat(F.array(F.lit(None).cast("struct<phrase:string,pos:int>")), F.col("_s")), 1,
                   F.size("_s"))
    marked = F.zip_with("_s", prev, lambda a, b: F.struct(
        a["phrase"].alias("phrase"), a["pos"].alias("pos"),
        (~a["phrase"].eqNullSafe(b["phrase"])).alias("start")))
    s2 = s1.select(*keep, "_s", marked.alias("_m"))
    starts_at = F.filter(F.transform("_m", lambda x, i: F.when(x["start"], i).otherwise(F.lit(-1))),
                         lambda i: i >= 0)
    s3 = s2.select(*keep, "_s", F.filter("_m", lambda x: x["start"]).alias("_firsts"), starts_at.alias("_st"))
    ends = F.slice(F.concat("_st", F.array(F.size("_s"))), 2, F.size("_st"))
    counts = F.zip_with("_st", ends, lambda a, b: b - a)
    ranked = F.sort_array(F.zip_with("_firsts", counts, lambda f, c: F.struct(
        (-c).alias("neg_count"), f["pos"].alias("pos"), f["phrase"].alias("phrase"))))
    top = F.filter(F.slice(ranked, 1, TOPIC_LIMIT), lambda e: -e["neg_count"] >= TOPIC_MIN_COUNT)
    return s3.select(*keep, F.transform(top, lambda e: e["phrase"]).alias(out_col))


def annotate_documents(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Counts, page estimate, language guess, academic indicators and topics
    (computed on the raw text, as the chunk metadata is)."""
    t = F.col(text_col)
    out = df.select(
        "*",
        tx.char_count(t).alias("total_characters"),
        tx.word_count(t).alias("total_words"),
        tx.estimated_pages(t).alias("estimated_pages"),
        tx.language_guess(t).alias("language"),
        tx.academic_indicators(t).alias("academic_indicators"),
    )
    return with_topics(out, text_col)


def path_metadata(df: DataFrame, path_col: str = "path") -> DataFrame:
    """file_type (lower-cased suffix), filename (stem), chapter, page, date and
    a validated ``date_value`` from the final path component."""
    p = F.col(path_col)
    return df.select(
        "*",
        tx.path_suffix(p).alias("file_type"),
        tx.path_stem(p).alias("filename"),
        tx.chapter_from_name(p).alias("chapter"),
        tx.page_from_name(p).alias("page"),
        tx.date_from_name(p).alias("date"),
    ).withColumn("date_value", tx.valid_date("date"))


def with_content_ids(chunks: DataFrame, text_col: str = "text", metadata_cols: list[str] | None = None,
                     out_col: str = "chunk_uid") -> DataFrame:
    """``16 hex of MD5(text)`` + ``_`` + ``8 hex of MD5(JSON of name-sorted metadata)``.

    Run-time values (timestamps) are never part of the metadata, so the id is
    stable across runs.
    """
    meta = tx.sorted_struct(*metadata_cols) if metadata_cols else None
    return chunks.withColumn(out_col, tx.content_id(text_col, meta))
