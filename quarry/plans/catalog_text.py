"""Registered annotation queries (counts, language, flags, topics, ids, paths, stats, chunkers)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators import annotate, chunking, reports
from quarry.plans import sqlparts as sq
from quarry.plans.catalog import register
from quarry.plans.tables import load

NUMBERING_SIZE, NUMBERING_OVERLAP = 500, 100


@register("text_counts", lambda: f"""SELECT doc_id, length(text)::BIGINT AS n_chars,
  {sq.word_count('text')}::BIGINT AS n_words,
  greatest(1, length(text) // {tx.CHARS_PER_PAGE})::BIGINT AS est_pages FROM documents""")
def q_text_counts(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    return d.select("doc_id", tx.char_count("text").cast("long").alias("n_chars"),
                    tx.word_count("text").cast("long").alias("n_words"),
                    tx.estimated_pages("text").cast("long").alias("est_pages"))


def _lang_sql() -> str:
    hits = f"len(list_intersect(list_distinct({sq.split_words('lower(text)')}), {sq.str_list(tx.ENGLISH_FUNCTION_WORDS)}))"
    return f"""SELECT doc_id, {hits}::BIGINT AS english_hits,
  CASE WHEN {hits} > {tx.ENGLISH_MIN_HITS} THEN 'english' ELSE 'unknown' END AS language FROM documents"""


@register("language_flag", _lang_sql)
def q_language(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    return d.select("doc_id", tx.english_hits("text").cast("long").alias("english_hits"),
                    tx.language_guess("text").alias("language"))


def _flags_sql() -> str:
    nw = sq.NONWORD
    words = "|".join(tx.ACADEMIC_STRUCTURE_WORDS)
    cites = "|".join(tx.CITATION_MARKERS)
    st = f"regexp_matches(lower(text), '(^|{nw})({words})($|{nw})')"
    yr = f"regexp_matches(text, '(^|{nw})\\p{{Nd}}{{4}}($|{nw})')"
    ci = f"regexp_matches(lower(text), '(^|{nw})({cites}){sq.WORD}')"
    au = f"regexp_matches(text, '{tx.AUTHOR_CITATION}')"
    return f"""SELECT doc_id, {st} AS academic_structure, {yr} AS year_references, {ci} AS citation_style,
  {au} AS author_citations, ({st}::INT + {yr}::INT + {ci}::INT + {au}::INT)::BIGINT AS n_indicators FROM documents"""


@register("academic_flags", _flags_sql)
def q_flags(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    return d.select("doc_id", tx.has_academic_structure("text").alias("academic_structure"),
                    tx.has_year_reference("text").alias("year_references"),
                    tx.has_citation_style("text").alias("citation_style"),
                    tx.has_author_citation("text").alias("author_citations"),
                    F.size(tx.academic_indicators("text")).cast("long").alias("n_indicators"))


def _topics_sql() -> str:
    return f"""WITH _r AS (SELECT doc_id, regexp_extract_all(text, '{sq.WORD}+|{sq.NONWORD}+') AS rs FROM documents),
_runs AS (SELECT doc_id, unnest(rs) AS r, generate_subscripts(rs, 1) AS i FROM _r),
_cls AS (SELECT doc_id, i, r, regexp_full_match(r, '[A-Z][a-z]+') AS cap, regexp_full_match(r, '{sq.WS}+') AS ws
         FROM _runs),
_nb AS (SELECT *, coalesce(lag(cap) OVER w, false) AS pcap, coalesce(lead(cap) OVER w, false) AS ncap,
               coalesce(lag(ws) OVER w, false) AS pws, coalesce(lag(cap, 2) OVER w, false) AS p2cap
        FROM _cls WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
_mem AS (SELECT doc_id, i, r, cap, (cap AND NOT (pws AND p2cap)) AS start
         FROM _nb WHERE cap OR (ws AND pcap AND ncap)),
_ph AS (SELECT *, sum(start::INT) OVER (PARTITION BY doc_id ORDER BY i) AS pid FROM _mem),
_phr AS (SELECT doc_id, pid, string_agg(r, '' ORDER BY i) AS phrase, min(i) AS pos, sum(cap::INT) AS nw
         FROM _ph GROUP BY doc_id, pid),
_cnt AS (SELECT doc_id, phrase, count(*) AS c, min(pos) AS first_pos FROM _phr
         WHERE nw <= {annotate.TOPIC_MAX_WORDS} GROUP BY ALL),
_top AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, first_pos) AS topic_rank FROM _cnt)
SELECT doc_id, topic_rank::BIGINT AS topic_rank, phrase AS topic FROM _top
WHERE topic_rank <= {annotate.TOPIC_LIMIT} AND c >= {annotate.TOPIC_MIN_COUNT}"""


@register("topics", _topics_sql)
def q_topics(spark, sf_dir):
    d = annotate.with_topics(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return (d.select("doc_id", F.posexplode_outer("potential_topics").alias("p", "topic"))
            .where(F.col("topic").isNotNull()).select("doc_id", (F.col("p") + 1).cast("long").alias("topic_rank"), "topic"))


_META = ["chunk_end_char", "chunk_index", "chunk_size", "chunk_start_char", "doc_id", "lang", "source"]


def _doc_ids_sql() -> str:
    fields = ", ".join(f"{c} := {c}" for c in sorted(_META))
    return f"""WITH {sq.chunks_cte()},
_c AS (SELECT c.doc_id, c.chunk_index::INT AS chunk_index, length(c.text)::INT AS chunk_size,
              c.chunk_start_char::INT AS chunk_start_char, (c.chunk_start_char + length(c.text))::INT AS chunk_end_char,
              d.lang, d.source, c.text
       FROM chunks c JOIN documents d USING (doc_id))
SELECT doc_id, chunk_index::BIGINT AS chunk_index,
       substring(md5(text), 1, 16) || '_' || substring(md5(to_json(struct_pack({fields}))), 1, 8) AS chunk_uid
FROM _c"""


@register("doc_ids", _doc_ids_sql)
def q_doc_ids(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    ch = chunking.chunk_fixed(docs, keep=["doc_id", "lang", "source"], first_occurrence=True)
    ids = annotate.with_content_ids(ch, metadata_cols=_META)
    return ids.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk_uid")


def _path_sql_parts() -> dict[str, str]:
    name = r"regexp_extract(url, '([^/]+)/*$', 1)"
    raw_suffix = rf"regexp_extract({name}, '^.+(\.[^.]+)$', 1)"
    stem = f"left({name}, length({name}) - length({raw_suffix}))"
    date = (f"CASE WHEN regexp_matches({stem}, '{tx.DATE_PATTERN}') THEN "
            f"regexp_extract({stem}, '{tx.DATE_PATTERN}', 1) || '-' || regexp_extract({stem}, '{tx.DATE_PATTERN}', 2)"
            f" || '-' || regexp_extract({stem}, '{tx.DATE_PATTERN}', 3) END")
    return {
        "file_type": f"lower({raw_suffix})",
        "filename": stem,
        "chapter": f"TRY_CAST(nullif(regexp_extract(lower({stem}), '{tx.CHAPTER_PATTERN}', 1), '') AS INT)::VARCHAR",
        "page": f"TRY_CAST(nullif(regexp_extract(lower({stem}), '{tx.PAGE_PATTERN}', 1), '') AS INT)::VARCHAR",
        "date": date,
        "date_valid": f"try_strptime({date}, '%Y-%m-%d') IS NOT NULL",
    }


@register("path_meta", lambda: "SELECT page_id, " + ", ".join(
    f"{v} AS {k}" for k, v in _path_sql_parts().items()) + " FROM pages")
def q_path_meta(spark, sf_dir):
    p = annotate.path_metadata(load(spark, sf_dir, "pages").select("page_id", "url"), "url")
    # chapter/page are mostly absent: emitted as nullable strings
    return p.select("page_id", "file_type", "filename", F.col("chapter").cast("string").alias("chapter"),
                    F.col("page").cast("string").alias("page"), "date",
                    F.col("date_value").isNotNull().alias("date_valid"))


@register("safe_name", lambda: f"""SELECT page_id, substring(regexp_replace(regexp_replace(url,
  '{tx.UNSAFE_NAME_CHARS}', '_', 'g'), '^[ .]+|[ .]+$', '', 'g'), 1, {tx.SAFE_NAME_MAX}) AS safe FROM pages""")
def q_safe_name(spark, sf_dir):
    p = load(spark, sf_dir, "pages")
    return p.select("page_id", tx.safe_name("url").alias("safe"))


@register("corpus_stats", lambda: f"""WITH {sq.chunks_cte()}
SELECT count(*)::BIGINT AS total_chunks, sum(length(text))::BIGINT AS chunk_characters,
  sum({sq.word_count('text')})::BIGINT AS total_words, round(avg(length(text)), 6) AS average_chunk_size,
  min(length(text))::BIGINT AS min_chunk_size, max(length(text))::BIGINT AS max_chunk_size
FROM chunks HAVING count(*) > 0""")
def q_corpus_stats(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    s = reports.corpus_stats(chunking.chunk_fixed(docs, keep=["doc_id"]))
    return s.withColumn("average_chunk_size", F.round("average_chunk_size", 6))


@register("type_distribution", lambda: f"""SELECT coalesce({_path_sql_parts()['file_type']}, 'unknown') AS file_type,
  count(*)::BIGINT AS n FROM pages GROUP BY 1""")
def q_type_distribution(spark, sf_dir):
    p = annotate.path_metadata(load(spark, sf_dir, "pages").select("url"), "url")
    return reports.type_distribution(p)


@register("chunk_numbering", lambda: f"""WITH {sq.chunks_cte(size=NUMBERING_SIZE, overlap=NUMBERING_OVERLAP)}
SELECT doc_id, chunk_index::BIGINT AS chunk_index, chunk_number::BIGINT AS chunk_number,
       total_chunks::BIGINT AS total_chunks, window_start::BIGINT AS window_start FROM chunks""")
def q_chunk_numbering(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    c = chunking.chunk_fixed(docs, keep=["doc_id"], size=NUMBERING_SIZE, overlap=NUMBERING_OVERLAP)
    return c.select("doc_id", *[F.col(n).cast("long").alias(n) for n in (
        "chunk_index", "chunk_number", "total_chunks", "window_start")])


def _sentences_sql() -> str:
    mark = "chr(57344)"
    mw = chunking.SENTENCE_MAX_WORDS
    return f"""WITH _s AS (
  SELECT doc_id, string_split(regexp_replace(text, '([.!?]){sq.WS}+', '\\1' || {mark}, 'g'), {mark}) AS ss
  FROM documents),
_wc AS (SELECT doc_id, i, s, {sq.word_count('s')} AS w FROM
        (SELECT doc_id, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM _s)),
_pack AS (
  WITH RECURSIVE p(doc_id, i, grp, total) AS (
    SELECT doc_id, i, CASE WHEN w > {mw} THEN 1 ELSE 0 END, w FROM _wc WHERE i = 1
    UNION ALL
    SELECT c.doc_id, c.i,
           CASE WHEN p.total + c.w > {mw} THEN p.grp + 1 ELSE p.grp END,
           CASE WHEN p.total + c.w > {mw} THEN c.w ELSE p.total + c.w END
    FROM p JOIN _wc c ON c.doc_id = p.doc_id AND c.i = p.i + 1)
  SELECT * FROM p),
_chunks AS (SELECT w.doc_id, p.grp, string_agg(w.s, ' ' ORDER BY w.i) AS text
            FROM _wc w JOIN _pack p USING (doc_id, i) GROUP BY w.doc_id, p.grp)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY grp) - 1)::BIGINT AS chunk_index,
       {sq.word_count('text')}::BIGINT AS n_words, md5(text) AS chunk_md5
FROM _chunks WHERE text <> ''"""


@register("chunk_sentences", _sentences_sql)
def q_chunk_sentences(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    c = chunking.chunk_sentences(docs, keep=["doc_id"])
    return c.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"),
                    F.col("n_words").cast("long").alias("n_words"), F.md5("text").alias("chunk_md5"))


def _sep_sql() -> str:
    size, ov, half = chunking.CHUNK_SIZE, chunking.CHUNK_OVERLAP, chunking.CHUNK_SIZE // 2

    def end(st: str) -> str:
        win = f"substring(s, {st} + 1, {size})"
        last = f"length(regexp_extract({win}, '(?s)^(.*)\\n', 1))"
        return (f"CASE WHEN {st} + {size} < n AND regexp_matches({win}, '\\n') AND {last} > {half} "
                f"THEN {st} + {last} + 1 ELSE {st} + {size} END")

    def strip(x: str) -> str:
        return f"regexp_replace({x}, '^{sq.WS}+|{sq.WS}+$', '', 'g')"

    return f"""WITH RECURSIVE d AS (SELECT doc_id, text AS s, length(text) AS n FROM documents),
w(doc_id, st, en) AS (
  SELECT doc_id, 0, {end('0')} FROM d WHERE n > {size}
  UNION ALL
  SELECT w.doc_id, w.en - {ov}, {end(f'(w.en - {ov})')}
  FROM w JOIN d USING (doc_id) WHERE w.en - {ov} < d.n),
pieces AS (
  SELECT doc_id, st, {strip('substring(s, st + 1, least(en, n) - st)')} AS piece, false AS single
  FROM w JOIN d USING (doc_id)
  UNION ALL SELECT doc_id, 0, s, true FROM d WHERE n <= {size}),
ne AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY st) - 1 AS chunk_index FROM pieces
       WHERE single OR piece <> ''),
kept AS (SELECT * FROM ne WHERE length({strip('piece')}) >= {chunking.MIN_CHUNK_LENGTH})
SELECT doc_id, chunk_index::BIGINT AS chunk_index,
       row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index)::BIGINT AS chunk_number,
       count(*) OVER (PARTITION BY doc_id)::BIGINT AS total_chunks, st::BIGINT AS window_start,
       md5(piece) AS chunk_md5
FROM kept"""


@register("chunk_sep", _sep_sql)
def q_chunk_sep(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    c = chunking.chunk_separator(docs, keep=["doc_id"])
    return c.select("doc_id", *[F.col(n).cast("long").alias(n) for n in (
        "chunk_index", "chunk_number", "total_chunks", "window_start")], F.md5("text").alias("chunk_md5"))
