"""DuckDB SQL fragments used to build the independent oracle queries.

The oracle is a second, brute-force formulation of each operator in plain
SQL (DuckDB dialect, RE2 regular expressions, 1-based lists).  It shares no
code path with the Spark side except the fixed values (patterns, word lists).
"""

from __future__ import annotations

from quarry.functions import stopwords
from quarry.functions import text as tx

# RE2 has no look-around and its \s lacks \v; spell the Python whitespace set out.
WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WORD = r"[\p{L}\p{N}_]"
NONWORD = r"[^\p{L}\p{N}_]"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def str_list(words) -> str:
    return "[" + ", ".join(lit(w) for w in words) + "]"


def stop_list() -> str:
    return str_list(sorted(set(stopwords.english())))


def normalize(x: str) -> str:
    drop = r"[^\p{L}\p{N}_\s" + tx.KEEP_PUNCT + "]"
    return f"trim(regexp_replace(regexp_replace({x}, '{WS}+', ' ', 'g'), '{drop}', '', 'g'))"


def split_words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w: w <> '')"


def word_count(x: str) -> str:
    return f"len({split_words(x)})"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{tx.TOKEN}')"


def kept_tokens(x: str) -> str:
    return f"list_filter({tokens(x)}, lambda w: NOT list_contains({stop_list()}, w))"


def chunks_cte(source: str = "documents", id_col: str = "doc_id", text_col: str = "text",
               size: int = 1000, overlap: int = 200, min_len: int = 100, normalise: bool = True) -> str:
    """CTEs ``_norm``, ``_win``, ``chunks`` (doc_id, chunk_index, chunk_number,
    total_chunks, text, chunk_start_char)."""
    src = normalize(text_col) if normalise else text_col
    step = size - overlap
    return f"""
_norm AS (SELECT {id_col} AS doc_id, {src} AS s FROM {source}),
_starts AS (
  SELECT doc_id, s, length(s) <= {size} AS single,
         unnest(CASE WHEN length(s) <= {size} THEN [0::BIGINT]
                     ELSE generate_series(0, length(s) - 1, {step}) END) AS st
  FROM _norm),
_pieces AS (
  SELECT doc_id, s, st, CASE WHEN single THEN s ELSE trim(substring(s, st + 1, {size})) END AS piece, single
  FROM _starts),
_nonempty AS (
  SELECT doc_id, s, st, piece,
         row_number() OVER (PARTITION BY doc_id ORDER BY st) - 1 AS chunk_index
  FROM _pieces WHERE single OR piece <> ''),
_kept AS (SELECT * FROM _nonempty WHERE length(trim(piece)) >= {min_len}),
chunks AS (
  SELECT doc_id, chunk_index,
         row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) AS chunk_number,
         count(*) OVER (PARTITION BY doc_id) AS total_chunks,
         piece AS text, instr(s, piece) - 1 AS chunk_start_char, st AS window_start
  FROM _kept)"""


def tfidf_ctes(corpus: str, queries: str, max_features: int = 10000) -> str:
    """Given CTE names ``corpus(doc_id, text)`` and ``queries(query_id, text)``
    defines ``_vocab``, ``_post(doc_id, term, weight)``, ``_qv(query_id, term, qweight)``
    and ``_scores(query_id, doc_id, score)`` over every (query, document) pair."""
    return f"""
_dtok AS (SELECT doc_id, {kept_tokens('text')} AS w FROM {corpus}),
_dterms AS (
  SELECT doc_id, unnest(w) AS term FROM _dtok
  UNION ALL
  SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM _dtok),
_dtf AS (SELECT doc_id, term, count(*) AS tf FROM _dterms GROUP BY doc_id, term),
_vocab AS (
  SELECT term, count(*) AS df, sum(tf) AS cf,
         ln((1 + (SELECT count(*) FROM {corpus}))::DOUBLE / (1 + count(*))) + 1 AS idf
  FROM _dtf GROUP BY term ORDER BY cf DESC, term ASC LIMIT {max_features}),
_post AS (
  SELECT t.doc_id, t.term, t.tf * v.idf / sqrt(sum((t.tf * v.idf) * (t.tf * v.idf)) OVER (PARTITION BY t.doc_id)) AS weight
  FROM _dtf t JOIN _vocab v USING (term)),
_qtok AS (SELECT query_id, {kept_tokens('text')} AS w FROM {queries}),
_qterms AS (
  SELECT query_id, unnest(w) AS term FROM _qtok
  UNION ALL
  SELECT query_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM _qtok),
_qtf AS (SELECT query_id, term, count(*) AS tf FROM _qterms GROUP BY query_id, term),
_qv AS (
  SELECT q.query_id, q.term, q.tf * v.idf / sqrt(sum((q.tf * v.idf) * (q.tf * v.idf)) OVER (PARTITION BY q.query_id)) AS qweight
  FROM _qtf q JOIN _vocab v USING (term)),
_matched AS (
  SELECT q.query_id, p.doc_id, sum(p.weight * q.qweight) AS score
  FROM _qv q JOIN _post p USING (term) GROUP BY q.query_id, p.doc_id),
_scores AS (
  SELECT q.query_id, d.doc_id, coalesce(m.score, 0.0) AS score
  FROM (SELECT DISTINCT query_id FROM {queries}) q CROSS JOIN (SELECT doc_id FROM {corpus}) d
  LEFT JOIN _matched m ON m.query_id = q.query_id AND m.doc_id = d.doc_id)"""


def ranked(source: str, k: int, score: str = "score", ids: str = "doc_id") -> str:
    return f"""(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round({score}, 9) DESC, {ids}) AS rank
   FROM {source}) WHERE rank <= {k}"""
