"""DuckDB SQL for the operators that SQL can express (the others are tested
against brute force, an exact round trip or held-out accuracy)."""

from __future__ import annotations

from quarry.llm import dual_tree, license_scan, line_dedup, prefix_trie, substring_dedup

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def embedding_sql(threshold: float = 0.95) -> str:
    """All pairs, and the reachable set of every vector by recursion."""
    return f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
         WHERE list_cosine_similarity(a.e, b.e) >= {threshold}),
reach AS (SELECT vec_id AS s, vec_id AS t FROM v UNION SELECT r.s, l.b FROM reach r JOIN link l ON l.a = r.t),
least AS (SELECT s, min(t) AS component_id FROM reach GROUP BY s)
SELECT v.vec_id, (SELECT count(*) FROM link WHERE a = v.vec_id)::BIGINT AS n_links, component_id::BIGINT AS component_id,
       v.vec_id = component_id AS kept
FROM v JOIN least ON s = v.vec_id"""


def decontamination_sql(window: int = 10) -> str:
    """Every window of every item against every word position of every document."""
    return f"""WITH doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
item AS (SELECT item_id::VARCHAR AS item_id, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), {window}) AS n, array_to_string(list_slice(w, i, i + least(len(w), {window}) - 1), ' ') AS x
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {window} + 1, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
size AS (SELECT DISTINCT n FROM win),
place AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, size WHERE len(w) >= n),
met AS (
  SELECT p.doc_id, p.i, p.n, win.item_id FROM place p JOIN win ON win.n = p.n
   AND win.x = array_to_string(list_slice(p.w, p.i, p.i + p.n - 1), ' ')),
hit AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM met) GROUP BY doc_id),
ids AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS s FROM met GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(s.n, 0)::BIGINT AS n_items,
       sha256(coalesce(s.s, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM doc d LEFT JOIN hit h USING (doc_id) LEFT JOIN ids s USING (doc_id)"""


def tool_calls_sql() -> str:
    """Every need points two turns back, so a call's place is its turn."""
    words = "len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> ''))"
    known = "(SELECT conv_id, turn FROM conversations WHERE role = 'user')"
    return f"""WITH t AS (SELECT conv_id, turn, role, text, {words} AS words FROM conversations),
call AS (
  SELECT t.*, 'call-' || t.conv_id || '-' || t.turn AS call_id, CASE WHEN t.turn < 2 THEN 'ask' ELSE 'follow_up' END AS name,
         (SELECT min((r.turn, r.text)) FROM t r WHERE r.role = 'assistant' AND r.conv_id = t.conv_id AND r.turn = t.turn + 1) AS r,
         (SELECT count(*) FROM t r WHERE r.role = 'assistant' AND r.conv_id = t.conv_id AND r.turn = t.turn + 1) AS n_results,
         CASE WHEN t.turn >= 2 AND NOT EXISTS (SELECT 1 FROM {known} k WHERE k.conv_id = t.conv_id AND k.turn = t.turn - 2)
              THEN 1 ELSE 0 END AS missing
  FROM t WHERE role = 'user'),
checked AS (
  SELECT *, concat_ws('; ', CASE WHEN text IS NULL THEN '$.prompt: required' WHEN text = '' THEN '$.prompt: minLength' END,
    CASE WHEN words < 1 THEN '$.words: minimum' END, CASE WHEN words > 60 THEN '$.words: maximum' END) AS errors FROM call)
SELECT conv_id, turn, call_id, 'call' AS kind, name, turn AS place, n_results::BIGINT AS n_results, missing::BIGINT AS missing,
       errors = '' AS valid, errors,
       '{{"arguments":{{' || CASE WHEN text IS NULL THEN '' ELSE '"prompt":' || to_json(text)::VARCHAR || ',' END
         || '"turn":' || turn || ',"words":' || words || '}},"call_id":' || to_json(call_id)::VARCHAR || ',"depends_on":['
         || CASE WHEN turn >= 2 THEN to_json('call-' || conv_id || '-' || (turn - 2))::VARCHAR ELSE '' END
         || '],"name":"' || name || '","result":' || coalesce(to_json(r[2])::VARCHAR, 'null') || '}}' AS json
FROM checked
UNION ALL
SELECT conv_id, turn, 'call-' || conv_id || '-' || (turn - 1), 'orphan', NULL, NULL, 0, 0, false, 'no call',
       '{{"call_id":' || to_json('call-' || conv_id || '-' || (turn - 1))::VARCHAR || ',"result":'
         || coalesce(to_json(text)::VARCHAR, 'null') || '}}'
FROM t WHERE role = 'assistant'
  AND NOT EXISTS (SELECT 1 FROM {known} k WHERE k.conv_id = t.conv_id AND k.turn = t.turn - 1)
UNION ALL
SELECT t.conv_id, t.turn, c.call_id, 'extra', c.name, c.turn, c.n_results::BIGINT, 0, true, '',
       '{{"call_id":' || to_json(c.call_id)::VARCHAR || ',"result":' || coalesce(to_json(t.text)::VARCHAR, 'null') || '}}'
FROM t JOIN (SELECT DISTINCT conv_id, turn, call_id, name, n_results, r FROM checked) c ON c.conv_id = t.conv_id AND c.turn = t.turn - 1
WHERE t.role = 'assistant' AND (t.turn, t.text) IS DISTINCT FROM c.r"""


def lines_sql(source: str, key: str, host: str, text: str, ratio: float = line_dedup.RATIO,
              min_pages: int = line_dedup.MIN_PAGES) -> str:
    """CTEs ``page`` and ``left_lines`` (key, n_lines, n_dropped, text): line removal over ``source``,
    where pages of one text count once."""
    return f"""page AS (SELECT {key} AS k, {host} AS host, {text} AS text FROM {source}),
line AS (
  SELECT k, host, body, i, x, trim(x) AS s FROM (
    SELECT k, host, md5(coalesce(text, '')) AS body, unnest(string_split(coalesce(text, ''), chr(10))) AS x,
           unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM page)),
total AS (SELECT host, count(DISTINCT coalesce(text, '')) AS total FROM page GROUP BY host),
bad AS (
  SELECT l.host, s FROM (SELECT host, s, count(DISTINCT body) AS n FROM line WHERE s <> '' GROUP BY host, s) l
  JOIN total t ON l.host IS NOT DISTINCT FROM t.host WHERE n >= {min_pages} AND n / total::DOUBLE > {ratio}),
marked AS (SELECT l.*, b.s IS NOT NULL AS bad FROM line l LEFT JOIN bad b ON l.host IS NOT DISTINCT FROM b.host AND l.s = b.s),
left_lines AS (
  SELECT k, count(*) FILTER (WHERE s <> '') AS n_lines, count(*) FILTER (WHERE bad) AS n_dropped,
         coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (WHERE NOT bad), '') AS text FROM marked GROUP BY k)"""


def line_dedup_sql() -> str:
    host = f"lower(regexp_extract(url, '{line_dedup.HOST}', 1))"
    text = f"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '{line_dedup.HIDDEN}', '', 'g'),
        '{line_dedup.BLOCK}', chr(10), 'g'), '{line_dedup.TAG}', '', 'g'), '[ \\t\\r]*\\n[ \\t\\r\\n]*', chr(10), 'g'), '^\\n|\\n$', '', 'g')"""
    return f"""WITH {lines_sql('pages', 'page_id', host, text)}
SELECT p.k AS page_id, p.host, l.n_lines::BIGINT AS n_lines, l.n_dropped::BIGINT AS n_dropped,
       md5(CASE WHEN l.n_dropped = 0 THEN p.text ELSE l.text END) AS text_md5
FROM page p JOIN left_lines l USING (k)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_embedding_dedup": embedding_sql(),
        "op2_license_scan": license_scan.report_sql(),
        "op3_decontamination": decontamination_sql(),
        "op6_tool_calls": tool_calls_sql(),
        "op8_line_dedup": line_dedup_sql(),
        "op10_substring_dedup": substring_dedup.repeats_sql(),
        "op11_lexical_search": dual_tree.search_sql(),
        "op13_prefix_trie": prefix_trie.trie_sql(),
    }
