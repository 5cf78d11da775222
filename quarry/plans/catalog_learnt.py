"""Registered queries whose models are learnt from the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import stopwords
from quarry.operators import heavy, language, lexical, sentences
from quarry.plans.catalog import _vocab_sql, register
from quarry.plans.tables import load
from quarry.session import materialize

# Language profiles are learnt from the documents whose id leaves another remainder.
HELD_OUT = (5, 0)

_GRAMS = f"""framed AS (
  SELECT doc_id, lang, '_' || regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}]+', '_', 'g'), '^_|_$', '', 'g') || '_' AS s
  FROM documents),
cut AS (SELECT doc_id, lang, s, string_split(s, '') AS c FROM framed),
grams AS (
  SELECT doc_id, lang, c[i] || c[i + 1] || c[i + 2] AS gram
  FROM (SELECT doc_id, lang, c, unnest(range(1, len(c) - 1)) AS i FROM cut)),
counts AS (SELECT lang, gram, count(*) AS n FROM grams WHERE lang IS NOT NULL AND doc_id % {HELD_OUT[0]} <> {HELD_OUT[1]} GROUP BY ALL),
profile AS (
  SELECT lang, gram, r - 1 AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS r FROM counts)
  WHERE r <= {language.PROFILE_SIZE})"""


@register("language_profiles", lambda: f"WITH {_GRAMS} SELECT lang, gram, rank::BIGINT AS rank FROM profile")
def q_language_profiles(spark, sf_dir):
    """The ranked trigrams of each language, from all documents but the held-out ones."""
    docs = load(spark, sf_dir, "documents").where(F.col("doc_id") % HELD_OUT[0] != HELD_OUT[1])
    return language.learn_profiles(docs).select("lang", "gram", F.col("rank").cast("long").alias("rank"))


@register("language_identified", lambda: f"""WITH {_GRAMS},
met AS (SELECT g.doc_id, p.lang, sum({language.PROFILE_SIZE} - p.rank) AS total FROM grams g JOIN profile p USING (gram) GROUP BY ALL),
size AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY total DESC, lang) AS r FROM met) WHERE r = 1)
SELECT d.doc_id, d.doc_id % {HELD_OUT[0]} = {HELD_OUT[1]} AS held_out, d.lang, b.lang AS language,
       round(coalesce(b.total / (s.n * {language.PROFILE_SIZE}), 0.0), 6)::DOUBLE AS score
FROM documents d LEFT JOIN best b USING (doc_id) LEFT JOIN size s USING (doc_id)""")
def q_language_identified(spark, sf_dir):
    """The language of every document by profiles that the held-out documents had no part in."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = language.learn_profiles(docs.where(F.col("doc_id") % HELD_OUT[0] != HELD_OUT[1]))
    found = language.identify(docs, profiles)
    return found.select("doc_id", (F.col("doc_id") % HELD_OUT[0] == HELD_OUT[1]).alias("held_out"), "lang", "language",
                        F.round("language_score", 6).alias("score"))


_TOKENS = """tok AS (
  SELECT unnest(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) AS x FROM documents),
typed AS (
  SELECT regexp_matches(x, '^[\\p{L}\\p{N}_.''-]*\\p{L}[\\p{L}\\p{N}_.''-]*\\.$') AS stop,
    lower(CASE WHEN regexp_matches(x, '^[\\p{L}\\p{N}_.''-]*\\p{L}[\\p{L}\\p{N}_.''-]*\\.$') THEN x[:-2]
      ELSE regexp_extract(x, '^[^\\p{L}\\p{N}]*([\\p{L}\\p{N}_.''-]*\\p{L}[\\p{L}\\p{N}_''-]*)[^\\p{L}\\p{N}]*$', 1) END) AS type FROM tok)"""


@register("sentence_scores", lambda: f"""WITH {_TOKENS},
c AS (SELECT type, count(*) FILTER (WHERE stop) AS k, count(*) AS n FROM typed WHERE type <> '' GROUP BY type),
w AS (SELECT sum(k)::DOUBLE / sum(n) AS p FROM c),
s AS (SELECT type, k, n, length(type) - length(replace(type, '.', '')) AS inner_stops,
        -2 * ((k * ln(greatest(p, 1e-300)) + (n - k) * ln(greatest(1 - p, 1e-300)))
              - (k * ln({sentences.SURE}) + (n - k) * ln(1 - {sentences.SURE}))) AS ratio FROM c, w WHERE k > 0)
SELECT type, k::BIGINT AS n_stop, (n - k)::BIGINT AS n_plain,
       round(ratio * (inner_stops + 1) * exp(-(length(type) - inner_stops)) * exp(-(n - k) / k::DOUBLE), 6) AS score FROM s""")
def q_sentence_scores(spark, sf_dir):
    """How much every type that stands with a full stop looks like an abbreviation."""
    scores = sentences.abbreviation_scores(load(spark, sf_dir, "documents"))
    return scores.select("type", "n_stop", "n_plain", F.round("score", 6).alias("score"))


@register("vocab_heavy", lambda: _vocab_sql())
def q_vocab_heavy(spark, sf_dir):
    """The vocabulary by bounded summaries and an exact second pass."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    lists = materialize(lexical.term_lists(docs, "doc_id", "text", stopwords.english(), 2), "terms")
    totals = heavy.heavy_terms(lists, lexical.MAX_FEATURES)
    found = lexical.weighted_terms(totals, lists.count(), lexical.MAX_FEATURES)
    return found.select("term", F.col("df").cast("long").alias("df"), F.col("cf").cast("long").alias("cf"), F.round("idf", 6).alias("idf"))
