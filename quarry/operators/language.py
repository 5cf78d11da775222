"""Language identification by ranked character trigrams.

A language's profile is its ``size`` most frequent trigrams, learnt from texts that are known
to be in it; the most frequent has the rank 0.  A trigram weighs ``size - rank`` in its
language and nothing in others.  A text's score for a language is the mean weight of the
trigrams in the whole text; the language of the highest score is its own.  Learning is one
combinable count per (language, trigram); profiles (languages x ``size`` entries) go to the
tasks, and texts are normalised and scored where they lie.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROFILE_SIZE = 300
GRAM = 3
# A word's edges; letters of all scripts are kept, the rest parts words.
EDGE = "_"


def framed(text: Column | str) -> Column:
    """The lower-cased words of a text, parted and framed by ``EDGE``."""
    t = F.col(text) if isinstance(text, str) else text
    words = F.regexp_replace(F.lower(F.coalesce(t, F.lit(""))), r"[^\p{L}]+", EDGE)
    return F.concat(F.lit(EDGE), F.regexp_replace(words, f"^{EDGE}|{EDGE}$", ""), F.lit(EDGE))


def trigrams(text: Column | str) -> Column:
    """All trigrams of ``framed``; a look-ahead matches at every character, so that they overlap."""
    return F.regexp_extract_all(framed(text), F.lit(f"(?=(.{{{GRAM}}}))"), 1)


def learn_profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE_SIZE) -> DataFrame:
    """(lang, gram, rank) of each language's ``size`` most frequent trigrams, ties by trigram."""
    known = docs.where(F.col(lang_col).isNotNull())
    counts = (known.select(F.col(lang_col).alias("lang"), F.explode(trigrams(text_col)).alias("gram")).groupBy("lang", "gram")
              .agg(F.count(F.lit(1)).alias("n")))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return counts.withColumn("rank", nth - 1).where(F.col("rank") < size).select("lang", "gram", "rank")


def identify(docs: DataFrame, profiles: DataFrame, text_col: str = "text", size: int = PROFILE_SIZE, lang_out: str = "language",
             score_out: str = "language_score") -> DataFrame:
    """``docs`` with the language of the highest score (ties: the first by name; null where no
    language has a trigram of the text) and that score, a share of ``size`` from 0 to 1."""
    rows = profiles.collect()  # languages x size
    languages = sorted({r["lang"] for r in rows})
    weights: dict[str, np.ndarray] = {}
    for r in rows:
        weights.setdefault(r["gram"], np.zeros(len(languages), np.int64))[languages.index(r["lang"])] = size - r["rank"]

    @F.pandas_udf("language string, score double")
    def score(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            grams = [text[i:i + GRAM] for i in range(len(text) - GRAM + 1)]
            known = [w for w in map(weights.get, grams) if w is not None]
            total = np.sum(known, axis=0) if known else np.zeros(1)
            best = int(np.argmax(total))
            out.append((languages[best], total[best] / (len(grams) * size)) if known else (None, 0.0))
        return pd.DataFrame(out, columns=["language", "score"])

    scored = docs.withColumn("_language", score(framed(text_col)))
    return scored.select(*docs.columns, F.col("_language.language").alias(lang_out), F.col("_language.score").alias(score_out))
