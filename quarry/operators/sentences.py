"""Sentence boundaries learnt from the corpus itself, without labels.

A full stop ends a sentence or marks an abbreviation.  Abbreviations stand with their stop
much more often than chance would have it, are short, and may hold stops inside: a type's
score is Dunning's log-likelihood ratio of "stands with a stop", times the number of inner
stops and one, and falls with its length and with its uses without a stop (Kiss and Strunk,
2006).  Sentence starters are types that follow a sentence's end more often than chance.

All statistics are combinable counts over the corpus's tokens; the scores are columns.
``split_sentences`` then cuts a text after ``.``, ``!`` or ``?`` and white space, but not after an
abbreviation, unless a capitalised sentence starter follows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.session import materialize

# Fixed values of the published method: the least scores of an abbreviation and of a starter,
# and how sure a type must be to stand with its stop.
ABBREVIATION_SCORE = 0.3
STARTER_SCORE = 30.0
SURE = 0.99
# Types that the splitter holds; the best scored come first.
MOST_TYPES = 50_000

# A token with a stop: letters, digits and inner stops, at least one letter, then one stop.
STOPPED = r"^([\p{L}\p{N}_.'-]*\p{L}[\p{L}\p{N}_.'-]*)\.$"
PLAIN = r"^[^\p{L}\p{N}]*([\p{L}\p{N}_.'-]*\p{L}[\p{L}\p{N}_'-]*)[^\p{L}\p{N}]*$"
BOUNDARY = r"(?<=[.!?])\s+"


def _types(text: Column) -> Column:
    """Tokens as structs (type, stop): the lower-cased type, and whether it stands with a stop."""
    tokens = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != "")
    return F.transform(tokens, lambda x: F.struct(
        F.lower(F.when(x.rlike(STOPPED), F.regexp_extract(x, STOPPED, 1)).otherwise(F.regexp_extract(x, PLAIN, 1))).alias("type"),
        x.rlike(STOPPED).alias("stop"), x.rlike(r"[.!?][\"')\]]*$").alias("end"), x.rlike(r"^[^\p{L}\p{N}]*\p{Lu}").alias("upper")))


def _log_likelihood(n: Column, k: Column, p0: Column, p1: Column) -> Column:
    """-2 log of the ratio of k successes of n under p0 and under p1."""
    def log(p):
        return F.log(F.greatest(p, F.lit(1e-300)))

    return -2 * ((k * log(p0) + (n - k) * log(1 - p0)) - (k * log(p1) + (n - k) * log(1 - p1)))


def abbreviation_scores(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(type, n_stop, n_plain, score) of every type that stands with a stop."""
    t = docs.select(F.explode(_types(F.col(text_col))).alias("t")).select("t.type", "t.stop").where("type <> ''")
    counts = materialize(t.groupBy("type").agg(F.sum(F.col("stop").cast("long")).alias("n_stop"), F.count(F.lit(1)).alias("n")), "types")
    whole = counts.agg(F.sum("n_stop"), F.sum("n")).first()
    share = (whole[0] or 0) / max(whole[1] or 0, 1)
    inner = F.length("type") - F.length(F.replace("type", F.lit("."), F.lit("")))
    letters = F.length("type") - inner
    ratio = _log_likelihood(F.col("n"), F.col("n_stop"), F.lit(share), F.lit(SURE))
    score = ratio * (inner + 1) * F.exp(-letters.cast("double")) * F.exp(-(F.col("n") - F.col("n_stop")) / F.col("n_stop"))
    return counts.where("n_stop > 0").select("type", "n_stop", (F.col("n") - F.col("n_stop")).alias("n_plain"), score.alias("score"))


def starter_scores(docs: DataFrame, abbreviations: list[str], text_col: str = "text") -> DataFrame:
    """(type, n_start, n, score): how much more often than chance a type follows a sentence's end."""
    known = F.array(*[F.lit(a) for a in abbreviations]) if abbreviations else F.array().cast("array<string>")
    tokens = docs.select(_types(F.col(text_col)).alias("t"))
    pairs = tokens.select(F.explode(F.transform("t", lambda x, i: F.struct(
        x["type"].alias("type"), F.when(i > 0, F.get("t", i - 1)).alias("before")))).alias("p"))
    starts = F.coalesce(F.col("p.before.end") & ~(F.col("p.before.stop") & F.array_contains(known, F.col("p.before.type"))), F.lit(False))
    counts = materialize(pairs.where("p.type <> ''").groupBy(F.col("p.type").alias("type"))
                         .agg(F.sum(starts.cast("long")).alias("n_start"), F.count(F.lit(1)).alias("n")), "starts")
    whole = counts.agg(F.sum("n_start"), F.sum("n")).first()
    p, p1 = F.lit((whole[0] or 0) / max(whole[1] or 0, 1)), F.col("n_start") / F.col("n")
    more = F.when(p1 > p, _log_likelihood(F.col("n"), F.col("n_start"), p, p1)).otherwise(F.lit(0.0))
    return counts.where("n_start > 0").select("type", "n_start", "n", more.alias("score"))


@dataclass
class Boundaries:
    """What the splitter needs: types, at most ``MOST_TYPES`` of each kind."""

    abbreviations: frozenset[str]
    starters: frozenset[str] = field(default_factory=frozenset)


def learn(docs: DataFrame, text_col: str = "text") -> Boundaries:
    def best(scores: DataFrame, least: float) -> list[str]:
        rows = scores.where(F.col("score") >= least).orderBy(F.desc("score"), "type").limit(MOST_TYPES).select("type").collect()
        return [r["type"] for r in rows]

    short = best(abbreviation_scores(docs, text_col), ABBREVIATION_SCORE)
    return Boundaries(frozenset(short), frozenset(best(starter_scores(docs, short, text_col), STARTER_SCORE)))


def split_sentences(text: Column, known: Boundaries) -> Column:
    """array<string>: the text's sentences, white space between them gone."""
    abbreviations, starters = known.abbreviations, known.starters

    def merged(parts):
        """Parts that the plain rule has cut after an abbreviation are put together again."""
        out: list[str] = []
        for part in parts:
            words = part.split()
            last = out[-1].split()[-1] if out and out[-1].split() else ""
            first = words[0].strip("\"'([").rstrip(".,;:!?)]\"'") if words else ""
            held = last.endswith(".") and last[:-1].lstrip("\"'([").lower() in abbreviations
            if held and not (first[:1].isupper() and first.lower() in starters):
                out[-1] += " " + part
            else:
                out.append(part)
        return out

    @F.pandas_udf("array<string>")
    def join(parts: pd.Series) -> pd.Series:
        return parts.map(lambda p: None if p is None else merged(list(p)))

    return join(F.split(text, BOUNDARY))
