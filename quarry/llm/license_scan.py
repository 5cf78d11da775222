"""Licence scan by a positional rare-token index, in DataFrame functions only.

The templates (licence titles, headers and notices) are indexed by word: a posting is a
template and a place in it.  One pass over the files keeps each file's word count, its
distinct licence words and, where some template's key phrases could be complete, its
words.  The licence words' document frequencies over all files give their IDF.  Of each
template's key phrases, which are mandatory, the ``ANCHORS`` words of the highest IDF are
its anchors: a file that matches holds them all, so looking up a file's anchors loses
nothing.  An anchor's places in the file less its place in the template are the positions
at which the template could stand; the anchors' lists are intersected, and at what is left
the mandatory key phrases are verified word by word.  Complete key phrases decide; the share
of the template's words that stand at their place is the alignment's score (``coverage``
can ask for a least share).

The template list is a bounded literal, so the index needs no join.

Defined results: a null or empty text has no words and score 0; repeated rows
give equal rows; a null id stays null; columns beside id and text are not read;
an empty table gives an empty result.  A very long text is one row's array of words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import stage

# Phrases and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}


@dataclass(frozen=True)
class Template:
    """A notice: its label, words and mandatory key phrases (each stands in ``text``)."""

    label: str
    text: str
    keys: tuple[str, ...]

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def required(self) -> list[int]:
        """Places of the key phrases' words."""
        w, out = self.words, set()
        for key in self.keys:
            k = key.split()
            at = next(i for i in range(len(w)) if w[i:i + len(k)] == k)
            out.update(range(at, at + len(k)))
        return sorted(out)


TEMPLATES = (
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("gpl-2.0", "gnu general public license version 2 june 1991", ("gnu general public license version 2",)),
    Template("gpl-3.0", "gnu general public license version 3 29 june 2007", ("gnu general public license version 3",)),
    Template("gpl-2.0", "either version 2 of the license or at your option any later version", ("either version 2 of the license",)),
    Template("gpl-3.0", "either version 3 of the license or at your option any later version", ("either version 3 of the license",)),
    Template("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("agpl", "licensed under the gnu affero general public license", ("gnu affero general public license",)),
    Template("mit-notice", "released under the mit license", ("under the mit license",)),
    Template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software",
             ("permission is hereby granted", "obtaining a copy")),
    Template("mit-text", "the software is provided as is without warranty of any kind express or implied",
             ("the software is provided as is without warranty of any kind express or implied",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
             ("redistribution and use", "source and binary forms")),
    Template("bsd", "redistributions of source code must retain the above copyright notice",
             ("redistributions of source code must retain the above copyright notice",)),
    Template("mpl-2.0", "mozilla public license version 2 0", ("mozilla public license version 2 0",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0",
             ("mozilla public license v 2 0",)),
    Template("epl", "eclipse public license v 2 0", ("eclipse public license",)),
    Template("boost", "boost software license version 1 0", ("boost software license",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
             ("permission to use copy modify", "with or without fee")),
    Template("unlicense", "this is free and unencumbered software released into the public domain",
             ("free and unencumbered", "public domain")),
    Template("cc-by-4.0", "creative commons attribution 4 0 international", ("creative commons attribution 4 0",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("cc-by-sa", "licensed under cc by sa", ("cc by sa",)),
    Template("cc0", "cc0 1 0 universal public domain dedication", ("cc0 1 0", "public domain")),
    Template("rights-reserved", "all rights reserved", ("all rights reserved",)),
)

# The least share of a template's words at their place; complete key phrases are enough.
COVERAGE = 0.0
# Words of a template whose positions are intersected before anything is verified.
ANCHORS = 2


def ascii_lower(col: Column) -> Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_array(col: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; null: none."""
    return F.filter(F.split(ascii_lower(F.coalesce(col, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _begins(phrase: list[str]):
    def here(i):
        all_ = F.lit(True)
        for k, w in enumerate(phrase):
            all_ = all_ & F.coalesce(F.get("w", i + k) == w, F.lit(False))
        return all_
    return here


def _labelled(label: str):
    return lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label"))


def scan(files: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES,
         phrases: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """One row per file: id, n_words, phrase_places (array of struct(at, label)),
    found (array of struct(label, at, score), the accepted alignments)."""
    phrases = BASE_PHRASES if phrases is None else phrases
    vocabulary = sorted({w for t in templates for w in t.words} | {w for p in phrases for w in p.split()})
    # words of which a file needs every one for some key phrase or base phrase
    needed = sorted({tuple(sorted({w for k in t.keys for w in k.split()})) for t in templates}
                    | {tuple(sorted(set(p.split()))) for p in phrases})

    words = files.select(F.col(id_col).alias("id"), word_array(F.col(text_col).cast("string")).alias("w"))
    seen = words.select("id", "w", F.array_intersect("w", _strings(vocabulary)).alias("known"))
    can = F.lit(False)
    for group in needed:
        every = F.lit(True)
        for w in group:
            every = every & F.array_contains("known", w)
        can = can | every
    kept = stage(seen.select("id", F.size("w").cast("long").alias("n_words"), "known", F.when(can, F.col("w")).alias("w")),
                 "license-words")

    # document frequencies of the fixed vocabulary: at most that many rows
    df = {r["x"]: r["count"] for r in kept.select(F.explode("known").alias("x")).groupBy("x").count().collect()}
    # the highest IDF is the lowest frequency; of equals the first in the alphabet
    anchors = [sorted(t.required, key=lambda i, w=t.words: (df.get(w[i], 0), w[i], i))[:ANCHORS] for t in templates]
    looked_up = sorted({t.words[i] for t, at in zip(templates, anchors, strict=True) for i in at})
    place = F.sequence(F.lit(0), F.size("w") - 1)
    found_type = "array<struct<label:string,at:bigint,score:double>>"
    # the file's places of all anchors, found in one pass
    kept = kept.withColumn("at", F.filter(F.transform("w", lambda x, i: F.when(x.isin(looked_up), F.struct(x.alias("x"), i.alias("i")))),
                                          lambda x: x.isNotNull()) if looked_up else F.lit(None).cast("array<struct<x:string,i:int>>"))

    def positions(t: Template, anchor: int) -> Column:
        """Where the template would begin for this anchor to stand."""
        word = t.words[anchor]
        return F.transform(F.filter("at", lambda a: a["x"] == word), lambda a: a["i"] - anchor)

    def alignments(t: Template, at: list[int]) -> Column:
        meet = positions(t, at[0])
        for anchor in at[1:]:
            meet = F.array_intersect(meet, positions(t, anchor))

        def stands(begin, k):
            """Whether the template's word k stands at its place (get() outside the file is null)."""
            return F.coalesce(F.get("w", begin + k) == F.lit(t.words[k]), F.lit(False))

        def verified(begin):
            every = F.lit(True)
            for k in t.required:
                every = every & stands(begin, k)
            return every

        def scored(begin):
            share = sum((stands(begin, k).cast("int") for k in range(len(t.words))), F.lit(0)) / len(t.words)
            return F.struct(F.lit(t.label).alias("label"), begin.cast("long").alias("at"), share.alias("score"))

        return F.filter(F.transform(F.filter(F.array_distinct(meet), verified), scored), lambda x: x["score"] >= coverage)

    found = F.array().cast(found_type)
    if templates:
        found = F.flatten(F.array(*[alignments(t, at) for t, at in zip(templates, anchors, strict=True)]))
    base = F.array().cast("array<struct<at:bigint,label:string>>")
    for phrase, label in phrases.items():
        base = F.concat(base, F.transform(F.filter(place, _begins(phrase.split())), _labelled(label)))
    has = F.col("w").isNotNull()
    return kept.select(
        F.col("id").alias(id_col), "n_words",
        F.when(has, base).otherwise(F.array().cast("array<struct<at:bigint,label:string>>")).alias("phrase_places"),
        F.when(has, found).otherwise(F.array().cast(found_type)).alias("found"))


def report(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digest columns of ``scan``; the score is the best accepted alignment's."""
    at = F.transform("phrase_places", lambda x: x["at"])
    base = F.transform("phrase_places", lambda x: x["label"])
    own = F.transform("found", lambda x: x["label"])
    return scanned.select(
        id_col, "n_words", F.size("phrase_places").cast("long").alias("n_base"), F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"), F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, own)), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x["score"])), F.lit(0.0)).alias("score"))


def report_sql(templates: tuple[Template, ...] = TEMPLATES, phrases: dict[str, str] | None = None,
               coverage: float = COVERAGE) -> str:
    """DuckDB SQL for ``report(scan(documents))``: every alignment of every template."""
    phrases = BASE_PHRASES if phrases is None else phrases

    def text(s):
        return "'" + s.replace("'", "''") + "'"

    rows = ", ".join(f"({n}, {text(t.label)}, {i}, {text(w)}, {i in set(t.required)})"
                     for n, t in enumerate(templates) for i, w in enumerate(t.words))
    sizes = ", ".join(f"({n}, {len(t.words)}, {len(t.required)})" for n, t in enumerate(templates))
    marks = " UNION ALL ".join(
        f"SELECT doc_id, i - 1 AS pos, {text(label)} AS label FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words)"
        f" WHERE list_slice(w, i, i + {len(p.split()) - 1}) = [{', '.join(map(text, p.split()))}]" for p, label in phrases.items())
    return f"""WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
template(t, label, i, x, needed) AS (VALUES {rows}), size(t, n, r) AS (VALUES {sizes}),
places AS (SELECT doc_id, unnest(w) AS x, unnest(range(0, len(w))) AS pos FROM words),
aligned AS (
  SELECT p.doc_id, t.t, t.label, p.pos - t.i AS pos, count(*) AS stands, count(*) FILTER (WHERE needed) AS kept
  FROM places p JOIN template t ON p.x = t.x GROUP BY ALL),
own AS (SELECT doc_id, label, stands / n::DOUBLE AS score FROM aligned JOIN size USING (t)
        WHERE kept = r AND stands / n::DOUBLE >= {coverage}),
base AS ({marks}),
b AS (SELECT doc_id, count(*) AS n, min(pos) AS lo, max(pos) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
      FROM base GROUP BY doc_id),
both_labels AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
                FROM (SELECT doc_id, label FROM base UNION SELECT doc_id, label FROM own) GROUP BY doc_id),
o AS (SELECT doc_id, max(score) AS score FROM own GROUP BY doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.lo::BIGINT AS first_word,
       b.hi::BIGINT AS last_word, coalesce(b.labels, '') AS base_labels, coalesce(l.labels, '') AS labels,
       coalesce(o.score, 0.0)::DOUBLE AS score
FROM words w LEFT JOIN b USING (doc_id) LEFT JOIN both_labels l USING (doc_id) LEFT JOIN o USING (doc_id)"""
