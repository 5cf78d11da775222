"""Scalar text functions as ``Column -> Column`` expressions.

All regular expressions used by the engine live here, so the dialect rules
(Java regex inside Spark) are handled in one place.  Python's ``\\s`` and
``\\w`` are Unicode-aware while Java's defaults are ASCII, so the classes are
spelled out explicitly.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# These must stay exactly as written for results to agree with
# the semantics being reproduced (text normalisation, tokenising, flags).
# ---------------------------------------------------------------------------
# Whitespace as Python's str.isspace() sees it (Java's \s lacks most of it).
WS_CLASS = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WS_RUN = WS_CLASS + "+"
# A Unicode "word" character (letters, numbers, underscore).
WORD_CHAR = r"[\p{L}\p{N}_]"
NOT_WORD_BEFORE = r"(?<![\p{L}\p{N}_])"
NOT_WORD_AFTER = r"(?![\p{L}\p{N}_])"
# Characters kept by normalisation besides word characters and whitespace.
KEEP_PUNCT = r".,!?;:\-()\[\]{}"
NORMALISE_DROP = r"[^\p{L}\p{N}_\s" + KEEP_PUNCT + "]"
# Lexical tokens: runs of two or more word characters.
TOKEN = r"[\p{L}\p{N}_]{2,}"
# Characters replaced in safe file names.
UNSAFE_NAME_CHARS = r'[<>:"/\\|?*]'
SAFE_NAME_MAX = 200
# Filename metadata patterns (applied to the lower-cased stem for chapter/page).
CHAPTER_PATTERN = r"chapter[_\s]*(\d+)"
PAGE_PATTERN = r"page[_\s]*(\d+)"
DATE_PATTERN = r"(\d{4})[_\s]*(\d{2})[_\s]*(\d{2})"
# Academic indicator names, in output order, and their patterns.
ACADEMIC_STRUCTURE_WORDS = ["abstract", "introduction", "conclusion", "references", "bibliography"]
CITATION_MARKERS = [r"et al\.", r"ibid\.", r"op\. cit\."]
AUTHOR_CITATION = r"[A-Z][a-z]+ et al\."
# Function words for the language guess and the threshold (strictly greater).
ENGLISH_FUNCTION_WORDS = ["the", "and", "of", "to", "in", "a", "is", "that", "it", "with"]
ENGLISH_MIN_HITS = 5
# Characters per estimated page.
CHARS_PER_PAGE = 2500
# ---------------------------------------------------------------------------


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def normalize(col: Column | str) -> Column:
    """Collapse whitespace runs to one space, drop characters other than word
    characters, whitespace and basic punctuation, then strip."""
    collapsed = F.regexp_replace(_c(col), WS_RUN, " ")
    return F.trim(F.regexp_replace(collapsed, NORMALISE_DROP, ""))


def strip_ws(col: Column | str) -> Column:
    """Strip leading/trailing whitespace as ``str.strip()`` does (``trim`` only removes spaces)."""
    # \z, not $: Java's $ also matches before a final line break
    return F.regexp_replace(_c(col), "^" + WS_RUN + "|" + WS_RUN + r"\z", "")


def lstrip_ws(col: Column | str) -> Column:
    """Strip leading whitespace as ``str.lstrip()`` does."""
    return F.regexp_replace(_c(col), "^" + WS_RUN, "")


def split_words(col: Column | str) -> Column:
    """Whitespace tokenisation with no empty tokens (``str.split()``)."""
    return F.filter(F.split(_c(col), WS_RUN), lambda x: x != F.lit(""))


def word_count(col: Column | str) -> Column:
    return F.size(split_words(col))


def char_count(col: Column | str) -> Column:
    return F.length(_c(col))


def estimated_pages(col: Column | str) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(_c(col)) / CHARS_PER_PAGE).cast("int"))


def preview(col: Column | str, n: int) -> Column:
    """First ``n`` characters with ``...`` always appended."""
    return F.concat(F.substring(_c(col), 1, n), F.lit("..."))


def safe_name(col: Column | str) -> Column:
    replaced = F.regexp_replace(_c(col), UNSAFE_NAME_CHARS, "_")
    stripped = F.regexp_replace(replaced, r"^[ .]+|[ .]+\z", "")
    return F.substring(stripped, 1, SAFE_NAME_MAX)


# --- path / file name metadata -------------------------------------------------

def path_name(col: Column | str) -> Column:
    """Final path component (trailing slashes ignored)."""
    return F.regexp_extract(_c(col), r"([^/]+)/*\z", 1)


def path_suffix(col: Column | str) -> Column:
    """Lower-cased suffix of the final component ('' when none)."""
    return F.lower(F.regexp_extract(path_name(col), r"^.+(\.[^.]+)\z", 1))


def path_stem(col: Column | str) -> Column:
    name = path_name(col)
    return F.regexp_replace(name, r"(?<=.)\.[^.]+\z", "")


def _int_group(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("int")


def chapter_from_name(col: Column | str) -> Column:
    return _int_group(F.lower(path_stem(col)), CHAPTER_PATTERN)


def page_from_name(col: Column | str) -> Column:
    return _int_group(F.lower(path_stem(col)), PAGE_PATTERN)


def date_from_name(col: Column | str) -> Column:
    """``YYYY-MM-DD`` from 4+2+2 digits in the stem; not validated (see ``valid_date``)."""
    stem = path_stem(col)
    found = F.regexp_extract(stem, DATE_PATTERN, 0) != F.lit("")
    text = F.concat_ws(
        "-",
        F.regexp_extract(stem, DATE_PATTERN, 1),
        F.regexp_extract(stem, DATE_PATTERN, 2),
        F.regexp_extract(stem, DATE_PATTERN, 3),
    )
    return F.when(found, text)


def valid_date(date_text: Column | str) -> Column:
    return F.try_to_timestamp(_c(date_text), F.lit("yyyy-MM-dd")).cast("date")


# --- content flags --------------------------------------------------------------

def has_academic_structure(col: Column | str) -> Column:
    words = "|".join(ACADEMIC_STRUCTURE_WORDS)
    return F.lower(_c(col)).rlike(f"{NOT_WORD_BEFORE}({words}){NOT_WORD_AFTER}")


def has_year_reference(col: Column | str) -> Column:
    return _c(col).rlike(NOT_WORD_BEFORE + r"\p{Nd}{4}" + NOT_WORD_AFTER)


def has_citation_style(col: Column | str) -> Column:
    # The marker must be followed directly by a word character.
    markers = "|".join(CITATION_MARKERS)
    return F.lower(_c(col)).rlike(f"{NOT_WORD_BEFORE}({markers})(?={WORD_CHAR})")


def has_author_citation(col: Column | str) -> Column:
    return _c(col).rlike(AUTHOR_CITATION)


def academic_indicators(col: Column | str) -> Column:
    """The indicator list in fixed order."""
    flags = F.array(
        F.when(has_academic_structure(col), F.lit("academic_structure")),
        F.when(has_year_reference(col), F.lit("year_references")),
        F.when(has_citation_style(col), F.lit("citation_style")),
        F.when(has_author_citation(col), F.lit("author_citations")),
    )
    return F.filter(flags, lambda x: x.isNotNull())


def english_hits(col: Column | str) -> Column:
    vocab = F.array(*[F.lit(w) for w in ENGLISH_FUNCTION_WORDS])
    return F.size(F.array_intersect(split_words(F.lower(_c(col))), vocab))


def language_guess(col: Column | str) -> Column:
    return F.when(english_hits(col) > ENGLISH_MIN_HITS, F.lit("english")).otherwise(F.lit("unknown"))


# --- ids --------------------------------------------------------------------------

def content_hash(col: Column | str) -> Column:
    return F.substring(F.md5(_c(col)), 1, 16)


def content_id(text: Column | str, metadata: Column | None = None) -> Column:
    """16 hex of MD5(text), plus ``_`` and 8 hex of MD5(metadata JSON) when given.

    ``metadata`` should be a struct with its fields in name order and without
    run-time values (timestamps), so ids stay stable across runs.
    """
    base = content_hash(text)
    if metadata is None:
        return base
    return F.concat(base, F.lit("_"), F.substring(F.md5(F.to_json(metadata)), 1, 8))


def sorted_struct(*names: str) -> Column:
    return F.struct(*[F.col(n) for n in sorted(names)])


# --- lexical tokens -----------------------------------------------------------------

def tokens(col: Column | str) -> Column:
    """Lower-cased runs of two or more word characters (empty for null text)."""
    return F.coalesce(F.regexp_extract_all(F.lower(_c(col)), F.lit(TOKEN), 0), F.array().cast("array<string>"))
