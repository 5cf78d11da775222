"""Line removal by site-relative frequency, in DataFrame functions only.

A site is a host.  For each (host, line) the pages of the host that hold the
line are counted and divided by the host's pages; a line on more than ``ratio`` of
them is boilerplate of that host and is dropped from all its pages, with the other
lines left as they are.  Pages of one text (a 128-bit digest) count once, in the
lines' pages and in the host's, so that copies alone make no line boilerplate; a
line must stand on ``MIN_PAGES`` = 2 of them, as a host of a single text tells nothing.

Counting shuffles line digests, not lines, and counts on the map side first, so
one host or line with a large share of all rows is a partial count per task.
The boilerplate lines of a host are at most its mean lines per page divided by
``ratio``, so their digests fit one row per host.  Pages meet their host's row in a
join (Spark broadcasts the hosts' rows if they are small, and splits a host with
many pages otherwise), and the text is filtered in its row.

Defined results: a null or empty text has no lines, is a page of its host all
the same (all of them one), and stays as it is; lines are compared with surrounding
blanks stripped, blank lines are never boilerplate; a null host is a host of its own;
repeated rows lose the same lines, and count each on request (``by_text`` false);
other columns are kept (clashing names too, as the operator's own columns have names
apart); an empty table gives an empty result.  A very long text is one row's array of
lines and digests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import stage

RATIO = 0.5
MIN_PAGES = 2

# A line's digest: two 64-bit hashes with different seeds.
_SEEDS = (0, 1)


def digest(line: Column) -> Column:
    """128 bits of the stripped line as two longs."""
    return F.struct(*[F.xxhash64(F.lit(s), F.trim(line)).alias(f"h{s}") for s in _SEEDS])


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def boilerplate(pages: DataFrame, host: Column, text: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES,
                by_text: bool = True) -> DataFrame:
    """Rows (host, line digest, pages, share): the lines above the ratio."""
    whole = F.struct(*[F.xxhash64(F.lit(s), F.coalesce(text, F.lit(""))).alias(f"h{s}") for s in _SEEDS])
    p = pages.select(host.cast("string").alias("host"), *([whole.alias("page")] if by_text else []), F.array_distinct(F.transform(
        F.filter(_lines(text), lambda x: F.trim(x) != ""), digest)).alias("lines"))
    if by_text:
        # copies meet on the map side first, then by digest; staged as it is read twice
        p = stage(p.dropDuplicates(["host", "page"]).select("host", "lines"), "host-texts")
    # one row per host, staged so that the join below is of two plain shuffles
    totals = stage(p.groupBy("host").agg(F.count(F.lit(1)).alias("total")).withColumnRenamed("host", "of_host"), "host-totals")
    counts = (p.select("host", F.explode("lines").alias("line")).groupBy("host", "line")
              .agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= min_pages))
    return (counts.join(totals, F.col("host").eqNullSafe(F.col("of_host")))
            .withColumn("share", F.col("pages") / F.col("total")).where(F.col("share") > ratio)
            .select("host", "line", "pages", "share"))


def drop_lines(pages: DataFrame, host: Column, text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES,
               n_lines: str | None = None, n_dropped: str | None = None, by_text: bool = True) -> DataFrame:
    """``pages`` with the boilerplate lines gone from ``text_col``; on request also
    the counts of lines and of dropped lines, under the given names."""
    text = F.col(text_col)
    bad = boilerplate(pages, host, text, ratio, min_pages, by_text)
    held = stage(bad.groupBy(F.col("host").alias("_h")).agg(F.collect_list("line").alias("_drop")), "boilerplate")
    # the row's other columns travel as one struct, so that no name can clash
    rest = [c for c in pages.columns if c != text_col]
    row = F.struct(F.lit(0).alias("none"), *[pages[c].alias(f"c{i}") for i, c in enumerate(rest)])
    keyed = pages.select(row.alias("row"), host.cast("string").alias("_host"), text.alias("text"))
    met = keyed.join(held, F.col("_host").eqNullSafe(F.col("_h")), "left")
    lines = _lines(F.col("text"))
    left = F.filter(lines, lambda x: ~F.coalesce(F.array_contains("_drop", digest(x)), F.lit(False)))
    total = F.size(F.filter(lines, lambda x: F.trim(x) != "")).cast("long")
    kept = met.select("row", "text", F.when(F.col("_drop").isNotNull(), left).alias("left"), total.alias("total"))
    gone = F.when(F.col("left").isNull(), F.lit(0)).otherwise(F.size(lines) - F.size("left")).cast("long")
    new = F.when(gone > 0, F.array_join("left", "\n")).otherwise(F.col("text"))
    done = kept.select("row", F.struct(new.alias("text"), "total", gone.alias("gone")).alias("made"))
    more = [F.col("made").getField(c).alias(name) for name, c in ((n_lines, "total"), (n_dropped, "gone")) if name]
    return done.select(*[F.col("made").getField("text").alias(c) if c == text_col else
                         F.col("row").getField(f"c{rest.index(c)}").alias(c) for c in pages.columns], *more)


# --- raw pages ------------------------------------------------------------------------

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
HIDDEN = r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->"
BLOCK = r"(?i)<(/?(p|div|li|ul|ol|h1|h2|h3|h4|h5|h6|tr|td|th|table|article|nav|header|footer|section|title|body|head|html)|br)([ /][^>]*)?>"
TAG = r"<[^>]*>"


def host_of(url: Column) -> Column:
    """The host part of a URL in lower case; null for a null URL, empty without one."""
    return F.lower(F.regexp_extract(url, HOST, 1))


def page_text(html: Column) -> Column:
    """A page's text, one line per block element: script, style and comments go,
    block tags become line breaks, other tags vanish, blank lines go."""
    text = F.regexp_replace(html, HIDDEN, "")
    text = F.regexp_replace(F.regexp_replace(text, BLOCK, "\n"), TAG, "")
    return F.regexp_replace(F.regexp_replace(text, r"[ \t\r]*\n[ \t\r\n]*", "\n"), r"^\n|\n$", "")
