"""Boilerplate lines by site-relative frequency (DataFrame functions only).

A line is boilerplate on a site when the pages of the site that contain it,
divided by all pages of the site, exceed ``max_ratio`` (and are at least
``min_pages``).  Boilerplate lines are dropped from every page of that site.

Counting combines before the shuffle and moves a 16-byte digest per distinct
line of a page, never the line.  What is joined back is one row per site with
its boilerplate digests.  A line needs over ``max_ratio`` of the pages, so a
site has fewer than (mean distinct lines a page / ``max_ratio``) of them,
whatever its number of pages.  That table is written first, so that Spark
broadcasts it only if its size on disk is under the threshold; otherwise the
join shuffles and adaptive execution splits a hot site.

Defined results: lines of white space only are never counted or dropped; a
page counts once for a line it repeats; a NULL text stays NULL; pages of a
NULL site are left as they are; repeated rows are pages of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoframe.llm.common import drop_columns, own_name, quoted, written

NOT_BLANK = r"[^\x20\x09-\x0D]"


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(line))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate_lines(
    pages: DataFrame,
    site_col: str = "source",
    text_col: str = "text",
    max_ratio: float = 0.1,
    min_pages: int = 3,
) -> DataFrame:
    """Rows ``(site, digest, pages, site_pages)`` of the lines over the ratio."""
    site, text = F.col(quoted(site_col)).alias("site"), F.col(quoted(text_col))
    known = pages.filter(F.col(quoted(site_col)).isNotNull())
    # written first, so that Spark knows its size when it chooses the join below
    totals = written(known.groupBy(site).agg(F.count("*").alias("site_pages")), "line-sites")
    shown = F.array_distinct(F.filter(_lines(text), lambda x: x.rlike(NOT_BLANK)))
    counted = (
        known.select(site, F.explode(shown).alias("line"))
        .groupBy("site", _digest(F.col("line")).alias("digest"))
        .agg(F.count("*").alias("pages"))
        .filter(F.col("pages") >= min_pages)
    )
    return counted.join(totals, "site").filter(F.col("pages") > F.lit(max_ratio) * F.col("site_pages"))


def drop_boilerplate(
    pages: DataFrame,
    site_col: str = "source",
    text_col: str = "text",
    max_ratio: float = 0.1,
    min_pages: int = 3,
    n_chars_col: str | None = None,
) -> DataFrame:
    """``pages`` without boilerplate lines, and ``n_dropped_lines`` (long).

    With ``n_chars_col`` that column gets the length of the new text.
    """
    found = boilerplate_lines(pages, site_col, text_col, max_ratio, min_pages)
    per_site = written(found.groupBy("site").agg(F.collect_set("digest").alias("digests")), "line-boilerplate")
    keep = drop_columns(pages, ["n_dropped_lines"])
    key, digests, lines, kept = (own_name(keep, n) for n in ("_site", "_digests", "_lines", "_kept"))
    per_site = per_site.select(F.col("site").alias(key), F.col("digests").alias(digests))
    joined = keep.join(per_site, F.col(quoted(site_col)) == F.col(key), "left").withColumn(
        lines, F.when(F.col(digests).isNotNull(), _lines(F.col(quoted(text_col))))
    )
    # a blank line's digest is never among a site's digests
    out = joined.withColumn(
        kept, F.filter(lines, lambda x: ~F.array_contains(F.col(digests), _digest(x)))
    ).withColumns(
        {
            "n_dropped_lines": F.when(F.col(lines).isNull(), F.lit(0))
            .otherwise(F.size(lines) - F.size(kept))
            .cast("long"),
            text_col: F.when(F.col(lines).isNull(), F.col(quoted(text_col))).otherwise(F.array_join(kept, "\n")),
        }
    )
    if n_chars_col:
        out = out.withColumn(n_chars_col, F.length(F.col(quoted(text_col))).cast("long"))
    return out.select([F.col(quoted(c)) for c in keep.columns] + ["n_dropped_lines"])
