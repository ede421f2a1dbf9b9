"""Boilerplate lines by their frequency within a site.

For each site, the pages that contain a line are divided by all pages of the site; lines above ``ratio`` go from every
page of that site. Counting moves two hashes of each distinct line of a page, combined before the shuffle, never the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.llm.common import cut

RATIO = 0.05
MIN_PAGES = 3
#: A site with more than this share of all pages is a hot one; so there are fewer than 1 / HOT of these.
HOT = 0.001
#: Boilerplate lines, of all sites, up to which the list is broadcast (16 bytes each); beyond, hot sites' lists are, and the rest is joined.
BROADCAST_LINES = 1_000_000


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def html_text(html: Column) -> Column:
    """A page's text, with a line feed in the place of each tag; scripts, styles and comments go."""
    rest = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", "")
    return F.regexp_replace(rest, r"(?s)<[^>]*>", "\n")


def hot_sites(pages: DataFrame, site: Column, share: float = HOT) -> DataFrame:
    """(site, total, hot) of all sites: how many pages there are, and whether these are over ``share`` of all."""
    totals = cut(pages.groupBy(site.alias("site")).agg(F.count("*").alias("total")))
    every = totals.agg(F.sum("total")).first()[0] or 0
    return totals.withColumn("hot", F.col("total") > F.lit(share * every))


def _by_site(rows: DataFrame, table: DataFrame, sites: DataFrame, how: str) -> DataFrame:
    """Join on the site: what hot sites have of ``table``, a row each, is broadcast (fewer than 1 / HOT rows), so that no task gets a hot site's rows."""
    hot = F.broadcast(sites.where("hot").select("site"))
    of_hot = rows.join(hot, "site", "left_semi").join(F.broadcast(table.join(hot, "site", "left_semi")), "site", how)
    return of_hot.unionByName(rows.join(hot, "site", "left_anti").join(table, "site", how))


def boilerplate_lines(
    pages: DataFrame, site: Column, text: Column, sites: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """(site, lines): each site's boilerplate as an array of line keys; ``sites`` as from ``hot_sites``.

    The array is bounded: a site has at most (distinct lines of a page, on average) / ratio such lines.
    """
    keys = pages.select(
        site.alias("site"),
        F.array_distinct(F.transform(F.filter(_lines(text), lambda x: F.trim(x) != ""), _key)).alias("keys"),
    )
    counted = keys.select("site", F.explode("keys").alias("k")).groupBy("site", "k.h1", "k.h2").agg(F.count("*").alias("n"))
    often = cut(counted.where(F.col("n") >= min_pages))
    boiler = _by_site(often, sites.select("site", "total"), sites, "inner").where(F.col("n") > F.lit(ratio) * F.col("total"))
    return boiler.groupBy("site").agg(F.collect_list(F.struct("h1", "h2")).alias("lines"))


def drop_boilerplate(
    pages: DataFrame,
    site_col: str = "host",
    text_col: str = "text",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
    broadcast_lines: int = BROADCAST_LINES,
    hot: float = HOT,
) -> DataFrame:
    """Every input row, with its columns as they were in ``row`` and kept_text, n_lines, n_dropped beside it.

    Lines end at LF. Blank lines stay and never count. A line goes if more than ``ratio`` of its site's pages, and at
    least ``min_pages``, contain it; a repeat within one page counts once. A null site is a site of its own ('' is another).
    A null text has no lines and stays null. Repeated rows are pages of their own.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in pages.columns])
    work = pages.select(
        row.alias("row"),
        F.coalesce(F.concat(F.lit("s"), F.col(f"`{site_col}`")), F.lit("n")).alias("site"),
        F.col(f"`{text_col}`").alias("text"),
    )
    sites = hot_sites(work, F.col("site"), hot)
    boiler = cut(boilerplate_lines(work, F.col("site"), F.col("text"), sites, ratio, min_pages))
    held = boiler.agg(F.sum(F.size("lines"))).first()[0] or 0
    if held <= broadcast_lines:
        joined = work.join(F.broadcast(boiler), "site", "left")
    else:
        joined = _by_site(work, boiler, sites, "left")
    lines = _lines(F.col("text"))
    kept = F.when(F.col("lines").isNull(), lines).otherwise(
        F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("lines"), _key(x)))
    )
    return joined.select(
        "row",
        F.array_join(kept, "\n").alias("kept_text"),
        F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"),
        F.coalesce(F.size(lines) - F.size(kept), F.lit(0)).alias("n_dropped"),
    )
