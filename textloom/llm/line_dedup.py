"""Line deduplication by the share of a site's pages that hold a line. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.graph import meet
from textloom.session import cut

RATIO = 0.2  # a line on more than this share of its host's pages is boilerplate
BROADCAST_BYTES = 16 << 20  # of all hosts' lists, up to which they are broadcast
LEAST_PAGES = 2  # and on this many pages at least: a page alone is no repetition
BLOCKS = "address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h1|h2|h3|h4|h5|h6|head|header|hr|html|li|main|nav|ol|option|p|pre|section|select|table|tbody|td|tfoot|th|thead|title|tr|ul"
# what is never closed ends with the page, so that no start is scanned twice
GONE = r"(?is)<(?:script|style)\b[^>]*(?:>|\z).*?(?:</(?:script|style)\s*>|\z)|<!--.*?(?:-->|\z)"
BLOCK_TAG = rf"(?i)</?(?:{BLOCKS})\b[^>]*(?:>|\z)"
TAG = r"<[A-Za-z!/?][^>]*(?:>|\z)"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def html_lines(html: Column) -> Column:
    """The text lines of a page: scripts, styles and comments go, block tags end a line, other tags vanish, blanks collapse, empty lines go. A script, style, comment or tag that is never closed ends with the page."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), GONE, " ")
    text = F.regexp_replace(text, BLOCK_TAG, "\n")
    text = F.regexp_replace(text, TAG, "")
    for entity, sign in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(sign))
    text = F.regexp_replace(text, r"[\x20\x09\x0B\x0C\x0D]+", " ")
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def host_of(url: Column) -> Column:
    """Lower-cased host of a URL, without user and port; empty for anything else."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))


def line_dedup(pages: DataFrame, lines: Column, site: Column, id_col: str = "page_id", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """One row per input row: page_id, host, n_lines, n_dropped, text (the lines that stay).

    A line is dropped from all pages of a host if more than `ratio` of the host's pages, and at least `least_pages`,
    hold it. The lines of all pages are written to the shared folder, so that no page is parsed twice. Each page counts
    a line once (by its MD5 digest); counts are combined before the shuffle, so a line that is on all pages of a hot
    host costs one row per task. Lines below `least_pages` go before they meet the host totals, those of a hot host
    dealt over tasks. What is left is one short list per host, as its ratios sum to no more than the mean lines of its
    pages. The lists are broadcast if their summed size allows it; else pages meet them by host, and a hot host is
    dealt over as many tasks as its pages need (see meet()). Pages filter their lines in place.

    Cases: null or empty html: no lines, empty text; null, empty or malformed url: all share the host ''; a null id is
    returned as it is; repeated rows count as pages each; a ratio that equals the limit stays; an empty table gives no
    rows; other columns are ignored, whatever their names.
    """
    rows = cut(pages.select(F.col(id_col).cast("long").alias("page_id"), site.alias("host"), lines.alias("lines")))
    digests = F.array_distinct(F.transform("lines", lambda x: F.unhex(F.md5(x))))
    counts = rows.select("host", F.explode(digests).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages)
    totals = rows.groupBy("host").agg(F.count("*").alias("pages"))
    totals = cut(totals)
    total = totals.agg(F.sum("pages")).first()[0] or 0
    boiler = meet(counts, totals.withColumn("_size", F.col("pages")), "host", "_size", total).where(F.col("n") > ratio * F.col("pages")).groupBy("host").agg(F.collect_list("line").alias("boiler"))
    boiler = cut(boiler)
    size = boiler.agg(F.sum(F.size("boiler") * 24 + F.length("host") + 64)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        met = rows.join(F.broadcast(boiler), "host", "left")
    else:
        met = meet(rows, totals.join(boiler, "host", "left"), "host", "pages", total)
    known = F.coalesce("boiler", F.array().cast("array<binary>"))
    stay = F.filter("lines", lambda x: ~F.array_contains(known, F.unhex(F.md5(x))))
    kept = met.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), stay.alias("stay"))
    return kept.select("page_id", "host", "n_lines", (F.col("n_lines") - F.size("stay")).alias("n_dropped"), F.array_join("stay", "\n").alias("text"))


def page_line_dedup(pages: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """line_dedup() of web pages: hosts from urls, lines from html."""
    return line_dedup(pages, html_lines(F.col(html_col)), host_of(F.col(url_col)), id_col, ratio, least_pages)


SQL = rf"""
WITH stripped AS (
  SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)) AS host,
    regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
      '{GONE}', ' ', 'g'), '{BLOCK_TAG}', chr(10), 'g'), '{TAG}', '', 'g') AS t
  FROM pages),
plain AS (
  SELECT page_id, host, row_number() OVER () AS rid,
    list_filter(list_transform(string_split(regexp_replace(
      replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'),
      '[\x20\x09\x0B\x0C\x0D]+', ' ', 'g'), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS lines
  FROM stripped),
counts AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM plain) GROUP BY host, line),
totals AS (SELECT host, count(*) AS pages FROM plain GROUP BY host),
boiler AS (SELECT host, list(line) AS boiler FROM counts JOIN totals USING (host) WHERE n >= {LEAST_PAGES} AND n > {RATIO} * pages GROUP BY host),
kept AS (
  SELECT page_id, host, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(boiler, []::VARCHAR[]), x)) AS stay
  FROM plain LEFT JOIN boiler USING (host))
SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(stay) AS BIGINT) AS n_dropped, coalesce(array_to_string(stay, chr(10)), '') AS text
FROM kept
"""
