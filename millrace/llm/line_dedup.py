"""Removal of lines that most pages of a site share (site-relative line frequency).

Pages are grouped by host.  For each line the number of the host's pages that hold it is divided
by the host's number of pages; a line whose share exceeds ``ratio`` is boilerplate there, and all its
occurrences on that host go.  A line must be shared to be boilerplate: one that a single page holds
(``least_pages`` is 2) stays, or all of a small host's lines would go.
Everything is DataFrame code; no Python runs on the executors.

Counting is pre-aggregated: a page gives a line once, as (host, 16 bytes of its SHA-256), and
partial counts are summed before and after the one shuffle, so that a host or a line with any
share of the rows is no hot key.  The boilerplate of a host has at most (distinct lines of its
average page) / ratio lines, whatever the number of pages; only this list meets the pages, in a
plain equi-join that Spark broadcasts if the list is small and else sorts, splitting hot hosts.  A page
first intersects its lines with its host's list, by hashing; each line is then looked for among the
page's own boilerplate.

Defined results
---------------
* The host is the URL's authority in lower case, without user name and port; URLs without one
  (also null) share the host "".
* HTML becomes lines so: comments, scripts and styles go (to the page's end if they aren't closed), tags of blocks end a line, other tags
  go, white space is collapsed, empty lines go.  Character references stay as they are.
* A null page or text has no lines, but counts as a page of its host.  Every row is a page, also
  where ids repeat, and gives one row; an empty table gives no rows.
* ``text`` is the kept lines joined by newlines, in order; a page that loses all lines stays with "".
* Other columns, whatever their names, do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _io

RATIO, LEAST_PAGES = 0.2, 2

#: What goes with its content, tags that end a line, other tags, white space within a line.
HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<script[\s>].*?(?:</script\s*>|\z)|<style[\s>].*?(?:</style\s*>|\z)"
BLOCKS = r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)(?:[\s/][^>]*)?>"
TAGS = r"<[^>]*>"
SPACE = r"[ \t\r\f\x0B]+"
AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, AUTHORITY, 1), F.lit("")))


def lines_of(text: Column) -> Column:
    """Lines of plain text, trimmed, without empty ones."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "), "\n")
    return F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")


def html_lines(html: Column) -> Column:
    text = F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, "")
    return lines_of(F.regexp_replace(F.regexp_replace(text, BLOCKS, "\n"), TAGS, ""))


def _key(line: Column) -> Column:
    return F.substring(F.unhex(F.sha2(line.cast("binary"), 256)), 1, 16)


def line_dedup(pages: DataFrame, id_col: str, host: Column, lines: Column, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """id, host, n_lines, n_dropped, text: one row for each row of ``pages``."""
    cut = _io.materialise(pages.select(F.col(id_col).alias("id"), host.alias("host"), lines.alias("lines")), "lines")
    totals = cut.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    held = cut.select("host", F.explode(F.array_distinct(F.transform("lines", _key))).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_pages)
    common = held.join(totals, "host").where(F.col("n") > ratio * F.col("pages")).groupBy("host").agg(F.collect_list("line").alias("common"))
    out = cut.join(_io.materialise(common, "boilerplate"), "host", "left")
    out = out.withColumn("common", F.array_intersect(F.transform("lines", _key), "common"))
    kept = F.when(F.coalesce(F.size("common"), F.lit(0)) <= 0, F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains("common", _key(x))))
    return out.select("id", "host", "lines", kept.alias("kept")).select(
        "id", "host", F.size("lines").cast("bigint").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("bigint").alias("n_dropped"), F.array_join("kept", "\n").alias("text"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return line_dedup(pages, "page_id", host_of(F.col("url")), html_lines(F.col("html"))).withColumnRenamed("id", "page_id")


OP3_SQL = f"""
WITH p AS (
  SELECT row_number() OVER () AS r, page_id, lower(coalesce(regexp_extract(url, '{AUTHORITY}', 1), '')) AS host,
         list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
           '{HIDDEN}', '', 'g'), '{BLOCKS}', chr(10), 'g'), '{TAGS}', '', 'g'), '{SPACE}', ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines
  FROM pages),
t AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
h AS (SELECT host, line, count(DISTINCT r) AS n FROM (SELECT r, host, unnest(lines) AS line FROM p) GROUP BY host, line),
c AS (SELECT h.host, list(h.line) AS common FROM h JOIN t ON h.host = t.host WHERE n >= {LEAST_PAGES} AND n > {RATIO} * pages GROUP BY h.host),
k AS (SELECT p.page_id, p.host, lines, CASE WHEN common IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(common, x)) END AS kept FROM p LEFT JOIN c ON p.host = c.host)
SELECT page_id, host, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_dropped, coalesce(array_to_string(kept, chr(10)), '') AS text FROM k
"""
