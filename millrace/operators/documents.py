"""Sections, links and search over text documents (DOC)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strings import slug


def sections(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Sections of Markdown texts by heading: position, level, heading, anchor, body, minutes of reading (DOC-02).

    Reading time is (words of prose + half the words of code blocks) / 220.  Text before the first
    heading has level 0 and no heading.
    """
    marked = F.regexp_replace(F.col(text_col), r"(?m)^(#{1,6}) +(.*)$", "\u0001$1\u0002$2\u0003")
    parts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col), F.posexplode(F.split(marked, "\u0001")).alias("position", "part"))
    head = F.regexp_extract("part", "^(#{1,6})\u0002([^\u0003]*)\u0003", 1)
    title = F.trim(F.regexp_extract("part", "^(#{1,6})\u0002([^\u0003]*)\u0003", 2))
    body = F.trim(F.regexp_replace("part", "^#{1,6}\u0002[^\u0003]*\u0003", ""), F.lit(" \n\t"))
    out = parts.select(id_col, "position", F.length(head).alias("level"), title.alias("heading"), slug(title).alias("anchor"), body.alias("body")).where("heading <> '' OR body <> ''")
    code = F.array_join(F.regexp_extract_all("body", F.lit("(?s)```(.*?)```"), 1), " ")
    words = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    prose = F.regexp_replace("body", "(?s)```.*?```", " ")
    return out.withColumn("minutes", F.round((words(prose) + words(code) / 2) / 220, 4))


def links(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Links written [text](target) of Markdown texts: source, label, page, anchor."""
    raw = docs.select(F.col(id_col).alias("source"), F.explode(F.regexp_extract_all(text_col, F.lit(r"\[[^\]\n]*\]\([^)\s]+\)"), 0)).alias("link"))
    target = F.regexp_extract("link", r"\]\(([^)\s]+)\)$", 1)
    return raw.select("source", F.regexp_extract("link", r"^\[([^\]]*)\]", 1).alias("label"), F.regexp_extract(target, "^([^#]*)", 1).alias("page"), F.regexp_extract(target, "#(.*)$", 1).alias("anchor"))


def backlinks(edges: DataFrame, source: str = "source", target: str = "page") -> DataFrame:
    """Pages with the distinct pages that link to them, in order, without themselves (DOC-03)."""
    return (edges.where(F.col(source).cast("string") != F.col(target).cast("string")).select(source, target).distinct()
            .groupBy(target).agg(F.sort_array(F.collect_set(source)).alias("backlinks"), F.count(F.lit(1)).alias("n")))


def broken_links(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """Edges whose (page, anchor) isn't among ``anchors`` (DOC-05)."""
    return edges.join(anchors.select("page", "anchor").distinct(), ["page", "anchor"], "left_anti")


def search(entries: DataFrame, query: str, per_page: int = 3, most: int = 30, page: str = "page", title: str = "title", heading: str = "heading", body: str = "body") -> DataFrame:
    """Entries that hold all terms of a query, best first (DOC-04).

    At most eight lower-case terms count; each scores 10 in the heading, 6 in the title, and once for
    each occurrence in the body.  At most ``per_page`` entries of a page and ``most`` in all are the
    feature.
    """
    terms = [t for t in dict.fromkeys(query.lower().split()) if t][:8]
    if not terms:
        return entries.where(F.lit(False)).withColumn("score", F.lit(0))
    low = {c: F.lower(F.coalesce(F.col(c), F.lit(""))) for c in (title, heading, body)}
    held: Column = F.lit(True)
    score: Column = F.lit(0)
    for t in terms:
        where = {c: F.instr(x, t) > 0 for c, x in low.items()}
        held = held & (where[title] | where[heading] | where[body])
        times = ((F.length(low[body]) - F.length(F.replace(low[body], F.lit(t), F.lit("")))) / len(t)).cast("int")
        score = score + F.when(where[heading], 10).otherwise(0) + F.when(where[title], 6).otherwise(0) + times
    found = entries.where(held).withColumn("score", score)
    w = Window.partitionBy(page).orderBy(F.desc("score"), heading)
    return found.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= per_page).drop("__n").orderBy(F.desc("score"), page, heading).limit(most)
