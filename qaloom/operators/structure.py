"""Tables of contents, sections and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qaloom.functions.text import chapters, strip


def number_toc(toc: DataFrame, last_page: DataFrame) -> DataFrame:
    """Chapters and sections of TOC rows ``doc, ord, level, title, page``, with their page ranges.

    Levels over 2 and sections before a chapter are left out. A range ends before
    the next entry of its level starts, the last where its parent ends; two entries
    on one page give an end before the start. ``last_page`` has ``doc, pages``.
    All windows are within a document.
    """
    by_doc = Window.partitionBy("doc").orderBy("ord")
    kept = toc.where(F.col("level") <= 2).withColumn("ch", F.sum((F.col("level") == 1).cast("int")).over(by_doc)).where("ch > 0")
    in_level = Window.partitionBy("doc", "level").orderBy("ord")
    in_chapter = Window.partitionBy("doc", "ch", "level").orderBy("ord")
    chapters = (
        kept.where("level = 1").join(last_page, "doc")
        .withColumn("end_page", F.coalesce(F.lead("page").over(in_level) - 1, F.col("pages")))
        .select("doc", "ch", "title", "page", "end_page")
    )
    sections = (
        kept.where("level = 2").join(chapters.select("doc", "ch", F.col("end_page").alias("parent_end")), ["doc", "ch"])
        .withColumn("sec", F.row_number().over(in_chapter))
        .withColumn("end_page", F.coalesce(F.lead("page").over(in_chapter) - 1, F.col("parent_end")))
    )
    return chapters.select(
        "doc", F.concat(F.lit("ch"), F.col("ch")).alias("id"), F.lit(1).alias("level"), "title", F.col("page").alias("start_page"), "end_page"
    ).unionByName(
        sections.select("doc", F.concat_ws(".", "ch", "sec").alias("id"), "level", "title", F.col("page").alias("start_page"), "end_page")
    )


CONTENTS = ("doc", "id", "level", "title", "start_page", "end_page")


def heading_toc(pages: DataFrame, last_page: DataFrame, first: int = 20) -> DataFrame:
    """Chapters by headings 'Chapter n: title' in the first pages; each spans the whole document and has no sections.

    Duplicates stay. A heading starts a line of the joined pages.
    """
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_number", "text"))), lambda p: F.coalesce(p["text"], F.lit(""))), "")
    found = pages.where(F.col("page_number").between(1, first)).groupBy("doc").agg(text.alias("t")).select("doc", F.explode(chapters(F.col("t"))).alias("c"))
    return found.join(last_page, "doc").select(
        "doc", F.concat(F.lit("ch"), F.col("c.number").cast("int")).alias("id"), F.lit(1).alias("level"), strip(F.col("c.title")).alias("title"),
        F.lit(1).cast("long").alias("start_page"), F.col("pages").cast("long").alias("end_page"),
    )


def contents(toc: DataFrame, pages: DataFrame, last_page: DataFrame) -> DataFrame:
    """``doc, id, level, title, start_page, end_page`` of every document of ``last_page`` (doc, pages).

    Bookmarks (``toc``) if a document has any; else headings; else one chapter 'Full Document' with a section 'Content'.
    """
    kinds = lambda df: df.select("doc", "id", "level", "title", F.col("start_page").cast("long").alias("start_page"), F.col("end_page").cast("long").alias("end_page"))
    marked = toc.select("doc").distinct()
    bare = last_page.join(marked, "doc", "left_anti")
    headed = heading_toc(pages.join(marked, "doc", "left_anti"), bare)
    none = bare.join(headed.select("doc").distinct(), "doc", "left_anti")
    whole = F.array(
        F.struct(F.lit("ch1").alias("id"), F.lit(1).alias("level"), F.lit("Full Document").alias("title")),
        F.struct(F.lit("1.1").alias("id"), F.lit(2).alias("level"), F.lit("Content").alias("title")),
    )
    default = none.select("doc", "pages", F.explode(whole).alias("x")).select("doc", "x.*", F.lit(1).alias("start_page"), F.col("pages").alias("end_page"))
    return kinds(number_toc(toc, last_page)).unionByName(kinds(headed)).unionByName(kinds(default))


def page_text(pages: DataFrame, doc, number: int) -> DataFrame:
    """One row with the page's text, '' where there is no such page."""
    return pages.where((F.col("doc") == doc) & (F.col("page_number") == number)).agg(F.coalesce(F.max("text"), F.lit("")).alias("text"))


def section_text(sections: DataFrame, pages: DataFrame) -> DataFrame:
    """``doc, id, full_text``: the texts of each section's pages, joined by blank lines.

    A section becomes one row a page, so the join is an equi-join on document and page.
    """
    wanted = sections.where("end_page >= start_page").select(
        "doc", "id", F.explode(F.sequence("start_page", "end_page")).alias("page_number")
    )
    return (
        wanted.join(pages, ["doc", "page_number"])
        .groupBy("doc", "id")
        .agg(F.sort_array(F.collect_list(F.struct("page_number", "text"))).alias("p"))
        .select("doc", "id", F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("full_text"))
    )
