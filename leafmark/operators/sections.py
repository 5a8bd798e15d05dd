"""Sections: titles become (page, y) intervals, elements are assigned by an interval join over pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Page end of a section, page end of a preamble, a title nearer to the top than this starts a page.
PAGE_END, PREAMBLE_END, TOP = 999_999, 99_999_999, 100
NONAME = "noname"


def identify(elements: DataFrame, num_pages: int | Column = 12) -> DataFrame:
    """doc_id, section_idx, title, title_ord, start_page, start_y, end_page, end_y.

    Documents without titles have no sections. Two titles near the top of one page give an inverted range; it is kept.
    """
    last = (num_pages if isinstance(num_pages, Column) else F.lit(num_pages)) - 1
    order = Window.partitionBy("doc_id").orderBy("page_idx", "y1", "ord")
    t = elements.where(F.col("label") == "paragraph_title")
    t = t.withColumn("rn", F.row_number().over(order)).withColumn("np", F.lead("page_idx").over(order)).withColumn("ny", F.lead("y1").over(order))
    top = F.col("ny") < TOP
    end_page = F.when(F.col("np").isNull(), last).when(top, F.col("np") - 1).otherwise(F.col("np"))
    end_y = F.when(F.col("np").isNull() | top, F.lit(PAGE_END)).otherwise(F.col("ny"))
    # the preamble, if any, is made from the first title's own row, so both come from one sort
    below, later = F.col("y1") > TOP, F.col("page_idx") > 0
    first = F.struct(F.lit(0).cast("long").alias("k"), F.lit(NONAME).alias("title"), F.lit(None).cast("long").alias("title_ord"), F.lit(0).cast("long").alias("start_page"), F.lit(0).cast("long").alias("start_y"), F.when(below, F.col("page_idx")).otherwise(F.col("page_idx") - 1).cast("long").alias("end_page"), F.when(below, F.col("y1")).otherwise(F.lit(PREAMBLE_END)).cast("long").alias("end_y"))
    body = F.struct(F.col("rn").cast("long").alias("k"), F.col("ocr").alias("title"), F.col("ord").cast("long").alias("title_ord"), F.col("page_idx").cast("long").alias("start_page"), F.col("y1").cast("long").alias("start_y"), end_page.cast("long").alias("end_page"), end_y.cast("long").alias("end_y"))
    rows = t.select("doc_id", F.explode(F.when((F.col("rn") == 1) & (below | later), F.array(first, body)).otherwise(F.array(body))).alias("s")).select("doc_id", "s.*")
    idx = F.row_number().over(Window.partitionBy("doc_id").orderBy("k")) - 1
    return rows.select("doc_id", idx.cast("long").alias("section_idx"), "title", "title_ord", "start_page", "start_y", "end_page", "end_y")


def _inside() -> Column:
    p, y = F.col("page_idx"), F.col("y1")
    one = (F.col("start_page") == F.col("end_page")) & (F.col("end_page") == p)
    return (
        F.when(one, (F.col("start_y") <= y) & (y < F.col("end_y")))
        .when(p == F.col("start_page"), y >= F.col("start_y"))
        .when(p == F.col("end_page"), y < F.col("end_y"))
        .otherwise((F.col("start_page") < p) & (p < F.col("end_page")))
    )


def _on_pages(sections: DataFrame, low: Column, high: Column) -> DataFrame:
    keep = sections.select("doc_id", "section_idx", "start_page", "start_y", "end_page", "end_y")
    return keep.where(low <= high).withColumn("page_idx", F.explode(F.sequence(low, high)))


def assign(elements: DataFrame, sections: DataFrame) -> DataFrame:
    """(doc_id, ord, section_idx): the first section that holds each formula, number and formula number. Sections are dealt to
    their pages, so the join is on (doc_id, page_idx)."""
    pages = _on_pages(sections, F.least("start_page", "end_page"), F.greatest("start_page", "end_page"))
    e = elements.where(F.col("label").isin("formula", "number", "formula_number")).select("doc_id", "page_idx", "ord", "label", "y1")
    return e.join(pages, ["doc_id", "page_idx"]).where(_inside()).groupBy("doc_id", "ord", "label").agg(F.min("section_idx").alias("section_idx"))


def formulas_in(elements: DataFrame, sections: DataFrame) -> DataFrame:
    """(doc_id, section_idx, ord) of every section that holds a formula; inverted ranges hold none."""
    pages = _on_pages(sections, F.col("start_page"), F.col("end_page"))
    return elements.where(F.col("label") == "formula").select("doc_id", "page_idx", "ord", "y1").join(pages, ["doc_id", "page_idx"]).where(_inside()).select("doc_id", "section_idx", "ord")


def formula_counts(elements: DataFrame, sections: DataFrame) -> DataFrame:
    return formulas_in(elements, sections).groupBy("doc_id", "section_idx").agg(F.count("*").alias("formulas"))


def summary(elements: DataFrame, sections: DataFrame) -> DataFrame:
    """Sections with page_range, total_elements, formulas and numbers."""
    held = assign(elements, sections).groupBy("doc_id", "section_idx").agg(F.count("*").alias("total_elements"), F.count_if(F.col("label").isin("number", "formula_number")).alias("numbers"))
    out = sections.join(held, ["doc_id", "section_idx"], "left").join(formula_counts(elements, sections), ["doc_id", "section_idx"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(*sections.columns, F.concat_ws("-", "start_page", "end_page").alias("page_range"), zero("total_elements"), zero("formulas"), zero("numbers"))


def document_summary(pages: DataFrame, sections: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, total_pages, total_sections, page_numbers (map of page to label), numbered_pages."""
    total = pages.groupBy("doc_id").agg(F.count("*").alias("total_pages"))
    n = sections.groupBy("doc_id").agg(F.count("*").alias("total_sections"))
    numbers = labels.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("page_idx", "label")))).alias("page_numbers"))
    out = total.join(n, "doc_id", "left").join(numbers, "doc_id", "left")
    return out.select("doc_id", "total_pages", F.coalesce("total_sections", F.lit(0)).cast("long").alias("total_sections"), F.coalesce("page_numbers", F.create_map().cast("map<bigint,string>")).alias("page_numbers"))
