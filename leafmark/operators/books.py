"""The way of a book from detected elements to chunk rows, in one call."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmark.operators import elements as el
from leafmark.operators import hierarchy, pagenums, stitch
from leafmark.operators import sections as se


def section_rows(elements: DataFrame, sections: DataFrame, verdicts: DataFrame | None, labels: DataFrame) -> DataFrame:
    """Sections with verdicts, counts and page labels, as the folds take them. verdicts as in hierarchy.apply_verdicts."""
    counts = se.summary(elements, sections).select("doc_id", "section_idx", "total_elements", "formulas", "numbers")
    return hierarchy.apply_verdicts(sections, verdicts).join(counts, ["doc_id", "section_idx"]).join(labels, ["doc_id", "section_idx"])


def folded(rows: DataFrame) -> DataFrame:
    """Rejected sections, then ancestors that are nothing but a title, then other sections that are, fold into what is before them."""
    return hierarchy.fold_title_only(hierarchy.drop_title_only_ancestors(hierarchy.fold_rejected(rows)))


def build_chunks(elements: DataFrame, pages: DataFrame, ocr: DataFrame | None = None, verdicts: DataFrame | None = None, num_pages: int | Column = 12, keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> DataFrame:
    """stitch.chunks of whole books: elements(doc_id, page_idx, ord, label, x1, y1, x2, y2, score, ocr), pages(doc_id, page_idx,
    width, height), ocr(doc_id, formula_id, ocr) of formulas, verdicts(doc_id, idx, ancestors) of a model; without these the
    numbers of the headings decide. keep(df, name) may write a step that several later ones read, and give it back read."""
    best = keep(pagenums.best_numbers(elements, pages), "numbers")
    typed = pagenums.typed(best)
    found = keep(se.identify(elements, num_pages), "sections")
    if verdicts is None:
        verdicts = hierarchy.heading_tree(found.select("doc_id", F.col("section_idx").alias("idx"), "title"))
    final = keep(folded(keep(section_rows(elements, found, verdicts, pagenums.section_labels(found, typed)), "rows")), "folded")
    sliced = stitch.slices(final, pages, pagenums.cut_lines(best))
    texts = el.with_ocr(el.formula_records(elements, pages), ocr) if ocr is not None else el.formula_records(elements, pages).withColumn("ocr_content", F.lit(""))
    held = se.formulas_in(elements, final).join(elements.select("doc_id", "ord", "page_idx", "x1", "y1", "x2", "y2"), ["doc_id", "ord"])
    placed = stitch.remap(held, sliced).join(texts.select("doc_id", "ord", F.col("ocr_content").alias("content")), ["doc_id", "ord"])
    return stitch.chunks(final, final.select("doc_id", "section_idx", "labels"), placed)
