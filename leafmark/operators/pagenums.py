"""Printed page numbers: choice, typed labels, cut lines, formatting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_DASH = "-–—"


def best_numbers(elements: DataFrame, pages: DataFrame) -> DataFrame:
    """The lowest `number` element with text of each page; of equally low ones the first detected."""
    found = elements.where((F.col("label") == "number") & (F.trim(F.coalesce("ocr", F.lit(""))) != ""))
    first = Window.partitionBy("doc_id", "page_idx").orderBy(F.col("y1").desc(), F.col("ord"))
    best = found.withColumn("rn", F.row_number().over(first)).where("rn = 1")
    return best.join(pages, ["doc_id", "page_idx"]).select("doc_id", "page_idx", "ord", "y1", "ocr", F.round(F.col("y1") / F.col("height") * 100, 6).alias("y_percent"))


def typed(best: DataFrame) -> DataFrame:
    """label, number (null unless all ASCII digits) and is_digit; a number's leading zeros are lost."""
    text = F.trim("ocr")
    digits = text.rlike("^[0-9]+$")
    number = F.when(digits, F.expr("try_cast(trim(ocr) as bigint)"))
    return best.withColumn("number", number).withColumn("is_digit", digits).withColumn("label", F.coalesce(number.cast("string"), text))


def cut_lines(best: DataFrame, padding: int = 60) -> DataFrame:
    """(doc_id, page_idx, cut): nothing below cut is part of a page's content."""
    return best.select("doc_id", "page_idx", F.greatest(F.lit(0), F.col("y1") - padding).cast("long").alias("cut"))


def section_labels(sections: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, section_idx, labels): labels of a section's pages in page order; inverted ranges have no pages."""
    pages = sections.where("start_page <= end_page").select("doc_id", "section_idx", F.explode(F.sequence("start_page", "end_page")).alias("page_idx"))
    by = pages.join(labels.select("doc_id", "page_idx", "label"), ["doc_id", "page_idx"]).groupBy("doc_id", "section_idx")
    found = by.agg(F.array_sort(F.collect_list(F.struct("page_idx", "label"))).alias("l")).select("doc_id", "section_idx", F.col("l.label").alias("labels"))
    return sections.select("doc_id", "section_idx").join(found, ["doc_id", "section_idx"], "left").withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))


def format_label(page: Column, prefix: str = "Trang") -> Column:
    """'' for nothing, labels that carry a word stay, ranges and single labels get the prefix."""
    raw = F.regexp_replace(page.cast("string"), r"^\s+|\s+$", "")
    bare = F.regexp_replace(raw, rf"^[\s{_DASH}]+|[\s{_DASH}]+$", "")
    parts = F.split(bare, rf"\s*[{_DASH}]\s*", -1)
    pair = (F.size(parts) == 2) & (F.get(parts, F.lit(0)) != "") & (F.get(parts, F.lit(1)) != "")
    out = F.when(raw.isNull() | (raw == ""), F.lit("")).when(raw.rlike(r"(?i)^(trang|page)\b"), raw).when(bare == "", raw)
    return out.when(pair, F.concat(F.lit(f"{prefix} "), F.get(parts, F.lit(0)), F.lit(" - "), F.get(parts, F.lit(1)))).otherwise(F.concat(F.lit(f"{prefix} "), bare))


def capped(labels: Column, most: int = 4) -> Column:
    """struct(shown, hidden): the first labels and how many are not shown."""
    return F.struct(F.slice(labels, 1, most).alias("shown"), F.greatest(F.lit(0), F.size(labels) - most).cast("long").alias("hidden"))
