"""Detected elements: filters, boxes, formula ids and quality reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LABELS = ("paragraph_title", "formula", "number", "formula_number")


@dataclass(frozen=True)
class Thresholds:
    """Bounds of a formula's size as shares of its page, and its least score; all inclusive."""

    min_width: float = 0.045
    max_width: float = 0.85
    min_height: float = 0.015
    max_height: float = 0.25
    min_area: float = 0.0003
    min_score: float = 0.65


def of_labels(elements: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    return elements.where(F.col("label").isin(*labels))


def label_counts(elements: DataFrame) -> DataFrame:
    return elements.groupBy("label").agg(F.count("*").alias("n"))


def crop_boxes(elements: DataFrame, pages: DataFrame, pad: int = 10) -> DataFrame:
    """Each element's box with padding, clamped to its page."""
    low = lambda c: F.greatest(F.col(c) - pad, F.lit(0)).cast("long")
    high = lambda c, side: F.least(F.col(c) + pad, F.col(side)).cast("long")
    out = elements.join(pages, ["doc_id", "page_idx"])
    return out.select("doc_id", "page_idx", "ord", low("x1").alias("cx1"), low("y1").alias("cy1"), high("x2", "width").alias("cx2"), high("y2", "height").alias("cy2"))


def measured(elements: DataFrame, pages: DataFrame) -> DataFrame:
    """Formulas with size and share of the page."""
    f = elements.where(F.col("label") == "formula").join(pages, ["doc_id", "page_idx"])
    f = f.withColumn("w", F.col("x2") - F.col("x1")).withColumn("h", F.col("y2") - F.col("y1")).withColumn("area", F.col("w") * F.col("h"))
    return f.withColumn("rw", F.col("w") / F.col("width")).withColumn("rh", F.col("h") / F.col("height")).withColumn("ra", F.col("area") / (F.col("width") * F.col("height")))


def _fits(t: Thresholds) -> Column:
    return F.col("rw").between(t.min_width, t.max_width) & F.col("rh").between(t.min_height, t.max_height) & (F.col("ra") >= t.min_area) & (F.col("score") >= t.min_score)


def kept_formulas(elements: DataFrame, pages: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    return measured(elements, pages).where(_fits(t))


def _half_even(c: str, places: int) -> Column:
    """Half-even on the scaled double; bround() would go by the decimal digits that are printed."""
    return F.rint(F.col(c) * 10.0**places) / 10.0**places


def formula_records(elements: DataFrame, pages: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Kept formulas with formula_id (numbered in detection order on their page) and rounded size info."""
    n = F.row_number().over(Window.partitionBy("doc_id", "page_idx").orderBy("ord")) - 1
    return kept_formulas(elements, pages, t).select(
        "doc_id", "page_idx", "ord", F.format_string("page_%d_formula_%d", F.col("page_idx"), n).alias("formula_id"), "x1", "y1", "x2", "y2", "score",
        F.col("w").cast("long").alias("width"), F.col("h").cast("long").alias("height"), F.col("area").cast("long").alias("area"),
        _half_even("rw", 4).alias("width_ratio"), _half_even("rh", 4).alias("height_ratio"), _half_even("ra", 6).alias("area_ratio"),
    )


def rejected(elements: DataFrame, pages: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Formulas that are not kept with the codes of the reasons."""
    tests = {
        "width_too_small": F.col("rw") < t.min_width, "height_too_small": F.col("rh") < t.min_height, "area_too_small": F.col("ra") < t.min_area,
        "width_too_large": F.col("rw") > t.max_width, "height_too_large": F.col("rh") > t.max_height, "score_too_low": F.col("score") < t.min_score,
    }
    return measured(elements, pages).where(~_fits(t)).withColumn("reasons", F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in tests.items()])))


def rejection_reasons(bad: DataFrame) -> DataFrame:
    """(reason, n, percent): percent of all rejected formulas."""
    by = bad.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
    return by.crossJoin(F.broadcast(bad.agg(F.count("*").alias("all")))).select("reason", "n", F.round(100.0 * F.col("n") / F.col("all"), 6).alias("percent"))  # one row


def rejection_sizes(bad: DataFrame) -> DataFrame:
    """(metric, lowest, highest, mean, n) of six size metrics."""
    metrics = {"width": "w", "height": "h", "area": "area", "width_ratio": "rw", "height_ratio": "rh", "area_ratio": "ra"}
    long = bad.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(c).cast("double").alias("v")) for k, c in metrics.items()])).alias("m")).select("m.*")
    return long.groupBy("metric").agg(F.round(F.min("v"), 6).alias("lowest"), F.round(F.max("v"), 6).alias("highest"), F.round(F.avg("v"), 6).alias("mean"), F.count("*").alias("n"))


def rejection_pages(bad: DataFrame) -> DataFrame:
    return bad.groupBy("page_idx").agg(F.count("*").alias("n"))


def rejection_cube(bad: DataFrame) -> DataFrame:
    """(level, reason, page_idx, n): reasons, pages and reasons by page in one pass over the rejected formulas, by grouping sets. A
    formula counts once for each of its reasons on the levels reason and both, and once on the level page."""
    # the first row of a formula stands for it where reasons do not matter
    rows = bad.select("page_idx", F.posexplode("reasons").alias("at", "reason"))
    r, p = F.col("reason"), F.col("page_idx")
    out = rows.groupingSets([[r], [p], [r, p]], r, p).agg(F.grouping_id().alias("g"), F.count("*").alias("each"), F.count_if(F.col("at") == 0).alias("once"))
    level = F.when(F.col("g") == 0, "both").when(F.col("g") == 1, "reason").otherwise("page")
    return out.select(level.alias("level"), "reason", "page_idx", F.when(F.col("g") == 2, F.col("once")).otherwise(F.col("each")).alias("n"))


def with_ocr(formulas: DataFrame, ocr: DataFrame) -> DataFrame:
    """Recognised text by (doc_id, formula_id); '' where there is none."""
    return formulas.join(ocr.withColumnRenamed("ocr", "_ocr"), ["doc_id", "formula_id"], "left").withColumn("ocr_content", F.coalesce("_ocr", F.lit(""))).drop("_ocr")
