"""Page preparation: geometry over page rows (doc_id, page_idx, width, height)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dynamic_dpi(pages: DataFrame, anchor: int = 500_990, dpi: int = 300, min_dpi: int = 45) -> DataFrame:
    """(doc_id, dpi) from the size of each document's first page."""
    size = F.col("width") * F.col("height")
    return pages.where("page_idx = 0").select("doc_id", F.greatest(F.lit(min_dpi), F.floor(anchor / size * dpi).cast("int")).cast("long").alias("dpi"))


def page_cap(pages: DataFrame, max_pages: int | None) -> DataFrame:
    """The first max_pages sheets; 0 or None keeps all. Comes before the split."""
    return pages.where(F.col("page_idx") < max_pages) if max_pages else pages


def vertical_split(pages: DataFrame) -> DataFrame:
    """Left half [0, w div 2) and right half [w div 2, w) of every sheet, as pages 2p and 2p + 1."""
    half = F.floor(F.col("width") / 2)
    sides = F.array(F.struct(F.lit(0).alias("side"), F.lit(0).cast("long").alias("x0"), half.alias("x1")), F.struct(F.lit(1).alias("side"), half.alias("x0"), F.col("width").cast("long").alias("x1")))
    out = pages.withColumn("s", F.explode(sides))
    return out.select("doc_id", (F.col("page_idx") * 2 + F.col("s.side")).cast("long").alias("page_idx"), "s.x0", "s.x1", (F.col("s.x1") - F.col("s.x0")).alias("width"), F.col("height").cast("long").alias("height"))


def trim(pages: DataFrame, top: int = 0, bottom: int = 0, left: int = 0, right: int = 0) -> DataFrame:
    """Margins cut off, each clamped to what is left of the page."""
    x0, y0 = F.least(F.greatest(F.lit(left), F.lit(0)), F.col("width")), F.least(F.greatest(F.lit(top), F.lit(0)), F.col("height"))
    x1 = F.col("width") - F.least(F.greatest(F.lit(right), F.lit(0)), F.col("width") - x0)
    y1 = F.col("height") - F.least(F.greatest(F.lit(bottom), F.lit(0)), F.col("height") - y0)
    return pages.select("doc_id", "page_idx", *[c.cast("long").alias(n) for c, n in ((x0, "x0"), (y0, "y0"), (x1, "x1"), (y1, "y1"))])


def content_box(pages: DataFrame, boxes: DataFrame, padding: int = 30) -> DataFrame:
    """Bounding box of a page's text boxes with padding. Pages without text go, later ones are numbered anew; orig_page_idx stays."""
    hull = boxes.groupBy("doc_id", "page_idx").agg(F.min("x1").alias("a"), F.min("y1").alias("b"), F.max("x2").alias("c"), F.max("y2").alias("d"))
    out = pages.join(hull, ["doc_id", "page_idx"]).select(
        "doc_id", F.col("page_idx").alias("orig_page_idx"), (F.row_number().over(Window.partitionBy("doc_id").orderBy("page_idx")) - 1).cast("long").alias("page_idx"),
        F.greatest(F.col("a") - padding, F.lit(0)).cast("long").alias("x0"), F.greatest(F.col("b") - padding, F.lit(0)).cast("long").alias("y0"),
        F.least(F.col("c") + padding, F.col("width")).cast("long").alias("x1"), F.least(F.col("d") + padding, F.col("height")).cast("long").alias("y1"),
    )
    return out


def uniform_width(crops: DataFrame) -> DataFrame:
    """Every crop padded to the widest of its document: new width and the offset at which it is pasted."""
    w = F.col("x1") - F.col("x0")
    out = crops.withColumn("width", w).withColumn("max_width", F.max(w).over(Window.partitionBy("doc_id")))
    return out.withColumn("offset_x", F.floor((F.col("max_width") - F.col("width")) / 2))


def visual_tokens(width: Column, height: Column, min_width: int = 600, patch: int = 14, merge: int = 2, min_pixels: int = 3136, max_pixels: int = 1_003_520) -> Column:
    """struct(grid_w, grid_h, tokens) after the resize; null where a side is more than 200 times the other in the bounded resize.

    The width is fixed at round(min_width / f) * f and the height follows; outside the bounds both sides are rounded and then
    scaled into them. Rounding is half-even.
    """
    f = patch * merge
    wide = round(min_width / f) * f
    tall = F.bround(wide / width * height / f) * f
    h1, w1 = F.bround(height / f) * f, F.bround(width / f) * f
    down, up = F.sqrt(height * width / max_pixels), F.sqrt(min_pixels / (height * width))
    shrink = lambda x: F.greatest(F.lit(float(f)), F.floor(x / down / f) * f)
    grow = lambda x: F.ceil(x * up / f) * f
    fit = lambda r, x: F.when(h1 * w1 > max_pixels, shrink(x)).when(h1 * w1 < min_pixels, grow(x)).otherwise(r).cast("double")
    inside = (tall * wide).between(min_pixels, max_pixels)
    w = F.when(inside, F.lit(float(wide))).otherwise(fit(w1, width))
    h = F.when(inside, tall.cast("double")).otherwise(fit(h1, height))
    far = ~inside & (F.greatest(height, width) / F.least(height, width) > 200)
    grid = lambda x: F.floor(F.floor(x / patch) / merge).cast("long")
    return F.when(~far, F.struct(grid(w).alias("grid_w"), grid(h).alias("grid_h"), (grid(w) * grid(h)).alias("tokens")))
