"""Stitching geometry: page slices of a section, its canvas, formulas on it, chunk rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def slices(sections: DataFrame, pages: DataFrame, cuts: DataFrame) -> DataFrame:
    """doc_id, section_idx, page_idx, width, y_start, y_end, uncut_end, cut, merged_start, merged_end."""
    on = sections.where("start_page <= end_page").select("doc_id", "section_idx", "start_page", "start_y", "end_page", "end_y", F.explode(F.sequence("start_page", "end_page")).alias("page_idx"))
    on = on.join(pages, ["doc_id", "page_idx"]).join(cuts, ["doc_id", "page_idx"], "left")
    y1 = F.when(F.col("page_idx") == F.col("start_page"), F.col("start_y")).otherwise(F.lit(0)).cast("long")
    y2 = F.when(F.col("page_idx") == F.col("end_page"), F.least("end_y", "height")).otherwise(F.col("height")).cast("long")
    on = on.withColumn("y_start", y1).withColumn("uncut_end", y2).withColumn("y_end", F.least("uncut_end", "cut"))  # least() passes over a null cut
    on = on.where("(cut is null or y_start < cut) and y_end > y_start")
    height = F.col("y_end") - F.col("y_start")
    before = F.coalesce(F.sum(height).over(Window.partitionBy("doc_id", "section_idx").orderBy("page_idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return on.select("doc_id", "section_idx", "page_idx", F.col("width").cast("long").alias("width"), "y_start", "y_end", "uncut_end", "cut", before.alias("merged_start"), (before + height).alias("merged_end"))


def canvases(sections: DataFrame, sliced: DataFrame) -> DataFrame:
    """doc_id, section_idx, width, height, saved_pixels, n_slices; sections without slices get 100 x 100."""
    size = sliced.groupBy("doc_id", "section_idx").agg(F.max("width").alias("w"), F.max("merged_end").alias("h"), F.sum(F.when(F.col("cut").isNotNull(), F.col("uncut_end") - F.col("y_end")).otherwise(0)).alias("s"), F.count("*").alias("n"))
    out = sections.select("doc_id", "section_idx").join(size, ["doc_id", "section_idx"], "left")
    return out.select("doc_id", "section_idx", *[F.coalesce(c, F.lit(d)).cast("long").alias(name) for c, d, name in (("w", 100, "width"), ("h", 100, "height"), ("s", 0, "saved_pixels"), ("n", 0, "n_slices"))])


def slice_offsets(sliced: DataFrame) -> DataFrame:
    """Where each slice is pasted: centred in the widest of its section."""
    return sliced.withColumn("offset_x", F.floor((F.max("width").over(Window.partitionBy("doc_id", "section_idx")) - F.col("width")) / 2))


def remap(formulas: DataFrame, sliced: DataFrame, shift_x: bool = False) -> DataFrame:
    """formulas(doc_id, section_idx, page_idx, ord, x1, y1, x2, y2) in coordinates of their section's canvas; those outside go."""
    s = slice_offsets(sliced) if shift_x else sliced.withColumn("offset_x", F.lit(0))
    j = formulas.join(s.drop("width"), ["doc_id", "section_idx", "page_idx"])
    j = j.where("(cut is null or cut = 0 or (y1 < cut and y2 <= cut)) and y_start <= y1 and y1 < y_end and y_start <= y2 and y2 <= y_end")
    new = lambda c: (F.col("merged_start") + F.col(c) - F.col("y_start")).cast("long")
    j = j.withColumn("ny1", new("y1")).withColumn("ny2", new("y2")).where("ny1 >= 0 and ny2 >= ny1")
    return j.select("doc_id", "section_idx", "page_idx", "ord", (F.col("x1") + F.col("offset_x")).cast("long").alias("x1"), F.col("ny1").alias("y1"), (F.col("x2") + F.col("offset_x")).cast("long").alias("x2"), F.col("ny2").alias("y2"))


def safe_name(name: Column) -> Column:
    return F.trim(F.substring(F.regexp_replace(name, r'[<>:"/\\|?*]', "_"), 1, 50))


def image_name(section_idx: Column, title: Column) -> Column:
    return F.concat(F.format_string("section_%02d_", section_idx), safe_name(title), F.lit(".png"))


def chunks(sections: DataFrame, labels: DataFrame, placed: DataFrame) -> DataFrame:
    """doc_id, section_idx, section_title, formulas, section_pages, section_pages_index, ancestors, image_path.

    sections carry ancestor_titles; labels(doc_id, section_idx, labels); placed are remapped formulas with `content`."""
    own = placed.groupBy("doc_id", "section_idx").agg(F.array_sort(F.collect_list(F.struct("ord", "content", F.array("x1", "y1", "x2", "y2").alias("coordinate"), F.col("page_idx").alias("page")))).alias("f"))
    out = sections.join(labels.select("doc_id", "section_idx", F.col("labels").alias("section_pages")), ["doc_id", "section_idx"], "left").join(own, ["doc_id", "section_idx"], "left")
    formulas = F.transform(F.coalesce("f", F.array().cast("array<struct<ord:bigint,content:string,coordinate:array<bigint>,page:bigint>>")), lambda x: F.struct(x["content"].alias("content"), x["coordinate"].alias("coordinate"), x["page"].alias("page")))
    index = F.when(F.col("start_page") <= F.col("end_page"), F.sequence("start_page", "end_page")).otherwise(F.array().cast("array<bigint>"))
    return out.select("doc_id", "section_idx", F.col("title").alias("section_title"), formulas.alias("formulas"), F.coalesce("section_pages", F.array().cast("array<string>")).alias("section_pages"), index.alias("section_pages_index"), F.col("ancestor_titles").alias("ancestors"), image_name(F.col("section_idx"), F.col("title")).alias("image_path"))
