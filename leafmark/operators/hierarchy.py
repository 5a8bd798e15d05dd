"""Hierarchy repair: heading keys and ancestors, folding of rejected and empty sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmark.operators.sections import NONAME

#: A heading begins with a chapter mark or a dotted number that no bracket closes.
HEADING = r"^\s*(?:([0-9]+|[IVX]+)章|([0-9]+(?:\.[0-9]+)*)(?![0-9.]*[)）]))"
MIN_HEIGHT = 170


def heading_key(title: Column) -> Column:
    """'1.2' of '1.2 Scope', '3' of a third chapter; '' for no heading."""
    return F.coalesce(F.concat(F.regexp_extract(title, HEADING, 1), F.regexp_extract(title, HEADING, 2)), F.lit(""))


def heading_tree(titles: DataFrame) -> DataFrame:
    """titles(doc_id, idx, title) -> doc_id, idx, title, key, ancestors (top down, by idx) of the valid headings.

    The parent is the latest earlier heading with the number one level up: in one pass over (doc_id, number), headings and
    those who look for them are sorted together and the last heading before is carried on. A parent has one number less, so
    the longest number in the data tells how many times the next ancestor is to be looked up.
    """
    valid = titles.withColumn("key", heading_key(F.col("title"))).where("key <> ''").select("doc_id", "idx", "title", "key")
    up = F.when(F.col("key").contains("."), F.regexp_replace("key", r"\.[0-9]+$", ""))
    asked = valid.select("doc_id", "idx", up.alias("at"), F.lit(None).cast("long").alias("here")).where("at is not null")
    there = valid.select("doc_id", "idx", F.col("key").alias("at"), F.col("idx").alias("here"))
    before = Window.partitionBy("doc_id", "at").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    parents = asked.unionByName(there).withColumn("parent", F.last("here", ignorenulls=True).over(before)).where("here is null and parent is not null").select("doc_id", "idx", "parent")
    out = valid.join(parents, ["doc_id", "idx"], "left").withColumn("ancestors", F.when(F.col("parent").isNotNull(), F.array("parent")).otherwise(F.array().cast("array<bigint>")))
    step = parents.select("doc_id", F.col("idx").alias("parent"), F.col("parent").alias("next"))
    depth = valid.agg(F.max(F.size(F.split("key", r"\."))).alias("n")).first().n or 0
    for _ in range(depth - 2):
        out = out.join(step, ["doc_id", "parent"], "left").withColumn("ancestors", F.when(F.col("next").isNotNull(), F.concat(F.array("next"), "ancestors")).otherwise(F.col("ancestors"))).withColumn("parent", F.col("next")).drop("next")
    return out.select("doc_id", "idx", "title", "key", "ancestors")


def apply_verdicts(sections: DataFrame, verdicts: DataFrame | None) -> DataFrame:
    """Sections with kept, ancestors and ancestor_titles. verdicts(doc_id, idx, ancestors); None keeps all, an empty table only
    the nameless first section."""
    none = F.array().cast("array<bigint>")
    if verdicts is None:
        out = sections.withColumn("kept", F.lit(True)).withColumn("ancestors", none)
    else:
        head = (F.col("section_idx") == 0) & (F.col("title") == NONAME)
        v = verdicts.select("doc_id", F.col("idx").alias("section_idx"), F.col("ancestors").alias("_a"))
        out = sections.join(v, ["doc_id", "section_idx"], "left").withColumn("kept", head | F.col("_a").isNotNull()).withColumn("ancestors", F.when(head, none).otherwise(F.coalesce("_a", none))).drop("_a")
    asked = out.select("doc_id", "section_idx", F.posexplode("ancestors").alias("pos", "a"))
    names = sections.select("doc_id", F.col("section_idx").alias("a"), F.col("title").alias("t"))
    found = asked.join(names, ["doc_id", "a"]).groupBy("doc_id", "section_idx").agg(F.array_sort(F.collect_list(F.struct("pos", "t"))).alias("l")).select("doc_id", "section_idx", F.col("l.t").alias("ancestor_titles"))
    return out.join(found, ["doc_id", "section_idx"], "left").withColumn("ancestor_titles", F.coalesce("ancestor_titles", F.array().cast("array<string>")))


def _folded(rows: DataFrame, kept: Column) -> DataFrame:
    """Rows that are not kept widen the kept row before them; rows before any kept one are lost."""
    order = Window.partitionBy("doc_id").orderBy("section_idx")
    g = rows.withColumn("_g", F.sum(kept.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("_g > 0")
    first = lambda c: F.min_by(c, "section_idx").alias(c)
    last = lambda c: F.max_by(c, "section_idx").alias(c)
    labels = F.array_distinct(F.flatten(F.col("_l.labels")))
    out = g.groupBy("doc_id", "_g").agg(
        F.min("section_idx").alias("section_idx"), first("title"), first("start_page"), first("start_y"), last("end_page"), last("end_y"), first("ancestors"), first("ancestor_titles"),
        F.array_sort(F.collect_list(F.struct("section_idx", "labels"))).alias("_l"), *[F.sum(c).alias(c) for c in ("total_elements", "formulas", "numbers")],
    )
    return out.withColumn("labels", labels).drop("_g", "_l")


def fold_rejected(rows: DataFrame) -> DataFrame:
    """rows: sections with kept, ancestors, ancestor_titles, labels (in page order) and counts."""
    return _folded(rows, F.col("kept"))


def title_only() -> Column:
    return (F.col("start_page") == F.col("end_page")) & (F.col("end_y") - F.col("start_y") < MIN_HEIGHT)


def drop_title_only_ancestors(rows: DataFrame) -> DataFrame:
    named = rows.select("doc_id", F.explode("ancestors").alias("section_idx")).distinct()
    empty = rows.where(title_only()).select("doc_id", "section_idx").join(named, ["doc_id", "section_idx"], "left_semi")
    return rows.join(empty, ["doc_id", "section_idx"], "left_anti")


def fold_title_only(rows: DataFrame) -> DataFrame:
    """Sections that are nothing but a title widen the survivor before them; the first row always survives."""
    rn = F.row_number().over(Window.partitionBy("doc_id").orderBy("section_idx"))
    return _folded(rows.withColumn("_keep", (rn == 1) | ~title_only()), F.col("_keep")).drop("_keep")


def totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc_id").agg(F.count("*").alias("total_sections"))
