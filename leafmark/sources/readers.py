"""Readers: summary reports, page files, OCR maps, book folders, images. Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SECTION = "struct<index:bigint,title:string,page_range:string,precise_range:struct<start_page:bigint,start_y:double,end_page:bigint,end_y:double,page_numbers:array<string>>,total_elements:bigint,formulas:bigint,numbers:bigint,ancestors:array<bigint>,ancestor_titles:array<string>>"
REPORT = f"total_pages bigint, total_sections bigint, page_numbers map<string,string>, sections array<{SECTION}>, _corrupt_record string"


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def _place(depth: str) -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), depth, 1)


def read_reports(spark: SparkSession, root: str, pattern: str = "*/*/summary_report.json") -> DataFrame:
    """A row for each book with a report: collection, book_index, readable, totals, page_numbers, sections. Unreadable JSON
    keeps the book with defaults. Folders that are not numbers are no books."""
    schema = REPORT
    path = f"{root}/{pattern}"
    if not _exists(spark, path):
        return spark.createDataFrame([], "collection string, book_index bigint, readable boolean, total_pages bigint, total_sections bigint, page_numbers map<string,string>, sections array<" + SECTION + ">")
    raw = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    rows = raw.withColumn("collection", _place(r"([^/=]+)/[^/]+/[^/]+$")).withColumn("book", _place(r"([^/=]+)/[^/]+$"))
    sections = F.coalesce("sections", F.array().cast(f"array<{SECTION}>"))
    return rows.where(F.col("book").rlike("^[0-9]+$")).select(
        F.expr("url_decode(collection)").alias("collection"), F.expr("try_cast(book as bigint)").alias("book_index"), F.col("_corrupt_record").isNull().alias("readable"), F.coalesce("total_pages", F.lit(0)).cast("long").alias("total_pages"),
        F.coalesce("total_sections", F.size(sections)).cast("long").alias("total_sections"), F.coalesce("page_numbers", F.create_map().cast("map<string,string>")).alias("page_numbers"), sections.alias("sections"),
    )


def report_sections(reports: DataFrame) -> DataFrame:
    """(collection, book_index, pos, title, …) of the sections of reports, with all that a report says of a section."""
    return reports.select("collection", "book_index", F.posexplode("sections").alias("pos", "s")).select("collection", "book_index", F.col("pos").cast("long").alias("pos"), "s.*")


def list_pages(files: DataFrame) -> DataFrame:
    """files(doc_id, path) -> doc_id, page_idx, path. page_X_Y comes at (X, Y), page_X at (X, 0), other names last; ties by path."""
    name = F.regexp_extract("path", r"([^/]+)\.[A-Za-z]+$", 1)
    number = lambda k: F.expr(f"try_cast(regexp_extract(_name, '^page_([0-9]+)(?:_([0-9]+))?$', {k}) as bigint)")
    rows = files.where(F.lower("path").rlike(r"\.(png|jpe?g)$")).withColumn("_name", name).withColumn("_x", F.coalesce(number(1), F.lit(999_999))).withColumn("_y", F.when(F.col("_x") == 999_999, F.lit(999_999)).otherwise(F.coalesce(number(2), F.lit(0))))
    order = Window.partitionBy("doc_id").orderBy("_x", "_y", "path")
    return rows.select("doc_id", (F.row_number().over(order) - 1).cast("long").alias("page_idx"), "path")


def read_files(spark: SparkSession, root: str, pattern: str = "*.png", content: bool = False) -> DataFrame:
    """(path[, content]) of files below root."""
    if not _exists(spark, root):
        return spark.createDataFrame([], "path string, content binary" if content else "path string")
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root)
    return df.select("path", "content") if content else df.select("path")


def read_ocr_map(spark: SparkSession, path: str, value: str, pattern: str | None = None) -> DataFrame:
    """(file, key, value) of JSON objects with numbers for names; value is the Spark type of the values. Absent files are empty. path
    names the files, stars included, or with pattern the folder that they lie below: then tasks list it, not the driver."""
    if not _exists(spark, path):
        return spark.createDataFrame([], f"file string, key bigint, value {value}")
    reader = spark.read.option("wholetext", True)
    text = (reader if pattern is None else reader.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)).text(path).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", f"map<string,{value}>").alias("m"))
    return text.select("file", F.explode("m").alias("k", "value")).select("file", F.expr("try_cast(k as bigint)").alias("key"), "value").where("key is not null")


def books(folders: DataFrame, reports: DataFrame) -> DataFrame:
    """folders(collection, name) -> the numbered ones with title, total_pages, total_sections; without a report "Book n", 0, 0."""
    numbered = folders.where(F.col("name").rlike("^[0-9]+$")).select("collection", F.expr("try_cast(name as bigint)").alias("book_index")).distinct()
    out = numbered.join(reports.select("collection", "book_index", "readable", "total_pages", "total_sections"), ["collection", "book_index"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("collection", "book_index", F.coalesce("readable", F.lit(False)).alias("has_report"), F.concat(F.lit("Book "), F.col("book_index").cast("string")).alias("title"), zero("total_pages"), zero("total_sections"))


def data_uri(content: Column) -> Column:
    """One line, whatever the session says about breaking base64 into lines."""
    return F.when(content.isNotNull(), F.concat(F.lit("data:image/png;base64,"), F.regexp_replace(F.base64(content), "\r\n", "")))


def chunk_images(chunks: DataFrame, images: DataFrame) -> DataFrame:
    """chunks(chunk_id, image_path), images(folder_id, name, content) -> chunk_id, uris in the order of the file names."""
    by = images.groupBy("folder_id").agg(F.array_sort(F.collect_list(F.struct("name", data_uri(F.col("content")).alias("uri")))).alias("l"))
    return chunks.join(by, chunks["chunk_id"] == by["folder_id"], "left").select(chunks["chunk_id"], F.coalesce(F.col("l.uri"), F.array().cast("array<string>")).alias("uris"))
