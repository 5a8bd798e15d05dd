"""Rollups: tables of contents, upload gate and report, chat sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmark.operators.sections import NONAME

MAX_BYTES = 500 * 1024 * 1024


def book_titles(books: DataFrame, sections: DataFrame) -> DataFrame:
    """collection, book_index, title: the first section title with a name, else "Document", and the number of pages. A book
    without a report is "Book n". books(collection, book_index, has_report, total_pages), sections(collection, book_index, pos, title)."""
    named = sections.where((F.trim("title") != "") & (F.lower(F.trim("title")) != NONAME))
    first = named.groupBy("collection", "book_index").agg(F.min_by(F.trim("title"), "pos").alias("t"))
    out = books.join(first, ["collection", "book_index"], "left")
    pages = F.concat(F.lit(" ("), F.col("total_pages").cast("string"), F.lit(" pages)"))
    title = F.when(F.col("has_report"), F.concat(F.coalesce("t", F.lit("Document")), pages)).otherwise(F.concat(F.lit("Book "), F.col("book_index").cast("string")))
    return out.select("collection", "book_index", title.alias("title"), F.when(F.col("has_report"), F.col("total_pages")).otherwise(0).cast("long").alias("total_pages"))


def by_number(rows: Column, field: str) -> Column:
    """An array of structs in order of a field; the structs themselves may hold maps, which have no order."""
    return F.array_sort(rows, lambda a, b: F.when(a[field] < b[field], -1).when(a[field] > b[field], 1).otherwise(0))


def book_contents(books: DataFrame, sections: DataFrame, form: str = "full") -> DataFrame:
    """A row for each book: collection, book_index, book_folder, title, total_pages, total_sections, sections in order, and in
    form "full" page_numbers. Form "full" keeps every column of the sections, "simple" their titles only. books may carry
    total_sections and page_numbers as their report has them; without the first the sections are counted."""
    more = [c for c in sections.columns if c not in ("collection", "book_index", "pos", "index")]
    own = sections.groupBy("collection", "book_index").agg(by_number(F.collect_list(F.struct("pos", F.struct(*more).alias("s"))), "pos").alias("_s"))
    report = books.select("collection", "book_index", "has_report", *[F.col(c).alias(f"_{c}") for c in ("total_sections", "page_numbers") if c in books.columns])
    rows = book_titles(books, sections).join(report, ["collection", "book_index"]).join(own, ["collection", "book_index"], "left")
    none = F.array().cast(own.schema["_s"].dataType)
    listed = F.when(F.col("has_report"), F.coalesce("_s", none)).otherwise(none)
    if form == "simple":
        shown = F.transform(listed, lambda x: F.struct(x["s"]["title"].alias("title")))
    else:
        shown = F.transform(listed, lambda x, i: F.struct(i.cast("long").alias("index"), *[x["s"][c].alias(c) for c in more]))
    total = F.coalesce("_total_sections", F.size(listed)) if "total_sections" in books.columns else F.size(listed)
    out = ["collection", "book_index", F.col("book_index").cast("string").alias("book_folder"), "title", "total_pages", F.when(F.col("has_report"), total).otherwise(0).cast("long").alias("total_sections"), shown.alias("sections")]
    if form != "simple" and "page_numbers" in books.columns:
        out.append(F.when(F.col("has_report"), F.col("_page_numbers")).alias("page_numbers"))
    return rows.select(*out)


def contents(books: DataFrame, sections: DataFrame, form: str = "full") -> DataFrame:
    """collection_name, total_books, books: the table of contents of a collection as one document, its books by index. For
    large collections keep to book_contents, which never gathers a collection into a row."""
    rows = book_contents(books, sections, form)
    book = F.struct(*[c for c in rows.columns if c != "collection"])
    return rows.groupBy(F.col("collection").alias("collection_name")).agg(F.count("*").alias("total_books"), by_number(F.collect_list(book), "book_index").alias("books"))


def collection_totals(books: DataFrame, sections: DataFrame) -> DataFrame:
    """collection, books, sections and pages (of books with a report)."""
    n = sections.groupBy("collection", "book_index").agg(F.count("*").alias("n"))
    rows = books.join(n, ["collection", "book_index"], "left")
    out = rows.groupBy("collection").agg(F.count("*").alias("books"), F.sum(F.coalesce("n", F.lit(0))).alias("sections"), F.sum(F.when(F.col("has_report"), F.col("total_pages")).otherwise(0)).alias("pages"))
    return out.select("collection", *[F.col(c).cast("long").alias(c) for c in ("books", "sections", "pages")])


def totals_by_level(books: DataFrame, sections: DataFrame) -> DataFrame:
    """level (book, collection, all), collection, book_index, books, sections, pages: collection_totals of every level from one
    pass, by grouping sets over a row for each book."""
    n = sections.groupBy("collection", "book_index").agg(F.count("*").alias("n"))
    rows = books.join(n, ["collection", "book_index"], "left")
    sums = F.count("*").alias("books"), F.sum(F.coalesce("n", F.lit(0))).alias("sections"), F.sum(F.when(F.col("has_report"), F.col("total_pages")).otherwise(0)).alias("pages")
    c, b = F.col("collection"), F.col("book_index")
    out = rows.groupingSets([[c, b], [c], []], c, b).agg(F.grouping_id().alias("g"), *sums)
    level = F.when(F.col("g") == 0, "book").when(F.col("g") == 1, "collection").otherwise("all")
    return out.select(level.alias("level"), "collection", "book_index", *[F.col(x).cast("long").alias(x) for x in ("books", "sections", "pages")])


def gate(files: DataFrame, metadata_counts: DataFrame | None = None) -> DataFrame:
    """files(batch, name, size_bytes) with accepted and reason. metadata_counts(batch, n): where given, a batch of another
    number of files is rejected whole. Batches are counted and compared on their own, and only those that differ are joined
    back, so no batch meets in one task."""
    bad = F.when(~F.lower("name").endswith(".pdf"), "not_pdf").when(F.col("size_bytes") > MAX_BYTES, "too_large")
    if metadata_counts is not None:
        counted = files.groupBy("batch").agg(F.count("*").alias("_files")).join(metadata_counts.select("batch", F.col("n").alias("_n")), "batch", "left")
        differ = counted.where(F.coalesce(F.col("_files") != F.col("_n"), F.lit(True))).select(F.col("batch").alias("_batch"), F.lit(True).alias("_differs"))
        files = files.join(differ, F.col("batch").eqNullSafe(F.col("_batch")), "left").drop("_batch")
        bad = F.when(F.coalesce("_differs", F.lit(False)), "metadata_mismatch").otherwise(bad)
    return files.withColumn("reason", bad).withColumn("accepted", F.col("reason").isNull()).drop("_differs")


def rejected_files(gated: DataFrame) -> DataFrame:
    """batch, name, reason: a row for each file that was turned away."""
    return gated.where("not accepted").select("batch", "name", "reason")


def file_pages(gated: DataFrame) -> DataFrame:
    """batch, name, pages of accepted files; of equal names the last upload counts."""
    ok = gated.where("accepted")
    return ok.groupBy("batch", "name").agg(F.max_by("pages", "seq").alias("pages"))


def upload_report(gated: DataFrame) -> DataFrame:
    """batch, success, processed_files, chunks, total_pages (the same number), file_pages (last of a name wins), errors.

    gated carries accepted, reason, name, seq (order of upload) and pages (section images made of it). Lists within a report are
    as long as the batch; rejected_files and file_pages give the same as rows."""
    maps = file_pages(gated).groupBy("batch").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "pages")))).alias("file_pages"))
    all_ = gated.groupBy("batch").agg(F.count_if("accepted").alias("processed_files"), F.coalesce(F.sum(F.when(F.col("accepted"), F.col("pages"))), F.lit(0)).alias("chunks"), F.array_sort(F.collect_list(F.when(~F.col("accepted"), F.concat_ws(": ", "name", "reason")))).alias("errors"))
    out = all_.join(maps, "batch", "left")
    return out.select("batch", (F.col("processed_files") > 0).alias("success"), "processed_files", "chunks", F.col("chunks").alias("total_pages"), F.coalesce("file_pages", F.create_map().cast("map<string,bigint>")).alias("file_pages"), "errors")


def upload_summary(gated: DataFrame) -> DataFrame:
    """batch, success, processed_files, rejected_files, chunks, files_digest, errors_digest: upload_report without lists, so a batch
    of any size is a few numbers. A digest is the sum of the first 28 bits of the MD5 of each "name=pages" or "name: reason", whatever
    their order; rejected_files and file_pages give the rows."""
    code = lambda text: F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long")
    files = file_pages(gated).groupBy("batch").agg(F.sum(code(F.concat_ws("=", "name", "pages"))).alias("files_digest"))
    bad = ~F.col("accepted")
    counts = gated.groupBy("batch").agg(F.count_if("accepted").alias("processed_files"), F.count_if(bad).alias("rejected_files"), F.sum(F.when(F.col("accepted"), F.col("pages"))).alias("chunks"), F.sum(F.when(bad, code(F.concat_ws(": ", "name", "reason")))).alias("errors_digest"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return counts.join(files, "batch", "left").select("batch", (F.col("processed_files") > 0).alias("success"), "processed_files", "rejected_files", zero("chunks"), zero("files_digest"), zero("errors_digest"))


def short_title(text: Column, most: int = 38) -> Column:
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(F.char_length(t) > most, F.concat(F.substring(t, 1, most), F.lit("..."))).otherwise(t)


def sessions(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) -> session_id, title of the first question, turns (questions), messages."""
    asked = F.col("role") == "user"
    out = turns.groupBy(F.col("conv_id").alias("session_id")).agg(F.min_by(F.when(asked, F.col("text")), F.when(asked, F.col("turn"))).alias("q"), F.count_if(asked).alias("turns"), F.count("*").alias("messages"), F.max("turn").alias("last_turn"))
    return out.select("session_id", short_title(F.coalesce("q", F.lit(""))).alias("title"), "turns", "messages", "last_turn")


def latest_session(rows: DataFrame) -> DataFrame:
    """rows(session_id, collection, updated_at) -> the session of each collection that was touched last."""
    return rows.groupBy("collection").agg(F.max_by("session_id", F.struct("updated_at", "session_id")).alias("session_id"), F.max("updated_at").alias("updated_at"))
