"""The registered queries: each operator on the views of plans.fixtures, flat and with every column cast."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.functions.ids import file_id
from leafmark.operators import books, elements, hierarchy, lsh, models, pagenums, pages, retrieval, rollups, sections, stitch, title_index, token_store, vectors
from leafmark.plans.fixtures import view
from leafmark.plans.session import scratch_dir, ship_package
from leafmark.sources import book_folders, readers, sinks
from leafmark.streaming import ingest

#: Folders that op_src3 deals its files to.
MAP_FOLDERS = 256
#: Ids of a source that op_ve2 batches in one task.
SHARD_IDS = 20_000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def joined(c: str | Column) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), "|")


def _pe(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return view(s, d, "fx_pages"), view(s, d, "fx_elements")


def _kept(df: DataFrame, name: str) -> DataFrame:
    """A step that several later ones read, written to the shared folder once."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _sheets(s: SparkSession, d: str) -> DataFrame:
    """Pages of many sizes."""
    p = view(s, d, "fx_pages")
    return p.withColumn("width", 800 + F.col("doc_id") % 9 * 100 + F.col("page_idx") * 3).withColumn("height", 1200 + F.col("doc_id") % 5 * 150)


# pages
@query
def op_pg1(s, d):
    return pages.dynamic_dpi(_sheets(s, d))


@query
def op_pg2(s, d):
    return pages.page_cap(_sheets(s, d), 5)


@query
def op_pg3(s, d):
    return pages.vertical_split(_sheets(s, d))


@query
def op_pg4(s, d):
    return pages.trim(_sheets(s, d), 100, 1300, 50, 900)


def _crops(s, d):
    p, e = _pe(s, d)
    return pages.content_box(p, e.where("label = 'text' or label = 'number'"))


@query
def op_pg5(s, d):
    return _crops(s, d)


@query
def op_pg6(s, d):
    return pages.uniform_width(_crops(s, d)).select("doc_id", "page_idx", "width", "max_width", "offset_x")


@query
def op_pg7(s, d):
    return _sheets(s, d).withColumn("height", F.when(F.col("page_idx") == 11, F.col("height") * 40).otherwise(F.col("height"))).select("doc_id", "page_idx", pages.visual_tokens(F.col("width"), F.col("height")).alias("v")).select("doc_id", "page_idx", "v.*")


# elements
@query
def op_el1(s, d):
    return elements.of_labels(view(s, d, "fx_elements")).select("doc_id", "page_idx", "ord", "label", "x1", "y1", "x2", "y2")


@query
def op_el2(s, d):
    return elements.label_counts(view(s, d, "fx_elements"))


@query
def op_el3(s, d):
    p, e = _pe(s, d)
    return elements.crop_boxes(e, p)


@query
def op_el4(s, d):
    p, e = _pe(s, d)
    return elements.kept_formulas(e, p).select("doc_id", "page_idx", "ord", "score")


def _records(s, d):
    p, e = _pe(s, d)
    return elements.formula_records(e, p)


@query
def op_el5(s, d):
    return _records(s, d).select("doc_id", "page_idx", "ord", "formula_id", "width", "height", "area", "width_ratio", "height_ratio", "area_ratio")


def _rejected(s, d):
    p, e = _pe(s, d)
    return elements.rejected(e, p)


@query
def op_el6_reasons(s, d):
    return elements.rejection_reasons(_rejected(s, d))


@query
def op_el6_sizes(s, d):
    return elements.rejection_sizes(_rejected(s, d))


@query
def op_el6_pages(s, d):
    return elements.rejection_pages(_rejected(s, d))


@query
def op_el6_cube(s, d):
    """Reasons, pages and both in one pass."""
    return elements.rejection_cube(_rejected(s, d))


@query
def op_el7(s, d):
    r = _records(s, d)
    ocr = r.where("ord % 3 <> 0").select("doc_id", "formula_id", F.concat(F.lit("tex"), F.col("ord").cast("string")).alias("ocr"))
    return elements.with_ocr(r, ocr).select("doc_id", "formula_id", "ocr_content")


# page numbers
def _best(s, d):
    p, e = _pe(s, d)
    return pagenums.best_numbers(e, p)


@query
def op_pn1(s, d):
    return _best(s, d)


@query
def op_pn2(s, d):
    return pagenums.typed(_best(s, d)).select("doc_id", "page_idx", "label", "number", "is_digit")


@query
def op_pn3(s, d):
    return pagenums.cut_lines(_best(s, d))


def _labels(s, d):
    return pagenums.section_labels(sections.identify(view(s, d, "fx_elements")), pagenums.typed(_best(s, d)))


@query
def op_pn4(s, d):
    return _labels(s, d).select("doc_id", "section_idx", joined("labels").alias("labels"))


@query
def op_pn5(s, d):
    e = view(s, d, "fx_elements")
    raw = F.when(F.col("ord") % 6 == 0, F.concat(F.lit("Page "), "ocr")).when(F.col("ord") % 6 == 1, F.concat("ocr", F.lit(" – "), F.col("ord").cast("string"))).when(F.col("ord") % 6 == 2, F.lit("--")).when(F.col("ord") % 6 == 3, F.lit(None)).otherwise(F.col("ocr"))
    return e.select("ord", pagenums.format_label(raw).alias("shown"))


@query
def op_pn6(s, d):
    return _labels(s, d).select("doc_id", "section_idx", pagenums.capped(F.col("labels")).alias("c")).select("doc_id", "section_idx", joined("c.shown").alias("shown"), F.col("c.hidden").alias("hidden"))


# sections
@query
def op_se1(s, d):
    return sections.identify(view(s, d, "fx_elements"))


@query
def op_se2(s, d):
    e = view(s, d, "fx_elements")
    return sections.assign(e, sections.identify(e)).select("doc_id", "ord", "section_idx")


@query
def op_se3(s, d):
    e = view(s, d, "fx_elements")
    return sections.formula_counts(e, sections.identify(e))


@query
def op_se4(s, d):
    e = view(s, d, "fx_elements")
    return sections.summary(e, sections.identify(e)).select("doc_id", "section_idx", "title", "page_range", "total_elements", "formulas", "numbers")


@query
def op_se5(s, d):
    p, e = _pe(s, d)
    out = sections.document_summary(p, sections.identify(e), pagenums.typed(_best(s, d)))
    numbers = F.array_join(F.transform(F.array_sort(F.map_entries("page_numbers")), lambda x: F.concat_ws("=", x["key"], x["value"])), "|")
    return out.select("doc_id", "total_pages", "total_sections", numbers.alias("page_numbers"), F.size("page_numbers").cast("long").alias("numbered_pages"))


# hierarchy
def _found_sections(s, d):
    return _kept(sections.identify(view(s, d, "fx_elements")), "sections")


def _tree(t):
    return hierarchy.heading_tree(t.select("doc_id", F.col("section_idx").alias("idx"), "title"))


@query
def op_hi1(s, d):
    return _tree(_found_sections(s, d)).select("doc_id", "idx", "key", joined("ancestors").alias("ancestors"))


def _judged(s, d):
    t = _found_sections(s, d)
    return hierarchy.apply_verdicts(t, _tree(t))


@query
def op_hi2(s, d):
    return _judged(s, d).select("doc_id", "section_idx", "kept", joined("ancestors").alias("ancestors"), joined("ancestor_titles").alias("ancestor_titles"))


def _rows(s, d):
    t = _found_sections(s, d)
    return books.section_rows(view(s, d, "fx_elements"), t, _tree(t), pagenums.section_labels(t, pagenums.typed(_best(s, d))))


def _flat(rows):
    return rows.select("doc_id", "section_idx", "title", "start_page", "start_y", "end_page", "end_y", joined(F.array_sort("labels")).alias("labels"), *[F.col(c).cast("long").alias(c) for c in ("total_elements", "formulas", "numbers")])


@query
def op_hi3(s, d):
    return _flat(hierarchy.fold_rejected(_rows(s, d)))


def _before_title_only(s, d):
    # the folded rows are read twice: for the ancestors they name, and for themselves
    return hierarchy.drop_title_only_ancestors(_kept(hierarchy.fold_rejected(_rows(s, d)), "folded"))


@query
def op_hi4(s, d):
    return _flat(_before_title_only(s, d))


def _final(s, d):
    return hierarchy.fold_title_only(_before_title_only(s, d))


@query
def op_hi5(s, d):
    return _flat(_final(s, d))


@query
def op_hi6(s, d):
    return hierarchy.totals(_final(s, d))


# stitching
def _slices(s, d):
    p, e = _pe(s, d)
    return stitch.slices(sections.identify(e), p, pagenums.cut_lines(_best(s, d)))


@query
def op_st1(s, d):
    return _slices(s, d)


@query
def op_st2(s, d):
    return stitch.canvases(sections.identify(view(s, d, "fx_elements")), _slices(s, d))


def _placed(s, d):
    e = view(s, d, "fx_elements")
    f = sections.formulas_in(e, sections.identify(e)).join(e.select("doc_id", "ord", "page_idx", "x1", "y1", "x2", "y2"), ["doc_id", "ord"])
    return stitch.remap(f, _slices(s, d))


@query
def op_st3(s, d):
    return _placed(s, d)


@query
def op_st4(s, d):
    placed = _placed(s, d).withColumn("content", F.concat(F.lit("tex"), F.col("ord").cast("string")))
    c = stitch.chunks(_judged(s, d), _labels(s, d), placed)
    told = F.array_join(F.transform("formulas", lambda f: F.concat_ws(":", f["content"], f["page"], f["coordinate"][1])), "|")
    return c.select("doc_id", "section_idx", "section_title", told.alias("formulas"), joined("section_pages").alias("section_pages"), joined("section_pages_index").alias("section_pages_index"), joined("ancestors").alias("ancestors"), "image_path")


@query
def op_st4_books(s, d):
    """The whole way of a book in one call."""
    p, e = _pe(s, d)
    ocr = elements.formula_records(e, p).select("doc_id", "formula_id", F.concat(F.lit("tex"), F.col("ord").cast("string")).alias("ocr"))
    c = books.build_chunks(e, p, ocr, keep=_kept)
    told = F.array_join(F.transform("formulas", lambda f: F.concat_ws(":", f["content"], f["page"], f["coordinate"][1])), "|")
    return c.select("doc_id", "section_idx", "section_title", told.alias("formulas"), joined(F.array_sort("section_pages")).alias("section_pages"), joined("section_pages_index").alias("section_pages_index"), joined("ancestors").alias("ancestors"))


@query
def op_st5(s, d):
    t = sections.identify(view(s, d, "fx_elements"))
    odd = F.when(F.col("section_idx") % 3 == 0, F.concat(F.lit('<a:b>"/\\|?* '), "title", F.lit(" " * 3), F.repeat("title", 8))).otherwise(F.col("title"))
    return t.select("doc_id", "section_idx", stitch.image_name(F.col("section_idx"), odd).alias("file"))


# vectors
def _pooled(s, d):
    return vectors.pooled(view(s, d, "fx_tokens"), 2, 2)


@query
def op_ve1(s, d):
    return _pooled(s, d).select("chunk_id", "kind", "pos", F.posexplode("vec").alias("dim", "v")).select("chunk_id", "kind", F.col("pos").cast("long").alias("pos"), F.col("dim").cast("long").alias("dim"), F.round("v", 6).alias("v"))


@query
def op_ve2(s, d):
    items = view(s, d, "fx_files").select(F.concat_ws(":", "batch", F.floor(F.col("seq") / SHARD_IDS)).alias("shard"), F.col("seq").alias("item_id"), (F.col("pages") * 90 + 200 + F.col("seq") % 97).alias("tokens"))
    return vectors.batches(items)


def _load_model():
    """A stand-in for a model: counts of letters by place in the alphabet."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        vec = [[float(t.lower().count(chr(97 + k))) for k in range(8)] for t in part["text"].fillna("")]
        return pd.DataFrame({"doc_id": part["doc_id"], "vec": vec})

    return run


@query
def op_ve3(s, d):
    ship_package(s)
    return vectors.embed(s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), _load_model, "doc_id long, vec array<double>").select("doc_id", joined(F.transform("vec", lambda x: x.cast("long"))).alias("vec"))


@query
def op_ve3_models(s, d):
    """Two models by name, each with rows of its own."""
    models.register(ship_package(s))
    s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").createOrReplaceTempView("leafmark_texts")
    told = "array_join(transform(e.vec, x -> cast(cast(x as bigint) as string)), '|') AS vec"
    return s.sql(f"SELECT d.doc_id, 'letters' AS model, 0L AS tok, {told} FROM leafmark_texts d, LATERAL embed('letters', d.text) e UNION ALL SELECT d.doc_id, 'lines', e.tok, {told} FROM leafmark_texts d, LATERAL embed('lines', d.text) e")


@query
def op_ve4(s, d):
    return vectors.normalised(view(s, d, "fx_tokens")).select("chunk_id", "tok", F.posexplode("vec").alias("dim", "v")).select("chunk_id", "tok", F.col("dim").cast("long").alias("dim"), F.round("v", 6).alias("v"))


# retrieval
@query
def op_re1(s, d):
    return retrieval.max_sim(view(s, d, "fx_query_tokens"), view(s, d, "fx_tokens")).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


def _token_store(s, d):
    ship_package(s)
    return token_store.write(view(s, d, "fx_tokens"), scratch_dir(s, "tokens"))


def _pooled_store(s, d):
    return token_store.write(_pooled(s, d), scratch_dir(s, "pooled"))


@query
def op_re1_top(s, d):
    """The ten best chunks of each query, by matrix products over stored chunks."""
    found = retrieval.top(token_store.block_scores(view(s, d, "fx_query_tokens"), _token_store(s, d).rows(), 10), 10)
    return found.select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


@query
def op_re2_stored(s, d):
    """The rows of op_re2; the second stage reads its candidates alone."""
    return token_store.two_stage(view(s, d, "fx_query_tokens"), _pooled_store(s, d), _token_store(s, d), 5).withColumn("score", F.round("score", 6))


def _found_by_lsh(s, d, k=5):
    tokens, root = _token_store(s, d), scratch_dir(s, "lsh")
    lsh.write_index(_pooled(s, d), root)
    return lsh.two_stage(view(s, d, "fx_query_tokens"), lsh.read_index(s, root), _pooled_store(s, d), tokens, k)


@query
def op_re2_lsh(s, d):
    """Prefetch from hashed buckets, then exact scores."""
    return _found_by_lsh(s, d).withColumn("score", F.round("score", 6))


@query
def op_re2_lsh_recall(s, d):
    """How many of op_re2's results op_re2_lsh finds, by query."""
    exact = token_store.two_stage(view(s, d, "fx_query_tokens"), _pooled_store(s, d), _token_store(s, d), 5)
    return lsh.recall(_found_by_lsh(s, d), exact).withColumn("recall", F.round("recall", 6))


def _found(s, d, k=5):
    return retrieval.two_stage(view(s, d, "fx_query_tokens"), _pooled(s, d), view(s, d, "fx_tokens"), k)


@query
def op_re2(s, d):
    return _found(s, d).withColumn("score", F.round("score", 6))


@query
def op_re3(s, d):
    return retrieval.token_level(view(s, d, "fx_query_tokens"), view(s, d, "fx_tokens"), 4).withColumn("score", F.round("score", 6))


@query
def op_re3_stored(s, d):
    """The rows of op_re3 by matrix products over stored chunks."""
    return token_store.token_level(view(s, d, "fx_query_tokens"), _token_store(s, d), 4).withColumn("score", F.round("score", 6))


@query
def op_re4(s, d):
    return retrieval.by_title(view(s, d, "fx_chunks"), "Section 3", 10).select("collection", "chunk_id", "section_title", "rn")


@query
def op_re5(s, d):
    return retrieval.outline_search(view(s, d, "fx_toc_sections"), " CUSTOMER#0000001 ")


@query
def op_re5_index(s, d):
    """The rows of op_re5 by the index of titles."""
    root, keys = scratch_dir(s, "titles"), ["collection", "book_index", "pos"]
    title_index.write(view(s, d, "fx_toc_sections"), root, keys)
    return title_index.search(s, root, " CUSTOMER#0000001 ", keys)


def _payloads(s, d):
    """Chunks with all that a result shows of them."""
    c = view(s, d, "fx_chunks")
    some = lambda c, x: F.when(F.col(c).isNotNull(), F.array(x))
    formulas = some("formula", F.struct(F.col("formula").alias("content"), F.array(*[F.lit(x).cast("long") for x in (1, 2, 3, 4)]).alias("coordinate"), F.col("page")))
    return c.select("chunk_id", "collection", "section_title", "image_path", formulas.alias("formulas"), F.array(F.col("page").cast("string")).alias("section_pages"), some("parent", F.col("parent")).alias("ancestors"), F.create_map(F.lit("display_name"), F.col("display_name")).alias("metadata"))


@query
def op_re6(s, d):
    c = _payloads(s, d)
    images = c.where("image_path <> ''").select("image_path", readers.data_uri(F.encode("image_path", "UTF-8")).alias("uri"))
    slices = c.where("chunk_id % 2 = 0").select("chunk_id", F.array(F.concat(F.lit("slice"), F.col("chunk_id"))).alias("uris"))
    return _told_results(retrieval.search(view(s, d, "fx_query_tokens"), _pooled(s, d), view(s, d, "fx_tokens"), c, 5, images, slices))


def _told_results(r):
    told = lambda x: F.concat_ws(":", x["chunk_id"], x["section_title"], x["image_path"], F.array_join(F.transform(x["formulas"], lambda f: F.concat_ws("@", f["content"], f["page"])), ","), F.array_join(x["section_pages"], ","), F.array_join(x["ancestors"], ","), x["metadata"]["display_name"], F.coalesce(F.md5(x["image_base64"]), F.lit("-")), F.array_join(x["chunk_images"], ","))
    return r.select("query_id", F.array_join(F.transform("results", told), "|").alias("results"), "total_results")


@query
def op_re6_stored(s, d):
    """The rows of op_re6 from stored layouts."""
    c = _payloads(s, d)
    images = c.where("image_path <> ''").select("image_path", readers.data_uri(F.encode("image_path", "UTF-8")).alias("uri"))
    slices = c.where("chunk_id % 2 = 0").select("chunk_id", F.array(F.concat(F.lit("slice"), F.col("chunk_id"))).alias("uris"))
    return _told_results(retrieval.search(view(s, d, "fx_query_tokens"), _pooled_store(s, d), _token_store(s, d), c, 5, images, slices, find=token_store.two_stage))


@query
def op_re7(s, d):
    return retrieval.metadata_of(view(s, d, "fx_chunks"), _found(s, d))


@query
def op_re8(s, d):
    return retrieval.previews(view(s, d, "fx_chunks")).select("collection", "chunk_id", "image_path", "rn")


@query
def op_re9(s, d):
    return retrieval.anchored_query(view(s, d, "fx_replies")).select("query_id", "rewritten", "search_text")


@query
def op_re10(s, d):
    q = view(s, d, "fx_replies").select("query_id")
    c = retrieval.contexts(q, _found(s, d), view(s, d, "fx_chunks"))
    return c.select("query_id", joined("chunk_ids").alias("chunk_ids"), joined("image_paths").alias("image_paths"), "found")


# rollups
def _bs(s, d):
    return view(s, d, "fx_books"), view(s, d, "fx_toc_sections")


def _told_books(rows: DataFrame) -> DataFrame:
    """Books with a digest of their sections."""
    whole = lambda x: F.concat_ws(";", x["index"], x["title"], x["start_page"], x["formulas"])
    simple = "start_page" not in rows.schema["sections"].dataType.elementType.names
    told = F.array_join(F.transform("sections", (lambda x: x["title"]) if simple else whole), ",")
    return rows.select("collection", "book_index", "book_folder", "title", "total_pages", "total_sections", F.md5(told).alias("sections_md5"), *(["page_numbers"] if "page_numbers" in rows.columns else []))


@query
def op_tc1(s, d):
    return _told_books(rollups.book_contents(*_bs(s, d)))


@query
def op_tc2(s, d):
    return rollups.book_titles(*_bs(s, d))


@query
def op_tc3(s, d):
    return _told_books(rollups.book_contents(*_bs(s, d), form="simple"))


@query
def op_tc4(s, d):
    return rollups.collection_totals(*_bs(s, d))


def _gated(s, d):
    f = view(s, d, "fx_files")
    n = f.groupBy("batch").agg(F.count("*").alias("c")).select("batch", F.when(F.col("batch") == "src3", F.col("c") + 1).otherwise(F.col("c")).alias("n"))
    return rollups.gate(f, n)


@query
def op_tc4_levels(s, d):
    return rollups.totals_by_level(*_bs(s, d))


@query
def op_tc1_nested(s, d):
    """A collection's contents as one document."""
    told = lambda b: F.concat_ws(";", b["book_folder"], b["title"], b["total_pages"], b["total_sections"], F.array_join(F.transform(b["sections"], lambda x: F.concat_ws(":", x["index"], x["title"])), ","))
    return rollups.contents(*_bs(s, d)).select("collection_name", "total_books", F.md5(F.array_join(F.transform("books", told), "|")).alias("books_md5"))


@query
def op_up1(s, d):
    return _gated(s, d).select("batch", "name", "accepted", "reason")


@query
def op_up2(s, d):
    r = rollups.upload_report(_gated(s, d))
    told = F.array_join(F.transform(F.array_sort(F.map_entries("file_pages")), lambda x: F.concat_ws("=", x["key"], x["value"])), "|")
    return r.select("batch", "success", "processed_files", "chunks", "total_pages", F.md5(told).alias("files_md5"), F.md5(joined("errors")).alias("errors_md5"))


@query
def op_up2_summary(s, d):
    return rollups.upload_summary(_gated(s, d))


@query
def op_up2_errors(s, d):
    return rollups.rejected_files(_gated(s, d))


@query
def op_up2_pages(s, d):
    return rollups.file_pages(_gated(s, d))


@query
def op_ss1(s, d):
    return rollups.sessions(s.read.parquet(f"{d}/conversations.parquet")).select("session_id", "title", "turns", "messages")


@query
def op_ss2(s, d):
    t = rollups.sessions(s.read.parquet(f"{d}/conversations.parquet"))
    return rollups.latest_session(t.select("session_id", (F.col("session_id") % 7).alias("collection"), (F.col("last_turn") * 1000 + F.col("session_id")).alias("updated_at")))


# sources and sinks
def _written_reports(s, d, root):
    b, t = _bs(s, d)
    own = t.groupBy("collection", "book_index").agg(F.array_sort(F.collect_list(F.struct("pos", "title"))).alias("l"))
    r = b.where("has_report").join(own, ["collection", "book_index"], "left")
    listed = F.transform(F.coalesce("l", F.array().cast("array<struct<pos:bigint,title:string>>")), lambda x, i: F.struct(i.cast("long").alias("index"), x["title"].alias("title")))
    r.select("collection", F.col("book_index").alias("book"), "total_pages", listed.alias("sections")).write.partitionBy("collection", "book").json(root)


@query
def op_src1(s, d):
    root = scratch_dir(s, "reports")
    _written_reports(s, d, root)
    return readers.report_sections(readers.read_reports(s, root, "*/*/*.json")).select("collection", "book_index", "pos", "title")


@query
def op_src2(s, d):
    e = view(s, d, "fx_elements")
    name = F.when(F.col("ord") % 5 == 0, F.concat(F.lit("scan"), F.col("ord").cast("string"))).when(F.col("ord") % 5 == 1, F.concat(F.lit("page_"), (F.col("ord") % 90).cast("string"))).otherwise(F.concat_ws("_", F.lit("page"), F.col("ord") % 90, F.col("ord") % 7))
    ending = F.when(F.col("ord") % 11 == 0, ".txt").when(F.col("ord") % 11 == 1, ".JPG").otherwise(".png")
    return readers.list_pages(e.select("doc_id", F.concat(F.lit("/p/"), F.col("ord").cast("string"), F.lit("/"), name, ending).alias("path")))


def _section_maps(s, d):
    """(doc_id, content): the sections of each document as a JSON object."""
    t = sections.identify(view(s, d, "fx_elements")).select("doc_id", F.col("section_idx").cast("string").alias("k"), "title")
    m = t.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "title"))).alias("m"))
    return m.select("doc_id", F.to_json("m").alias("content")).repartition(max(4, s.sparkContext.defaultParallelism), "doc_id")


@query
def op_src3(s, d):
    root = scratch_dir(s, "ocr")
    folder, name = F.pmod(F.xxhash64("doc_id"), F.lit(MAP_FOLDERS)).cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))
    sinks.write_files(_section_maps(s, d).select(F.concat(folder, F.lit("/doc_id="), name, F.lit(".txt")).alias("path"), "content"), root)
    back = readers.read_ocr_map(s, root, "string", "*.txt")
    return back.select(F.expr("try_cast(regexp_extract(file, 'doc_id=(-?[0-9]+)', 1) as bigint)").alias("doc_id"), F.col("key").alias("section_idx"), F.col("value").alias("title"))


@query
def op_src4(s, d):
    b = view(s, d, "fx_books")
    folders = b.select("collection", F.col("book_index").cast("string").alias("name")).union(b.select("collection", F.lit("temp_folder")))
    reports = b.where("has_report").select("collection", "book_index", F.lit(True).alias("readable"), "total_pages", F.lit(3).cast("long").alias("total_sections"))
    return readers.books(folders, reports)


@query
def op_src5(s, d):
    p = s.read.parquet(f"{d}/pages.parquet")
    return p.select("page_id", F.md5(readers.data_uri(F.encode("html", "UTF-8"))).alias("uri_md5"))


def _books_read(s, root, table, **options):
    return book_folders.register(s).read.format("book_folders").options(path=root, table=table, **options).load()


@query
def op_src1_source(s, d):
    """op_src1 by the data source."""
    root = scratch_dir(s, "reports")
    _written_reports(s, d, root)
    return _books_read(s, root, "sections", report="*.json").select("collection", "book_index", "pos", "title")


@query
def op_src3_source(s, d):
    """op_src3 by the data source: a map for each book."""
    root = scratch_dir(s, "maps")
    sinks.write_files(_section_maps(s, d).where("doc_id is not null").select(F.concat(F.lit("c/"), F.col("doc_id").cast("string"), F.lit("/titles.txt")).alias("path"), "content"), root)
    return _books_read(s, root, "maps", maps="*.txt").select(F.col("book_index").alias("doc_id"), F.col("key").alias("section_idx"), F.col("value").alias("title"))


@query
def op_src4_source(s, d):
    """op_src4 by the data source: books with and without a report, and a folder that is no book."""
    root = scratch_dir(s, "books")
    b = view(s, d, "fx_books")
    b.where("has_report").select("collection", F.col("book_index").alias("book"), "total_pages", F.lit(3).alias("total_sections")).write.partitionBy("collection", "book").json(root)
    folders = b.select("collection", F.col("book_index").cast("string").alias("book"), F.lit("x").alias("value")).union(b.select("collection", F.lit("temp_folder"), F.lit("x")))
    folders.write.mode("append").partitionBy("collection", "book").text(root)
    return _books_read(s, root, "books", report="*.json")


@query
def op_snk5_books(s, d):
    """Contents of collections whose books come as a stream of folders."""
    root = scratch_dir(s, "books")
    _written_reports(s, d, f"{root}/in")
    ingest.ingest_books(s, f"{root}/in", f"{root}/points", f"{root}/toc", f"{root}/ck", report="*.json", settled="0")
    return s.read.schema("files bigint, chunks bigint, named bigint, collection string").parquet(f"{root}/toc")


@query
def op_src5_images(s, d):
    """The images of each chunk's folder, in the order of their names."""
    p = s.read.parquet(f"{d}/pages.parquet")
    images = p.select(F.floor(F.col("page_id") / 5).alias("folder_id"), F.md5(F.col("page_id").cast("string")).alias("name"), F.encode("html", "UTF-8").alias("content"))
    return readers.chunk_images(view(s, d, "fx_chunks").select("chunk_id", "image_path"), images).select("chunk_id", F.size("uris").cast("long").alias("images"), F.md5(F.array_join("uris", "|")).alias("uris_md5"))


def _points(s, d):
    c = view(s, d, "fx_chunks")
    name = F.concat(F.lit("file"), (F.col("chunk_id") % 6).cast("string"))
    return c.select("collection", file_id(name).alias("file_id"), F.col("chunk_id").alias("position"), "section_title", F.lit(1).cast("long").alias("load_seq"))


@query
def op_snk1(s, d):
    root = scratch_dir(s, "points")
    new = _points(s, d)
    sinks.upsert(s, new, root)
    sinks.upsert(s, new.where("position % 6 < 3").withColumn("section_title", F.concat(F.lit("again "), "section_title")).withColumn("load_seq", F.lit(2).cast("long")), root)
    return sinks.read_points(s, root, ingest.CHUNKS).select("collection", "position", "section_title", "load_seq")


@query
def op_snk2(s, d):
    root = scratch_dir(s, "collection")
    sinks.upsert(s, _points(s, d), root)
    sinks.create_collection(s, root, "c1")  # there already: nothing happens
    sinks.create_collection(s, root, "a new one")
    sinks.drop_collection(s, root, "c3")
    left = sinks.read_points(s, root, ingest.CHUNKS).groupBy("collection").agg(F.count("*").alias("points"))
    return sinks.list_collections(s, root).join(left, "collection", "left").withColumn("points", F.coalesce("points", F.lit(0)))


@query
def op_snk3(s, d):
    root = scratch_dir(s, "toc")
    toc = rollups.book_contents(*_bs(s, d))
    sinks.write_contents(toc, root)
    return _told_books(sinks.read_contents(s, root, toc.schema))


@query
def op_snk4(s, d):
    root = scratch_dir(s, "json")
    e = view(s, d, "fx_elements")
    rows = sections.summary(e, sections.identify(e)).select("doc_id", "section_idx", "title", "page_range", "total_elements", "formulas", "numbers")
    sinks.report_json(rows, "doc_id").write.parquet(root)
    return s.read.parquet(root).select(F.from_json("report", rows.schema).alias("r")).select("r.*")


@query
def op_snk5(s, d):
    root = scratch_dir(s, "stream")
    chunks = _points(s, d).select("collection", "file_id", "position", "section_title", "load_seq")
    chunks.where("position % 2 = 0").write.mode("append").parquet(f"{root}/in")
    ingest.ingest(s, f"{root}/in", f"{root}/points", f"{root}/toc", f"{root}/ck")
    # whole files come again with their other half
    chunks.withColumn("load_seq", F.lit(2).cast("long")).write.mode("append").parquet(f"{root}/in")
    ingest.ingest(s, f"{root}/in", f"{root}/points", f"{root}/toc", f"{root}/ck")
    return s.read.schema("files bigint, chunks bigint, named bigint, collection string").parquet(f"{root}/toc")
