"""Hand-made cases, one for each trap."""

import random
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from leafmark.functions.ids import file_id, point_id
from leafmark.operators import elements, hierarchy, pagenums, pages, retrieval, rollups, sections, stitch, vectors
from leafmark.sources import readers, sinks
from leafmark.streaming import ingest

E = "doc_id long, page_idx long, ord long, label string, x1 long, y1 long, x2 long, y2 long, score double, ocr string"


def el(spark, rows):
    """rows: (page, ord, label, y1[, ocr[, y2]])"""
    return spark.createDataFrame([(1, r[0], r[1], r[2], 0, r[3], 10, r[5] if len(r) > 5 else r[3] + 20, 0.9, r[4] if len(r) > 4 else "t") for r in rows], E)


def intervals(df):
    return [(r.start_page, r.start_y, r.end_page, r.end_y) for r in df.orderBy("section_idx").collect()]


def test_sections_without_titles(spark):
    assert sections.identify(el(spark, [(0, 1, "formula", 5)])).count() == 0


@pytest.mark.parametrize("page,y,first", [(0, 100, None), (0, 101, (0, 0, 0, 101)), (2, 50, (0, 0, 1, 99_999_999))])
def test_preamble(spark, page, y, first):
    got = intervals(sections.identify(el(spark, [(page, 1, "paragraph_title", y)])))
    assert got == ([first] if first else []) + [(page, y, 11, 999_999)]


def test_inverted_section(spark):
    e = el(spark, [(5, 1, "paragraph_title", 20), (5, 2, "paragraph_title", 60), (5, 3, "formula", 30)])
    s = sections.identify(e)
    assert intervals(s)[1] == (5, 20, 4, 999_999)
    assert {(r.ord, r.section_idx) for r in sections.assign(e, s).collect()} == {(3, 1)}
    assert not [r for r in sections.formula_counts(e, s).collect() if r.section_idx == 1]
    labels = pagenums.section_labels(s, spark.createDataFrame([(1, 4, "x")], "doc_id long, page_idx long, label string"))
    assert [r.labels for r in labels.where("section_idx = 1").collect()] == [[]]
    p = spark.createDataFrame([(1, k, 1000, 1600) for k in range(12)], "doc_id long, page_idx long, width long, height long")
    c = stitch.canvases(s, stitch.slices(s, p, spark.createDataFrame([], "doc_id long, page_idx long, cut long")))
    assert [(r.width, r.height) for r in c.where("section_idx = 1").collect()] == [(100, 100)]


def test_gap_is_unassigned(spark):
    e = el(spark, [(3, 1, "paragraph_title", 500), (5, 2, "paragraph_title", 50), (5, 3, "formula", 20)])
    assert not [r for r in sections.assign(e, sections.identify(e)).collect() if r.ord == 3]


def test_first_number_wins_a_tie(spark):
    p = spark.createDataFrame([(1, 0, 1000, 1600)], "doc_id long, page_idx long, width long, height long")
    got = pagenums.best_numbers(el(spark, [(0, 4, "number", 900, "7"), (0, 3, "number", 900, "8"), (0, 5, "number", 950, "  ")]), p).collect()
    assert [r.ord for r in got] == [3]


def test_typed_labels(spark):
    df = spark.createDataFrame([("007",), (" -93- ",), ("²",), ("9" * 30,)], "ocr string")
    got = [(r.label, r.number, r.is_digit) for r in pagenums.typed(df).collect()]
    assert got[:3] == [("7", 7, True), ("-93-", None, False), ("²", None, False)]


def test_number_at_the_top_skips_the_page(spark):
    s = spark.createDataFrame([(1, 0, 0, 0, 0, 500)], "doc_id long, section_idx long, start_page long, start_y long, end_page long, end_y long")
    p = spark.createDataFrame([(1, 0, 1000, 1600)], "doc_id long, page_idx long, width long, height long")
    cut = pagenums.cut_lines(spark.createDataFrame([(1, 0, 5)], "doc_id long, page_idx long, y1 long"))
    assert [r.cut for r in cut.collect()] == [0]
    assert stitch.slices(s, p, cut).count() == 0


LABELS = [("-93-", "Trang 93"), ("93 – 95", "Trang 93 - 95"), ("Trang 4", "Trang 4"), ("--", "--"), (None, ""), ("page 3", "page 3"), ("pages", "Trang pages"), (" 1-2-3 ", "Trang 1-2-3")]


def test_label_format(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(LABELS)], "i int, raw string")
    assert [r[0] for r in df.orderBy("i").select(pagenums.format_label(F.col("raw"))).collect()] == [b for _, b in LABELS]


def rows(spark, data):
    """data: (section_idx, title, start_page, start_y, end_page, end_y, kept, ancestors)"""
    return spark.createDataFrame([(1, *r, [], [str(r[0])], 1, 1, 0) for r in data], "doc_id long, section_idx long, title string, start_page long, start_y long, end_page long, end_y long, kept boolean, ancestors array<long>, ancestor_titles array<string>, labels array<string>, total_elements long, formulas long, numbers long")


def test_leading_reject_is_lost(spark):
    got = hierarchy.fold_rejected(rows(spark, [(0, "a", 0, 0, 1, 5, False, []), (1, "b", 1, 5, 2, 6, True, []), (2, "c", 2, 6, 3, 7, False, [])])).collect()
    assert [(r.section_idx, r.end_page, r.end_y, r.labels, r.total_elements) for r in got] == [(1, 3, 7, ["1", "2"], 2)]


def test_no_verdicts_and_empty_verdicts(spark):
    s = sections.identify(el(spark, [(1, 1, "paragraph_title", 500), (2, 2, "paragraph_title", 500)]))
    assert {r.kept for r in hierarchy.apply_verdicts(s, None).collect()} == {True}
    none = spark.createDataFrame([], "doc_id long, idx long, ancestors array<long>")
    assert [r.kept for r in hierarchy.apply_verdicts(s, none).orderBy("section_idx").collect()] == [True, False, False]


@pytest.mark.parametrize("height,kept", [(169, False), (170, True)])
def test_title_only_ancestor(spark, height, kept):
    r = rows(spark, [(0, "a", 0, 0, 0, height, True, []), (1, "b", 0, height, 3, 7, True, [0])])
    assert (hierarchy.drop_title_only_ancestors(r).where("section_idx = 0").count() == 1) is kept


def test_cascade_of_title_only(spark):
    r = rows(spark, [(0, "a", 0, 0, 1, 500, True, []), (1, "b", 1, 500, 1, 550, True, []), (2, "c", 1, 550, 1, 600, True, []), (3, "d", 1, 600, 4, 9, True, [])])
    got = hierarchy.fold_title_only(r).orderBy("section_idx").collect()
    assert [(x.section_idx, x.end_y, x.total_elements) for x in got] == [(0, 600, 3), (3, 9, 1)]


def test_heading_tree(spark):
    titles = ["前言", "第1章", "1章 始", "1.1 x", "1.1.1 y", "1) item", "(2) item", "2 z", "2.1 w", "3.1 orphan", "1.2 late"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(titles)], "doc_id long, idx long, title string")
    got = {r.idx: r.ancestors for r in hierarchy.heading_tree(df).collect()}
    assert got == {2: [], 3: [2], 4: [2, 3], 7: [], 8: [7], 9: [], 10: [2]}


def test_ten_levels_of_headings(spark):
    titles = [".".join("1" * n) + " x" for n in range(1, 11)]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(titles)], "doc_id long, idx long, title string")
    assert {r.idx: r.ancestors for r in hierarchy.heading_tree(df).collect()} == {i: list(range(i)) for i in range(10)}
    assert hierarchy.heading_tree(df.limit(0)).count() == 0


#: Two lists of titles with the headings that count and their ancestors. Fixed values.
HEADINGS = [
    (["noname", "2.2.1 uii", "2.3.1 jqk", "ad 2.3.1.3 abc", "(1)座屈安全率V_B", "2.3.1.1 def", "2.3.1.1.1 ghi", "2.3.1.1.2 reta"], {1: [], 2: [], 5: [2], 6: [2, 5], 7: [2, 5]}),
    (
        ["noname", "目次", "I共通編", "1章総則", "1.1適用の範囲", "橋の耐荷性能1", "橋の耐荷性能2", "3章 設計状況", "3.1作用の種類", "1)水平補剛材を用いない場合", "2)水平補剛材を1段用いる場合", "3.2 設計状況の設定", "3.3作用の組合せ", "3.3.1荷重組合せ", "i）荷重組合せ"],
        {3: [], 4: [3], 7: [], 8: [7], 11: [7], 12: [7], 13: [7, 12]},
    ),
]


@pytest.mark.parametrize("titles,want", HEADINGS)
def test_hierarchies(spark, titles, want):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(titles)], "doc_id long, idx long, title string")
    tree = hierarchy.heading_tree(df)
    assert {r.idx: r.ancestors for r in tree.collect()} == want
    judged = hierarchy.apply_verdicts(df.withColumnRenamed("idx", "section_idx"), tree).collect()
    assert {r.section_idx for r in judged if r.kept} == {0, *want}
    assert {r.section_idx: r.ancestor_titles for r in judged if r.kept} == {0: []} | {i: [titles[a] for a in up] for i, up in want.items()}


def test_formula_across_the_cut_is_dropped(spark):
    sl = spark.createDataFrame([(1, 0, 0, 1000, 0, 900, 1600, 900, 0, 900)], "doc_id long, section_idx long, page_idx long, width long, y_start long, y_end long, uncut_end long, cut long, merged_start long, merged_end long")
    f = spark.createDataFrame([(1, 0, 0, 1, 0, 880, 5, 910), (1, 0, 0, 2, 0, 100, 5, 900)], "doc_id long, section_idx long, page_idx long, ord long, x1 long, y1 long, x2 long, y2 long")
    assert [r.ord for r in stitch.remap(f, sl).collect()] == [2]


def test_batches(spark):
    df = spark.createDataFrame([(0, i, n) for i, n in enumerate([5, 6, 5, 20])], "shard long, item_id long, tokens long")
    by = {}
    for r in vectors.batches(df, budget=12).collect():
        by.setdefault(r.batch, []).append(r.tokens)
    assert [by[k] for k in sorted(by)] == [[5, 5], [6], [20]]


def test_token_grid_rounds_half_even(spark):
    rnd = random.Random(1)
    sizes = [(rnd.randint(300, 3000), rnd.randint(300, 5000)) for _ in range(500)] + [(588, 14), (1176, 28 * 3 * 1)]
    df = spark.createDataFrame(sizes, "w long, h long")
    for (w, h), r in zip(sizes, df.select(pages.visual_tokens(F.col("w"), F.col("h")).alias("v")).collect()):
        tall = round(588 / w * h / 28) * 28
        if 3136 <= tall * 588 <= 1_003_520:
            assert (r.v.grid_w, r.v.grid_h) == (21, tall // 28)


def test_too_narrow_has_no_tokens(spark):
    assert spark.range(1).select(pages.visual_tokens(F.lit(10), F.lit(100_000)).alias("v")).first().v is None


def test_ids(spark):
    names = ["a:0", "héllo:12", "x" * 200]
    df = spark.createDataFrame([(n.rsplit(":", 1)[0], n) for n in names], "a string, n string")
    from leafmark.functions.ids import uuid5

    assert [r[0] for r in df.select(uuid5(F.col("n"))).collect()] == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]
    got = spark.range(1).select(point_id(file_id(F.lit("book")), F.lit(3))).first()[0]
    import hashlib

    assert got == str(uuid.uuid5(uuid.NAMESPACE_URL, hashlib.md5(b"book").hexdigest()[:8] + ":3"))


def test_safe_name(spark):
    got = spark.createDataFrame([('a<b>:"/\\|?*c' + "x" * 60,), ("  t  ",)], "t string").select(stitch.safe_name(F.col("t"))).collect()
    assert got[0][0] == ("a_b________c" + "x" * 60)[:50] and got[1][0] == "t"


def test_two_stage_is_exact_when_wide(spark):
    rnd = random.Random(2)
    vec = lambda: [rnd.gauss(0, 1) for _ in range(4)]
    tokens = spark.createDataFrame([(c, t, vec()) for c in range(20) for t in range(5)], "chunk_id long, tok long, vec array<double>")
    q = spark.createDataFrame([(i, t, vec()) for i in range(3) for t in range(2)], "query_id long, tok long, vec array<double>")
    full = retrieval.top(retrieval.max_sim(q, tokens), 3).select("query_id", "rank", "chunk_id")
    two = retrieval.two_stage(q, vectors.pooled(tokens, 2, 2), tokens, 3, 20).select("query_id", "rank", "chunk_id")
    blocks = retrieval.top(retrieval.token_scores(q, tokens, 1).groupBy("query_id", "tok", "chunk_id").agg(F.max("s").alias("s")).groupBy("query_id", "chunk_id").agg(F.sum("s").alias("score")), 3).select("query_id", "rank", "chunk_id")
    assert sorted(full.collect()) == sorted(two.collect()) == sorted(blocks.collect())


def test_pooling_layouts(spark):
    t = spark.createDataFrame([(1, k, [float(k)]) for k in range(8)], "chunk_id long, tok long, vec array<float>")  # one before, 3 x 2, one after
    got = {(r.kind, r.pos): r.vec[0] for r in vectors.pooled(t, 3, 2).collect()}
    assert got == {("mean_r", 0): 0, ("mean_r", 1): 3, ("mean_r", 2): 4, ("mean_r", 3): 7, ("mean_c", 0): 0, ("mean_c", 1): 1.5, ("mean_c", 2): 3.5, ("mean_c", 3): 5.5, ("mean_c", 4): 7}
    hw = {(r.kind, r.pos): r.vec[0] for r in vectors.pooled(t, 3, 2, layout="hw").collect()}
    assert (hw["mean_r", 1], hw["mean_r", 2]) == (2, 5) and [hw["mean_c", k] for k in (1, 2, 3)] == [2.5, 3.5, 4.5]


def test_anchor(spark):
    df = spark.createDataFrame([(1, "q", "a <query> x\ny </query> <query>z</query>"), (2, "q", "none"), (3, "q", "<query></query>")], "query_id long, question string, reply string")
    assert [(r.rewritten, r.search_text) for r in retrieval.anchored_query(df).orderBy("query_id").collect()] == [("x\ny", "q(x\ny)"), (None, "q"), ("", "q()")]


def test_reports(spark, tmp_path):
    """Two books of one collection, a folder that is no book, a book without report, a damaged one."""
    import json

    root = tmp_path / "out"
    for book, titles in ((0, ["noname", "1.1 A"]), (1, ["noname", "2.1 B", "2.2 C"])):
        (root / "demo" / str(book)).mkdir(parents=True)
        (root / "demo" / str(book) / "summary_report.json").write_text(json.dumps({"total_pages": 10 * (book + 1), "total_sections": len(titles), "sections": [{"index": i, "title": t} for i, t in enumerate(titles)], "page_numbers": {"0": "1"}}, indent=1))
    for name in ("2", "temp_folder", "3"):
        (root / "demo" / name).mkdir()
    (root / "demo" / "3" / "summary_report.json").write_text("{not json")
    (root / "demo" / "temp_folder" / "summary_report.json").write_text("{}")
    r = readers.read_reports(spark, f"file://{root}")
    folders = spark.createDataFrame([("demo", n) for n in ("0", "1", "2", "3", "temp_folder")], "collection string, name string")
    books = readers.books(folders, r)
    got = {x.book_index: x for x in rollups.book_titles(books, readers.report_sections(r)).collect()}
    assert {k: v.title for k, v in got.items()} == {0: "1.1 A (10 pages)", 1: "2.1 B (20 pages)", 2: "Book 2", 3: "Book 3"}
    toc = rollups.contents(books, readers.report_sections(r), "simple").collect()[0]
    assert [b.total_sections for b in toc.books] == [2, 3, 0, 0] and toc.books[1].sections[2].title == "2.2 C"
    full = rollups.contents(books.join(r.select("collection", "book_index", "page_numbers"), ["collection", "book_index"], "left"), readers.report_sections(r))
    b = full.collect()[0].books
    assert b[1].book_folder == "1" and b[1].page_numbers == {"0": "1"} and (b[1].sections[2]["index"], b[1].sections[2].title, b[1].sections[2].page_range) == (2, "2.2 C", None)
    assert {"page_range", "precise_range", "total_elements", "formulas", "numbers", "ancestors", "ancestor_titles"} <= set(b[0].sections[0].asDict()) and b[2].sections == []
    assert readers.read_reports(spark, f"file://{tmp_path}/nothing").count() == 0
    assert readers.read_ocr_map(spark, f"file://{tmp_path}/nothing", "string").count() == 0


def test_page_order(spark):
    df = spark.createDataFrame([(1, f"/x/{n}") for n in ("page_10.png", "page_2_1.jpg", "page_2.png", "zz.jpeg", "aa.png", "page_1.txt")], "doc_id long, path string")
    assert [r.path.split("/")[-1] for r in readers.list_pages(df).orderBy("page_idx").collect()] == ["page_2.png", "page_2_1.jpg", "page_10.png", "aa.png", "zz.jpeg"]


def test_images(spark, tmp_path):
    import base64

    (tmp_path / "b.png").write_bytes(b"\x89x" * 100)
    (tmp_path / "a.png").write_bytes(b"y")
    f = readers.read_files(spark, f"file://{tmp_path}", content=True).select(F.lit(1).alias("folder_id"), F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "content")
    got = readers.chunk_images(spark.createDataFrame([(1, "p"), (2, "q")], "chunk_id int, image_path string"), f)
    assert {r.chunk_id: r.uris for r in got.collect()} == {1: ["data:image/png;base64," + base64.b64encode(x).decode() for x in (b"y", b"\x89x" * 100)], 2: []}


def _points(spark, data):
    return spark.createDataFrame(data, ingest.CHUNKS)


@pytest.mark.parametrize("keep,positions", [(False, [0]), (True, [0, 1, 2])])
def test_upsert_of_a_shorter_file(spark, tmp_path, keep, positions):
    at = f"file://{tmp_path}/p"
    sinks.upsert(spark, _points(spark, [("c", "f", k, "old", 1) for k in range(3)] + [("c", "g", 0, "g", 1)]), at)
    sinks.upsert(spark, _points(spark, [("c", "f", 0, "new", 2)]), at, keep_tail=keep)
    sinks.upsert(spark, _points(spark, [("c", "f", 0, "new", 2)]), at, keep_tail=keep)
    got = sinks.read_points(spark, at, ingest.CHUNKS).collect()
    assert sorted(r.position for r in got if r.file_id == "f") == positions
    assert [r.section_title for r in got if r.file_id == "f" and r.position == 0] == ["new"]
    assert len([r for r in got if r.file_id == "g"]) == 1


def test_stream_equals_batch(spark, tmp_path):
    a, b = _points(spark, [("c", "f", k, "t", 1) for k in range(4)]), _points(spark, [("c", "f", 0, "noname", 2), ("d", "g", 0, "t", 1)])
    root = f"file://{tmp_path}"
    for df in (a, b):
        df.coalesce(1).write.mode("append").parquet(f"{root}/in")
        ingest.ingest(spark, f"{root}/in", f"{root}/s", f"{root}/toc", f"{root}/ck")
    ingest.ingest(spark, f"{root}/in", f"{root}/s", f"{root}/toc", f"{root}/ck")  # nothing new
    for df in (a, b):
        sinks.upsert(spark, df, f"{root}/b")
    cols = ["collection", "file_id", "position", "section_title"]
    assert sorted(sinks.read_points(spark, f"{root}/s", ingest.CHUNKS).select(cols).collect()) == sorted(sinks.read_points(spark, f"{root}/b", ingest.CHUNKS).select(cols).collect())
    assert {r.collection: (r.files, r.chunks, r.named) for r in spark.read.parquet(f"{root}/toc").collect()} == {"c": (1, 1, 0), "d": (1, 1, 1)}


def test_parts_of_a_load_add_up(spark, tmp_path):
    root = f"file://{tmp_path}"
    for data in ([("c", "f", 0, "a", 1), ("c", "f", 1, "a", 1)], [("c", "f", 2, "a", 1), ("c", "f", 3, "a", 1)], [("c", "f", 0, "late", 0)]):
        _points(spark, data).coalesce(1).write.mode("append").parquet(f"{root}/in")
        ingest.ingest(spark, f"{root}/in", f"{root}/s", f"{root}/toc", f"{root}/ck")
    assert sorted((r.position, r.section_title) for r in sinks.read_points(spark, f"{root}/s", ingest.CHUNKS).collect()) == [(k, "a") for k in range(4)]


def test_collections_on_storage(spark, tmp_path):
    root = f"file://{tmp_path}/p"
    assert sinks.list_collections(spark, root).count() == 0
    for c in ("a/b c", "d"):
        assert sinks.create_collection(spark, root, c, _points(spark, [(c, "f", 0, "t", 1)]))
    assert not sinks.create_collection(spark, root, "d")
    assert [r.collection for r in sinks.list_collections(spark, root).collect()] == ["a/b c", "d"]
    assert sinks.drop_collection(spark, root, "a/b c") and not sinks.drop_collection(spark, root, "a/b c")
    assert [r.collection for r in sinks.read_points(spark, root, ingest.CHUNKS).collect()] == ["d"]
    assert sinks.create_collection(spark, root, "d", replace=True) and sinks.read_points(spark, root, ingest.CHUNKS).count() == 0
    assert [r.collection for r in sinks.list_collections(spark, root).collect()] == ["d"]


def test_bounds_of_requests(spark):
    none = spark.createDataFrame([], "chunk_id long, collection string, section_title string")
    for k in (0, 101):
        with pytest.raises(ValueError):
            retrieval.search(none, none, none, none, k)
    with pytest.raises(ValueError):
        retrieval.search_by_title(none, limit=1001)
    found = spark.createDataFrame([(1, 1, 7, 0.5)], "query_id long, rank long, chunk_id long, score double")
    r = retrieval.results(found, none, 5).collect()[0].results[0]
    assert (r.section_title, r.formulas, r.section_pages, r.ancestors, r.metadata, r.image_path) == ("", [], [], [], {}, "")


def test_gate(spark):
    f = spark.createDataFrame([("b", "x.PDF", 10), ("b", "y.txt", 10), ("b", "z.pdf", 600 * 1024 * 1024), ("m", "x.pdf", 1)], "batch string, name string, size_bytes long")
    got = {(r.batch, r.name): r.reason for r in rollups.gate(f, spark.createDataFrame([("b", 3), ("m", 2)], "batch string, n long")).collect()}
    assert got == {("b", "x.PDF"): None, ("b", "y.txt"): "not_pdf", ("b", "z.pdf"): "too_large", ("m", "x.pdf"): "metadata_mismatch"}


def test_empty_tables(spark):
    none = el(spark, [(0, 1, "formula", 1)]).limit(0)
    p = spark.createDataFrame([], "doc_id long, page_idx long, width long, height long")
    s = sections.identify(none)
    assert s.count() == sections.assign(none, s).count() == stitch.slices(s, p, pagenums.cut_lines(pagenums.best_numbers(none, p))).count() == 0
    assert elements.rejection_reasons(elements.rejected(none, p)).count() == 0
    assert rollups.sessions(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def _model_sections(titles, n):
    """Row by row."""
    titles = sorted(titles)
    if not titles:
        return []
    p, y = titles[0][:2]
    out = [(0, 0, p, y)] if y > 100 else [(0, 0, p - 1, 99_999_999)] if p > 0 else []
    for k, (p, y, _) in enumerate(titles):
        if k + 1 == len(titles):
            out.append((p, y, n - 1, 999_999))
        else:
            q, z = titles[k + 1][:2]
            out.append((p, y, q - 1, 999_999) if z < 100 else (p, y, q, z))
    return out


def test_sections_against_a_model(spark):
    rnd = random.Random(5)
    docs = {d: [(rnd.randint(0, 11), rnd.choice([20, 60, 100, 101, 500, 900]), o) for o in range(rnd.randint(0, 9))] for d in range(40)}
    e = spark.createDataFrame(pd.DataFrame([(d, p, o, "paragraph_title", 0, y, 1, y + 1, 1.0, "t") for d, ts in docs.items() for p, y, o in ts], columns=[c.split()[0] for c in E.split(", ")]), E)
    got = {}
    for r in sections.identify(e).orderBy("doc_id", "section_idx").collect():
        got.setdefault(r.doc_id, []).append((r.start_page, r.start_y, r.end_page, r.end_y))
    assert got == {d: _model_sections(ts, 12) for d, ts in docs.items() if ts}
