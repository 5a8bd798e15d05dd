"""Book folders as a data source, in batch and as a stream."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from leafmark.sources import book_folders, points, readers
from leafmark.streaming import ingest


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text if isinstance(text, str) else json.dumps(text))


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("books")
    section = {"index": 0, "title": "1.1 A", "page_range": "1-2", "precise_range": {"start_page": 1, "start_y": 3, "page_numbers": ["i"]}, "formulas": 2, "ancestors": [0], "ancestor_titles": ["1 X"], "more": 1}
    write(root / "demo/0/summary_report.json", {"total_pages": 10, "total_sections": 2, "page_numbers": {"0": "1"}, "sections": [{"index": 0, "title": "noname"}, section]})
    write(root / "demo/1/summary_report.json", {"sections": [{"title": 5}, "no section", {"title": "x", "formulas": "two"}]})
    write(root / "demo/3/summary_report.json", "{not json")
    write(root / "demo/4/summary_report.json", "[1]")
    (root / "demo/2").mkdir()
    write(root / "demo/temp_folder/summary_report.json", {})
    write(root / "collection=a b/book=7/summary_report.json", {"total_pages": 1})
    for name in ("page_10.png", "page_2_1.JPG", "page_2.png", "zz.jpeg", "aa.png", "page_1.txt"):
        write(root / "demo/0/pages" / name, "x")
    write(root / "demo/0/titles.json", {"1": "one", "-2": None, "x": "no", "3": {"deep": True}})
    write(root / "demo/1/titles.json", "broken")
    return root


def read(spark, root, table, **options):
    return book_folders.register(spark).read.format("book_folders").options(path=str(root), table=table, **options).load()


@pytest.mark.parametrize("uri", [False, True])
def test_reports_and_sections_are_those_of_the_readers(spark, root, uri):
    at = f"file://{root}" if uri else root
    cols = ["collection", "book_index", "readable", "total_pages", "total_sections", "page_numbers"]
    key = lambda r: (r.collection, r.book_index)
    mine, theirs = (sorted(df.select(cols).collect(), key=key) for df in (read(spark, at, "reports"), readers.read_reports(spark, f"file://{root}")))
    assert {key(r): r.readable for r in mine} == {("demo", 0): True, ("demo", 1): True, ("demo", 3): False, ("demo", 4): False, ("a b", 7): True}
    # a report that is not an object, and sections that are none, are read by Spark's JSON in ways of its own
    agree = lambda rows: [r for r in rows if r.book_index not in (1, 4)]
    assert agree(mine) == agree(theirs)
    sections = read(spark, at, "sections").orderBy("collection", "book_index", "pos").collect()
    assert sections[:2] == readers.report_sections(readers.read_reports(spark, f"file://{root}").where("book_index = 0")).orderBy("pos").collect()
    assert [(r.pos, r.title, r.formulas) for r in sections[2:]] == [(0, "5", None), (1, None, None), (2, "x", None)]


def test_sections_have_the_readers_type():
    assert book_folders.SECTION.simpleString() == readers.SECTION


def test_books(spark, root):
    folders = spark.createDataFrame([("demo", n) for n in ("0", "2", "3", "temp_folder")], "collection string, name string")
    theirs = readers.books(folders, readers.read_reports(spark, f"file://{root}"))
    mine = read(spark, root, "books")
    assert sorted(mine.where("collection = 'demo' and book_index in (0, 2, 3)").collect()) == sorted(theirs.collect())
    assert mine.count() == 6


def test_pages_and_maps(spark, root):
    pages = read(spark, root, "pages").orderBy("page_idx").collect()
    assert [(r.page_idx, os.path.basename(r.path)) for r in pages] == list(enumerate(["page_2.png", "page_2_1.JPG", "page_10.png", "aa.png", "zz.jpeg"]))
    files = spark.createDataFrame([(0, r.path) for r in pages], "doc_id long, path string")
    assert [r.path for r in readers.list_pages(files).orderBy("page_idx").collect()] == [r.path for r in pages]
    assert sorted((r.key, r.value) for r in read(spark, root, "maps").collect() if r.value) == [(1, "one"), (3, '{"deep": true}')]


def test_nothing_there_and_wrong_names(spark, root, tmp_path):
    for table in book_folders.TABLES:
        assert read(spark, tmp_path / "none", table).collect() == []
    with pytest.raises(Exception, match="no table"):
        read(spark, root, "chapters")
    with pytest.raises(Exception, match="option path"):
        spark.read.format("book_folders").load()


def test_books_are_dealt_to_tasks(tmp_path, monkeypatch):
    for c in ("a", "b"):
        for k in range(7 if c == "a" else 1):
            (tmp_path / c / str(k)).mkdir(parents=True)
    monkeypatch.setattr(book_folders, "BOOKS", 3)
    parts = book_folders.Reader({"path": str(tmp_path)}, "books").partitions()
    assert [len(p.places) for p in parts] == [3, 3, 2]


def test_a_stream_of_books_feeds_the_contents(spark, tmp_path):
    books, at = tmp_path / "books", f"file://{tmp_path}"

    def told(n, titles, age):
        write(books / f"c/{n}/summary_report.json", {"sections": [{"title": t} for t in titles]})
        then = time.time() - age
        os.utime(books / f"c/{n}/summary_report.json", (then, then))

    def taken():
        ingest.ingest_books(spark, str(books), f"{at}/p", f"{at}/toc", f"{at}/ck")
        return {r.collection: (r.files, r.chunks, r.named) for r in spark.read.parquet(f"{at}/toc").collect()}

    told(0, ["noname", "A", "B"], 100)
    told(1, ["noname"], 90)
    assert taken() == {"c": (2, 4, 2)}
    told(0, ["A"], 50)  # changed, and shorter
    told(2, ["C", "D"], 40)
    assert taken() == {"c": (3, 4, 3)}
    told(3, ["E"], -100)  # not settled yet
    assert taken() == {"c": (3, 4, 3)}
    got = points.read_points(spark, f"{at}/p", ingest.CHUNKS).collect()
    assert sorted((r.file_id, r.position, r.section_title) for r in got) == [("c/0", 0, "A"), ("c/1", 0, "noname"), ("c/2", 0, "C"), ("c/2", 1, "D")]


@pytest.mark.parametrize("uri", ["", "file:", "file://"])
def test_files_are_written_by_tasks_and_listed_by_them(spark, tmp_path, uri):
    from leafmark.sources import sinks

    data = [(f"{k % 3}/doc_id={k}.txt", json.dumps({"1": f"é{k}", "x": "no number"})) for k in range(40)]
    files = spark.createDataFrame(data, "path string, content string").repartition(3)
    for _ in range(2):  # as a task that runs again
        sinks.write_files(files, f"{uri}{tmp_path}/maps")
    assert sorted(str(p.relative_to(tmp_path / "maps")) for p in (tmp_path / "maps").rglob("*") if p.is_file()) == sorted(p for p, _ in data)
    found = readers.read_ocr_map(spark, f"{uri}{tmp_path}/maps", "string", "*.txt").selectExpr("regexp_extract(file, '=([0-9]+)', 1) as k", "key", "value")
    assert {tuple(r) for r in found.collect()} == {(str(k), 1, f"é{k}") for k in range(40)}


@pytest.mark.parametrize("name", ["op_src3", "op_src3_source"])
def test_maps_need_no_commit_by_the_driver(spark, monkeypatch, name):
    """A commit that names folders by a column costs the driver some milliseconds for each document."""
    from pyspark.sql import DataFrameWriter

    from conftest import SF
    from leafmark.plans.queries import QUERIES

    asked = []
    monkeypatch.setattr(DataFrameWriter, "partitionBy", lambda self, *by: asked.append(by) or self)
    assert QUERIES[name](spark, SF).count() > 0 and not asked


def test_documents_without_an_id_keep_their_maps(spark, tmp_path):
    from conftest import SF
    from leafmark.plans.queries import QUERIES

    events = spark.read.parquet(f"{SF}/events.parquet")
    events.withColumn("user_id", F.when(F.col("user_id") == 3, F.lit(None)).when(F.col("user_id") == 4, F.lit(-4)).otherwise(F.col("user_id")).cast("long")).write.parquet(f"{tmp_path}/events.parquet")
    count = lambda df: {r.doc_id: r["count"] for r in df.groupBy("doc_id").count().collect()}
    want = count(QUERIES["op_se1"](spark, str(tmp_path)))
    assert None in want and -4 in want and count(QUERIES["op_src3"](spark, str(tmp_path))) == want
