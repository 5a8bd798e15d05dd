"""Book folders as a data source of Spark's, in batch and as a stream: spark.read.format("book_folders").

A root holds collections, these hold books, folders whose names are numbers, and a book holds its report, page images and maps
of recognised text. Options: `path` (the root), `table` (below), `report`, `pages` and `maps` (patterns of names; pages lie in
the book or one folder down). Tables:

    reports   collection, book_index, readable, total_pages, total_sections, page_numbers, sections
    sections  a row for each section of a report, with its place
    books     every numbered folder, with or without a report
    pages     page_idx and path of page images, by the order of readers.list_pages
    maps      file, key, value of JSON objects with numbers for names
    chunks    what ingest takes: a row for each section, its book as the file, the report's time as the load

Collections are listed by the driver, names only, and books are dealt to tasks BOOKS at a time, whatever collection they are
of. Reports that are not JSON keep their book, unreadable and with defaults. A folder's name may be written as a partition value
(collection=a%20b). The stream gives books whose report came or changed since; it takes reports that are
SETTLED seconds old (option `settled`), so that one written in the same moment is not passed over. Files are read through Arrow's file systems.
"""

from __future__ import annotations

import fnmatch
import json
import re
import time
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

BOOKS = 200
#: Seconds that a report must lie before the stream takes it.
SETTLED = 1.0
_N, _S, _F = T.LongType(), T.StringType(), T.DoubleType()
_SPOT = T.StructType().add("start_page", _N).add("start_y", _F).add("end_page", _N).add("end_y", _F).add("page_numbers", T.ArrayType(_S))
#: readers.SECTION as types: tasks have no JVM that would parse it.
SECTION = (
    T.StructType().add("index", _N).add("title", _S).add("page_range", _S).add("precise_range", _SPOT).add("total_elements", _N).add("formulas", _N).add("numbers", _N)
    .add("ancestors", T.ArrayType(_N)).add("ancestor_titles", T.ArrayType(_S))
)
_PLACE = "collection string, book_index bigint"
_REPORT = f"{_PLACE}, readable boolean, total_pages bigint, total_sections bigint, page_numbers map<string,string>, sections array<{SECTION.simpleString()}>"
TABLES = {
    "reports": _REPORT, "sections": f"{_PLACE}, pos bigint, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in SECTION), "books": f"{_PLACE}, has_report boolean, title string, total_pages bigint, total_sections bigint",
    "pages": f"{_PLACE}, page_idx bigint, path string", "maps": f"{_PLACE}, file string, key bigint, value string",
    "chunks": "collection string, file_id string, position bigint, section_title string, load_seq bigint",
}


def fitted(value, kind: T.DataType):
    """A JSON value as a Spark value of that type; null where it is of another."""
    if isinstance(kind, T.StructType):
        return tuple(fitted(value.get(f.name), f.dataType) for f in kind) if isinstance(value, dict) else None
    if isinstance(kind, T.ArrayType):
        return [fitted(v, kind.elementType) for v in value] if isinstance(value, list) else None
    if isinstance(kind, T.MapType):
        return {k: fitted(v, kind.valueType) for k, v in value.items()} if isinstance(value, dict) else None
    if isinstance(kind, T.StringType):
        return value if isinstance(value, str) or value is None else json.dumps(value)
    if isinstance(value, bool) or not isinstance(value, int | float):
        return None
    if isinstance(kind, T.DoubleType):
        return float(value)
    return value if isinstance(value, int) and abs(value) < 2**63 else None


def _plain(name: str) -> str:
    """A folder's name, or the value it was written for as a partition."""
    return unquote(name.partition("=")[2]) if "=" in name else name


def opened(path: str) -> tuple:
    """Arrow's file system for a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


class Folders:
    """What the tables are read with."""

    def __init__(self, options: dict):
        self.store, self.root = opened(options["path"])
        self.report, self.page, self.map = options.get("report", "summary_report.json"), options.get("pages", "*"), options.get("maps", "titles.json")

    def children(self, path: str, folders: bool) -> list:
        from pyarrow import fs

        kind = fs.FileType.Directory if folders else fs.FileType.File
        found = self.store.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return sorted((f for f in found if f.type == kind and not f.base_name.startswith((".", "_"))), key=lambda f: f.base_name)

    def books(self) -> Iterator[tuple[str, int, str]]:
        """(collection, number, path)."""
        for c in self.children(self.root, True):
            for b in self.children(c.path, True):
                if re.fullmatch("[0-9]+", number := _plain(b.base_name)) and int(number) < 2**63:
                    yield _plain(c.base_name), int(number), b.path

    def named(self, book: str, pattern: str) -> list:
        return [f for f in self.children(book, False) if fnmatch.fnmatchcase(f.base_name, pattern)]

    def text(self, path: str) -> str:
        with self.store.open_input_stream(path) as file:
            return file.read().decode("utf-8", "replace")

    def json(self, path: str) -> dict | None:
        try:
            found = json.loads(self.text(path))
        except ValueError:
            return None
        return found if isinstance(found, dict) else None


def _page_order(path: str) -> tuple:
    """page_X_Y at (X, Y), page_X at (X, 0), others last; ties by path."""
    m = re.search(r"(?:^|/)page_([0-9]+)(?:_([0-9]+))?\.[A-Za-z]+$", path)
    return (int(m[1]), int(m[2] or 0), path) if m and int(m[1]) < 2**63 else (999_999, 999_999, path)


def _report(found: dict | None) -> tuple:
    """readable, total_pages, total_sections, page_numbers, sections."""
    value = lambda name, kind: fitted((found or {}).get(name), kind)
    sections, total = value("sections", T.ArrayType(SECTION)) or [], value("total_sections", _N)
    return found is not None, value("total_pages", _N) or 0, len(sections) if total is None else total, value("page_numbers", T.MapType(_S, _S)) or {}, sections


def rows_of(folders: Folders, table: str, collection: str, book: int, path: str) -> Iterator[tuple]:
    """The rows of a book."""
    if table == "pages":
        found = [f.path for folder in [path, *(f.path for f in folders.children(path, True))] for f in folders.named(folder, folders.page) if re.search(r"\.(png|jpe?g)$", f.path.lower())]
        yield from ((collection, book, i, p) for i, p in enumerate(sorted(found, key=_page_order)))
    elif table == "maps":
        for f in folders.named(path, folders.map):
            for k, v in (folders.json(f.path) or {}).items():
                if re.fullmatch("-?[0-9]+", k):
                    yield collection, book, f.path, int(k), fitted(v, _S)
    else:
        reports = folders.named(path, folders.report)
        told = [(f, _report(folders.json(f.path))) for f in reports]
        if table == "books":
            readable, pages, total = next(((r[0], r[1], r[2]) for _, r in told), (False, 0, 0))
            yield collection, book, readable, f"Book {book}", pages, total
        for f, r in told:
            if table == "reports":
                yield collection, book, *r
            elif table == "sections":
                yield from ((collection, book, i, *(s or (None,) * len(SECTION))) for i, s in enumerate(r[4]))
            elif table == "chunks":
                yield from ((collection, f"{collection}/{book}", i, s and s[1], f.mtime_ns // 1000) for i, s in enumerate(r[4]))


@dataclass
class Books(InputPartition):
    """Books of one task."""

    places: list[tuple[str, int, str]]


class Reader(DataSourceReader):
    def __init__(self, options: dict, table: str):
        self.options, self.table = options, table

    def _dealt(self, places: list[tuple[str, int, str]]) -> list[Books]:
        return [Books(places[k : k + BOOKS]) for k in range(0, len(places), BOOKS)] or [Books([])]

    def partitions(self) -> list[Books]:
        return self._dealt(list(Folders(self.options).books()))

    def read(self, partition: Books) -> Iterator[tuple]:
        folders = Folders(self.options)
        for place in partition.places:
            yield from rows_of(folders, self.table, *place)


class StreamReader(Reader, DataSourceStreamReader):
    """An offset is the time up to which reports are taken; {"until": nanoseconds}."""

    def initialOffset(self) -> dict:
        return {"until": -1}

    def _reports(self) -> Iterator[tuple[int, tuple[str, int, str]]]:
        folders = Folders(self.options)
        for place in folders.books():
            for f in folders.named(place[2], folders.report):
                yield f.mtime_ns or 0, place

    def latestOffset(self) -> dict:
        now = time.time_ns() - int(float(self.options.get("settled", SETTLED)) * 1e9)
        return {"until": max((t for t, _ in self._reports() if t <= now), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Books]:
        return self._dealt(sorted({place for t, place in self._reports() if start["until"] < t <= end["until"]}))

    def commit(self, end: dict) -> None:
        pass


class BookFolders(DataSource):
    @classmethod
    def name(cls) -> str:
        return "book_folders"

    def _table(self) -> str:
        table = self.options.get("table", "reports")
        if table not in TABLES:
            raise ValueError(f"no table {table}: {', '.join(TABLES)}")
        if "path" not in self.options:
            raise ValueError("say where the books are: option path")
        return table

    def schema(self) -> str:
        return TABLES[self._table()]

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return Reader(dict(self.options), self._table())

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return StreamReader(dict(self.options), self._table())


def register(spark: SparkSession) -> SparkSession:
    """Makes the format known to a session, and the package to its tasks."""
    from leafmark.plans.session import ship_package

    spark.dataSource.register(BookFolders)
    return ship_package(spark)
