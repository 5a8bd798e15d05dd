"""Sinks: chunk upsert and collections (sources.points), tables of contents, JSON reports."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from leafmark.plans.session import ship_package
from leafmark.sources import book_folders
from leafmark.sources.points import create_collection, drop_collection, list_collections, merged, read_points, store_contents, upsert, with_ids  # noqa: F401
from leafmark.sources.readers import _exists


def write_contents(toc: DataFrame, path: str) -> None:
    """Tables of contents, a folder for each collection: of rollups.book_contents a line for each book, of contents one for all."""
    by = "collection" if "collection" in toc.columns else "collection_name"
    toc.write.mode("overwrite").partitionBy(by).json(path)


def read_contents(spark: SparkSession, path: str, schema) -> DataFrame:
    """What write_contents wrote; empty where nothing was."""
    return spark.read.schema(schema).json(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def report_json(rows: DataFrame, key: str, name: str = "report") -> DataFrame:
    """(key, JSON text of all columns)."""
    return rows.select(key, F.to_json(F.struct(*rows.columns)).alias(name))


def write_files(files: DataFrame, root: str) -> None:
    """A text file for each row of files(path, content), path being below root. Tasks write the files themselves, so there is no
    commit of the driver's that would go through them one by one; each appears whole, and is the same if its task runs again."""

    def run(rows: Iterator[Row]) -> None:
        store, base = book_folders.opened(root)
        last = None
        for r in rows:
            folder, _, name = f"{base}/{r.path}".rpartition("/")
            if folder != last:
                store.create_dir(folder, recursive=True)
                last = folder
            own = f"{folder}/.{name}-{uuid.uuid4().hex}"
            with store.open_output_stream(own) as out:
                out.write(r.content.encode("utf-8"))
            store.move(own, f"{folder}/{name}")

    ship_package(files.sparkSession)
    files.select("path", "content").foreachPartition(run)
