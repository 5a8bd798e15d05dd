"""Incremental ingest: new chunk files are upserted and the contents of the touched collections refreshed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafmark.sources.book_folders import register
from leafmark.sources.points import store_contents, upsert

CHUNKS = "collection string, file_id string, position bigint, section_title string, load_seq bigint"


def load(spark: SparkSession, df: DataFrame, points: str, contents: str) -> None:
    """A batch of chunks: upserted, and the contents (files, chunks, named) of its collections written. Counts are kept for each
    bucket with the commit of its points, so they are taken up and replaced together and a load reads its own buckets only."""
    upsert(spark, df, points)
    fresh = store_contents(spark, points).join(df.select("collection").distinct(), "collection", "left_semi")
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collection").parquet(contents)


def run(stream: DataFrame, points: str, contents: str, checkpoint: str) -> None:
    """load() for all that a stream of chunks has so far."""
    spark = stream.sparkSession

    def batch(df: DataFrame, batch_id: int) -> None:
        load(spark, df, points, contents)

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def ingest(spark: SparkSession, incoming: str, points: str, contents: str, checkpoint: str) -> None:
    """Takes all files that have come so far. Ids are deterministic and a batch is merged by the number of its load, so one that
    is run again after a failure leaves the same points, and a file that comes in several runs of a load keeps all its parts."""
    run(spark.readStream.schema(CHUNKS).parquet(incoming), points, contents, checkpoint)


def ingest_books(spark: SparkSession, root: str, points: str, contents: str, checkpoint: str, **options: str) -> None:
    """Takes the books below root whose report came or changed since the last time; a section is a chunk."""
    stream = register(spark).readStream.format("book_folders").options(path=root, table="chunks", **options).load()
    run(stream, points, contents, checkpoint)
