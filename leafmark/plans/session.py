"""What a session needs before operators with Python stages run."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

ARROW_ROWS, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1024


def ship_package(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once for each application."""
    sc = spark.sparkContext
    if getattr(sc, "_leafmark_shipped", False):
        return spark
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="leafmark-"), "leafmark_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    z.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), os.path.dirname(root)))
    sc.addPyFile(path)
    sc._leafmark_shipped = True
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on one machine, where that is unset, one of our own."""
    if not (root := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        if not (known := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="leafmark-"))
            known = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = known.get()
    return root.rstrip("/")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder's path below the shared one."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def short_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Tasks get that many rows at once: whole texts, or chunks with their vectors, wait on both sides of the
    pipe, and ten thousand of them are tens of MB."""
    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)
