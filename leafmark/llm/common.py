"""What the training-data operators share: the folder all executors see, word splitting, size-checked joins, ranks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from leafmark.plans.session import scratch_dir, short_batches  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of the given tables that a join side may have to be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 100_000
#: Bytes that a side with rows of unequal size may have to be broadcast.
BROADCAST_BYTES = 32 << 20


fresh_dir = scratch_dir

#: Tells Spark to remove the shuffle files of a query when it has ended.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is stored is read from the shared folder from then on; the shuffles it came by only fill the executors' disks."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREE_SHUFFLES) if before is None else spark.conf.set(FREE_SHUFFLES, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: cuts lineage, and survives the loss of any executor."""
    path = fresh_dir(df.sparkSession, name)
    with shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._leafmark_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes tables made by stored() that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_leafmark_path", None):
            removed(df.sparkSession, path)


def removed(spark: SparkSession, path: str) -> None:
    """Removes a folder that fresh_dir() named."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, however often body uses it, lambdas included."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; lower() is the fast way where all is ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def split_words(text: Column, separators: str) -> Column:
    """Maximal runs of characters outside the class; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{separators}]+"), "")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most that many rows, else as it is. df should be cheap to count (stored)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def light(df: DataFrame, row_bytes: Column, most: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for broadcast if its rows, by row_bytes of each, come to that many bytes at most, else as it is."""
    return F.broadcast(df) if (df.agg(F.sum(row_bytes.cast("long"))).first()[0] or 0) <= most else df


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], buckets: int, name: str = "rank", keyed_by: Column | None = None) -> DataFrame:
    """Gapless ranks from 0 within keys, without a task that holds a whole key.

    Rows fall by hash into buckets; rank = rows of the key in earlier buckets + place within the bucket.
    The counts by key and bucket are the only thing summed in one place.
    """
    b = F.pmod(keyed_by if keyed_by is not None else F.xxhash64(*order), F.lit(buckets)).cast("int")
    rows = df.withColumn("_b", b)
    sizes = rows.groupBy(*keys, "_b").count()
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    inside = Window.partitionBy(*keys, "_b").orderBy(*order)
    out = rows.withColumn("_in", F.row_number().over(inside) - 1).join(sizes, [*keys, "_b"])
    return out.withColumn(name, (F.col("_in") + F.col("_before")).cast("long")).drop("_b", "_in", "_before")


def long_type(name: str, nullable: bool = True) -> T.StructField:
    return T.StructField(name, T.LongType(), nullable)
