"""Points on storage: a directory of buckets that grows by splitting, changed by commits.

A file lies in one bucket of its collection, named by the last `depth` bits of the hash of its id: bucket number 2 ** depth + those bits,
so number 1 is all of a collection. A bucket that has grown beyond ROWS rows is split by as many further bits as that takes;
other buckets stay as they are, so buckets of many depths stand side by side and no name begins another's. A file longer than
a bucket stays whole and is written by a task for each PIECE of its positions.

A load writes the buckets it touches into folders of its own and then commits: a manifest names the folder of every bucket, with
its files, chunks and named chunks, and becomes the current one when the file of the next number is created below `_log`,
which only one of two writers can do; the other begins again. Readers see the buckets of one manifest, never half a load.
Folders that a commit replaced are removed by the one after it, as are manifests but the last two. Contents are sums over
the manifest: no points are read.

Folders written before there were manifests (collection=*/bucket=*) are read as they are and taken over by the first load.
Points without a file id or collection have no place and are left out.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.functions.ids import point_id
from leafmark.plans.session import scratch_dir

#: Rows that a bucket is split beyond, and positions of a file that one task writes.
ROWS, PIECE = 1_000_000, 250_000
#: Bits that names of buckets have at most; loads that begin again when others come first; folders that are read by name.
DEPTH, TRIES, FOLDERS = 40, 5, 1000
#: Bytes of a table of names that is broadcast; larger ones are joined by a shuffle.
LIGHT = 32 << 20
MANIFEST = "collection string, bucket long, load string, files long, chunks long, named long, live boolean"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _children(spark: SparkSession, path: str) -> list:
    p, store = _at(spark, path)
    return list(store.listStatus(p)) if store.exists(p) else []


def _removed(spark: SparkSession, path: str) -> bool:
    p, store = _at(spark, path)
    return bool(store.delete(p, True))


def _names(spark: SparkSession):
    """How partition values are written as folder names."""
    return spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils


def _folder(spark: SparkSession, collection: str) -> str:
    return f"collection={_names(spark).escapePathName(collection)}"


def _bytes(df: DataFrame, *names: str) -> int:
    """Of a table of names and a few numbers a row."""
    size = sum((F.coalesce(F.octet_length(n), F.lit(0)) for n in names), F.lit(64))
    return df.agg(F.sum(size.cast("long"))).first()[0] or 0


def _hint(df: DataFrame, light: bool) -> DataFrame:
    return F.broadcast(df) if light else df


def with_ids(chunks: DataFrame) -> DataFrame:
    """chunks(collection, file_id, position, …) with the point id that (file_id, position) fixes."""
    return chunks.withColumn("id", point_id(F.col("file_id"), F.col("position")))


def merged(old: DataFrame, new: DataFrame, keep_tail: bool = False) -> DataFrame:
    """old and new points by (collection, file_id). A load that is newer than what is there replaces the file whole; rows of one
    load that come in several runs add up; rows of an older load are passed over. keep_tail leaves points of older loads where
    the newer one has none at their position."""
    rows = old.unionByName(new)
    if not keep_tail:
        newest = rows.groupBy("collection", "file_id").agg(F.max("load_seq").alias("_newest"))
        rows = rows.join(newest, ["collection", "file_id"]).where(F.col("load_seq").eqNullSafe(F.col("_newest"))).drop("_newest")
    others = [c for c in new.columns if c not in ("collection", "id")]
    best = rows.groupBy("collection", "id").agg(F.max_by(F.struct(*others), F.struct("load_seq", *[c for c in others if c != "load_seq" and not new.schema[c].dataType.typeName() == "map"])).alias("r"))
    return best.select("collection", "id", "r.*").select(*new.columns)


def _depth(bucket: Column) -> Column:
    return F.length(F.bin(bucket)) - 1


def _bucket(depth: Column) -> Column:
    """The bucket of a file_id at a depth."""
    size = F.call_function("shiftleft", F.lit(1).cast("long"), depth.cast("int"))
    return size + F.xxhash64("file_id").bitwiseAND(size - 1)


def _current(spark: SparkSession, path: str) -> tuple[int, DataFrame]:
    """Number and manifest of the last commit; 0 and none before the first."""
    numbers = [int(s.getPath().getName()) for s in _children(spark, f"{path}/_log") if s.getLen() and s.getPath().getName().isdigit()]
    if not numbers:
        return 0, spark.createDataFrame([], MANIFEST)
    name = spark.read.text(f"{path}/_log/{max(numbers):020d}").first()[0]
    return max(numbers), spark.read.schema(MANIFEST).parquet(f"{path}/_manifests/{name}")


def _commit(spark: SparkSession, path: str, n: int, rows: DataFrame) -> bool:
    """Makes rows the manifest of commit n; False where another writer has made one."""
    name = f"{n:020d}-{uuid.uuid4().hex}"
    rows.select(*[c.split()[0] for c in MANIFEST.split(", ")]).write.parquet(f"{path}/_manifests/{name}")
    p, store = _at(spark, f"{path}/_log/{n:020d}")
    try:
        out = store.create(p, False)
    except Py4JJavaError as e:
        if "AlreadyExists" in str(e.java_exception.getClass().getName()):
            _removed(spark, f"{path}/_manifests/{name}")
            return False
        raise
    out.writeBytes(name)
    out.close()
    return True


def _tidied(spark: SparkSession, path: str, n: int) -> None:
    """Removes commits before n and their manifests, and those that were never committed."""
    for place in ("_log", "_manifests"):
        for s in _children(spark, f"{path}/{place}"):
            if int(s.getPath().getName().split("-")[0]) < n:
                _removed(spark, f"{path}/{place}/{s.getPath().getName()}")


def _old_folders(spark: SparkSession, path: str) -> list[str]:
    return [s.getPath().getName() for s in _children(spark, path) if s.getPath().getName().startswith("collection=")]


def _stored(spark: SparkSession, path: str, schema: str, buckets: DataFrame) -> DataFrame:
    """Points of buckets(collection, bucket, load), with their bucket; folders of no other are opened."""
    full = f"{schema}, id string, bucket long, load string"
    if not _exists(spark, f"{path}/points"):
        return spark.createDataFrame([], full).drop("load")
    keys = ["collection", "bucket", "load"]
    named = buckets.select(*keys).limit(FOLDERS + 1).collect()
    read = spark.read.schema(full).option("basePath", f"{path}/points")
    if not named:
        return spark.createDataFrame([], full).drop("load")
    if len(named) <= FOLDERS:
        return read.parquet(*[f"{path}/points/{_folder(spark, r.collection)}/bucket={r.bucket}/load={r.load}" for r in named]).drop("load")
    return read.parquet(f"{path}/points").join(buckets.select(*keys), keys, "left_semi").drop("load")


def read_points(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Stored points with id and bucket; schema names the columns that the chunks came with."""
    n, manifest = _current(spark, path)
    out = _stored(spark, path, schema, manifest.where("live"))
    if not n and _old_folders(spark, path):
        out = out.unionByName(spark.read.schema(f"{schema}, id string, bucket long").parquet(path))
    return out


def _homes(files: DataFrame, live: DataFrame, light: bool) -> DataFrame:
    """(collection, file_id, _home) of files that a bucket is there for."""
    depths = [r[0] for r in live.select(_depth(F.col("bucket"))).distinct().collect()]  # DEPTH at most
    at = files.withColumn("bucket", F.explode(F.array(*[_bucket(F.lit(d)) for d in depths]).cast("array<bigint>")))
    return at.join(_hint(live.select("collection", "bucket"), light), ["collection", "bucket"]).select("collection", "file_id", F.col("bucket").alias("_home"))


def _upsert(spark: SparkSession, new: DataFrame, path: str, keep_tail: bool, rows: int) -> bool:
    n, manifest = _current(spark, path)
    live, load = manifest.where("live"), uuid.uuid4().hex
    columns = new.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new.schema if f.name != "id")
    came, touched, before = new.withColumn("_home", F.lit(None).cast("long")), live, []
    old = came.where("false")
    if n:
        files = new.select("collection", "file_id").distinct()
        few = _bytes(files, "collection", "file_id") <= LIGHT
        light = _bytes(live, "collection") <= LIGHT
        homes = _homes(files, live, light)
        came = new.join(_hint(homes, few), ["collection", "file_id"], "left")
        touched = live.join(_hint(homes.select("collection", F.col("_home").alias("bucket")).distinct(), few), ["collection", "bucket"], "left_semi")
        old = _stored(spark, path, schema, touched).withColumnRenamed("bucket", "_home")
    elif before := _old_folders(spark, path):
        old = spark.read.schema(f"{schema}, id string, bucket long").parquet(path).drop("bucket").withColumn("_home", F.lit(None).cast("long"))
    # the result is read for its sizes and for its rows
    staged = scratch_dir(spark, "upsert")
    merged(old.select(*columns, "_home"), came.select(*columns, "_home"), keep_tail).write.parquet(staged)
    points = spark.read.schema(f"{schema}, id string, _home long").parquet(staged)
    # a file that no bucket is there for gets one of the collection's greatest depth, which none there contains
    deepest = live.groupBy("collection").agg(F.max(_depth(F.col("bucket"))).alias("_deepest")) if n else None
    depth = F.coalesce("_deepest", F.lit(0)) if n else F.lit(0)
    points = (points.join(deepest, "collection", "left") if n else points).withColumn("_home", F.coalesce("_home", _bucket(depth))).drop("_deepest")
    sizes = points.groupBy("collection", "_home").agg(F.count("*").alias("_rows"), F.countDistinct("file_id").alias("_files"))
    more = F.least(F.ceil(F.log2(F.col("_rows") / rows)), F.ceil(F.log2("_files")), F.lit(DEPTH) - _depth(F.col("_home")))
    sizes = sizes.select("collection", "_home", F.when(F.col("_rows") > rows, more).otherwise(0).alias("_more"))
    out = points.join(sizes, ["collection", "_home"]).withColumn("bucket", _bucket(_depth(F.col("_home")) + F.col("_more")))
    out = out.drop("_home", "_more").withColumn("load", F.lit(load))
    out.repartition("collection", "bucket", F.floor(F.col("position") / PIECE)).write.mode("append").partitionBy("collection", "bucket", "load").parquet(f"{path}/points")
    named = F.count_if(F.col("section_title") != "noname") if "section_title" in columns else F.lit(None).cast("long")
    fresh = out.groupBy("collection", "bucket", "load").agg(F.countDistinct("file_id").alias("files"), F.count("*").alias("chunks"), named.alias("named")).withColumn("live", F.lit(True))
    kept = live.join(touched.select("collection", "bucket"), ["collection", "bucket"], "left_anti").unionByName(touched.withColumn("live", F.lit(False))).unionByName(fresh) if n else fresh
    if not _commit(spark, path, n + 1, kept):
        for r in fresh.select("collection", "bucket", "load").toLocalIterator():
            _removed(spark, f"{path}/points/{_folder(spark, r.collection)}/bucket={r.bucket}/load={r.load}")
        return False
    for r in manifest.where("not live").toLocalIterator():  # of the commit before; its readers have had a commit's time
        _removed(spark, f"{path}/points/{_folder(spark, r.collection)}/bucket={r.bucket}/load={r.load}")
    for name in before:
        _removed(spark, f"{path}/{name}")
    _tidied(spark, path, n)
    _removed(spark, staged)
    return True


def upsert(spark: SparkSession, new: DataFrame, path: str, keep_tail: bool = False, rows: int = ROWS) -> None:
    """Merges points into path. Only buckets of files that came are read and written again; a repeat changes nothing; rows is what a
    bucket is split beyond, and may differ from load to load."""
    new = with_ids(new.where("collection is not null and file_id is not null"))
    for _ in range(TRIES):
        if _upsert(spark, new, path, keep_tail, rows):
            return
    raise RuntimeError(f"{TRIES} times another load was committed first")


def store_contents(spark: SparkSession, path: str) -> DataFrame:
    """collection, files, chunks, named of all stored points, from the manifest alone."""
    _, manifest = _current(spark, path)
    return manifest.where("live").groupBy("collection").agg(*[F.sum(c).alias(c) for c in ("files", "chunks", "named")])


def create_collection(spark: SparkSession, path: str, collection: str, points: DataFrame | None = None, replace: bool = False) -> bool:
    """Makes the folder of a collection, with points if given. A no-op (False) where it is there, unless it is to be replaced."""
    if collection in _collections(spark, path):
        if not replace:
            return False
        drop_collection(spark, path, collection)
    p, store = _at(spark, f"{path}/points/{_folder(spark, collection)}")
    store.mkdirs(p)
    if points is not None:
        upsert(spark, points.where(F.col("collection") == collection), path)
    return True


def _collections(spark: SparkSession, path: str) -> list[str]:
    found = {*_old_folders(spark, path), *_old_folders(spark, f"{path}/points")}
    return sorted(_names(spark).unescapePathName(n.removeprefix("collection=")) for n in found)


def list_collections(spark: SparkSession, path: str) -> DataFrame:
    """(collection) of the folders below path, a name for each; those without points too."""
    return spark.createDataFrame([(n,) for n in _collections(spark, path)], "collection string")


def drop_collection(spark: SparkSession, path: str, collection: str) -> bool:
    """Removes a collection with all its points from storage; False where there was none."""
    if collection not in _collections(spark, path):
        return False
    for _ in range(TRIES):
        n, manifest = _current(spark, path)
        left = manifest.where(F.col("collection") != collection)
        if not n or _commit(spark, path, n + 1, left):
            for root in (path, f"{path}/points"):
                _removed(spark, f"{root}/{_folder(spark, collection)}")
            return True
    raise RuntimeError(f"{TRIES} times another load was committed first")
