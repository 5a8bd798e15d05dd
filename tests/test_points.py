"""The store of points: splitting buckets, commits, and incremental contents."""

import os
import random

import pytest
from pyspark.sql import functions as F

from leafmark.sources import points
from leafmark.streaming import ingest


def made(spark, data):
    return spark.createDataFrame(data, ingest.CHUNKS)


def rows_of(spark, at):
    return sorted((r.collection, r.file_id, r.position, r.section_title, r.load_seq) for r in points.read_points(spark, at, ingest.CHUNKS).collect())


def latest(loads):
    """Files whole by their newest load."""
    seq, out = {}, {}
    for data in loads:
        for c, f, p, t, n in data:
            if n >= seq.get((c, f), n):
                if n > seq.get((c, f), n):
                    out = {k: v for k, v in out.items() if k[:2] != (c, f)}
                seq[c, f] = n
                out[c, f, p] = (t, n)
    return sorted((*k, *v) for k, v in out.items())


def live(spark, at):
    return points._current(spark, at)[1].where("live").collect()


def test_buckets_split_and_keep_their_files(spark, tmp_path):
    at, rng = f"file://{tmp_path}/p", random.Random(1)
    loads = []
    for n in range(1, 4):
        files = [f"file{i}" for i in rng.sample(range(90), [50, 50, 4][n - 1])]
        loads.append([("a", f, p, "t" if p else "noname", n) for f in files for p in range(rng.randint(1, 6))])
        points.upsert(spark, made(spark, loads[-1]), at, rows=[200, 60, 30][n - 1])
        assert rows_of(spark, at) == latest(loads)
        found = live(spark, at)
        buckets = [r.bucket for r in found]
        assert len(set(buckets)) == len(buckets)
        names = sorted((bin(b)[3:][::-1] for b in buckets), key=len)  # low bits first: no name begins another's
        assert not any(y.startswith(x) for i, x in enumerate(names) for y in names[i + 1 :])
        assert sum(r.chunks for r in found) == len(latest(loads)) and sum(r.files for r in found) == len({x[1] for x in latest(loads)})
    assert len(buckets) > 4 and len({b.bit_length() for b in buckets}) > 1


def test_folders_without_manifest_are_taken_over(spark, tmp_path):
    at = f"file://{tmp_path}/p"
    old = [("c/1", f"f{i}", p, "t", 1) for i in range(20) for p in range(3)]
    df = points.with_ids(made(spark, old)).withColumn("bucket", F.pmod(F.xxhash64("file_id"), F.lit(64)).cast("int"))
    df.write.partitionBy("collection", "bucket").parquet(at)
    assert rows_of(spark, at) == sorted(old)
    assert [r.collection for r in points.list_collections(spark, at).collect()] == ["c/1"]
    new = [("c/1", "f3", 0, "new", 2), ("d", "g", 0, "noname", 2)]
    points.upsert(spark, made(spark, new), at)
    assert rows_of(spark, at) == latest([old, new])
    assert not [n for n in os.listdir(tmp_path / "p") if n.startswith("collection=")]
    assert {r.collection: (r.files, r.chunks, r.named) for r in points.store_contents(spark, at).collect()} == {"c/1": (20, 58, 58), "d": (1, 1, 0)}


def test_a_long_file_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(points, "PIECE", 1000)
    at = f"file://{tmp_path}/p"
    df = spark.range(8000).selectExpr("'c' as collection", "'huge' as file_id", "id as position", "'t' as section_title", "1L as load_seq")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # tiny pieces would be put together again
    try:
        points.upsert(spark, df, at, rows=500)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    (bucket,) = live(spark, at)  # a file is not split over buckets, however long
    assert (bucket.bucket, bucket.chunks) == (1, 8000)
    folder = f"{tmp_path}/p/points/collection=c/bucket=1/load={bucket.load}"
    assert len([n for n in os.listdir(folder) if n.endswith(".parquet")]) > 1


def test_a_load_reads_its_own_buckets_only(spark, tmp_path):
    root = f"file://{tmp_path}"
    first = [("c", f"f{i}", p, "t", 1) for i in range(30) for p in range(4)]
    points.upsert(spark, made(spark, first), f"{root}/p", rows=20)
    home = {r.file_id: r.bucket for r in points.read_points(spark, f"{root}/p", ingest.CHUNKS).select("file_id", "bucket").distinct().collect()}
    for r in live(spark, f"{root}/p"):
        if r.bucket != home["f7"]:  # whatever else is opened fails
            folder = f"{tmp_path}/p/points/collection=c/bucket={r.bucket}/load={r.load}"
            for n in os.listdir(folder):
                os.remove(f"{folder}/{n}")
                if n.endswith(".parquet"):
                    open(f"{folder}/{n}", "w").write("not parquet")
    ingest.load(spark, made(spark, [("c", "f7", 0, "noname", 2)]), f"{root}/p", f"{root}/toc")
    assert {r.collection: (r.files, r.chunks, r.named) for r in spark.read.parquet(f"{root}/toc").collect()} == {"c": (30, 117, 116)}


def test_stream_with_replays_equals_batch(spark, tmp_path):
    root = f"file://{tmp_path}"
    loads = [
        [("c", "f", k, "t", 1) for k in range(5)] + [("d", "g", 0, "noname", 1)],
        [("c", "f", 0, "t", 2), ("c", "h", 0, "t", 1)],  # f shrinks
        [("c", "f", k, "t", 1) for k in range(5)],  # an old load comes again
        [("c", "f", 0, "t", 2), ("c", "f", 1, "noname", 2)],  # more of the newest
    ]
    for data in loads:
        made(spark, data).coalesce(1).write.mode("append").parquet(f"{root}/in")
        ingest.ingest(spark, f"{root}/in", f"{root}/s", f"{root}/toc", f"{root}/ck")
    ingest.load(spark, made(spark, loads[-1]), f"{root}/s", f"{root}/toc")  # a batch that runs twice
    assert rows_of(spark, f"{root}/s") == latest(loads)
    assert {r.collection: (r.files, r.chunks, r.named) for r in spark.read.parquet(f"{root}/toc").collect()} == {"c": (2, 3, 2), "d": (1, 1, 0)}


def test_one_of_two_writers_begins_again(spark, tmp_path, monkeypatch):
    at, came = f"file://{tmp_path}/p", []
    real = points._commit

    def late(spark, path, n, rows):
        if not came:
            came.append(1)
            points.upsert(spark, made(spark, [("c", "other", 0, "t", 1)]), path)
        return real(spark, path, n, rows)

    monkeypatch.setattr(points, "_commit", late)
    points.upsert(spark, made(spark, [("c", "mine", 0, "t", 1)]), at)
    assert [r[1] for r in rows_of(spark, at)] == ["mine", "other"]


def test_half_a_load_is_not_seen(spark, tmp_path, monkeypatch):
    at = f"file://{tmp_path}/p"
    points.upsert(spark, made(spark, [("c", "f", 0, "old", 1)]), at)

    def broken(*_):
        raise RuntimeError("the driver went away")

    monkeypatch.setattr(points, "_commit", broken)
    with pytest.raises(RuntimeError):
        points.upsert(spark, made(spark, [("c", "f", 0, "new", 2)]), at)
    monkeypatch.undo()
    assert rows_of(spark, at) == [("c", "f", 0, "old", 1)]
    points.upsert(spark, made(spark, [("c", "f", 0, "new", 2)]), at)
    assert rows_of(spark, at) == [("c", "f", 0, "new", 2)]


def test_replaced_folders_go_a_commit_later(spark, tmp_path, monkeypatch):
    at = f"file://{tmp_path}/p"
    for n in range(1, 5):
        points.upsert(spark, made(spark, [("c", "f", 0, str(n), n), (None, "x", 0, "t", n), ("c", None, 0, "t", n)]), at)
    assert len([n for n in os.listdir(tmp_path / "p/_log") if n.isdigit()]) == 2 == len(os.listdir(tmp_path / "p/_manifests"))
    assert len(os.listdir(tmp_path / "p/points/collection=c/bucket=1")) == 2 and rows_of(spark, at) == [("c", "f", 0, "4", 4)]
    monkeypatch.setattr(points, "FOLDERS", 0)  # too many to name
    assert rows_of(spark, at) == [("c", "f", 0, "4", 4)]
