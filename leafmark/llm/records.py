"""Token ids in length-delimited binary records, with an offset index beside them.

A shard is a file of frames: length of the payload (u64), its masked checksum (u32), the payload, its masked checksum (u32),
all little-endian. A payload is the document's id (i64, with a flag byte before it for null), the width of an id in bytes
(u8), and the ids. The mask rotates the CRC-32 by 15 bits and adds a constant, so that a checksum of data holding
checksums stays good. Shards are written under a name of their own and renamed when complete, so a task that is run
again, or twice at once, leaves only whole files; the index (Parquet) names the files that count.

Documents stand in ascending id order, ties as they came; null ids come first. A null or empty text is the end id alone.
Repeated rows are records of their own. Other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmark.llm.common import fresh_dir

#: Fixed values of the checksum mask.
MASK_ROTATE, MASK_ADD = 15, 0xA282EAD8
INDEX = "shard int, file string, record long, doc_id long, offset long, frame_bytes long, n_tokens long"
READ = 4 << 20
#: Bytes of text that a shard holds about.
SHARD_BYTES = 128 << 20


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> MASK_ROTATE) | (c << (32 - MASK_ROTATE))) + MASK_ADD) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def payload_of(doc_id: int | None, ids: np.ndarray) -> bytes:
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    return struct.pack("<BqB", doc_id is None, doc_id or 0, width) + ids.astype(f"<u{width}").tobytes()


def parsed(payload: bytes) -> tuple[int | None, np.ndarray]:
    null, doc_id, width = struct.unpack_from("<BqB", payload)
    return None if null else doc_id, np.frombuffer(payload, f"<u{width}", offset=10).astype("<u4")


def unframed(head: bytes, rest) -> bytes:
    """The payload behind a 12-byte head; rest(n) gives the next n bytes. Raises ValueError where a checksum fails."""
    if len(head) != 12 or masked(head[:8]) != struct.unpack_from("<I", head, 8)[0]:
        raise ValueError("the length of a record is damaged")
    n = struct.unpack_from("<Q", head)[0]
    body = rest(n + 4)
    if len(body) != n + 4 or masked(body[:n]) != struct.unpack_from("<I", body, n)[0]:
        raise ValueError("a record is damaged")
    return body[:n]


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _write(tokenizer: str, end_id: int, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from leafmark.llm.tokens import encoder

        store, root = _filesystem(folder)
        store.create_dir(root, recursive=True)
        encode, shard = encoder(tokenizer).encode, TaskContext.get().partitionId()
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}"
        end = np.array([end_id], "<u4").tobytes()
        at = record = 0
        with store.open_output_stream(f"{root}/.{name}") as file:
            for whole in batches:
                for k in range(0, whole.num_rows, 256):
                    b, rows = whole.slice(k, 256), []
                    docs = b.column(0).to_pylist()
                    for doc, ids in zip(docs, encode([t or "" for t in b.column(1).to_pylist()])):
                        ids = np.frombuffer(ids + end, "<u4")
                        data = frame(payload_of(doc, ids))
                        file.write(data)
                        rows.append((shard, name, record, doc, at, len(data), len(ids)))
                        at += len(data)
                        record += 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.string(), *[pa.int64()] * 5))], names=[x.split()[0] for x in INDEX.split(", ")]
                    )
        store.move(f"{root}/.{name}", f"{root}/{name}")

    return run


def write(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 2, shards: int | None = None) -> tuple[DataFrame, str]:
    """Writes the records and the index under folder (by default a new one in the shared folder); returns the index and the folder."""
    spark = docs.sparkSession
    folder = folder or fresh_dir(spark, "records")
    if not shards:
        size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    # the place in the input deals out rows that share an id, and spares the sampling of ranges a look at the texts
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("_at"))
    ordered = rows.repartitionByRange(shards, "doc_id", "_at").sortWithinPartitions("doc_id", "_at").select("doc_id", "text")
    ordered.mapInArrow(_write(tokenizer, end_id, f"{folder}/data"), INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index"), folder


def _read_whole(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _filesystem(folder)
        for b in batches:
            for name, start in zip(b.column("file").to_pylist(), b.column("base").to_pylist()):
                with store.open_input_stream(f"{root}/{name}", buffer_size=READ) as file:
                    rows = []
                    while head := file.read(12):
                        doc, ids = parsed(unframed(head, file.read))
                        rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
                        start += len(ids)
                        if len(rows) == 4096:
                            yield _digests(rows)
                            rows = []
                    if rows:
                        yield _digests(rows)

    return run


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_back(index: DataFrame, folder: str) -> DataFrame:
    """Reads every shard from first to last byte: doc_id, start (tokens of all records before), n_tokens, ids_crc32."""
    shards = index.groupBy("shard", "file").agg(F.sum("n_tokens").alias("tokens"))  # a row for each file
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    n = max(1, index.select("shard").distinct().count())
    dealt = shards.repartitionByRange(n, "shard").select("file", "base")
    return dealt.mapInArrow(_read_whole(f"{folder}/data"), "doc_id long, start long, n_tokens long, ids_crc32 long")


def _read_at(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _filesystem(folder)
        opened: dict = {}
        for b in batches:
            rows = []
            for place, name, offset, n in zip(*(b.column(c).to_pylist() for c in ("place", "file", "offset", "frame_bytes"))):
                if name not in opened:
                    if len(opened) >= 64:
                        opened.pop(next(iter(opened))).close()
                    opened[name] = store.open_input_file(f"{root}/{name}")
                data = opened[name].read_at(n, offset)
                doc, ids = parsed(unframed(data[:12], lambda m: data[12 : 12 + m]))
                rows.append((place, doc, ids.astype(np.int32)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int32()))], names=["place", "doc_id", "ids"])

    return run


def read_shuffled(index: DataFrame, folder: str, seed: int = 0) -> DataFrame:
    """(place, doc_id, ids) of all records in an order that depends on the seed alone, each read at its offset."""
    n = max(1, index.select("shard").distinct().count())
    place = F.xxhash64("shard", "record", F.lit(seed))
    return index.select(place.alias("place"), "file", "offset", "frame_bytes").repartitionByRange(n, "place").sortWithinPartitions("place").mapInArrow(_read_at(f"{folder}/data"), "place long, doc_id long, ids array<int>")
