"""Cost-balanced packing of token ids into sequences.

A document's ids fill whole sequences first; what is left over (its tail) is packed with other tails. Attention sees a
sequence at a linear cost a token plus a quadratic cost a piece: cost = LINEAR * length + QUADRATIC * length ** 2. Tails
are taken in descending cost; each goes to the sequence of lowest cost that still has room for it. Tails that no sequence
can take whole are cut over the room that is left, lowest cost first, so sequences come out full. The last tokens of an
input partition, too few for a sequence, are cut at powers of two, which need no padding.

Each input partition packs for itself in batches of tails, so nothing is shuffled, memory is bounded by a batch, and a lost
task is made again alone. A null or empty text is its end id alone; rows with a null id are packed like others; repeated
rows are packed once each. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from leafmark.llm.tokens import ENTRIES

LINEAR, QUADRATIC = 1.0, 1.0 / 1024
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded long"
#: Tails that are packed together, about.
BATCH = 2048


def cost(length):
    return LINEAR * length + QUADRATIC * length * length


def balance(lengths: np.ndarray, capacity: int, sequences: int) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Pieces (item, from, length) for each sequence, and what no sequence had room for. lengths <= capacity."""
    load, room = np.zeros(sequences), np.full(sequences, capacity, np.int64)
    pieces: list[list[tuple[int, int, int]]] = [[] for _ in range(sequences)]
    rest = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fit = np.flatnonzero(room >= n)
        if not len(fit):
            rest.append(i)
            continue
        s = int(fit[np.argmin(load[fit])])
        pieces[s].append((i, 0, n))
        load[s] += cost(n)
        room[s] -= n
    over, open_ = [], [int(s) for s in np.argsort(load, kind="stable") if room[s]]
    for i in rest:
        at, n = 0, int(lengths[i])
        while at < n and open_:
            s = open_[0]
            take = min(n - at, int(room[s]))
            pieces[s].append((i, at, take))
            room[s] -= take
            at += take
            if not room[s]:
                open_.pop(0)
        if at < n:
            over.append((i, at, n - at))
    return pieces, over


def _pack(path: str, end_id: int, capacity: int, entries: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from leafmark.llm.tokens import encoder

        encode = encoder(path, entries).encode
        end = np.array([end_id], "<u4").tobytes()
        next_id = TaskContext.get().partitionId() << 40
        tails: list[tuple] = []  # (doc_id, start, doc_tokens, ids)
        out: list[tuple] = []

        def put(doc, start, n, total, ids, offset, padded=0):
            out.append((doc, start, n, zlib.crc32(ids), total, next_id, offset, padded))

        def pack(last: bool) -> None:
            nonlocal tails, next_id
            lengths = np.array([len(t[3]) // 4 for t in tails], np.int64)
            pieces, over = balance(lengths, capacity, int(lengths.sum()) // capacity)
            for seq in pieces:
                offset = 0
                for i, at, n in seq:
                    doc, start, total, ids = tails[i]
                    put(doc, start + at, n, total, ids[4 * at : 4 * (at + n)], offset)
                    offset += n
                next_id += 1
            tails = [(tails[i][0], tails[i][1] + at, tails[i][2], tails[i][3][4 * at : 4 * (at + n)]) for i, at, n in over]
            while last and tails:
                size = 1 << (sum(len(t[3]) // 4 for t in tails).bit_length() - 1)
                offset = 0
                while offset < size:
                    doc, start, total, ids = tails.pop(0)
                    n = min(len(ids) // 4, size - offset)
                    put(doc, start, n, total, ids[: 4 * n], offset)
                    if 4 * n < len(ids):
                        tails.insert(0, (doc, start + n, total, ids[4 * n :]))
                    offset += n
                next_id += 1

        def flush() -> pa.RecordBatch:
            nonlocal out
            made = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)] if out else [pa.array([], pa.int64())] * 8, names=[x.split()[0] for x in SCHEMA.split(", ")])
            out = []
            return made

        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                b = whole.slice(k, 256)
                for doc, ids in zip(b.column(0).to_pylist(), encode([t or "" for t in b.column(1).to_pylist()])):
                    ids += end
                    total = len(ids) // 4
                    for start in range(0, total - capacity + 1, capacity):
                        put(doc, start, capacity, total, ids[4 * start : 4 * (start + capacity)], 0)
                        next_id += 1
                    if rest := total % capacity:
                        tails.append((doc, total - rest, total, ids[4 * (total - rest) :]))
                if len(tails) >= BATCH:
                    pack(False)
                yield flush()
        pack(True)
        yield flush()

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, entries: int = ENTRIES) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and padded (tokens of padding, 0). A worker
    remembers the ids of 2 x entries pieces of text at most."""
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(_pack(tokenizer, end_id, capacity, entries), SCHEMA)
