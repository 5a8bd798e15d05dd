"""Token counts of whole texts by a two-tier look-up on the map side.

White space always ends a token of a word-end vocabulary, so a text's count is the sum of the counts of its pieces, the
maximal runs without white space. Tier one is a table of the corpus's frequent pieces with their counts, broadcast as one
small value: at most ENTRIES pieces of at most PIECE_BYTES bytes. What is not in it goes to tier two, a bounded cache in
each Python worker, and is encoded by the library when it is missing there too. Pieces are never shuffled.

The frequent pieces come from all texts: each input partition keeps a Misra-Gries summary of ENTRIES counters, and summaries
(not pieces) are merged FAN at a time over LEVELS levels, so no task holds more than FAN of them. Every piece that makes up
more than 1 / ENTRIES of the corpus is in the table, whatever the order. The table only saves time: counts are those of the
library with any table.

Texts that spell an added token of the vocabulary, or hold the separators U+001C to U+001F (white space for Python, not for the
library), are encoded whole. A null or empty text has no bytes and no tokens; rows with a null id and repeated rows are counted
like others; other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces in the broadcast table, and counters of a summary.
ENTRIES = 16_384
#: Longer pieces are not entered in the table.
PIECE_BYTES = 64
#: Summaries that one task merges, and how often: room for FAN ** LEVELS input partitions in the last task's share.
FAN, LEVELS = 32, 4
#: Pieces that a worker's cache holds, in two generations.
CACHED = 400_000
#: Texts that are handled at once.
ROWS = 256
_ODD = re.compile("[\x1c-\x1f]")
_SUMMARY = "part long, pieces array<string>, counts array<long>"


def pruned(tally: Counter, entries: int) -> Counter:
    """The Misra-Gries step: at most so many pieces stay, each less the largest count that goes."""
    if len(tally) <= entries:
        return tally
    counts = np.fromiter(tally.values(), np.int64, len(tally))
    cut = int(np.partition(counts, len(counts) - entries - 1)[len(counts) - entries - 1])
    return Counter({p: c - cut for p, c in tally.items() if c > cut})


def _summary(part: int, tally: Counter) -> pa.RecordBatch:
    pieces, counts = list(tally), list(tally.values())
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([pieces], pa.list_(pa.string())), pa.array([counts], pa.list_(pa.int64()))], names=["part", "pieces", "counts"])


def _texts(batches: Iterable[pa.RecordBatch], column: int) -> Iterator[list[str]]:
    for whole in batches:
        for k in range(0, whole.num_rows, ROWS):
            yield [t or "" for t in whole.column(column).slice(k, ROWS).to_pylist()]


def _summarise(entries: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter = Counter()
        for texts in _texts(batches, 0):
            for text in texts:
                tally.update(text.split())
                if len(tally) > 8 * entries:
                    tally = pruned(tally, entries)
        for piece in [p for p in tally if len(p.encode()) > PIECE_BYTES]:
            del tally[piece]
        yield _summary(TaskContext.get().partitionId(), pruned(tally, entries))

    return run


def _merge(entries: int):
    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter = Counter()
        for b in batches:
            for pieces, counts in zip(b.column("pieces"), b.column("counts")):
                tally.update(dict(zip(pieces.as_py(), counts.as_py())))
        yield _summary(key[0].as_py(), pruned(tally, entries))

    return run


def frequent(docs: DataFrame, entries: int = ENTRIES) -> list[str]:
    """The pieces of docs that come up most, at most so many; all whose share is over 1 / entries are among them."""
    rows = docs.select("text").mapInArrow(_summarise(entries), _SUMMARY)
    for _ in range(LEVELS):
        rows = rows.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("part").applyInArrow(_merge(entries), _SUMMARY)
    tally: Counter = Counter()
    for row in rows.select("pieces", "counts").toLocalIterator():  # one for each FAN ** LEVELS partitions
        tally.update(dict(zip(row.pieces, row.counts)))
        tally = pruned(tally, entries)
    return sorted(tally)


class Table(dict):
    """Tier one: counts by frequent piece. What it lacks is looked up in the worker's cache, tier two, and encoded there if need be."""

    def __init__(self, path: str, pieces: list[str] = (), counts: bytes = b"", cached: int = CACHED):
        from tokenizers import Tokenizer

        super().__init__(zip(pieces, np.frombuffer(counts, np.uint8).tolist()))
        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.whole = re.compile("|".join([_ODD.pattern, *map(re.escape, added)]))
        self.cached, self.young, self.old = cached, {}, {}

    def encode(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __missing__(self, piece: str) -> int:
        n = self.young.get(piece)
        if n is None:
            n = self.old.get(piece)
            if n is None:
                n = len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
            if len(self.young) >= self.cached // 2:
                self.young, self.old = {}, self.young
            self.young[piece] = n
        return n

    def count(self, text: str) -> int:
        if self.whole.search(text):
            return self.encode([text])[0]
        return sum(map(self.__getitem__, text.split()))


def packed(path: str, pieces: list[str]) -> tuple[str, bytes]:
    """The table as it is broadcast: pieces by blanks, a byte for each count. A piece has a token for each of its bytes at most;
    NFC may make one of a few characters longer, so what does not fit a byte is left to tier two."""
    counts = Table(path).encode(list(pieces))
    kept = [(p, n) for p, n in zip(pieces, counts) if n < 256]
    return " ".join(p for p, _ in kept), bytes(n for _, n in kept)


@lru_cache(maxsize=1)
def _table(path: str, pieces: str, counts: bytes) -> Table:
    """One for each Python worker."""
    return Table(path, pieces.split(" ") if pieces else [], counts)


def _count(path: str, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _table(path, *shared.value).count
        for whole in batches:
            n_bytes = pc.fill_null(pc.binary_length(whole.column(1)), 0).cast(pa.int64())
            n_tokens = [count(t) for texts in _texts([whole], 1) for t in texts]
            yield pa.RecordBatch.from_arrays([whole.column(0), n_bytes, pa.array(n_tokens, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def count(docs: DataFrame, tokenizer: str, limit: int = 2048, entries: int = ENTRIES) -> DataFrame:
    """A row for each document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than `limit` tokens). tokenizer is the path of a
    word-end vocabulary of the tokenizers library on every machine."""
    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    shared = docs.sparkSession.sparkContext.broadcast(packed(tokenizer, frequent(rows, entries)))
    return rows.mapInArrow(_count(tokenizer, shared), "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
