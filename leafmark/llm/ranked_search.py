"""Ranked lexical search over K2-treaps of the term-document grid.

Index. Each task lays the documents it reads into blocks of at most BLOCK_DOCS documents or BLOCK_TERMS terms. A block is a
square grid: a row for each of its terms, the commonest first, a column for each document, the longest first, so cells
near each other hold similar impacts. The grid is halved both ways down to single cells; of every cell that is not empty the tree
keeps the largest impact below it and which of its four quadrants are not empty (levels one after another, children found by
counting bits). Maxima are stored as differences from the parent's. Blocks are rows of a table in the shared folder.

Search. A query holds, for a range of documents, the cell that each of its terms' rows has there. The sum of weight times maximum
over these cells bounds every score in the range and is the score itself where the range is one document. All row paths
descend together into the halves of the range of the highest bound; ranges that cannot reach the k-th best score are left. Scores
equal to the k-th are kept, so ties fall by doc_id. Nothing but these bounds leaves a document out: results are exact.

Every block answers all queries; queries come in batches of BATCH_BYTES, each broadcast. One block in SEEDS is searched first:
its k-th best scores are lower bounds that every other block starts from. Each block returns k rows a query at most and a window
limited before its shuffle ranks them.

Terms are maximal runs of ASCII letters and digits and of all other characters; A-Z are lower-cased. Null and empty texts
have no terms and no results, as queries neither. Repeated rows are documents of their own; of equal scores those without an id come
last. Repeated items are ranked each for itself. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from heapq import heappop, heappush, heapreplace
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmark.llm.common import dropped, stored

BLOCK_DOCS, BLOCK_TERMS = 4096, 2_000_000
#: Texts of queries that are broadcast together.
BATCH_BYTES = 8 << 20
SEEDS = 16
#: Ranges that are halved together.
TOGETHER = 64
INDEX = "block long, doc_ids array<long>, terms binary, dfs binary, masks binary, steps binary"
_TERM_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms_of(text: bytes | None) -> list[bytes]:
    """Terms of a text in UTF-8. bytes.lower() touches A-Z alone."""
    return text.translate(_TERM_BYTES).split() if text else []


def _spread(x: np.ndarray) -> np.ndarray:
    """The bits of x with a zero before each."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


_BITS = np.array([[bin(m & ((1 << q) - 1)).count("1") for q in range(4)] for m in range(16)], np.uint8)
_COUNT = np.array([bin(m).count("1") for m in range(16)], np.uint8)


def _put_steps(steps: np.ndarray) -> bytes:
    """Small numbers in a byte; those from 255 on follow whole."""
    large = steps[steps >= 255].astype("<u4")
    return len(large).to_bytes(4, "little") + large.tobytes() + np.minimum(steps, 255).astype(np.uint8).tobytes()


def _get_steps(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:4], "little")
    steps = np.frombuffer(blob, np.uint8, offset=4 + 4 * n).astype(np.uint32)
    steps[steps == 255] = np.frombuffer(blob, "<u4", n, 4)
    return steps


class Treap:
    """masks: the quadrants (2 * lower half + right half) that are not empty, of every inner cell; maxima of every cell."""

    def __init__(self, height: int, masks: np.ndarray, maxima: np.ndarray):
        self.height, self.masks, self.maxima = height, masks, maxima
        self.first = np.cumsum(_COUNT[masks], dtype=np.int32) - _COUNT[masks] + np.int32(1)  # first child

    @classmethod
    def of(cls, rows: np.ndarray, columns: np.ndarray, values: np.ndarray) -> Treap:
        """From the cells that are not empty, each once, with values from 1."""
        height = max(int(rows.max(initial=0)), int(columns.max(initial=0)), 1).bit_length()
        z = (_spread(rows) << np.uint64(1)) | _spread(columns)
        order = np.argsort(z)
        key, top = z[order], values[order].astype(np.uint32)
        masks, maxima = [], [top]
        for _ in range(height):
            up = key >> np.uint64(2)
            starts = np.flatnonzero(np.r_[True, up[1:] != up[:-1]])
            masks.append(np.bitwise_or.reduceat(np.left_shift(1, (key & np.uint64(3)).astype(np.uint8), dtype=np.uint8), starts))
            top, key = np.maximum.reduceat(top, starts), up[starts]
            maxima.append(top)
        return cls(height, np.concatenate(masks[::-1]), np.concatenate(maxima[::-1]))

    def _parents(self) -> np.ndarray:
        """The parent of every cell but the root."""
        return np.repeat(np.arange(len(self.masks)), _COUNT[self.masks])

    def pack(self) -> tuple[bytes, bytes]:
        """Masks two to a byte; maxima as differences from the parent's."""
        m = np.r_[self.masks, np.zeros(len(self.masks) % 2, np.uint8)]
        steps = np.r_[self.maxima[:1], self.maxima[self._parents()] - self.maxima[1:]]
        return len(self.masks).to_bytes(4, "little") + bytes([self.height]) + (m[::2] | (m[1::2] << 4)).tobytes(), _put_steps(steps)

    @classmethod
    def unpack(cls, masks: bytes, steps: bytes) -> Treap:
        n, both = int.from_bytes(masks[:4], "little"), np.frombuffer(masks, np.uint8, offset=5)
        out = cls(masks[4], np.stack([both & 15, both >> 4], 1).ravel()[:n], _get_steps(steps))
        parents, done = out._parents(), 1
        for _ in range(out.height):  # a level after another
            upto = len(out.maxima) if done > len(out.masks) else int(np.searchsorted(parents, done)) + 1
            out.maxima[done:upto] = out.maxima[parents[done - 1 : upto - 1]] - out.maxima[done:upto]
            done = upto
        return out

    def best(self, rows: np.ndarray, weights: np.ndarray, k: int, least: int = 1) -> list[tuple[int, int]]:
        """(score, column) of the k highest scores from `least` on, and of all others equal to the k-th."""
        if not len(rows):
            return []
        rows, weights, height = rows.astype(np.int64), weights.astype(np.int64), self.height
        tops: list[int] = []  # the k highest scores so far, lowest first
        found: list[tuple[int, int]] = []
        least = max(least, 1)
        # (-bound, serial, level, first column >> height - level, terms, cells)
        heap = [(-int(weights.sum() * int(self.maxima[0])), 0, 0, 0, np.arange(len(rows)), np.zeros(len(rows), np.int64))]
        serial = count(1)
        while heap:
            ranges = []
            while heap and len(ranges) < TOGETHER and -heap[0][0] >= least:
                bound, _, level, column, terms, cells = heappop(heap)
                if level < height:
                    ranges.append((level, column, terms, cells))
                    continue
                found.append((-bound, column))
                if len(tops) < k:
                    heappush(tops, -bound)
                elif -bound > tops[0]:
                    heapreplace(tops, -bound)
                if len(tops) == k:
                    least = max(least, tops[0])
            if not ranges:
                break
            sizes = np.array([len(r[2]) for r in ranges])
            terms, cells = np.concatenate([r[2] for r in ranges]), np.concatenate([r[3] for r in ranges])
            shift = np.repeat(np.array([height - 1 - r[0] for r in ranges]), sizes)
            of = np.repeat(np.arange(len(ranges)), sizes)
            lower = ((rows[terms] >> shift) & 1) * 2
            masks, first = self.masks[cells], self.first[cells]
            for half in (0, 1):
                quadrant = lower + half
                there = np.flatnonzero((masks >> quadrant) & 1)
                if not len(there):
                    continue
                child = first[there].astype(np.int64) + _BITS[masks[there], quadrant[there]]
                own, sub = of[there], terms[there]
                starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                bounds = np.add.reduceat(weights[sub] * self.maxima[child].astype(np.int64), starts)
                ends = np.r_[starts[1:], len(own)]
                high = np.flatnonzero(bounds >= least)
                for bound, start, end, i in zip(bounds[high].tolist(), starts[high].tolist(), ends[high].tolist(), own[starts[high]].tolist()):
                    level, column, _, _ = ranges[i]
                    heappush(heap, (-bound, next(serial), level + 1, 2 * column + half, sub[start:end], child[start:end]))
        return [x for x in found if x[0] >= least]


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs = terms = 0
    for b in batches:
        for text in b.column(0):
            n = len(terms_of(text.as_py()))
            docs, terms = docs + (n > 0), terms + n
    yield pa.RecordBatch.from_arrays([pa.array([docs], pa.int64()), pa.array([terms], pa.int64())], names=["docs", "terms"])


def totals(docs: DataFrame) -> tuple[int, int]:
    """N documents with a term, and L, all their terms."""
    rows = docs.select(F.col("text").cast("binary")).mapInArrow(_totals, "docs long, terms long")
    return tuple(int(v or 0) for v in rows.agg(F.sum("docs"), F.sum("terms")).first())


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def _build(n: int, total: int, block_docs: int, block_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = count(TaskContext.get().partitionId() << 32)
        docs: list[int | None] = []
        known: defaultdict[bytes, int] = defaultdict(count().__next__)
        ids: list[np.ndarray] = []
        held = 0

        def block() -> pa.RecordBatch:
            nonlocal docs, known, ids, held
            sizes = np.array([len(x) for x in ids], np.int64)
            order = np.argsort(-sizes, kind="stable")
            column = np.empty(len(order), np.int64)
            column[order] = np.arange(len(order))
            cell, tf = np.unique((np.repeat(column, sizes) << 32) | np.concatenate(ids), return_counts=True)
            columns, local = cell >> 32, cell & 0xFFFFFFFF
            df = np.bincount(local, minlength=len(known))
            by = np.argsort(-df, kind="stable")
            row = np.empty(len(by), np.int64)
            row[by] = np.arange(len(by))
            m = np.array([75 + 25 * size * n // total for size in sizes[order].tolist()], np.int64)
            values = impact(tf, m[columns])
            some = values > 0
            masks, steps = Treap.of(row[local][some], columns[some], values[some]).pack() if some.any() else (b"", b"")
            names = list(known)
            out = [next(serial)], [[docs[i] for i in order]], [b" ".join(names[i] for i in by)], [df[by].astype("<u4").tobytes()], [masks], [steps]
            docs, known, ids, held = [], defaultdict(count().__next__), [], 0
            kinds = pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.binary()
            return pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(out, kinds)], names=[c.split()[0] for c in INDEX.split(", ")])

        for b in batches:
            for doc, text in zip(b.column(0), b.column(1)):
                if not (found := terms_of(text.as_py())):
                    continue
                if docs and (len(docs) >= block_docs or held + len(found) > block_terms):
                    yield block()
                docs.append(doc.as_py())
                ids.append(np.fromiter(map(known.__getitem__, found), np.int64, len(found)))
                held += len(found)
        if docs:
            yield block()

    return run


def build(docs: DataFrame, n: int, total: int, block_docs: int = BLOCK_DOCS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """The index of docs(doc_id, text), a row for each block; n and total are totals() of the whole collection."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(_build(n, total, block_docs, block_terms), INDEX)


def _frequencies(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        df = np.zeros(len(wanted), np.int64)
        for b in batches:
            for terms, dfs in zip(b.column(0), b.column(1)):
                own = np.frombuffer(dfs.as_py(), "<u4")
                for row, term in enumerate(terms.as_py().split(b" ")):
                    if (i := wanted.get(term)) is not None:
                        df[i] += own[row]
        there = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(df[there], pa.int64())], names=["i", "df"])

    return run


def _search(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value  # (key, terms, weights, least)
        for b in batches:
            for docs, terms, masks, steps in zip(*(b.column(c) for c in ("doc_ids", "terms", "masks", "steps"))):
                if not (blob := masks.as_py()):
                    continue
                rows = {t: i for i, t in enumerate(terms.as_py().split(b" "))}
                treap, ids, out = Treap.unpack(blob, steps.as_py()), docs.as_py(), []
                for key, names, weights, least in queries:
                    held = [(rows[t], w) for t, w in zip(names, weights) if t in rows]
                    held = np.array(held, np.int64).reshape(-1, 2)
                    best = sorted(((-s, ids[c] is None, ids[c] or 0) for s, c in treap.best(held[:, 0], held[:, 1], k, least)))[:k]
                    out += [(key, None if none else doc, -s) for s, none, doc in best]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out) if out else ([], [], []))], names=["key", "doc_id", "score"])

    return run


def _top(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(index: DataFrame, queries: DataFrame, n: int, k: int = 20, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """queries(item_id, text) over a stored index of n documents: item_id, rank (from 1), doc_id, score."""
    spark = index.sparkSession
    items = stored(queries.select(F.monotonically_increasing_id().alias("key"), "item_id", F.col("text").cast("binary").alias("text")), "search-items")
    batches = -(-int(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // batch_bytes)
    out = []
    for batch in range(batches):
        texts = items.where(F.pmod(F.xxhash64("key"), F.lit(batches)) == batch).select("key", "text").collect()  # batch_bytes, about
        tallies = [(r.key, Counter(terms_of(bytes(r.text)))) for r in texts if r.text]
        wanted = {t: i for i, t in enumerate(sorted({t for _, tally in tallies for t in tally}))}
        counted = index.select("terms", "dfs").mapInArrow(_frequencies(spark.sparkContext.broadcast(wanted)), "i long, df long").groupBy("i").agg(F.sum("df").alias("df"))
        df = {r.i: r.df for r in counted.collect()}  # a row for each term of the batch
        known = [(key, [t for t in tally if wanted[t] in df], tally) for key, tally in tallies]
        asked = [(key, names, [tally[t] * weight(n, df[wanted[t]]) for t in names]) for key, names, tally in known if names]

        def found(blocks: DataFrame, least: dict[int, int]) -> DataFrame:
            shared = spark.sparkContext.broadcast([(key, names, weights, least.get(key, 1)) for key, names, weights in asked])
            return stored(blocks.select("doc_ids", "terms", "masks", "steps").mapInArrow(_search(shared, k), "key long, doc_id long, score long"), "search-found")

        seed = F.pmod(F.xxhash64("block"), F.lit(SEEDS)) == 0
        seeds = found(index.where(seed), {})
        least = {r.key: r.score for r in _top(seeds, k).where(F.col("rank") == k).select("key", "score").collect()}  # a row a query
        out += [seeds, found(index.where(~seed), least)]
    if not out:
        return spark.createDataFrame([], f"item_id {queries.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    both = out[0]
    for more in out[1:]:
        both = both.unionByName(more)
    # k rows a query from each block, cut to k a task before they are shuffled
    return _top(both, k).join(items.select("key", "item_id"), "key").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def ranked(docs: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """Builds the index of docs and answers all queries: the k highest-scoring documents of each."""
    n, total = totals(docs)
    index = stored(build(docs, n, total), "search-index")
    out = stored(search(index, queries, n, k), "search")
    dropped(index)
    return out
