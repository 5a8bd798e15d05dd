"""MaxSim by matrix products: rows are chunks with all their vectors, queries come in blocks that are sent to the tasks.

A block of queries is one matrix of about BLOCK_TOKENS rows; more queries mean more blocks. A task multiplies the chunks that it
reads by the matrix, a few at a time, and gives back all scores or the k best of each query, never scores of single tokens.
Ids are whole numbers; null ids are kept. A vector that is null, holds null or is not as long as the queries' has no product;
where no token of a chunk or of a query has one, the score is null and comes last, as in SQL. NaN comes first. Vectors of queries must
be of one length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmark.plans.session import ship_package

#: Query tokens that go to the tasks at once.
BLOCK_TOKENS = 20_000
#: Chunks, document tokens and query tokens of one matrix product.
SLICE_CHUNKS, SLICE_TOKENS, SLICE_QUERY = 256, 4096, 512
#: Queries that a row of a chunk is asked by at most, about; more are several rows.
ASKED = 512
#: Scores this close may be equal to nine places.
NEAR = 2e-9
#: Best tokens of chunks for the tokens of a block that a task holds at once (16 MB), and rows of asked chunks that it takes apart at once.
GRID, ASKED_ROWS = 1 << 21, 1024
#: Rows that a task holds before it keeps the best of them alone.
HELD = 1 << 18
#: Stands for a null id inside.
NONE = -(2**63)
SCORES = "query_id long, chunk_id long, score double"
TOKENS = "query_id long, part long, chunk_id long, doc_tok long, s double"


def gathered(tokens: DataFrame) -> DataFrame:
    """(chunk_id, vecs) from tokens(chunk_id, tok, vec): the vectors of a chunk in order, null ones among them."""
    rows = tokens.groupBy(F.coalesce(F.col("chunk_id").cast("long"), F.lit(NONE)).alias("chunk_id"))
    # the tokens of a chunk are as many as its picture has, some thousands
    return rows.agg(F.array_sort(F.collect_list(F.struct("tok", "vec"))).alias("t")).select("chunk_id", F.col("t.vec").alias("vecs"))


@dataclass
class Queries:
    """A block of queries: ids, ascending, the row each begins at, all their tokens as a matrix, and which of these have a product."""

    ids: np.ndarray
    starts: np.ndarray
    matrix: np.ndarray
    ok: np.ndarray

    @property
    def ends(self) -> np.ndarray:
        return np.r_[self.starts[1:], len(self.matrix)]

    @property
    def filled(self) -> np.ndarray:
        return np.logical_or.reduceat(self.ok, self.starts)


def _sizes(lists: pa.Array) -> np.ndarray:
    return lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)


def _matrix(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, and which of them are whole and of that length; the others are zeros."""
    values = vectors.flatten()
    if not vectors.null_count and not values.null_count and (_sizes(vectors) == dim).all():
        return values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(vectors), dim), np.ones(len(vectors), bool)
    out, ok = np.zeros((len(vectors), dim)), np.zeros(len(vectors), bool)
    for i, v in enumerate(vectors.to_pylist()):
        if v is not None and len(v) == dim and None not in v:
            out[i], ok[i] = v, True
    return out, ok


def query_blocks(queries: DataFrame, most: int = BLOCK_TOKENS) -> Iterator[Queries]:
    """queries(query_id, tok, vec) in blocks that come to the driver one at a time."""
    rows = queries.select(F.coalesce(F.col("query_id").cast("long"), F.lit(NONE)).alias("query_id"), "tok", "vec")
    blocks = max(1, -(-rows.count() // most))
    for b in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        got = part.orderBy("query_id", "tok").toArrow().combine_chunks()  # `most` tokens, about
        if got.num_rows:
            vectors = pa.concat_arrays(got.column("vec").chunks)
            whole = vectors.drop_null()
            # one of them that is null in part is as long as the others
            lengths = np.unique(_sizes(whole))
            if len(lengths) > 1:
                raise ValueError("vectors of queries must be of one length")
            ids, starts = np.unique(got.column("query_id").to_numpy(), return_index=True)
            yield Queries(ids, starts, *_matrix(vectors, int(lengths[0]) if len(lengths) else 0))


def _slices(b: pa.RecordBatch, dim: int, most: int = SLICE_CHUNKS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Chunk ids, all their vectors, which of these have a product, the row each chunk begins at and the batch's rows they are, a
    few chunks (`most`) at a time."""
    vecs = b.column("vecs")
    sizes = _sizes(vecs)
    at, n = 0, len(sizes)
    while at < n:
        inside = np.cumsum(sizes[at : at + most]) <= SLICE_TOKENS
        end = at + max(1, int(inside.sum()))
        part = vecs.slice(at, end - at).flatten()
        if len(part):
            d, ok = _matrix(part, dim)
            some = np.flatnonzero(sizes[at:end])
            starts = np.r_[0, np.cumsum(sizes[at:end])[:-1]][some]
            yield b.column("chunk_id").slice(at, end - at).to_numpy(zero_copy_only=False)[some], d, ok, starts, some + at
        at = end


def _products(d: np.ndarray, ok: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Document tokens x query tokens; those without a product are the least."""
    out = d @ matrix.T
    if not ok.all():
        out[~ok] = -np.inf
    return out


def _against(d: np.ndarray, ok: np.ndarray, starts: np.ndarray, q: Queries) -> tuple[np.ndarray, np.ndarray]:
    """Scores, chunks x queries: the best token of a chunk for each query token, summed over the query; and which are null."""
    best = np.empty((len(starts), len(q.matrix)))
    sizes = np.diff(np.r_[starts, len(d)])
    even = int(sizes[0]) if (sizes == sizes[0]).all() else 0
    for k in range(0, len(q.matrix), SLICE_QUERY):
        x = _products(d, ok, q.matrix[k : k + SLICE_QUERY])
        best[:, k : k + SLICE_QUERY] = x.reshape(len(starts), even, x.shape[1]).max(1) if even else np.maximum.reduceat(x, starts, axis=0)
    best[:, ~q.ok] = 0
    s = np.add.reduceat(best, q.starts, axis=1)
    null = ~np.logical_or.reduceat(ok, starts)[:, None] | ~q.filled
    s[null] = -np.inf
    return s, null


class _Best:
    """The k best of each of n rows, equal to nine places by their labels; null ones (-inf and marked) last, NaN first."""

    def __init__(self, n: int, k: int):
        self.k, self.least, self.held = k, np.full(n, -np.inf), 0
        self.most = max(HELD, 2 * k * n)
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, row: np.ndarray, s: np.ndarray, null: np.ndarray, *labels: np.ndarray) -> None:
        self.parts.append((row, s, null, *labels))
        self.held += len(row)
        if self.held > self.most:
            self.shrink()

    def add_grid(self, at: int, s: np.ndarray, null: np.ndarray, *labels: np.ndarray) -> None:
        """Scores of rows from `at` on, with labels for the columns. What cannot be among the best is left out at once."""
        least, wide = self.least[at : at + len(s)], s.shape[1]
        if wide > self.k and (new := np.isinf(least)).any():
            least[new] = np.fmax(least[new], np.partition(s[new], wide - self.k, axis=1)[:, wide - self.k])
        row, col = np.nonzero(~(s < (least - NEAR)[:, None]))
        if len(row):
            self.add(row + at, s[row, col], np.broadcast_to(null, s.shape)[row, col], *(x[col] for x in labels))

    def shrink(self) -> tuple[np.ndarray, ...]:
        row, s, null, *labels = (np.concatenate(x) for x in zip(*self.parts))
        nan = np.isnan(s)
        order = np.lexsort((*labels[::-1], -np.round(np.where(nan, 0, s), 9), ~nan, null, row))
        place = np.arange(len(row)) - np.searchsorted(row[order], row[order])
        last = order[place == self.k - 1]
        self.least[row[last]] = np.fmax(self.least[row[last]], s[last])
        order = order[place < self.k]
        self.parts = [tuple(x[order] for x in (row, s, null, *labels))]
        self.held = len(order)
        return self.parts[0]


def _rows(query_id: np.ndarray, chunk_id: np.ndarray, score: np.ndarray, null: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(query_id, pa.int64(), mask=query_id == NONE), pa.array(chunk_id, pa.int64(), mask=chunk_id == NONE), pa.array(score, pa.float64(), mask=null)]
    return pa.RecordBatch.from_arrays(columns, names=["query_id", "chunk_id", "score"])


Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _score_all(shared, k: int | None) -> Task:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Queries = shared.value
        best = None if k is None else _Best(len(q.ids), k)
        most = min(SLICE_CHUNKS, max(1, GRID // max(len(q.matrix), 1)))
        for b in batches:
            for chunks, d, ok, starts, _ in _slices(b, q.matrix.shape[1], most):
                s, null = _against(d, ok, starts, q)
                if best is None:
                    yield _rows(np.tile(q.ids, len(chunks)), np.repeat(chunks, len(q.ids)), s.ravel(), null.ravel())
                else:
                    best.add_grid(0, np.ascontiguousarray(s.T), null.T, chunks)
        if best is not None and best.parts:
            row, s, null, chunk = best.shrink()
            yield _rows(q.ids[row], chunk, s, null)

    return run


def _score_asked(shared, k: int | None) -> Task:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Queries = shared.value
        ends, filled = q.ends, q.filled
        best = _Best(len(q.ids), k or 1)
        for b in (whole.slice(at, ASKED_ROWS) for whole in batches for at in range(0, whole.num_rows, ASKED_ROWS)):
            asked = b.column("asked")
            at = np.r_[0, np.cumsum(_sizes(asked))]
            wanted = np.searchsorted(q.ids, asked.flatten().to_numpy(zero_copy_only=False))
            for chunks, d, ok, starts, rows in _slices(b, q.matrix.shape[1]):
                for chunk, start, end, row in zip(chunks, starts, np.r_[starts[1:], len(d)], rows):
                    own = np.unique(wanted[at[row] : at[row + 1]])
                    sizes = ends[own] - q.starts[own]
                    first = np.r_[0, np.cumsum(sizes)[:-1]]
                    which = np.repeat(q.starts[own] - first, sizes) + np.arange(sizes.sum())
                    top = _products(d[start:end], ok[start:end], q.matrix[which]).max(0)
                    top[~q.ok[which]] = 0
                    s, null = np.add.reduceat(top, first), ~filled[own] | (not ok[start:end].any())
                    s[null] = -np.inf
                    best.parts.append((own, s, null, np.full(len(own), chunk)))
                    best.held += len(own)
                    if best.held > best.most:
                        if k is None:
                            yield _told(q, best)
                        else:
                            best.shrink()
        if best.parts:
            if k is not None:
                best.shrink()
            yield _told(q, best)

    return run


def _told(q: Queries, best: _Best) -> pa.RecordBatch:
    """All that is held, which is given back and forgotten."""
    row, s, null, chunk = (np.concatenate(x) for x in zip(*best.parts))
    best.parts, best.held = [], 0
    return _rows(q.ids[row], chunk, s, null)


def _nearest(shared, k: int) -> Task:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Queries = shared.value
        best = _Best(len(q.matrix), k)
        for b in batches:
            for chunks, d, ok, starts, _ in _slices(b, q.matrix.shape[1]):
                sizes = np.diff(np.r_[starts, len(d)])
                own, place = np.repeat(chunks, sizes), np.arange(len(d)) - np.repeat(starts, sizes)
                for at in range(0, len(q.matrix), SLICE_QUERY):
                    s = q.matrix[at : at + SLICE_QUERY] @ d.T
                    null = ~q.ok[at : at + SLICE_QUERY, None] | ~ok
                    if null.any():
                        s[null] = -np.inf
                    best.add_grid(at, s, null, own, place)
        if best.parts:
            part, s, null, chunk, tok = best.shrink()
            query = np.repeat(q.ids, q.ends - q.starts)[part]
            columns = [pa.array(query, mask=query == NONE), pa.array(part, pa.int64()), pa.array(chunk, pa.int64(), mask=chunk == NONE), pa.array(tok, pa.int64()), pa.array(s, mask=null)]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "part", "chunk_id", "doc_tok", "s"])

    return run


def _mapped(rows: DataFrame, q: Queries, task: Callable[..., Task], k: int | None, schema: str) -> DataFrame:
    return rows.mapInArrow(task(ship_package(rows.sparkSession).sparkContext.broadcast(q), k), schema)


def scores(q: Queries, rows: DataFrame, k: int | None = None) -> DataFrame:
    """(query_id, chunk_id, score) of a block's queries against every chunk of rows(chunk_id, vecs). With k, a task gives back the k
    best of what it has read for each query; the k best of all are among them."""
    return _mapped(rows.select("chunk_id", "vecs"), q, _score_all, k, SCORES)


def asked(q: Queries, candidates: DataFrame) -> DataFrame:
    """(chunk_id, asked): the queries of the block that ask for a chunk, by candidates(query_id, chunk_id). A chunk that very many ask
    for has several rows, so that a row stays short."""
    ids = candidates.sparkSession.createDataFrame([(int(i),) for i in q.ids], "query_id long")
    own = candidates.select("query_id", "chunk_id").join(F.broadcast(ids), "query_id")  # a row for each query of a block
    pieces = -(-len(q.ids) // ASKED)
    by = ["chunk_id", F.pmod(F.xxhash64("query_id"), F.lit(pieces)).alias("_piece")]
    return own.groupBy(*by).agg(F.collect_set("query_id").alias("asked")).select("chunk_id", "asked")


def asked_scores(q: Queries, rows: DataFrame, wanted: DataFrame, k: int | None = None) -> DataFrame:
    """(query_id, chunk_id, score) of the pairs of wanted, which asked() makes; with k as in scores()."""
    return _mapped(rows.join(wanted, "chunk_id").select("chunk_id", "vecs", "asked"), q, _score_asked, k, SCORES)


def nearest(q: Queries, rows: DataFrame, k: int) -> DataFrame:
    """(query_id, part, chunk_id, doc_tok, s): the k nearest document tokens of each query token (part) among those that a task has
    read, doc_tok their place in the chunk. Equal to nine places they fall by chunk and place."""
    return _mapped(rows.select("chunk_id", "vecs"), q, _nearest, k, TOKENS)


def united(like: DataFrame, parts: list[DataFrame], schema: str = SCORES) -> DataFrame:
    if not parts:
        return like.sparkSession.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
