"""Prefetch by locality-sensitive hashing: a stored index of hashed buckets of random projections.

A vector falls on one side or the other of a plane through the origin; the sides of `bits` planes name its bucket in a table,
and there are `tables` of them with planes of their own. The planes' entries are +1 and -1 by a rule, so an index can be
read anywhere. The index has a row for each table, bucket and chunk with a vector there, laid out by table and sorted by
bucket. A query token looks into its own bucket and into those beyond the `turns` planes that it lies nearest to, 2 ** turns
buckets a table, and the chunks found there are scored exactly by their pooled vectors, then by all their tokens.

Probes come in blocks of PROBES rows of three numbers, 24 MB at most, which are broadcast; more queries mean more blocks. A bucket
that very many chunks share is spread over as many tasks as its files have. How many of the k best are found depends on the
data: near neighbours are, vectors without any need many buckets. `recall` measures it against the exact way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.operators import retrieval
from leafmark.operators.token_store import TokenStore, _kept, candidate_scores
from leafmark.plans.session import short_batches

PROBES = 1_000_000
#: The rule of the planes: s -> (s * s + 12345 * s + 7) mod (2 ** 31 - 1), three times, from 1009 * plane + dimension + 1.
STEP, ADD, MOD, STRIDE, TIMES = 12345, 7, 2**31 - 1, 1009, 3


@dataclass
class Lsh:
    """The planes of an index."""

    bits: int = 11
    tables: int = 20
    turns: int = 3

    def planes(self, dim: int) -> np.ndarray:
        """dim x (tables * bits) of +1 and -1."""
        s = (np.arange(self.tables * self.bits)[None, :] * STRIDE + np.arange(dim)[:, None] + 1).astype(np.int64)
        for _ in range(TIMES):
            s = (s * s + STEP * s + ADD) % MOD
        return np.where(s % 2 == 0, 1.0, -1.0)

    def margins(self, vectors: np.ndarray) -> np.ndarray:
        """vectors x tables x bits: how far on which side."""
        return (vectors @ self.planes(vectors.shape[1])).reshape(len(vectors), self.tables, self.bits)

    def buckets(self, margins: np.ndarray) -> np.ndarray:
        """vectors x tables."""
        return ((margins > 0) << np.arange(self.bits)).sum(2)

    def probes(self, margins: np.ndarray) -> np.ndarray:
        """vectors x tables x 2 ** turns: the own bucket and those beyond the nearest planes."""
        near = 1 << np.argsort(np.abs(margins), axis=2, kind="stable")[:, :, : self.turns]
        chosen = (np.arange(2**self.turns)[:, None] >> np.arange(near.shape[2])) & 1
        return self.buckets(margins)[:, :, None] ^ (near[:, :, None, :] * chosen).sum(3)


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _hash(lsh: Lsh, probe: bool):
    name = "query_id" if probe else "chunk_id"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                b = whole.slice(k, 1024)
                m = lsh.margins(_vectors(b.column("vec")))
                found = lsh.probes(m) if probe else lsh.buckets(m)[:, :, None]
                each = lsh.tables * found.shape[2]
                table = np.tile(np.repeat(np.arange(lsh.tables), found.shape[2]), b.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(name).to_numpy(zero_copy_only=False), each), pa.int64()), pa.array(table, pa.int64()), pa.array(found.ravel(), pa.int64())], names=[name, "tab", "bucket"])

    return run


def _hashed(rows: DataFrame, key: str, lsh: Lsh) -> DataFrame:
    """(key, tab, bucket) of the vectors of rows, those without any entry left out."""
    rows = rows.where(F.col(key).isNotNull() & (F.size("vec") > 0)).select(F.col(key).cast("long").alias(key), F.col("vec").cast("array<double>").alias("vec"))
    return rows.mapInArrow(_hash(lsh, key == "query_id"), f"{key} long, tab long, bucket long").distinct()


def write_index(pooled: DataFrame, path: str, lsh: Lsh = Lsh()) -> None:
    """The index of all of pooled(chunk_id, kind, pos, vec) below path: (tab, bucket, chunk_id)."""
    rows = _hashed(pooled, "chunk_id", lsh)
    # ranges of buckets: a table is cut into files as its rows ask for, a full bucket is cut by chunk
    rows.repartitionByRange("tab", "bucket", "chunk_id").sortWithinPartitions("tab", "bucket").write.partitionBy("tab").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("bucket long, chunk_id long, tab long").parquet(path)


def candidates(queries: DataFrame, index: DataFrame, lsh: Lsh = Lsh()) -> DataFrame:
    """(query_id, chunk_id): chunks with a pooled vector in a bucket that a token of the query looks into."""
    tokens = queries.where("vec is not null")
    most = max(1, PROBES // (lsh.tables * 2**lsh.turns))
    blocks = max(1, -(-tokens.count() // most))
    out = None
    for b in range(blocks):
        part = tokens if blocks == 1 else tokens.where(F.pmod(F.xxhash64("query_id", "tok"), F.lit(blocks)) == b)
        found = index.join(F.broadcast(_hashed(part, "query_id", lsh)), ["tab", "bucket"]).select("query_id", "chunk_id")
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def two_stage(queries: DataFrame, index: DataFrame, pooled: TokenStore, tokens: TokenStore, k: int = 10, widen: int = 10, lsh: Lsh = Lsh()) -> DataFrame:
    """retrieval.two_stage with buckets instead of the scan of all pooled vectors: (query_id, rank, chunk_id, score). The pooled
    scores of the candidates leave k * widen of each kind, and all tokens of these give the exact score."""
    with short_batches(tokens.spark):
        near = _kept(candidates(queries, index, lsh), "lsh-candidates")
        stage = [retrieval.top(candidate_scores(queries, pooled, near, kind, k * widen), k * widen).select("query_id", "chunk_id") for kind in ("mean_c", "mean_r")]
        chosen = _kept(stage[0].union(stage[1]).distinct(), "lsh-chosen")
        return _kept(retrieval.top(candidate_scores(queries, tokens, chosen, k=k), k).select("query_id", "rank", "chunk_id", "score"), "lsh-found")


def finder(index: DataFrame, lsh: Lsh = Lsh()) -> retrieval.Find:
    """two_stage as retrieval.search takes it, over an index of the stored vectors."""

    def find(queries: DataFrame, pooled: TokenStore, tokens: TokenStore, k: int) -> DataFrame:
        return two_stage(queries, index, pooled, tokens, k, lsh=lsh)

    return find


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, recall): the share of exact(query_id, chunk_id) that is among found(query_id, chunk_id)."""
    hit = exact.select("query_id", "chunk_id").join(found.select("query_id", "chunk_id").distinct().withColumn("_hit", F.lit(1)), ["query_id", "chunk_id"], "left")
    return hit.groupBy("query_id").agg((F.count("_hit") / F.count("*")).alias("recall"))
