"""A stored layout of chunk vectors, MaxSim over it, and reads of candidates alone.

A row is a chunk with all its vectors in order, so a score never leaves the task that reads the chunk. Rows lie in folders by
kind and by range of chunk id (`part` = chunk_id div span), sorted by chunk_id in row groups of a sixteenth of a folder. The
span is chosen so that a folder holds about FOLDER_BYTES, and is kept beside the table.

Scores are those of `products`. Chunks without vectors score nothing, as do queries without tokens. Vectors of a chunk must be of one length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.operators import products, retrieval
from leafmark.operators.products import BLOCK_TOKENS
from leafmark.plans.session import scratch_dir, short_batches

FOLDER_BYTES = 128 << 20
#: Row groups of a folder.
PIECES = 16
#: Runs of chunk ids that a scan is given as filters; beyond it so many folders by number, and beyond that a join.
RUNS, FOLDERS = 256, 10_000


@dataclass
class TokenStore:
    """Where a layout is, how many chunk ids share a folder, and whether it is dealt by kind."""

    spark: SparkSession
    path: str
    span: int
    kinds: bool

    @property
    def piece(self) -> int:
        return max(1, self.span // PIECES)

    def rows(self) -> DataFrame:
        """chunk_id, vecs (arrays of vectors), part and, where dealt so, kind."""
        kind = ", kind string" if self.kinds else ""
        return self.spark.read.schema(f"chunk_id long, vecs array<array<double>>{kind}, part long").parquet(f"{self.path}/rows")

    def of(self, chunk_ids: DataFrame) -> DataFrame:
        """Rows of chunk_ids(chunk_id) and few others; folders and row groups without any of them are not read. Up to RUNS runs
        go into the scan as filters, on the folder and on the range of ids within it; of more, the folders do."""
        pieces = chunk_ids.select("chunk_id", _div("chunk_id", self.span).alias("part")).groupBy("part", _div("chunk_id", self.piece).alias("piece")).agg(F.min("chunk_id").alias("low"), F.max("chunk_id").alias("high"))
        runs = pieces.limit(RUNS + 1).collect()
        if len(runs) <= RUNS:
            near = F.lit(False)
            for r in runs:
                near = near | ((F.col("part") == r.part) & F.col("chunk_id").between(r.low, r.high))
            return self.rows().where(near)
        folders = pieces.select("part").distinct()
        parts = [r.part for r in folders.limit(FOLDERS + 1).collect()]
        return self.rows().where(F.col("part").isin(parts)) if len(parts) <= FOLDERS else self.rows().join(folders, "part", "left_semi")


def _div(name: str, by: int) -> Column:
    """Whole numbers divided, rounding down."""
    return F.expr(f"({name} - pmod({name}, {by})) div {by}")


def write(tokens: DataFrame, path: str, folder_bytes: int = FOLDER_BYTES, span: int | None = None) -> TokenStore:
    """Lays out tokens(chunk_id, tok, vec), or pooled vectors (chunk_id, kind, pos, vec), below path."""
    spark, kinds = tokens.sparkSession, "kind" in tokens.columns
    place = "pos" if "pos" in tokens.columns else "tok"
    if span is None:
        size, least, most = tokens.agg(F.sum(F.size("vec").cast("long") * 8), F.min("chunk_id"), F.max("chunk_id")).first()
        span = max(1, int(folder_bytes * (most - least + 1) // max(size or 0, 1))) if size else 1
    keys = ["chunk_id", *(["kind"] if kinds else [])]
    vec = F.col("vec").cast("array<double>")
    # the tokens of a chunk are as many as its picture has, some thousands
    rows = tokens.where("vec is not null and chunk_id is not null").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(place).alias("tok"), vec.alias("vec")))).alias("t"))
    store = TokenStore(spark, path, span, kinds)
    folders = [*(["kind"] if kinds else []), "part"]
    rows = rows.select("chunk_id", F.col("t.vec").alias("vecs"), *keys[1:], _div("chunk_id", span).alias("part"))
    out = rows.repartition(*folders).sortWithinPartitions(*folders, "chunk_id").write.partitionBy(*folders)
    out.option("parquet.block.row.count.limit", str(store.piece)).parquet(f"{path}/rows")
    spark.createDataFrame([(span, kinds)], "span long, kinds boolean").coalesce(1).write.parquet(f"{path}/layout")
    return store


def read(spark: SparkSession, path: str) -> TokenStore:
    """What write() laid out."""
    r = spark.read.schema("span long, kinds boolean").parquet(f"{path}/layout").first()
    return TokenStore(spark, path, r.span, r.kinds)


def _with_vectors(queries: DataFrame) -> DataFrame:
    return queries.where("vec is not null and query_id is not null")


def block_scores(queries: DataFrame, rows: DataFrame, k: int | None = None, block: int = BLOCK_TOKENS) -> DataFrame:
    """(query_id, chunk_id, score) of every query against every chunk of rows (TokenStore.rows, of one kind). With k, a task gives
    back the k best of what it has read for each query; the k best of all are among them."""
    return products.united(rows, [products.scores(q, rows, k) for q in products.query_blocks(_with_vectors(queries), block)])


def candidate_scores(queries: DataFrame, store: TokenStore, candidates: DataFrame, kind: str | None = None, k: int | None = None, block: int = BLOCK_TOKENS) -> DataFrame:
    """(query_id, chunk_id, score) of candidates(query_id, chunk_id), which are read twice and had best be stored. Only folders
    and row groups that hold one are read; a chunk comes to a task once, with the queries that ask for it.
    With k, a task gives back the k best of each query as in block_scores."""
    parts = []
    for q in products.query_blocks(_with_vectors(queries), block):
        wanted = products.asked(q, candidates)
        rows = store.of(wanted.select("chunk_id"))
        parts.append(products.asked_scores(q, rows if kind is None else rows.where(F.col("kind") == kind), wanted, k))
    return products.united(store.rows(), parts)


def nearest_tokens(queries: DataFrame, rows: DataFrame, k: int, block: int = BLOCK_TOKENS) -> DataFrame:
    """(query_id, part, chunk_id, doc_tok, s): for each query token (part) the k nearest document tokens, doc_tok their place in the
    chunk. A task gives back the k best of what it has read; equal to nine places they fall by chunk and place."""
    found = [retrieval.nearest_of_each(products.nearest(q, rows, k), k) for q in products.query_blocks(_with_vectors(queries), block)]
    return products.united(rows, found, products.TOKENS)


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def token_level(queries: DataFrame, tokens: TokenStore, k: int = 10, widen: int = 5) -> DataFrame:
    """retrieval.token_level over a stored layout: the k * widen nearest tokens of every query token name the candidates, of which
    all tokens are read and no others."""
    with short_batches(tokens.spark):
        near = _kept(nearest_tokens(queries, tokens.rows(), k * widen).select("query_id", "chunk_id").distinct(), "near")
        return _kept(retrieval.top(candidate_scores(queries, tokens, near, k=k), k).select("query_id", "rank", "chunk_id", "score"), "found")


def two_stage(queries: DataFrame, pooled: TokenStore, tokens: TokenStore, k: int = 10, widen: int = 10) -> DataFrame:
    """retrieval.two_stage over stored layouts: matrix products against all pooled vectors, k * widen of each kind by task, then the
    tokens of these chunks and of no others are read."""
    with short_batches(tokens.spark):
        stage = [retrieval.top(block_scores(queries, pooled.rows().where(F.col("kind") == kind), k * widen), k * widen).select("query_id", "chunk_id") for kind in ("mean_c", "mean_r")]
        chosen = _kept(stage[0].union(stage[1]).distinct(), "chosen")
        return _kept(retrieval.top(candidate_scores(queries, tokens, chosen, k=k), k).select("query_id", "rank", "chunk_id", "score"), "found")
