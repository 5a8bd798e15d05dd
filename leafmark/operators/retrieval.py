"""Late-interaction retrieval for batches of queries, and what is built from its results.

Queries are a batch of known size: their tokens are sent only up to a stated number and are otherwise dealt in blocks of queries,
each block with the scan of the documents. Scores are matrix products where a chunk's vectors are (`products`).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmark.operators import products
from leafmark.operators.products import BLOCK_TOKENS
from leafmark.operators.rollups import by_number
from leafmark.operators.sections import NONAME

#: (queries, pooled, tokens, k) -> (query_id, rank, chunk_id, score)
Find = Callable[..., DataFrame]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _query_blocks(queries: DataFrame, most: int) -> list[DataFrame]:
    n = queries.count()
    blocks = max(1, -(-n // most))
    return [queries] if blocks == 1 else [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) for b in range(blocks)]


def token_scores(queries: DataFrame, tokens: DataFrame, block: int = BLOCK_TOKENS) -> DataFrame:
    """(query_id, tok, chunk_id, doc_tok, s): every query token against every document token."""
    d = tokens.select("chunk_id", F.col("tok").alias("doc_tok"), F.col("vec").alias("dv"))
    parts = [d.crossJoin(F.broadcast(q.select("query_id", "tok", F.col("vec").alias("qv")))) for q in _query_blocks(queries, block)]
    return reduce(DataFrame.unionByName, parts).select("query_id", "tok", "chunk_id", "doc_tok", dot(F.col("dv"), F.col("qv")).alias("s"))


def max_sim(queries: DataFrame, tokens: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, score): sum over query tokens of the best document token. candidates(query_id, chunk_id) limits the pairs."""
    rows, blocks = products.gathered(tokens), products.query_blocks(queries)
    return products.united(rows, [products.scores(q, rows) if candidates is None else products.asked_scores(q, rows, products.asked(q, candidates)) for q in blocks])


def top(scores: DataFrame, k: int) -> DataFrame:
    """The k best of each query, rank from 1; scores equal to nine places fall by chunk_id."""
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "chunk_id")
    return scores.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def two_stage(queries: DataFrame, pooled: DataFrame, tokens: DataFrame, k: int = 10, widen: int = 10) -> DataFrame:
    """(query_id, rank, chunk_id, score): k * widen chunks by each pooled kind, then all tokens of the union of these."""
    rows, parts = products.gathered(tokens), []
    kinds = [products.gathered(pooled.where(F.col("kind") == kind).select("chunk_id", F.col("pos").alias("tok"), "vec")) for kind in ("mean_c", "mean_r")]
    for q in products.query_blocks(queries):
        stage = [top(products.scores(q, kind, k * widen), k * widen).select("query_id", "chunk_id") for kind in kinds]
        parts.append(products.asked_scores(q, rows, products.asked(q, stage[0].union(stage[1])), k))
    return top(products.united(rows, parts), k).select("query_id", "rank", "chunk_id", "score")


def nearest_of_each(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of products.nearest for each query token."""
    w = Window.partitionBy("query_id", "part").orderBy(F.round("s", 9).desc(), "chunk_id", "doc_tok")
    return found.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def token_level(queries: DataFrame, tokens: DataFrame, k: int = 10, widen: int = 5) -> DataFrame:
    """(query_id, rank, chunk_id, score): the k * widen nearest document tokens of every query token name the candidates."""
    rows, parts = products.gathered(tokens), []
    for q in products.query_blocks(queries):
        near = nearest_of_each(products.nearest(q, rows, k * widen), k * widen)
        parts.append(products.asked_scores(q, rows, products.asked(q, near), k))
    return top(products.united(rows, parts), k).select("query_id", "rank", "chunk_id", "score")


def by_title(chunks: DataFrame, title: str = NONAME, limit: int = 10) -> DataFrame:
    """Chunks with that very title, `limit` of each collection by chunk_id."""
    w = Window.partitionBy("collection").orderBy("chunk_id")
    return chunks.where(F.col("section_title") == title).withColumn("rn", F.row_number().over(w).cast("long")).where(F.col("rn") <= limit)


def outline_search(sections: DataFrame, text: str) -> DataFrame:
    """Sections whose title holds the text, whatever its case; blank text finds all."""
    return sections.where(F.lower("title").contains(text.strip().lower())) if text.strip() else sections


#: What a result shows of its chunk: Spark type, and the default where the chunk has no such value.
FIELDS = {
    "section_title": ("string", "''"), "formulas": ("array<struct<content:string,coordinate:array<bigint>,page:bigint>>", "array()"), "section_pages": ("array<string>", "array()"),
    "ancestors": ("array<string>", "array()"), "metadata": ("map<string,string>", "map()"), "image_path": ("string", "''"),
}


def results(found: DataFrame, chunks: DataFrame, k: int, images: DataFrame | None = None, chunk_images: DataFrame | None = None) -> DataFrame:
    """query_id, results (array of structs in rank order), total_results. A result has rank, chunk_id, score, collection and the
    fields above, with defaults for what chunks do not have, and where they are asked for image_base64, by images(image_path, uri),
    null without an image, and chunk_images, by chunk_images(chunk_id, uris)."""
    found = found.where(F.col("rank") <= k)
    # only chunks that were found are joined with images
    j = found.join(chunks.select("chunk_id", *[c for c in ("collection", *FIELDS) if c in chunks.columns]), "chunk_id", "left")
    item = ["rank", "chunk_id", F.round("score", 6).alias("score"), (F.coalesce("collection", F.lit("")) if "collection" in chunks.columns else F.lit("")).alias("collection")]
    for c, (kind, default) in FIELDS.items():
        none = F.expr(default).cast(kind)
        item.append((F.coalesce(F.col(c).cast(kind), none) if c in chunks.columns else none).alias(c))
    if images is not None:
        j = j.join(images.select("image_path", F.col("uri").alias("image_base64")), "image_path", "left")
        item.append(F.when(F.coalesce("image_path", F.lit("")) != "", F.col("image_base64")).alias("image_base64"))
    if chunk_images is not None:
        j = j.join(chunk_images.select("chunk_id", "uris"), "chunk_id", "left")
        item.append(F.coalesce("uris", F.array().cast("array<string>")).alias("chunk_images"))
    # k structs at most
    out = j.groupBy("query_id").agg(F.collect_list(F.struct(*item)).alias("l"))
    return out.select("query_id", by_number(F.col("l"), "rank").alias("results"), F.size("l").cast("long").alias("total_results"))


def search(queries: DataFrame, pooled, tokens, chunks: DataFrame, k: int = 5, images: DataFrame | None = None, chunk_images: DataFrame | None = None, find: Find = two_stage) -> DataFrame:
    """The whole search of a batch: two stages, then results(). k is 1 to 100 (20 for questions to an assistant). find looks for the
    chunks: two_stage in tables of vectors, token_store.two_stage in stored layouts, lsh.finder in these behind an index."""
    if not 1 <= k <= 100:
        raise ValueError("k must be from 1 to 100")
    return results(find(queries, pooled, tokens, k), chunks, k, images, chunk_images)


def search_by_title(chunks: DataFrame, title: str = NONAME, limit: int = 10) -> DataFrame:
    """by_title with the bounds of a request: limit is 1 to 1000."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be from 1 to 1000")
    return by_title(chunks, title, limit)


def metadata_of(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    return chunks.join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")


def previews(chunks: DataFrame, limit: int = 20) -> DataFrame:
    """Nameless chunks with an image, `limit` of each collection."""
    return by_title(chunks.where(F.coalesce("image_path", F.lit("")) != ""), NONAME, limit)


def anchored_query(replies: DataFrame) -> DataFrame:
    """query_id, rewritten (null without a tag), search_text: the question, with what the reply's first <query> tag holds."""
    tag = r"(?s)<query>(.*?)</query>"
    rewritten = F.when(F.col("reply").rlike(tag), F.regexp_replace(F.regexp_extract("reply", tag, 1), r"^\s+|\s+$", ""))
    return replies.select("query_id", "question", rewritten.alias("rewritten"), F.when(rewritten.isNotNull(), F.concat("question", F.lit("("), rewritten, F.lit(")"))).otherwise(F.col("question")).alias("search_text"))


def assemble_context(questions: DataFrame, queries: DataFrame, pooled, tokens, chunks: DataFrame, k: int = 5, find: Find = two_stage) -> DataFrame:
    """What an assistant is given for each of questions(query_id): a search of k chunks, as in search(), and contexts of what it
    found. k is 1 to 20."""
    if not 1 <= k <= 20:
        raise ValueError("k must be from 1 to 20")
    return contexts(questions, find(queries, pooled, tokens, k), chunks, k)


def contexts(questions: DataFrame, found: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """query_id, chunk_ids and image_paths (those not empty) in rank order, found; a row for every question."""
    r = found.where(F.col("rank") <= k).join(chunks.select("chunk_id", "image_path"), "chunk_id", "left")
    got = r.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", F.coalesce("image_path", F.lit("")).alias("p")))).alias("l"))  # k structs at most
    out = questions.select("query_id").distinct().join(got, "query_id", "left")
    ids = F.coalesce(F.col("l.chunk_id"), F.array().cast("array<bigint>"))
    paths = F.coalesce(F.filter(F.col("l.p"), lambda p: p != ""), F.array().cast("array<string>"))
    return out.select("query_id", ids.alias("chunk_ids"), paths.alias("image_paths"), F.col("l").isNotNull().alias("found"))
