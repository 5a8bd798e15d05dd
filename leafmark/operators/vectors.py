"""Multi-vector preparation: pooling, token-budget batches, the embedding hook, normalisation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def pooled(tokens: DataFrame, nx: int, ny: int, prefix: int = 1, layout: str = "reference") -> DataFrame:
    """tokens(chunk_id, tok, vec) -> chunk_id, kind (mean_r, mean_c), pos, vec.

    Image tokens are tok prefix .. prefix + nx * ny - 1; those before and after stay as they are around the means. Layout
    "reference" reads the rank of an image token as i * ny + j, "hw" (true rows and columns) as row * nx + column.
    """
    rank = F.col("tok") - prefix
    i, j = (F.floor(rank / ny), rank % ny) if layout == "reference" else (rank % nx, F.floor(rank / nx))
    inside = (rank >= 0) & (rank < nx * ny)
    image = tokens.where(inside).select("chunk_id", i.cast("long").alias("i"), j.cast("long").alias("j"), array_to_vector("vec").alias("v"))

    def means(kind: str, by: str, n: int) -> DataFrame:
        # means are summed where the tokens are, so a chunk of thousands of tokens shuffles a few rows for each mean
        mean = image.groupBy("chunk_id", F.col(by).alias("k")).agg(Summarizer.mean(F.col("v")).alias("m"))
        mean = mean.select("chunk_id", F.lit(kind).alias("kind"), (F.col("k") + prefix).alias("pos"), vector_to_array("m").alias("vec"))
        rest = tokens.where(~inside).select("chunk_id", F.lit(kind).alias("kind"), F.when(rank < 0, F.col("tok")).otherwise(F.col("tok") - nx * ny + n).alias("pos"), F.col("vec").cast("array<double>").alias("vec"))
        return mean.unionByName(rest)

    return means("mean_r", "j", ny).unionByName(means("mean_c", "i", nx))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def normalised(tokens: DataFrame, metric: str = "cosine") -> DataFrame:
    """Unit vectors for cosine (a zero vector stays), the vectors themselves for inner product."""
    if metric != "cosine":
        return tokens
    n = norm(F.col("vec"))
    return tokens.withColumn("_n", F.when(n > 0, n).otherwise(1.0)).withColumn("vec", F.transform("vec", lambda x: x.cast("double") / F.col("_n"))).drop("_n")


def batches(items: DataFrame, budget: int = 13_000, most: int | None = None) -> DataFrame:
    """items(shard, item_id, tokens) -> shard, item_id, tokens, batch: greedy over ascending tokens; a batch is closed when
    its size times its largest token count would pass the budget, or its size the cap. An item over the budget is alone."""

    def greedy(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["tokens", "item_id"], kind="stable").reset_index(drop=True)
        batch, size, out = 0, 0, []
        for n in part["tokens"].tolist():
            # in ascending order the newest item is the largest of its batch
            if size and ((size + 1) * n > budget or most is not None and size + 1 > most):
                batch, size = batch + 1, 0
            out.append(batch)
            size += 1
        return part.assign(batch=out)[["shard", "item_id", "tokens", "batch"]]

    return items.groupBy("shard").applyInPandas(greedy, f"shard {items.schema['shard'].dataType.simpleString()}, item_id long, tokens long, batch long")


def embed(rows: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """The hook for a model: load() is called once in each task and gives the function that turns a batch of rows into vectors."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for part in parts:
            yield model(part)

    return rows.mapInPandas(run, schema)


def token_vectors(items: DataFrame) -> DataFrame:
    """Order of the vectors of an item: (chunk_id, tok, vec) from (chunk_id, vecs)."""
    return items.select("chunk_id", F.posexplode("vecs").alias("tok", "vec"))


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
