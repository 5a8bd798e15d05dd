"""A substring index over titles: positional postings of their pieces of one, two and three letters.

Titles and searched texts are lower-cased; a text is looked up without the blanks around it, and a blank one finds all, as in
retrieval.outline_search. A text of one or two letters is a posting list of its own. A longer one is cut into its overlapping
pieces of three; the two rarest are intersected by where the text would begin, and what is left is verified on the title. Postings
are sorted by piece, so a search reads the row groups of its pieces alone; counts by piece say which are rarest, and that
there is nothing to find where one is missing. Rows without a title are found by no text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.operators.retrieval import outline_search

PIECE = 3


def write(sections: DataFrame, path: str, keys: list[str]) -> None:
    """The index of sections, whose rows `keys` tell apart, below path. Sections are kept beside it."""
    sections.write.parquet(f"{path}/sections")
    rows = sections.sparkSession.read.schema(sections.schema).parquet(f"{path}/sections").select(*keys, F.lower("title").alias("_t"))
    at = F.sequence(F.lit(1), F.char_length("_t"))
    found = rows.where(F.char_length("_t") > 0).select(*keys, "_t", F.explode(at).alias("_at"))
    found = found.select(*keys, (F.col("_at") - 1).alias("at"), F.explode(F.array(*[F.when(F.col("_at") + n - 1 <= F.char_length("_t"), F.substring("_t", F.col("_at"), F.lit(n))) for n in range(1, PIECE + 1)])).alias("piece")).where("piece is not null")
    found.repartitionByRange("piece", *keys).sortWithinPartitions("piece").write.parquet(f"{path}/postings")
    postings = sections.sparkSession.read.parquet(f"{path}/postings")
    postings.groupBy("piece").agg(F.count("*").alias("n")).repartitionByRange("piece").sortWithinPartitions("piece").write.parquet(f"{path}/counts")


def pieces_of(text: str) -> list[tuple[str, int]]:
    """(piece, offset) that a text is looked up by."""
    return [(text, 0)] if len(text) < PIECE else [(text[i : i + PIECE], i) for i in range(len(text) - PIECE + 1)]


def search(spark: SparkSession, path: str, text: str, keys: list[str]) -> DataFrame:
    """Sections whose title holds the text, whatever its case: the rows of outline_search."""
    sections = spark.read.parquet(f"{path}/sections")
    wanted = text.strip().lower()
    if not wanted:
        return sections
    places = pieces_of(wanted)
    counts = {r.piece: r.n for r in spark.read.parquet(f"{path}/counts").where(F.col("piece").isin(sorted({p for p, _ in places}))).collect()}  # the text's pieces
    if any(p not in counts for p, _ in places):
        return sections.where("false")
    rarest = sorted(places, key=lambda x: (counts[x[0]], x[1]))[:2]
    postings = spark.read.parquet(f"{path}/postings")
    lists = [postings.where(F.col("piece") == p).select(*keys, (F.col("at") - offset).alias("start")) for p, offset in rarest]
    begins = lists[0] if len(lists) == 1 else lists[0].join(lists[1], [*keys, "start"], "left_semi")
    return outline_search(sections.join(begins.select(*keys).distinct(), keys, "left_semi"), text)
