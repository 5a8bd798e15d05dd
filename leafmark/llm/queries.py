"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.llm import decontamination, jaccard, licenses, lm, packing, pii, quality, ranked_search, records, sharding, token_counts, urls, whitening
from leafmark.llm.common import table
from leafmark.llm.oracles import ORACLES  # noqa: F401  registered beside the queries
from leafmark.plans.session import ship_package


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """The vocabulary files are installed beside the library on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")).select("page_id", "host", "path", "rule", "verdict", "mined")


def _told(spans) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return pii.find(table(spark, sf_dir, "documents")).select("doc_id", *[count(k) for k in pii.BASE], F.sha2(_told(base), 256).alias("base_sha256"), _told("spans").alias("spans"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(ship_package(spark), sf_dir, "documents"), tokenizer_path()).drop("padded")


def op6_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.read_back(*records.write(table(ship_package(spark), sf_dir, "documents"), tokenizer_path()))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked_documents(table(ship_package(spark), sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "links")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(ship_package(spark), sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(ship_package(spark), sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents")).drop("linked")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked(table(ship_package(spark), sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(table(ship_package(spark), sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(ship_package(spark), sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality_rules, op2_url_filters, op3_pii, op4_decontamination, op5_packing, op6_records, op7_jaccard_join, op8_license_scan, op9_lm_scoring, op10_sharding, op11_ranked_search, op12_token_counts, op13_whitening)}
