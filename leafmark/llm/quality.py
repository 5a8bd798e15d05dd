"""Quality rules with risk-controlled thresholds.

Each rule rejects a document when one of its metrics is at least a cutoff. Cutoffs come from a fixed grid and are tested on
the labelled documents of each stratum: the null hypothesis "this cutoff rejects more than its share of the risk budget of
the good documents" is rejected by the exact binomial tail P(Bin(n_good, risk) <= false rejections), with a Bonferroni
correction over all strata, rules and cutoffs. Among the cutoffs that pass, the one that rejects most is used; a rule
without a passing cutoff, and a stratum without labels, rejects nothing. With probability 1 - delta no stratum then loses
more than `risk` of its good documents to all rules together.

Words: maximal runs outside [\\x20\\x09-\\x0D]. A null text has no words. Null strata form one stratum of their own. A
document labelled several times counts once, as bad if any label says so; null labels count for nothing. Repeated rows are
judged alike. Other columns are kept by filter_documents and ignored elsewhere.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmark.llm.common import let, small, split_words, stored, unused

SEPARATORS = r"\x20\x09-\x0D"
SYMBOLS = r"[#*$%&|<>]"


def rules_cutoffs() -> dict[str, tuple[str, tuple[float, ...]]]:
    """Rules with their column and cutoffs, from loose to strict."""
    return {
        "symbols": ("n_symbols / word_chars", (0.3, 0.2, 0.1, 0.05, 0.02)),
        "same_lines": ("n_dup_lines / n_lines", (0.9, 0.75, 0.5, 0.3, 0.2)),
        "repeats": ("n_repeat_words / n_words", (0.45, 0.35, 0.25, 0.15, 0.1)),
        "long_words": ("word_chars / n_words", (12.0, 10.0, 9.0, 8.0, 7.5)),
    }


def rules() -> dict[str, tuple[Column, tuple[float, ...]]]:
    """Rules with their metric: a share of two base columns, the lower one at least 1."""
    out = {}
    for name, (share, cuts) in rules_cutoffs().items():
        over, under = share.split(" / ")
        out[name] = (F.col(over) / F.greatest(F.col(under), F.lit(1)), cuts)
    return out


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that the text holds twice or more, the first ones included."""
    n = F.size(words)
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def union(starts: Column) -> Column:
        gaps = F.transform(starts, lambda x, k: F.least(F.coalesce(F.get(starts, k + 1) - x, F.lit(3)), F.lit(3)))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def few(h: Column, twice: Column) -> Column:
        """A handful of repeated windows: look every window up among them."""
        return let(F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(twice, x), i)), lambda i: i.isNotNull()), union)

    def many(h: Column) -> Column:
        by_hash = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda s, e, k: (F.get(s, k - 1)["h"] == e["h"]) | (F.get(s, k + 1)["h"] == e["h"])
        return let(let(by_hash, lambda s: F.sort_array(F.transform(F.filter(s, lambda e, k: F.coalesce(same(s, e, k), F.lit(False))), lambda e: e["i"]))), union)

    def covered(h: Column) -> Column:
        twice = let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1) == x, F.lit(False)))))
        return let(twice, lambda t: F.when(F.size(t) == 0, 0).when(F.size(t) <= 32, few(h, t)).otherwise(many(h)))

    return F.when(n < 4, 0).otherwise(let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))).cast("long")


def features(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, stratum, text hash and the base counts."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.col(stratum).cast("string").alias("stratum"), F.xxhash64("text").alias("h"), text.alias("t"), split_words(text, SEPARATORS).alias("w"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(f"[^{SEPARATORS}]"))
    return rows.select(
        "doc_id", "stratum", "h",
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.char_length("t") - F.char_length(F.regexp_replace("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("lines"),
        repeated_words(F.col("w")).alias("n_repeat_words"),
    ).select("*", F.col("lines.dup").cast("long").alias("n_dup_lines"), F.col("lines.n").cast("long").alias("n_lines")).drop("lines")


def _ln_gamma(x: Column) -> Column:
    """Stirling's series at x + 8, brought back by the recurrence."""
    z = x + 8
    series = (z - 0.5) * F.log(z) - z + F.lit(0.5 * math.log(2 * math.pi)) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    product = x
    for k in range(1, 8):
        product = product * (x + k)
    return series - F.log(product)


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k); 1 where k is over the mean, which no test passes. Terms fall off from k down, so few are summed."""
    n, k = n.cast("double"), k.cast("double")
    at_k = _ln_gamma(n + 1) - _ln_gamma(k + 1) - _ln_gamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    start = F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("s"))
    steps = F.sequence(F.lit(0), F.least(k, F.ceil(10 * F.sqrt(n * p)) + 50).cast("int"))

    def add(a: Column, i: Column) -> Column:
        j = k - i
        return F.struct((a["t"] * j / (n - j + 1) * ((1 - p) / p)).alias("t"), (a["s"] + a["t"]).alias("s"))

    return F.when(k > n * p, F.lit(1.0)).otherwise(F.exp(at_k) * F.aggregate(steps, start, add, lambda a: a["s"]))


def calibrate(measured: DataFrame, labels: DataFrame, risk: float, delta: float) -> DataFrame:
    """(stratum, cutoffs): by stratum a map from rule to the cutoff that passed and rejects most."""
    # a stratum's counts for the whole grid are summed in one pass, so no stratum's rows meet in one task
    judged = labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("l")).agg(F.min("quality").alias("quality"))
    held = measured.join(judged, F.col("doc_id") == F.col("l"))
    grid = [(name, i, c, metric) for name, (metric, cuts) in rules().items() for i, c in enumerate(cuts)]
    good, bad = F.col("quality") > 0, F.col("quality") <= 0
    counts = held.groupBy("stratum").agg(
        F.count_if(good).alias("n"),
        *[F.count_if(good & (m >= c)).alias(f"g{k}") for k, (_, _, c, m) in enumerate(grid)],
        *[F.count_if(bad & (m >= c)).alias(f"b{k}") for k, (_, _, c, m) in enumerate(grid)],
    )
    tests = counts.select("stratum", "n", F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(i).alias("i"), F.lit(c).alias("cutoff"), F.col(f"g{k}").alias("false_n"), F.col(f"b{k}").alias("true_n")) for k, (name, i, c, _) in enumerate(grid)])).alias("x")).select("stratum", "n", "x.*")
    strata = counts.agg(F.count("*").alias("strata"))  # one row
    tests = tests.crossJoin(F.broadcast(strata)).withColumn("p", F.when(F.col("n") > 0, binomial_tail(F.col("n"), F.col("false_n"), risk / len(rules()))).otherwise(1.0))
    passed = tests.where((F.col("p") <= delta / (F.col("strata") * len(grid))) & (F.col("true_n") > 0))
    best = passed.groupBy("stratum", "rule").agg(F.max_by("cutoff", F.struct("true_n", -F.col("i"))).alias("cutoff"))
    return best.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))


def judge(docs: DataFrame, labels: DataFrame, risk: float = 0.05, delta: float = 0.05, stratum: str = "lang", min_words: int = 50, max_repeat: int = 50) -> DataFrame:
    """Per document its text hash h, stratum, the base counts, base_failed, kept and the rules that rejected it (failed_rules)."""
    measured = stored(features(docs, stratum), "features")
    cutoffs = stored(calibrate(measured, labels, risk, delta), "cutoffs").select(F.col("stratum").alias("s"), "cutoffs")
    out = measured.join(small(cutoffs), F.col("stratum").eqNullSafe(F.col("s")), "left")
    over = [F.when(metric >= F.col("cutoffs")[name], F.lit(name)) for name, (metric, _) in rules().items()]
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    failed = F.array_compact(F.array(*over))
    return out.select("doc_id", "h", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & (F.size(failed) == 0)).alias("kept"), failed.alias("failed_rules"))


def filter_documents(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """The documents that are kept, with all their columns, whatever these are called. Null and empty texts have no words and go;
    a null id is an id like others; repeated rows go or stay together."""
    verdicts = judge(docs, labels, **parameters)
    d, h = unused(docs, "d", "h")
    # the stratum decides too, so rows of one id and text in several strata may be judged apart
    k = unused(docs, "k")[0]
    out = stored(verdicts.where(~F.col("kept")).select("doc_id", "h", "stratum").distinct().toDF(d, h, k), "rejected")
    same = docs["doc_id"].eqNullSafe(F.col(d)) & (F.xxhash64(docs["text"]) == F.col(h)) & docs[parameters.get("stratum", "lang")].cast("string").eqNullSafe(F.col(k))
    return docs.join(small(out, 1_000_000), same, "left_anti")
