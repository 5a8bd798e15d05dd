"""URL filtering by association rules.

Labelled URLs become baskets of tokens (host labels and suffixes, path words, endings, query keys) with their class as one
more token. FP-growth finds the frequent token combinations; rules towards the bad class are pruned by support, by confidence
(its lower bound, `sigmas` deviations below what was seen, must be `lift` times the share of bad URLs) and, where a shorter
rule says the same at least as surely, redundancy. The rules that are left stand in an inverted index
under their rarest token; a URL meets the rules listed under its tokens and is blocked if it holds all tokens of one. A
list of given host and path rules comes before: of the given rules that fit, the longest decides.

A page's label is that of the document whose number is the first all-digit word of the path. A document labelled
several times counts as bad if any label says so; null labels count for nothing. Null URLs, and URLs without "://", have
empty host and path, no tokens, and are allowed. Repeated rows are judged alike. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmark.llm.common import ascii_lower, light, stored

#: (host, path, verdict)
GIVEN = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
BAD, GOOD = "=bad", "=good"


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def given_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest given rule that fits, or null. Rules are a setting of a few lines."""
    fits = [F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in rules]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<size:int,rule:string,verdict:string>")


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: h: host labels, d: the last two labels together, p: path words, e: ending, q: query keys, f: fragment."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    tagged = lambda tag, xs: F.transform(xs, lambda x: F.concat(F.lit(tag), x))
    words = F.filter(F.split(path, "[/._-]+"), lambda x: (x != "") & ~x.rlike("^[0-9]+$"))
    keys = F.filter(F.transform(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda x: F.regexp_extract(x, "^([^=]*)", 1)), lambda x: x != "")
    extra = F.array_compact(F.array(F.when(F.size(labels) >= 2, F.concat(F.lit("d:"), F.array_join(F.slice(labels, -2, 2), "."))), F.when(host != "", F.concat(F.lit("s:"), host)), F.when(path.endswith("/"), F.lit("e:/")), F.when(url.contains("#"), F.lit("f:"))))
    return F.array_distinct(F.concat(tagged("h:", labels), extra, tagged("p:", words), tagged("q:", keys)))


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path, tokens."""
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return rows.withColumn("tokens", F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(tokens(F.col("url"), F.col("host"), F.col("path"))))


def surely(hit: Column, n: Column, sigmas: float) -> Column:
    """Wilson's lower bound of a share of which hit in n was seen."""
    share, z = hit / n, sigmas * sigmas
    return (share + z / (2 * n) - sigmas * F.sqrt(share * (1 - share) / n + z / (4 * n * n))) / (1 + z / n)


def mine(rows: DataFrame, labels: DataFrame, support: float, lift: float, sigmas: float, least: int) -> DataFrame:
    """Stored (rule_id, need, confidence, support, base, sure): token sets that speak for the bad class, the share of bad URLs,
    and the bound of their confidence. rows: of parsed()."""
    number = F.expr("try_cast(regexp_extract(path, '/([0-9]+)(?:[/.]|$)', 1) as bigint)")
    bad = (F.col("quality") == 0) | (F.coalesce("toxic", F.lit(0)) == 1)
    judged = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max(F.when(bad, 1).otherwise(0)).alias("bad"))
    baskets = rows.where("host <> ''").select("tokens", number.alias("doc_id")).join(judged, "doc_id")
    baskets = stored(baskets.select(F.array_append("tokens", F.when(F.col("bad") == 1, BAD).otherwise(GOOD)).alias("items")), "baskets")
    seen = baskets.agg(F.count("*").alias("n"), F.count_if(F.array_contains("items", BAD)).alias("bad")).first()
    if not seen.bad:
        return rows.sparkSession.createDataFrame([], "rule_id string, need array<string>, confidence double, support double, base double, sure double")
    n, base = seen.n, seen.bad / seen.n
    wanted = min(1.0, lift * base)
    # what the bound lets through has a higher confidence still
    model = FPGrowth(itemsCol="items", minSupport=max(support, least / n), minConfidence=wanted).fit(baskets)
    hit = F.rint(F.col("support") * n)
    rules = model.associationRules.where(F.array_contains("consequent", BAD) & (F.size("antecedent") > 0)).withColumn("sure", surely(hit, F.rint(hit / F.col("confidence")), sigmas))
    rules = stored(rules.where(F.col("sure") >= wanted).select(F.array_join(F.array_sort("antecedent"), " ").alias("rule_id"), F.array_sort("antecedent").alias("need"), "confidence", "support", F.lit(base).alias("base"), "sure"), "rules")
    # a rule with a shorter one inside it that is at least as sure adds nothing: the shorter ones are its subsets by one token
    shorter = rules.select("rule_id", "confidence", "need", F.explode("need").alias("out")).select("rule_id", "confidence", F.array_join(F.array_remove("need", F.col("out")), " ").alias("sub"))
    redundant = shorter.join(rules.select(F.col("rule_id").alias("sub"), F.col("confidence").alias("c")), "sub").where("c >= confidence").select("rule_id").distinct()
    return stored(rules.join(redundant, "rule_id", "left_anti"), "rules")


def blocked(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, by): URLs that hold all tokens of a rule, with the surest one, through the inverted index of the rules."""
    urls = rows.select("url", "tokens").distinct()
    terms = rules.select(F.explode("need").alias("token")).distinct()
    often = urls.select(F.explode("tokens").alias("token")).join(light(terms, F.octet_length("token") + 32), "token").groupBy("token").count()
    posted = rules.select("rule_id", "need", "confidence", F.explode("need").alias("token")).join(often, "token", "left")
    index = stored(posted.groupBy("rule_id", "need", "confidence").agg(F.min_by("token", F.struct(F.coalesce("count", F.lit(0)), "token")).alias("token")), "index")
    met = urls.select("url", "tokens", F.explode("tokens").alias("token")).join(light(index, 3 * F.octet_length("rule_id") + 32 * F.size("need") + 64), "token").where(F.size(F.array_except("need", "tokens")) == 0)
    return met.groupBy("url").agg(F.max_by("rule_id", F.struct("confidence", "rule_id")).alias("by"))


def judge(pages: DataFrame, labels: DataFrame, given: Sequence[tuple[str, str, str]] = GIVEN, support: float = 0.001, lift: float = 1.5, sigmas: float = 4.0, least: int = 10) -> DataFrame:
    """page_id, url, host, path, rule (the given rule or null), verdict, mined (the mined rule that blocks, or null)."""
    rows = parsed(pages)
    rules = mine(rows, labels, support, lift, sigmas, least)
    hit = stored(blocked(rows, rules).select(F.col("url").alias("u"), "by"), "blocked")
    out = rows.join(light(hit, F.octet_length("u") + F.octet_length("by") + 64), F.col("url") == F.col("u"), "left").withColumn("g", given_rule(F.col("host"), F.col("path"), given))
    verdict = F.coalesce(F.col("g.verdict"), F.when(F.col("by").isNotNull(), "block").otherwise("allow"))
    return out.select("page_id", "url", "host", "path", F.col("g.rule").alias("rule"), verdict.alias("verdict"), F.when(F.col("g").isNull(), F.col("by")).alias("mined"))
