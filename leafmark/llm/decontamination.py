"""Benchmark decontamination by a distributed positional inverted index.

Postings (term, document, position) of the corpus are stored for the terms that test windows are anchored on. A window's
terms are ordered by corpus frequency, rarest first; candidates are postings of the rarest term moved back by its offset,
intersected with the offset-adjusted lists of the next rarest terms, and proven on the document's words: by hash first, and
what is left word by word.

Words: A-Z lower-cased, then maximal runs outside [\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]. A null text has no words, so it is never
hit; an item of fewer words than a window is one window, an item without words none. Repeated rows are judged alike, each
on its own; equal doc_ids with other texts are kept apart. Null ids are ordinary values for documents; items with a null
id match but are left out of the list of item ids. Other columns of either table are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmark.llm.common import ascii_lower, let, light, small, split_words, stored, unused

SEPARATORS = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
#: Tasks that the postings of one anchor term are dealt to where they are not joined by broadcast.
SALTS = 16


def words(text: Column) -> Column:
    return split_words(ascii_lower(text), SEPARATORS)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("h"), F.col("text").alias("t"))


def item_windows(benchmark: DataFrame, width: int) -> DataFrame:
    """(item_id, gram, g, n): the windows of each item; g is the hash that stands for gram."""
    w = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    grams = w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i, width))).alias("gram"))
    return grams.select("item_id", "gram", F.xxhash64("gram").alias("g"), F.size("gram").alias("n")).distinct()


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Stored postings (term, d, h, pos) of the given terms over all documents."""
    at = _keyed(docs).select("d", "h", F.posexplode(words(F.col("t"))).alias("pos", "term"))
    return stored(at.join(small(terms), "term"), "postings")


def rarest_terms(docs: DataFrame, grams: DataFrame, depth: int) -> DataFrame:
    """(g, n, anchors): for each window its depth rarest terms with their offsets, rarest first."""
    at = grams.select("g", "n", F.posexplode("gram").alias("off", "term"))
    vocabulary = stored(at.select("term").distinct(), "vocabulary")
    seen = docs.select(F.explode(words(F.col("text"))).alias("term")).join(small(vocabulary), "term").groupBy("term").count()
    # a row for each term of the tests; every window that holds a common term asks for it
    by_term = at.join(small(stored(seen, "terms")), "term", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    # a window has at most its width of terms, so the list is short
    best = by_term.groupBy("g", "n").agg(F.sort_array(F.collect_list(F.struct("count", "off", "term"))).alias("a"))
    return best.where(F.col("a")[0]["count"] > 0).select("g", "n", F.slice("a", 1, depth).alias("anchors"))


def _intersected(index: DataFrame, anchors: DataFrame, depth: int, slop: int | None) -> DataFrame:
    """(g, n, d, h, start): places where the anchor terms stand at their offsets (slop None), or within slop words of the rarest."""
    salt = F.pmod(F.xxhash64("h"), F.lit(SALTS)).cast("int")
    first = anchors.select("g", "n", "anchors", F.col("anchors")[0]["term"].alias("term"), F.col("anchors")[0]["off"].alias("off"))
    # a term that is common and yet the rarest of its window has postings without end: they meet it in several tasks
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = index.withColumn("salt", salt).join(small(first), ["term", "salt"]).select("g", "n", "anchors", "d", "h", (F.col("pos") - F.col("off")).alias("start"), F.col("pos").alias("at"))
    found = found.where("start >= 0") if slop is None else found
    for k in range(1, depth):
        nxt = F.get("anchors", F.lit(k))
        rest = found.where(F.size("anchors") <= k)
        want = found.where(F.size("anchors") > k).withColumn("term", nxt["term"]).withColumn("off", nxt["off"])
        other = index.select(F.col("term").alias("t2"), F.col("d").alias("d2"), F.col("h").alias("h2"), F.col("pos").alias("p2"))
        same = F.col("d").eqNullSafe(F.col("d2")) & (F.col("h") == F.col("h2")) & (F.col("term") == F.col("t2"))
        near = F.col("p2") == F.col("start") + F.col("off") if slop is None else F.abs(F.col("p2") - F.col("at")) <= slop
        found = want.join(other, same & near, "left_semi").drop("term", "off").unionByName(rest)
    return found.select("g", "n", "d", "h", "start")


def exact_matches(docs: DataFrame, benchmark: DataFrame, width: int = 10, depth: int = 3) -> tuple[DataFrame, DataFrame]:
    """(matches, windows). matches(d, h, start, n, g): the proven places by document key (id, text hash)."""
    windows = stored(item_windows(benchmark, width), "windows")
    grams = windows.select("g", "n", "gram").distinct()
    anchors = stored(rarest_terms(docs, grams, depth), "anchors")
    terms = stored(anchors.select(F.explode("anchors.term").alias("term")).distinct(), "terms")
    index = build_index(docs, terms)
    places = _intersected(index, anchors, depth, None).groupBy("d", "h").agg(F.collect_set(F.struct("start", "n", "g")).alias("places"))
    places = stored(places.select(F.col("d").alias("pd"), F.col("h").alias("ph"), "places"), "places")
    rows = _keyed(docs).join(light(places, F.size("places") * 32 + 64), F.col("d").eqNullSafe(F.col("pd")) & (F.col("h") == F.col("ph")))
    # a text is split once for all its places; the words there are kept, for a hash alone proves nothing
    there = lambda w, p: F.slice(w, p["start"] + 1, p["n"])
    held = lambda w: F.filter("places", lambda p: (p["start"] + p["n"] <= F.size(w)) & (F.xxhash64(there(w, p)) == p["g"]))
    proven = let(words(F.col("t")), lambda w: F.transform(held(w), lambda p: F.struct(p["start"].alias("start"), p["n"].alias("n"), p["g"].alias("g"), there(w, p).alias("gram"))))
    # stored before it is unnested: a condition on the hits would be pushed into the join, and the text split there again
    hits = stored(rows.select("d", "h", proven.alias("hits")), "hits")
    found = hits.select("d", "h", F.explode("hits").alias("x")).select("d", "h", "x.*").dropDuplicates(["d", "h", "start", "n"])
    return stored(found.join(small(grams), ["g", "n", "gram"], "left_semi").select("d", "h", "start", "n", "g"), "matches"), windows


def _covered() -> Column:
    """Words inside any of the places of a document, of its rows grouped."""
    inside = F.aggregate(
        F.sort_array(F.collect_set(F.struct("start", "n"))), F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum")),
        lambda a, p: F.struct(F.greatest(a["end"], p["start"] + p["n"]).alias("end"), (a["sum"] + F.greatest(p["start"] + p["n"] - F.greatest(a["end"], p["start"]), F.lit(0))).alias("sum")), lambda a: a["sum"],
    )
    return inside.cast("long")


def proximity_matches(docs: DataFrame, benchmark: DataFrame, width: int = 10, depth: int = 3, slop: int = 20) -> DataFrame:
    """(doc_id, item_id, start): the depth rarest terms of an item's window stand within slop words of the rarest one."""
    windows = stored(item_windows(benchmark, width), "windows")
    anchors = stored(rarest_terms(docs, windows.select("g", "n", "gram").distinct(), depth), "anchors")
    index = build_index(docs, stored(anchors.select(F.explode("anchors.term").alias("term")).distinct(), "terms"))
    found = _intersected(index, anchors, depth, slop)
    return found.join(windows.select("g", "item_id"), "g").select(F.col("d").alias("doc_id"), "item_id", F.greatest("start", F.lit(0)).alias("start")).distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, depth: int = 3) -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words inside a matched window), n_items, items (sorted), contaminated."""
    matches, windows = exact_matches(docs, benchmark, width, depth)
    per = matches.groupBy("d", "h").agg(_covered().alias("m_hit"), F.collect_set("g").alias("gs"))
    items = per.select("d", "h", "m_hit", F.explode("gs").alias("g")).join(small(windows.select("g", "item_id").distinct()), "g")
    items = items.groupBy("d", "h").agg(F.first("m_hit").alias("m_hit"), F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("m_items"))
    found = stored(items.select(F.col("d").alias("md"), F.col("h").alias("mh"), "m_hit", "m_items"), "found")
    rows = docs.select(F.col("doc_id"), F.xxhash64("text").alias("h"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = rows.join(light(found, F.size("m_items") * 48 + 64), F.col("doc_id").eqNullSafe(F.col("md")) & (F.col("h") == F.col("mh")), "left")
    items = F.coalesce("m_items", F.array().cast("array<string>"))
    n_hit = F.coalesce("m_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), (n_hit > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, width: int = 10, max_share: float = 0.0) -> DataFrame:
    """The documents of which at most max_share of the words lie inside test windows, with all their columns, whatever these
    are called. A null text has no words and stays, a null id is an id like others, repeated rows stay or go together."""
    matches, _ = exact_matches(docs, benchmark, width)
    d, h, n = unused(docs, "d", "h", "n")
    bad = stored(matches.groupBy("d", "h").agg(_covered().alias("n")).toDF(d, h, n), "hits")
    marked = docs.join(small(bad), docs["doc_id"].eqNullSafe(F.col(d)) & (F.xxhash64(docs["text"]) == F.col(h)), "left")
    over = F.lit(True) if max_share <= 0 else F.col(n) / F.size(words(docs["text"])) > max_share
    return marked.where(F.col(n).isNull() | ~over).select(*[docs[c] for c in docs.columns])
