"""N-gram Jaccard join, size-aware: light sets by fixed-size subsets, heavy sets by inverted lists.

A document's set holds the 64-bit hashes of its distinct word shingles. Equal sets form a class, and only classes are
joined. Two sizes s <= t can link only if they share c = ceil(T (s + t) / (1 + T)) shingles:

* light sets (few shingles) enumerate their subsets of that fixed size c; two sets link if and only if they list one
  subset in common. Those that do come into a block too, where their links are counted;
* heavy sets are found through inverted lists. Sizes fall into levels; the sets of a level and the next one are cut into m
  parts by shingle hash. Two linked sets differ in at most k shingles, so m - k of their parts at least are the same, and it
  is enough that each set is listed under its k + 1 best parts: the best part that two linked sets share is among these for
  both, as "best" is told from the part alone (most shingles that are not hot first). So a passage that many documents
  share, or a single common shingle, names a list only where a set has nothing better. Sets that meet in a list are gathered
  into one block, once each, where inverted lists of single shingles are scanned and overlaps counted exactly. A block over
  the limit is put in the order of its lists and cut into parts; a task gets two parts that have a list in common, so all
  that meet in a list meet in a task, and parts without a common list are never compared.

The boundary is the size at which the rows that enumeration makes cost more than the lists and the scan. Links leave a
block as a spanning forest with each class's number of links, so a group of near copies never turns into all its pairs.

Null and empty texts have no shingles and link with nothing; texts of fewer words than a shingle are one shingle. Rows
that share a doc_id are one node; rows with a null id are counted but link with nothing and have no component. Repeated
rows come back as often as they came. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb, floor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmark.llm.common import ranked, short_batches, small, stored, unused
from leafmark.llm.components import components

#: Shingles and sets that one block task may hold.
BLOCK_SHINGLES, BLOCK_SETS = 3_000_000, 2_000
#: Bytes taken as the cost of a list or subset row, of bringing a set into a block (its text is read again), and of its scan
#: for each shingle.
ROW_COST, BLOCK_COST, SCAN_COST = 24, 400, 16
#: Parts for each list at least; a shingle is hot from HOT_ROWS documents on, or one in HOT_SHARE of them if that
#: is more, so that hot shingles stay few. They are told by a bitmap of 2 ** HOT_BITS bits (4 MB) over their last bits. Which
#: ones are hot, or are taken for it, decides on cost alone, never on links.
SLACK, HOT_ROWS, HOT_SHARE, HOT_BITS = 1.3, 16, 50_000, 25
CHUNK = 4_000_000
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that any bits of the result can be used."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], width: int = 3) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text. Words: A-Z lower-cased, split at \\x20 and \\x09-\\x0D."""
    split = [[] if t is None else t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
    flat = [w for ws in split for w in ws]
    words = np.empty(len(flat), object)
    words[:] = flat
    hashed = pd.util.hash_array(words, categorize=False) if len(flat) else np.empty(0, np.uint64)
    out, low = [], 0
    with np.errstate(over="ignore"):
        for ws in split:
            n = len(ws)
            h = hashed[low : low + n]
            low += n
            if n == 0:
                out.append(np.empty(0, np.uint64))
                continue
            take = min(n, width)
            x = np.full(n - take + 1, np.uint64(take))
            for k in range(take):
                x = mix(x * _M1 + h[k : n - take + 1 + k])
            out.append(np.unique(x))
    return out


class Plan:
    """Levels, list keys and subsets at a threshold of percent / 100."""

    def __init__(self, percent: int, light: int = 0):
        self.p, self.light = percent, light

    def linked(self, common, s, t):
        return (100 + self.p) * common >= self.p * (s + t)

    def need(self, s: int, t: int) -> int:
        return -(-self.p * (s + t) // (100 + self.p))

    def partners(self, s: int) -> range:
        return range(ceil(s * self.p / 100), floor(s * 100 / self.p) + 1)

    def levels(self, top: int) -> list[int]:
        """Smallest sizes of the levels up to size top; a set links within its level and the next ones only."""
        lows = [1]
        while lows[-1] <= top:
            lows.append(floor(lows[-1] * 100 / self.p) + 1)
        return lows

    def most_apart(self, s: int) -> int:
        """How many shingles a set of size s and one it links with may differ in."""
        return floor((s + floor(s * 100 / self.p)) * (100 - self.p) / (100 + self.p))

    def parts(self, lows: list[int], level: int) -> int:
        """Parts of a level; a power of two, so that neighbouring levels mostly share their lists."""
        k = self.most_apart(lows[level + 1] - 1)
        return 1 << (ceil(SLACK * (k + 1)) - 1).bit_length() if k else 1

    def lists(self, lows: list[int], s: int) -> set[int]:
        """The numbers of parts for a set of size s: those of its level and the next."""
        level = int(np.searchsorted(lows, s, "right")) - 1
        # with one part, or among light sets alone, no list is needed
        return {m for x in (level, level + 1) if (m := self.parts(lows, x)) > 1 and lows[x + 1] - 1 >= self.light}

    def subset_rows(self, s: int) -> int:
        return sum(comb(s, self.need(s, t)) for t in self.partners(s) if s != t or self.need(s, t) < s)

    def list_rows(self, s: int) -> int:
        return len(self.lists(self.levels(2 * s + 4), s)) * (self.most_apart(s) + 1)


def boundary(percent: int, counts: dict[int, int], most: int = 64) -> int:
    """The size from which sets are heavy: the x that makes (subset rows of smaller sets + list rows and scans of the others) cheapest."""
    plan = Plan(percent)
    light = {s: ROW_COST * plan.subset_rows(s) * n for s, n in counts.items() if s < most}
    heavy = {s: (ROW_COST * plan.list_rows(s) + BLOCK_COST + SCAN_COST * s) * n for s, n in counts.items() if s < most}
    cost = lambda x: sum(v for s, v in light.items() if s < x) + sum(v for s, v in heavy.items() if s >= x)
    return min(range(1, most + 1), key=lambda x: (cost(x), x))


def _list_keys(plan: Plan, h: np.ndarray, hot: np.ndarray, lows: list[int]) -> np.ndarray:
    """Keys of the inverted lists that a set stands in: hashes of its best parts. hot: mask over h."""
    keys, n = [], plan.most_apart(len(h)) + 1
    with np.errstate(over="ignore"):
        mixed = mix(h ^ _M1)
        for m in plan.lists(lows, len(h)):
            part = (h & np.uint64(m - 1)).astype(np.int64)
            # a sum of mixed hashes stands for the part's set
            total = np.zeros(m, np.uint64)
            np.add.at(total, part, mixed)
            key = mix(total ^ mix(np.uint64(m) * _M2 + np.arange(m, dtype=np.uint64)))
            if n < m:
                best = np.bincount(part[~hot], minlength=m) * (1 << 20) + np.bincount(part, minlength=m)
                key = key[np.lexsort((key, -best))[:n]]
            keys.append(key)
    return np.concatenate(keys) if keys else np.empty(0, np.uint64)


def _subset_keys(plan: Plan, h: np.ndarray) -> list[tuple[int, bool]]:
    """(key, is the smaller one) for each fixed-size subset of a light set with each size it may link with."""
    s, out = len(h), []
    with np.errstate(over="ignore"):
        mixed = mix(h ^ _M3)
        total = mixed.sum(dtype=np.uint64)
        for t in plan.partners(s):
            c = plan.need(s, t)
            if c > min(s, t) or t >= plan.light or s == t and c == s:
                continue
            salt = mix(np.uint64(min(s, t)) * _M1 + np.uint64(max(s, t)))
            for left in combinations(range(s), s - c):
                out.append((int(mix((total - mixed[list(left)].sum(dtype=np.uint64)) ^ salt)), s <= t))
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def _sketches(plan: Plan, width: int, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                b = whole.slice(k, 512)
                ids, rows = b.column(0), []
                sets = shingle_sets(b.column(1).to_pylist(), width)
                lows = plan.levels(max(map(len, sets), default=1) * 2 + 2)
                at = np.r_[0, np.cumsum(list(map(len, sets)))]
                flat = np.concatenate(sets) if at[-1] else np.empty(0, np.uint64)
                bit = (flat & np.uint64((1 << HOT_BITS) - 1)).astype(np.int64)
                warm = (hot[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)
                for i, h in enumerate(sets):
                    with np.errstate(over="ignore"):
                        a, c = mix(h).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(h * _M1)) if len(h) else np.uint64(0)
                    light = _subset_keys(plan, h) if 0 < len(h) < plan.light else []
                    heavy = _list_keys(plan, h, warm[at[i] : at[i + 1]], lows) if len(h) else np.empty(0, np.uint64)
                    rows.append((len(h), a, c, heavy, light))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.cast(pa.int64()), b.column(2), pa.array([r[0] for r in rows], pa.int64()),
                        pa.array(_signed(np.array([r[1] for r in rows], np.uint64))), pa.array(_signed(np.array([r[2] for r in rows], np.uint64))),
                        pa.array([_signed(r[3]) for r in rows], pa.list_(pa.int64())),
                        pa.array([_signed(np.array([x for x, _ in r[4]], np.uint64)) for r in rows], pa.list_(pa.int64())),
                        pa.array([[y for _, y in r[4]] for r in rows], pa.list_(pa.bool_())),
                    ],
                    names=["doc_id", "text_hash", "n", "a", "b", "lists", "subsets", "smaller"],
                )

    return run


def _survey(width: int):
    """(what, key, n): sizes of small sets (what 0), and shingles that a few million held more than twice (what 1)."""

    def told(sizes: list[int], held: np.ndarray) -> pa.RecordBatch:
        size, m = np.unique(np.array([x for x in sizes if x < 64], np.int64), return_counts=True)
        held.sort()  # in place: a worker holds a chunk once
        # the first row of each run of three or more
        many = np.empty(len(held), bool)
        many[-2:] = False
        np.equal(held[2:], held[:-2], out=many[:-2])
        many[1:] &= held[1:] != held[:-1]
        first = np.flatnonzero(many)
        key, n = _signed(held[first]), np.searchsorted(held, held[first], "right") - first
        what = np.r_[np.zeros(len(size), np.int32), np.ones(len(key), np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(what), pa.array(np.r_[size, key]), pa.array(np.r_[m, n].astype(np.int64))], names=["what", "key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, all_, held = [], np.empty(CHUNK + CHUNK // 2, np.uint64), 0  # pages that are not written take no memory
        for b in batches:
            for k in range(0, b.num_rows, 512):
                sets = shingle_sets(b.column(0).slice(k, 512).to_pylist(), width)
                sizes += map(len, sets)
                for h in sets:
                    if held + len(h) > len(all_):
                        all_ = np.concatenate([all_[:held], np.empty(len(h) + CHUNK // 8, np.uint64)])
                    all_[held : held + len(h)] = h
                    held += len(h)
                if held >= CHUNK:
                    yield told(sizes, all_[:held])
                    sizes, held = [], 0
        if sizes:
            yield told(sizes, all_[:held])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                b = whole.slice(k, 256)
                sets = shingle_sets(b.column("text").to_pylist(), width)
                with np.errstate(over="ignore"):
                    a = _signed(np.array([mix(h).sum(dtype=np.uint64) for h in sets], np.uint64))
                out = pa.RecordBatch.from_arrays([b.column("cls"), b.column("a"), b.column("family"), b.column("part"), pa.array([h.tobytes() for h in sets], pa.binary())], names=["cls", "a", "family", "part", "shingles"])
                yield out.filter(pa.array((a == b.column("a").to_numpy())))  # of rows that share an id, the class's own

    return run


def _scan(plan: Plan):
    """Exact links of a block: every set scans the inverted lists of its shingles, and overlaps are counted."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        _, left, right = key
        sets = [np.frombuffer(x, np.uint64) for x in group["shingles"]]
        ids, side = group["cls"].to_numpy(), group["part"].to_numpy()
        size = np.array(list(map(len, sets)), np.int64)
        order = np.argsort(size, kind="stable")
        sets, ids, side, size = [sets[i] for i in order], ids[order], side[order], size[order]
        n = len(sets)
        _, dense = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(n), size)
        by_shingle = np.argsort(dense, kind="stable")
        posted, starts = owner[by_shingle], np.r_[0, np.cumsum(np.bincount(dense))]
        offset = np.r_[0, np.cumsum(size)]
        top, degree = np.arange(n), np.zeros(n, np.int64)
        for i in range(n):
            mine = dense[offset[i] : offset[i + 1]]
            lows, lens = starts[mine], starts[mine + 1] - starts[mine]
            if lens.sum() == len(mine):
                continue
            at = np.repeat(lows - np.r_[0, np.cumsum(lens)[:-1]], lens) + np.arange(lens.sum())
            common = np.bincount(posted[at], minlength=n)
            common[: i + 1] = 0  # each pair once
            hit = np.flatnonzero(common)
            hit = hit[plan.linked(common[hit], size[i], size[hit])]
            if left != right:
                hit = hit[side[hit] != side[i]]
            degree[i] += len(hit)
            degree[hit] += 1
            if len(hit) and len(met := np.unique(top[np.r_[i, hit]])) > 1:
                top[np.isin(top, met[1:])] = met[0]
        lowest = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(lowest, top, ids)
        keep = degree > 0
        return pd.DataFrame({"u": ids[keep], "v": lowest[top][keep], "links": degree[keep]})

    return run


def _hot_bits(shingles: DataFrame) -> np.ndarray:
    """The bitmap over the last HOT_BITS bits of shingles(key); made by Spark, a row for each 4 KB of it."""
    place = F.col("key").bitwiseAND(F.lit((1 << HOT_BITS) - 1)) + 1  # buckets of places begin at one
    maps = shingles.groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    out = np.zeros((1 << HOT_BITS) // 8, np.uint8)
    for r in maps:
        out[(r.k - 1) * 4096 : r.k * 4096] = np.frombuffer(r.bits, np.uint8)
    return out


def _dealt(about: DataFrame, stood: DataFrame) -> tuple[DataFrame, DataFrame]:
    """about(cls, n, family), stood(cls, key): (parts, tasks). parts(cls, family, part) cuts the sets of a family into parts in
    the order of their lowest list; tasks(family, left, right) names the parts that have a list in common."""
    blocks = about.groupBy("family").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_SETS)).alias("blocks"), F.count("*").alias("sets"))
    blocks = stored(blocks.withColumnRenamed("family", "f"), "blocks")
    sized = about.join(blocks, F.col("family") == F.col("f")).drop("f")
    one = sized.where("blocks = 1").select("cls", "family", F.lit(0).cast("long").alias("part"))
    home = stood.groupBy("cls").agg(F.min("key").alias("home")).withColumnRenamed("cls", "c")
    large = sized.where("blocks > 1").join(home, F.col("cls") == F.col("c")).drop("c")
    # the upper bits of a list's key are as good as random, so their ranges are ranked apart
    order = ranked(large, ["family"], [F.col("home"), F.col("cls")], 1 << 20, "at", F.shiftrightunsigned("home", 44))
    cut = order.select("cls", "family", F.floor(F.col("at") * F.col("blocks") / F.col("sets")).cast("long").alias("part"))
    parts = stored(one.unionByName(cut), "parts")
    several = parts.join(blocks.where("blocks > 1").select("f"), F.col("family") == F.col("f"), "left_semi").withColumnRenamed("cls", "c")
    at = stored(stood.join(several, F.col("cls") == F.col("c")).select("key", "family", "part").distinct(), "spans")
    both = at.join(at.select(F.col("key").alias("k2"), F.col("part").alias("other")), F.col("key") == F.col("k2")).where("part <= other")
    pairs = both.select("family", F.col("part").alias("left"), F.col("other").alias("right"))
    alone = blocks.where("blocks = 1").select(F.col("f").alias("family"), F.lit(0).cast("long").alias("left"), F.lit(0).cast("long").alias("right"))
    return parts, stored(pairs.distinct().unionByName(alone), "tasks")


def jaccard_join(docs: DataFrame, percent: int = 90, width: int = 3) -> tuple[DataFrame, DataFrame]:
    """_join with few texts on the way to Python at once."""
    with short_batches(docs.sparkSession):
        return _join(docs, percent, width)


def _join(docs: DataFrame, percent: int, width: int) -> tuple[DataFrame, DataFrame]:
    """(members, links): members(doc_id, text_hash, n_shingles, cls) has a row for each document, cls being the smallest id with
    the same set; links(u, v, links) has for each class that links a class v of its component (a spanning forest) and how many
    it links with; several rows of a class add up."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    seen = stored(rows.select("text").mapInArrow(_survey(width), "what int, key long, n long").groupBy("what", "key").agg(F.sum("n").alias("n")).where(f"what = 0 or n >= {HOT_ROWS}"), "survey")
    counts = {r.key: r.n for r in seen.where("what = 0").collect()}  # 64 rows at most
    hot = _hot_bits(seen.where((F.col("what") == 1) & (F.col("n") >= max(HOT_ROWS, rows.count() // HOT_SHARE))))
    plan = Plan(percent, boundary(percent, counts))
    sets = stored(rows.mapInArrow(_sketches(plan, width, hot), "doc_id long, text_hash long, n long, a long, b long, lists array<long>, subsets array<long>, smaller array<boolean>"), "sets")
    filled = sets.where("n > 0 and doc_id is not null")
    classes = filled.groupBy("n", "a", "b").agg(F.min("doc_id").alias("cls"), F.count("*").alias("rows"))
    shared = stored(classes.where("rows > 1").select(F.col("n").alias("cn"), F.col("a").alias("ca"), F.col("b").alias("cb"), "cls"), "classes")
    same = (F.col("n") == F.col("cn")) & (F.col("a") == F.col("ca")) & (F.col("b") == F.col("cb"))
    own = sets.join(small(shared), same & F.col("doc_id").isNotNull(), "left").withColumn("cls", F.coalesce("cls", "doc_id"))
    members = own.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "cls")
    heads = own.where("n > 0 and doc_id = cls")

    # light: sets of one size all carry "smaller" and link; of two sizes, every small one links with every large one
    subs = heads.where(F.size("subsets") > 0).select("cls", F.explode(F.arrays_zip("subsets", "smaller")).alias("x")).select("cls", F.col("x.subsets").alias("key"), F.col("x.smaller").alias("smaller"))
    first = subs.groupBy("key").agg(F.min(F.when(F.col("smaller"), F.col("cls"))).alias("s"), F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo < hi and s is not null")
    linked = subs.join(first, "key").select("cls", "key", "lo")

    # heavy: classes that meet in an inverted list
    listed = heads.select("cls", F.explode("lists").alias("key"))
    met = stored(listed.groupBy("key").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo < hi").select("key", "lo"), "lists")
    # joined by key at every size: a table that is broadcast on small inputs only would make the shuffle grow faster than they
    stood = stored(listed.join(met, "key").select("cls", "key", "lo").unionByName(linked).distinct(), "stood")
    families = components(stood.select(F.col("cls").alias("u"), F.col("lo").alias("v")))
    about = heads.select("cls", "n", "a").join(families, F.col("cls") == F.col("node")).select("cls", "n", "a", F.col("component").alias("family"))
    about = stored(about, "families")
    parts, tasks = _dealt(about.groupBy("cls", "family").agg(F.sum("n").alias("n")), stood)
    wanted = stored(about.select("cls", "a").join(parts, "cls"), "wanted")
    texts = rows.join(small(wanted, 1_000_000), rows["doc_id"] == F.col("cls")).select("cls", "a", "family", "part", "text")
    full = texts.mapInArrow(_sets(width), "cls long, a long, family long, part long, shingles binary").dropDuplicates(["cls", "a"])
    sides = tasks.select("family", "left", "right", F.col("left").alias("part")).unionByName(tasks.where("left < right").select("family", "left", "right", F.col("right").alias("part")))
    dealt = full.join(sides, ["family", "part"]).select("cls", "shingles", "part", "family", "left", "right")
    return members, stored(dealt.groupBy("family", "left", "right").applyInPandas(_scan(plan), "u long, v long, links long"), "links")


def linked_documents(docs: DataFrame, percent: int = 90, width: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id, cls, links, text_hash: one row for each document; links counts the other sets that its
    set links with."""
    members, links = jaccard_join(docs, percent, width)
    tops = components(links.select("u", "v"))
    degree = links.groupBy(F.col("u").alias("dn")).agg(F.sum("links").alias("links"))
    known = stored(tops.join(degree, F.col("node") == F.col("dn"), "left").select("node", "component", F.coalesce("links", F.lit(0)).alias("links")), "components")
    out = members.join(small(known, 1_000_000), F.col("cls") == F.col("node"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "cls").alias("component_id"), "cls", F.coalesce("links", F.lit(0).cast("long")).alias("links"), "text_hash")


def one_of_each(docs: DataFrame, percent: int = 90, width: int = 3) -> DataFrame:
    """The documents that stand for their component (the smallest id), and those without words or id, with all their columns,
    whatever these are called. Of rows that share an id each goes or stays by its own text; repeated rows go or stay together."""
    d, h = unused(docs, "d", "h")
    out = stored(linked_documents(docs, percent, width).where("component_id <> doc_id").select("doc_id", "text_hash").distinct().toDF(d, h), "copies")
    return docs.join(small(out, 1_000_000), (docs["doc_id"] == F.col(d)) & (F.xxhash64(docs["text"]) == F.col(h)), "left_anti")
