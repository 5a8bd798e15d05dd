"""Sharding by balanced label propagation.

Every document starts in a shard by its rank, so counts are at most one apart. In each round a join brings every linked
document the shard where most of its group stands; documents that want to move are let go under quotas: as many leave a
shard as come to it, by wish in cycles of any length or (documents without links) to make room, so the balance law holds
all the time. Rounds go on until one grants nothing; each one before brings more documents to their group.
Groups are equal texts; a group joins a hub instead of being linked pair by pair. Only a group of more documents than a
shard holds is cut, into as few hubs as hold it. Hubs of a sixteenth of a shard or more, 16 a shard at most, are first
packed into shards, the largest first; the others wish for shards that these leave open.

Law "rows": shard counts are at most one apart. A null text counts no bytes and has no links. Repeated rows are rows of
their own and hold a slot each; null ids are placed like others. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmark.llm.common import dropped, ranked, small, stored

#: Rows that one ranking bucket holds about.
BUCKET_ROWS = 20_000
#: Documents of a hub that are joined to its wish in one piece; larger hubs are salted.
SALT_ROWS = 1_000
#: A hub of this share of a shard is packed by its size.
LARGE = 1 / 16


def with_groups(docs: DataFrame, shards: int) -> DataFrame:
    """Stored (doc_id, size, crc, hub, members): hub, and how many documents it has, are null for documents without an equal."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    rows = docs.select("doc_id", size.alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("crc"), F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("key"))
    rows = stored(rows, "sizes")
    n = rows.count()
    hub_rows = max(1, -(-n // shards))
    groups = rows.where(F.col("key").isNotNull()).groupBy("key", "crc", "size").agg(F.count("*").alias("members")).where("members > 1")
    groups = stored(groups, "groups")
    linked = rows.join(small(groups), ["key", "crc", "size"], "left")
    large = ranked(linked.where(F.col("members") > hub_rows), ["key", "crc", "size"], [F.col("doc_id")], max(1, n // BUCKET_ROWS), "place")
    parts = F.ceil(F.col("members") / hub_rows)
    hub = lambda part: F.struct("key", "crc", "size", part.cast("long").alias("part"))
    whole = linked.where(F.col("members").isNull() | (F.col("members") <= hub_rows))
    whole = whole.select("doc_id", "size", "crc", F.when(F.col("members").isNotNull(), hub(F.lit(0))).alias("hub"), "members")
    # parts are dealt in turn, so the first of them have one document more
    part, size = F.col("place") % parts, (F.col("members") / parts).cast("long")
    out = whole.unionByName(large.select("doc_id", "size", "crc", hub(part).alias("hub"), (size + (part < F.col("members") % parts).cast("long")).alias("members")))
    out = stored(out.withColumn("hub", F.when(F.col("hub").isNotNull(), F.xxhash64("hub"))), "hubs")
    dropped(rows, groups)
    return out


def _homes(now: DataFrame, n: int, shards: int) -> tuple[dict[int, int], list[int]]:
    """Shards of the large hubs, each where it fits best, and the shards that have room for any other hub."""
    least = LARGE * n / shards
    votes = now.where(F.col("members") >= least).groupBy("hub", "members", "shard").count().collect()  # 16 x shards x shards numbers at most
    room = [n // shards + (s < n % shards) for s in range(shards)]
    here = {(r.hub, r.shard): r["count"] for r in votes}
    homes = {}
    for size, hub in sorted({(-r.members, r.hub) for r in votes}):
        fits = [s for s in range(shards) if room[s] >= -size]
        best = min(fits, key=lambda s: (room[s], -here.get((hub, s), 0))) if fits else max(range(shards), key=lambda s: room[s])
        homes[hub] = best
        room[best] += size
    return homes, [s for s in range(shards) if room[s] >= least]


def propagate(rows: DataFrame, shards: int, rounds: int | None = None) -> DataFrame:
    """rows(doc_id, size, crc, hub, members) with shard; counts at most one apart in every round."""
    n = rows.count()
    buckets = max(1, n // BUCKET_ROWS)
    start = ranked(rows, [], [F.xxhash64("doc_id"), F.col("doc_id"), F.col("crc"), F.col("size")], buckets, "place")
    now = stored(start.select("doc_id", "size", "crc", "hub", "members", F.col("place").alias("id"), (F.col("place") % shards).cast("int").alias("shard")), "round")
    homes, open_ = _homes(now, n, shards)
    salts = F.ceil(F.col("members") / SALT_ROWS)
    done = 0
    while rounds is None or done < rounds:
        done += 1
        votes = now.where(F.col("hub").isNotNull()).groupBy("hub", "members", "shard").count()
        # ties fall by hash, so that wishes to and from a shard are about as many
        wish = votes.groupBy("hub", "members").agg(F.max_by("shard", F.struct(F.col("shard").isin(open_), "count", F.xxhash64("hub", "shard"))).alias("want"))
        if homes:
            home = F.create_map(*[F.lit(x) for hub, s in homes.items() for x in (hub, s)])
            wish = wish.withColumn("want", F.coalesce(F.try_element_at(home, "hub"), "want"))
        wish = wish.select("hub", "want", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"))
        # documents without links have no key to be joined on, and would all meet in one task
        alone = now.where(F.col("hub").isNull()).withColumn("want", F.lit(None).cast("int"))
        wants = now.where(F.col("hub").isNotNull()).withColumn("salt", F.pmod("id", salts)).join(wish, ["hub", "salt"]).drop("salt").withColumn("want", F.when(F.col("want") != F.col("shard"), F.col("want"))).unionByName(alone)
        wants = stored(wants, "wishes")
        # (a, b, moving, spare): wishes from a to b, and documents in a that may go anywhere
        wishes = wants.where(F.col("want").isNotNull()).groupBy(F.col("shard").alias("a"), F.col("want").alias("b")).agg(F.count("*").alias("moving"))
        spare = wants.where(F.col("hub").isNull()).groupBy(F.col("shard").alias("a")).agg(F.count("*").alias("spare"))
        granted, sent = _quotas({(r.a, r.b): r.moving for r in wishes.collect()}, {r.a: r.spare for r in spare.collect()}, shards)  # shards x shards numbers
        if not any(granted.values()):
            dropped(wants)
            break
        # movers by wish: the first `granted` of each pair; spares of a: consecutive ranges of ranks, one for each b
        order = [F.xxhash64("id"), F.col("id")]
        movers = ranked(wants.where(F.col("want").isNotNull()), ["shard", "want"], order, buckets, "place")
        quota = F.create_map(*[F.lit(x) for (a, b), v in granted.items() for x in (a * shards + b, v)])
        movers = movers.withColumn("shard", F.when(F.col("place") < F.coalesce(quota[F.col("shard") * shards + F.col("want")], F.lit(0)), F.col("want")).otherwise(F.col("shard")))
        spares = ranked(wants.where(F.col("hub").isNull()), ["shard"], order, buckets, "place")
        to = F.col("shard")
        for a in range(shards):
            low = 0
            for b in range(shards):
                if v := sent.get((a, b), 0):
                    to = F.when((F.col("shard") == a) & (F.col("place") >= low) & (F.col("place") < low + v), F.lit(b)).otherwise(to)
                    low += v
        spares = spares.withColumn("shard", to.cast("int"))
        still = wants.where(F.col("want").isNull() & F.col("hub").isNotNull())
        columns = ["doc_id", "size", "crc", "hub", "members", "id", "shard"]
        after = stored(movers.select(columns).unionByName(spares.select(columns)).unionByName(still.select(columns)), "round")
        dropped(now, wants)
        now = after
    return now


def _quotas(wishes: dict[tuple[int, int], int], spare: dict[int, int], shards: int) -> tuple[dict, dict]:
    """How many wishes from a to b are granted, and how many documents without links go from a to b, so that every shard
    gives as many as it takes. Cycles of wishes are granted first, the shortest first; what is left is granted along paths
    to a shard with spares, which pay for it. Nothing more can be granted then."""
    granted, sent, want, left = {}, {}, dict(wishes), dict(spare)
    for paid in (False, True):
        while path := _path(want, left if paid else None, shards):
            steps = list(zip(path, path[1:]))
            v = min(want[e] for e in steps)
            if paid:
                v = min(v, left[path[-1]])
                left[path[-1]] -= v
                sent[path[-1], path[0]] = sent.get((path[-1], path[0]), 0) + v
            for e in steps:
                want[e] -= v
                granted[e] = granted.get(e, 0) + v
    return granted, sent


def _path(want: dict[tuple[int, int], int], left: dict[int, int] | None, shards: int) -> list[int] | None:
    """The shortest way along wishes from a shard back to itself, or (with left) to another one that has spares."""
    best = None
    for a in range(shards):
        ways, seen = [[a]], {a}
        while ways and (best is None or len(ways[0]) < len(best)):
            longer = []
            for way in ways:
                for b in (b for b in range(shards) if want.get((way[-1], b), 0) > 0):
                    if (b == a) if left is None else (b != a and left.get(b, 0) > 0):
                        if best is None or len(way) + 1 < len(best):
                            best = [*way, b]
                    elif b not in seen:
                        seen.add(b)
                        longer.append([*way, b])
            ways = longer
    return best


def shard(docs: DataFrame, shards: int = 8, rounds: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard by the law "rows"."""
    rows = with_groups(docs, shards)
    placed = propagate(rows, shards, rounds)
    n = placed.count()
    out = ranked(placed, ["shard"], [F.xxhash64("id"), F.col("id")], max(1, n // BUCKET_ROWS // shards), "slot")
    return out.select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("hub").isNotNull().alias("linked"))


def cut(placed: DataFrame, docs: DataFrame) -> DataFrame:
    """One row: groups of equal texts, groups that stand in several shards, links (pairs of equal documents), cut links. placed: of
    shard(docs); equal documents have equal size and checksum, and are told apart beyond that by their text's hash."""
    key = docs.where("text is not null").select(F.col("doc_id").alias("i"), F.xxhash64("text").alias("key"), F.crc32("text").alias("c"))
    rows = placed.where("linked").join(key, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_crc32") == F.col("c")))
    here = rows.groupBy("key", "size", "text_crc32", "shard").agg(F.countDistinct("shard", "slot").alias("n"))
    pairs = lambda n: n * (n - 1) / 2
    groups = here.groupBy("key", "size", "text_crc32").agg(F.sum("n").alias("all"), F.count("*").alias("shards"), F.sum(pairs(F.col("n"))).alias("kept"))
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return groups.agg(F.count("*").alias("groups"), F.count_if(F.col("shards") > 1).alias("split_groups"), whole(pairs(F.col("all"))).alias("links"), whole(pairs(F.col("all")) - F.col("kept")).alias("cut_links"))
