"""The Jaccard join, components and sharding against plain Python."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from leafmark.llm import jaccard, sharding
from leafmark.llm.components import components
from llm.conftest import ODD, make


def brute(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def family(rnd, n, words, edits):
    base = [f"w{rnd.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rnd.randint(0, edits)):
            w[rnd.randrange(len(w))] = f"e{rnd.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_components_of_links(spark, width, percent):
    rnd = random.Random(percent)
    texts = [x for k in range(12) for x in family(rnd, 8, rnd.choice([6, 11, 14, 20, 21, 40, 90, 200]), 3)]
    passage = " ".join(f"p{k}" for k in range(60))
    texts += [f"{passage} {' '.join(f'q{rnd.randrange(10**6)}' for _ in range(50))}" for _ in range(40)]  # share much, link with nothing
    texts += ["a b c d e f g h i j k", "A B C D E F G H I J K", "a b c d e f g h i j k l", None, "", "one two", "One two"]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.linked_documents(make(spark, texts), percent, width).collect()}
    assert got == brute(list(enumerate(texts)), width, percent)


def test_blocks_over_the_limit(spark, monkeypatch):
    rnd = random.Random(9)
    texts = family(rnd, 60, 80, 2) + family(rnd, 60, 80, 2)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 10)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.linked_documents(make(spark, texts), 90, 3).collect()}
    assert got == brute(list(enumerate(texts)), 3, 90)


def test_number_of_links(spark):
    rnd = random.Random(10)
    texts = family(rnd, 12, 100, 2)
    sets = [set(zip(w, w[1:], w[2:])) for w in (t.split() for t in texts)]
    classes = {frozenset(s) for s in sets}
    want = {i: sum(c != s and 100 * len(c & s) >= 90 * len(c | s) for c in classes) for i, s in enumerate(sets)}
    assert {r.doc_id: r.links for r in jaccard.linked_documents(make(spark, texts)).collect()} == want


@pytest.mark.parametrize("block", [2_000, 5])
def test_number_of_links_of_short_texts(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", block)
    rnd = random.Random(16)
    texts = family(rnd, 40, 16, 1) + family(rnd, 30, 14, 1) + family(rnd, 30, 45, 1)
    sets = [frozenset(zip(w, w[1:], w[2:])) for w in (t.split() for t in texts)]
    classes = set(sets)
    for percent in (80, 90):
        want = {i: sum(c != s and 100 * len(c & s) >= percent * len(c | s) for c in classes) for i, s in enumerate(sets)}
        assert {r.doc_id: r.links for r in jaccard.linked_documents(make(spark, texts), percent).collect()} == want


def test_parts_without_a_common_list_are_not_compared(spark, monkeypatch):
    """A chain of families: the tasks grow with the parts, not with their square."""
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 10)
    chain = [(c, k) for c in range(1000) for k in (c // 4, c // 4 + 1)]
    about = spark.createDataFrame([(c, 50, 0) for c in range(1000)], "cls long, n long, family long")
    stood = spark.createDataFrame(chain, "cls long, key long").selectExpr("cls", "key * 36028797018963968 as key")
    parts, tasks = jaccard._dealt(about, stood)
    part = {r.cls: r.part for r in parts.collect()}
    named = {(r.left, r.right) for r in tasks.collect()}
    met = defaultdict(set)
    for r in stood.collect():
        met[r.key].add(part[r.cls])
    assert len(part) == 1000 and max(Counter(part.values()).values()) <= 11
    assert named == {(a, b) for ps in met.values() for a in ps for b in ps if a <= b} and len(named) < 1500


def test_one_row_of_each(spark):
    """Rows that share an id go or stay by their own text."""
    rnd = random.Random(17)
    para = lambda: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(60))
    a, b, c = para(), para(), para()
    kept = jaccard.one_of_each(make(spark, [a, a, b, c, c], [1, 2, 2, 3, 3])).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(1, a), (2, b), (3, c), (3, c)])


def test_hot_bits(spark):
    keys = [0, 1, 32767, 32768, (1 << jaccard.HOT_BITS) - 1, -1, 5 - (1 << 40), 2**63 - 1]
    bits = jaccard._hot_bits(spark.createDataFrame([(k,) for k in keys], "key long"))
    on = {i * 8 + j for i in bits.nonzero()[0].tolist() for j in range(8) if bits[i] >> j & 1}
    assert on == {k & ((1 << jaccard.HOT_BITS) - 1) for k in keys}


def test_boundary_is_where_cost_turns():
    assert jaccard.boundary(90, {s: 100 for s in range(5, 60)}) > 10
    assert jaccard.boundary(90, {}) == 1


def test_join_of_odd_rows(spark, odd):
    out = jaccard.linked_documents(odd).collect()
    assert len(out) == len(ODD) + 3
    assert {r.component_id for r in out if r.doc_id in (4, 5)} == {4} and {r.component_id for r in out if r.doc_id in (6, 7)} == {6}
    assert {r.component_id for r in out if r.doc_id is None} == {None}
    kept = jaccard.one_of_each(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.select("doc_id").collect() if r.doc_id is not None) == [k for k in range(len(ODD)) if k not in (5, 7)]
    assert jaccard.linked_documents(odd.limit(0)).count() == 0


def test_components(spark):
    rnd = random.Random(11)
    edges = [(k, k + 1) for k in range(300)] + [(1000, 1000 + k) for k in range(1, 200)] + [(rnd.randrange(2000, 2300), rnd.randrange(2000, 2300)) for _ in range(150)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    top = {x: x for e in edges for x in e}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        top[max(x, y)] = min(x, y)
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def check(rows, texts, shards):
    assert len(rows) == len(texts)
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(shards)) <= 1
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))


def test_shards(spark):
    rnd = random.Random(12)
    texts = [f"alone {k}" for k in range(300)] + [f"pair {k % 60}" for k in range(120)] + ["hot"] * 260 + [None] * 20 + [""] * 3
    rnd.shuffle(texts)
    rows = sharding.shard(make(spark, texts)).collect()
    check(rows, texts, 8)
    for r in rows:
        t = texts[r.doc_id]
        assert r.size == len((t or "").encode()) + 1 and r.text_crc32 == zlib.crc32((t or "").encode()) and r.law == "rows" and r.grown_shard is None
    where = defaultdict(set)
    for r in rows:
        where[texts[r.doc_id]].add(r.shard)
    pairs = [len(v) for k, v in where.items() if k and k.startswith("pair")]
    assert sum(n == 1 for n in pairs) >= 0.9 * len(pairs)


@pytest.mark.parametrize("sizes,alone", [([100] * 8, 0), ([90, 90, 60, 40, 30], 490), ([250], 550)])
def test_groups_that_fit_a_shard_stay_whole(spark, monkeypatch, sizes, alone):
    monkeypatch.setattr(sharding, "SALT_ROWS", 7)
    texts = [f"group {k}" for k, v in enumerate(sizes) for _ in range(v)] + [f"alone {k}" for k in range(alone)]
    random.Random(13).shuffle(texts)
    rows = sharding.shard(make(spark, texts)).collect()
    check(rows, texts, 8)
    for k, v in enumerate(sizes):
        assert len({r.shard for r in rows if texts[r.doc_id] == f"group {k}"}) == -(-v // 100)


def test_cut_links_are_told(spark):
    texts = [f"pair {k % 60}" for k in range(120)] + ["hot"] * 300 + [f"alone {k}" for k in range(380)]
    out = sharding.shard(make(spark, texts))
    where = defaultdict(Counter)
    for r in out.where("linked").collect():
        where[texts[r.doc_id]][r.shard] += 1
    got = sharding.cut(out, make(spark, texts)).first()
    assert (got.groups, got.split_groups) == (len(where), sum(len(c) > 1 for c in where.values()))
    links = lambda c: sum(c.values()) * (sum(c.values()) - 1) // 2
    assert (got.links, got.cut_links) == (sum(map(links, where.values())), sum(links(c) - sum(n * (n - 1) // 2 for n in c.values()) for c in where.values()))


def by_hand(start, hub, shards):
    """Propagation in plain Python under the same quotas: what no order of moves can bring together stays apart."""
    now = dict(start)
    while True:
        votes = defaultdict(Counter)
        for i, s in now.items():
            if hub[i] is not None:
                votes[hub[i]][s] += 1
        want = {i: max(range(shards), key=lambda s: (votes[hub[i]][s], -s)) for i in now if hub[i] is not None}
        moved = False
        for i in sorted(want):
            if now[i] != want[i]:
                partner = next((j for j in sorted(now) if now[j] == want[i] and (hub[j] is None or want[j] == now[i])), None)
                if partner is not None:
                    now[i], now[partner] = want[i], now[i]
                    moved = True
        if not moved:
            return now


def test_propagation_cuts_no_more_than_by_hand(spark):
    rnd = random.Random(18)
    texts = [f"group {k}" for k in range(25) for _ in range(rnd.randint(2, 9))] + [f"alone {k}" for k in range(150)]
    rnd.shuffle(texts)
    count = Counter(texts)
    hub = {i: t if count[t] > 1 else None for i, t in enumerate(texts)}
    hand = by_hand({i: i % 8 for i in range(len(texts))}, hub, 8)
    got = {r.doc_id: r.shard for r in sharding.shard(make(spark, texts)).collect()}
    split = lambda place: sum(len({place[i] for i in hub if hub[i] == g}) > 1 for g in set(hub.values()) - {None})
    assert split(got) <= split(hand)


def test_quotas():
    assert sharding._quotas({(0, 1): 5, (1, 2): 4, (2, 0): 7}, {}, 3)[0] == {(0, 1): 4, (1, 2): 4, (2, 0): 4}
    assert sharding._quotas({(0, 1): 5, (1, 2): 4}, {2: 3}, 3) == ({(1, 2): 3}, {(2, 1): 3})


def test_shards_of_odd_rows(spark, odd):
    check(sharding.shard(odd).collect(), [*ODD, 0, 0, 0], 8)
    assert sharding.shard(odd.limit(0)).count() == 0
    assert sorted(r.shard for r in sharding.shard(odd.limit(3), shards=2).collect()) in ([0, 0, 1], [0, 1, 1])


def test_a_survey_holds_a_chunk_once(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(3)
    made = [[np.unique(rng.integers(0, 4_000_000, 4000, dtype=np.uint64)) for _ in range(100)] for _ in range(12)]
    left = iter(made)
    monkeypatch.setattr(jaccard, "shingle_sets", lambda texts, width: next(left))
    monkeypatch.setattr(jaccard, "CHUNK", 2_000_000)
    batches = [pa.RecordBatch.from_arrays([pa.array(["t"] * 100)], names=["text"])] * 12
    tracemalloc.start()
    got = list(jaccard._survey(3)(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2.5 * 8 * jaccard.CHUNK
    want = []
    for some in (made[:6], made[6:]):
        key, n = np.unique(np.concatenate([h for sets in some for h in sets]), return_counts=True)
        want.append({(int(k), int(c)) for k, c in zip(key, n) if c > 2})
    assert [{(k, n) for w, k, n in zip(*b.to_pydict().values()) if w == 1} for b in got] == want
    assert all(b.column("what").to_pylist().count(0) == 0 for b in got)


def test_few_texts_at_once(spark, monkeypatch):
    survey = jaccard._survey

    def watched(width):
        def run(batches):
            def short():
                for b in batches:
                    if b.num_rows > 1024:
                        raise ValueError(f"{b.num_rows} texts at once")
                    yield b

            return survey(width)(short())

        return run

    monkeypatch.setattr(jaccard, "_survey", watched)
    rows = spark.range(0, 5000, 1, 1).selectExpr("id as doc_id", "concat('a b c ', id) as text")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    members, _ = jaccard.jaccard_join(rows, 90, 3)
    assert members.count() == 5000 and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_components_take_few_tasks(spark):
    """The driver remembers every task."""
    tracker = spark.sparkContext.statusTracker()

    def tasks(edges):
        spark.sparkContext.setJobGroup(f"components {len(edges)}", "")
        try:
            got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long").coalesce(1)).collect()}
        finally:
            spark.sparkContext._jsc.clearJobGroup()
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(f"components {len(edges)}")]
        return got, sum(tracker.getStageInfo(k).numTasks for j in jobs for k in j.stageIds if tracker.getStageInfo(k) and tracker.getStageInfo(k).numCompletedTasks)

    stars, few = tasks([(k + 1000, k % 5) for k in range(200)])
    path, more = tasks([(k + 1, k) for k in range(300)])
    assert stars == {k + 1000: k % 5 for k in range(200)} | {k: k for k in range(5)}
    assert path == dict.fromkeys(range(301), 0)
    assert few < more / 4 and few <= 20
