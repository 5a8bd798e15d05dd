"""Ranked search against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from llm.conftest import ODD, make
from leafmark.llm import ranked_search
from leafmark.llm.common import stored

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=20):
    """(item, rank, doc, score) by the formula, document after document."""
    tallies = [(d, Counter(terms(t))) for d, t in docs]
    tallies = [(d, c) for d, c in tallies if c]
    n, total = len(tallies), sum(sum(c.values()) for _, c in tallies)
    df = Counter(t for _, c in tallies for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in tallies:
            m = 75 + 25 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, rank, None if none else d, -s) for rank, (s, none, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def told(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


def items_of(spark, items):
    return spark.createDataFrame([(i, t, "a", 1, 2, 3) for i, t in items], "item_id string, text string, key string, score long, rank int, doc_id long")


@pytest.mark.parametrize("seed", range(6))
def test_best_of_a_grid(seed):
    rng = np.random.default_rng(seed)
    n_rows, n_columns = int(rng.integers(1, 90)), int(rng.integers(1, 300))
    grid = rng.integers(1, 40 if seed % 2 else 1000, (n_rows, n_columns)) * (rng.random((n_rows, n_columns)) < 0.2)
    grid[0, 0] = 1
    r, c = np.nonzero(grid)
    made = ranked_search.Treap.of(r, c, grid[r, c])
    treap = ranked_search.Treap.unpack(*made.pack())
    assert np.array_equal(treap.maxima, made.maxima) and np.array_equal(treap.masks, made.masks)
    for k in (1, 5, 20, 1000):
        rows = np.array(sorted(rng.choice(n_rows, min(n_rows, 12), replace=False)))
        weights = rng.integers(0, 9, len(rows))
        scores = (grid[rows] * weights[:, None]).sum(0)
        kept = sorted(scores[scores > 0], reverse=True)[:k]
        want = {(int(s), i) for i, s in enumerate(scores) if s > 0 and (len(kept) < k or s >= kept[-1])}
        assert set(treap.best(rows, weights, k)) == want
        floor = kept[0] if kept else 1
        assert set(treap.best(rows, weights, k, int(floor))) == {x for x in want if x[0] >= floor}


def test_steps_beyond_a_byte():
    steps = np.array([0, 254, 255, 256, 2**20, 3], np.uint32)
    assert np.array_equal(ranked_search._get_steps(ranked_search._put_steps(steps)), steps)


def collection(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(4000)] + ["Ünï", "中文", "A1b2"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 60))) for _ in range(250)]
    texts += [texts[3]] * 40 + ["only here", "ONLY-here; only", None, ""]
    return list(zip([*range(len(texts) - 2), None, 7], texts))


@pytest.mark.parametrize("blocks", [(4096, 2_000_000), (16, 2_000_000), (4096, 90)])
def test_small_blocks_and_batches(spark, blocks):
    docs = collection(1)
    items = [("a", docs[3][1]), ("b", "only here"), ("b", "W1 w1 w1 w2"), ("c", None), (None, docs[10][1]), ("d", "  ;; "), ("e", "nowhere-to-be-found"), ("f", "ünÏ 中文 a1B2")]
    df = make(spark, [t for _, t in docs], [d for d, _ in docs])
    n, total = ranked_search.totals(df)
    index = stored(ranked_search.build(df, n, total, *blocks), "index")
    assert index.count() >= (3 if blocks[0] == 4096 and blocks[1] > 90 else 15)
    got = told(ranked_search.search(index, items_of(spark, items), n, 20, batch_bytes=400))
    assert got == brute(docs, items)


def test_odd_documents_and_items(spark, odd):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    items = [(str(i), t) for i, t in enumerate(ODD)] + [("x", "null id text"), ("x", "null id text")]
    assert told(ranked_search.ranked(odd, items_of(spark, items))) == brute(docs, items)


def test_empty_tables(spark):
    docs = make(spark, ["some words", None])
    items = items_of(spark, [("a", "some")])
    assert ranked_search.ranked(docs.limit(0), items).collect() == []
    assert ranked_search.ranked(docs.where("text is null"), items).collect() == []
    assert ranked_search.ranked(docs, items.limit(0)).collect() == []
    assert told(ranked_search.ranked(docs, items)) == brute([(0, "some words"), (1, None)], [("a", "some")])
