"""Matrix products against the scores of all pairs of tokens."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import SF
from leafmark.operators import products, retrieval, vectors
from leafmark.plans.queries import QUERIES


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def by_pairs(q, tokens):
    s = retrieval.token_scores(q, tokens).groupBy("query_id", "tok", "chunk_id").agg(F.max("s").alias("s"))
    return s.groupBy("query_id", "chunk_id").agg(F.sum("s").alias("score"))


def told(df):
    return sorted(repr((r.query_id, r.chunk_id, r.score if r.score is None else round(r.score, 6) + 0.0)) for r in df.collect())


@pytest.fixture(scope="module")
def odd(spark):
    """Chunks of 1 to 6 vectors; some null, of another length, holding null or NaN, and null ids."""
    rnd = random.Random(8)
    vec = lambda: [rnd.gauss(0, 1) for _ in range(4)]
    rows = [(c, t, vec()) for c in range(30) for t in range(c % 6 + 1)]
    rows += [(40, 0, None), (41, 0, None), (41, 1, vec()), (42, 0, [1.0, None, 0.0, 0.0]), (43, 0, [1.0, 2.0]), (44, 0, [float("nan"), 0.0, 0.0, 1.0]), (44, 1, vec()), (None, 0, vec()), (None, 1, vec())]
    ask = [(i, t, vec()) for i in range(7) for t in range(i % 3 + 1)] + [(8, 0, None), (9, 0, vec()), (9, 1, None)]
    schema = "{} long, tok long, vec array<double>"
    return spark.createDataFrame(ask, schema.format("query_id")), spark.createDataFrame(rows, schema.format("chunk_id")).repartition(3)


def test_token_level_makes_no_row_for_a_pair_of_tokens(spark):
    plan = plan_of(QUERIES["op_re3"](spark, SF))
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("k", [1, 3, 50])
def test_token_level_of_odd_vectors(odd, k):
    q, tokens = odd
    near = retrieval.token_scores(q, tokens).selectExpr("*", "row_number() over (partition by query_id, tok order by round(s, 9) desc, chunk_id, doc_tok) as r").where(F.col("r") <= 5 * k).select("query_id", "chunk_id").distinct()
    want = retrieval.top(by_pairs(q, tokens).join(near, ["query_id", "chunk_id"]), k)
    columns = ["query_id", "rank", "chunk_id", F.round("score", 6).alias("score")]
    assert sorted(map(repr, retrieval.token_level(q, tokens, k).select(columns).collect())) == sorted(map(repr, want.select(columns).collect()))


@pytest.mark.parametrize("name", ["op_re2", "op_re6", "op_re7", "op_re10"])
def test_two_stage_makes_no_row_for_a_pair_of_tokens(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_blocks_of_queries_find_the_same(odd, monkeypatch):
    q, tokens = odd
    want = retrieval.two_stage(q, vectors.pooled(tokens.where("chunk_id < 40"), 2, 2), tokens, 2, 3).collect()
    monkeypatch.setattr(products.query_blocks, "__defaults__", (3,))
    monkeypatch.setattr(products, "HELD", 1)
    monkeypatch.setattr(products, "SLICE_CHUNKS", 4)
    got = retrieval.two_stage(q, vectors.pooled(tokens.where("chunk_id < 40"), 2, 2), tokens, 2, 3).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(want) >= 14


def test_all_scores_come_from_where_the_chunks_are(spark):
    plan = plan_of(QUERIES["op_re1"](spark, SF))
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_all_scores_of_odd_vectors(odd):
    q, tokens = odd
    assert told(retrieval.max_sim(q, tokens)) == told(by_pairs(q, tokens))
    pairs = by_pairs(q, tokens).where("(query_id + chunk_id) % 3 = 0")
    assert told(retrieval.max_sim(q, tokens, pairs)) == told(pairs)


def test_a_chunk_that_very_many_queries_ask_for_comes_in_several_rows(spark, odd, monkeypatch):
    q, tokens = odd
    monkeypatch.setattr(products, "ASKED", 2)
    pairs = by_pairs(q, tokens).where("chunk_id < 5")
    block = next(products.query_blocks(q))
    lists = [r.asked for r in products.asked(block, pairs).collect()]
    assert max(map(len, lists)) < len(block.ids) and sum(map(len, lists)) == pairs.count()
    assert told(retrieval.max_sim(q, tokens, pairs)) == told(pairs)


def test_a_task_holds_little_for_a_full_block(monkeypatch):
    """5,000 queries of four tokens, a batch of 3,000 chunks that 450 of them ask for each."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    n, chunks = 5_000, 3_000
    block = type("Shared", (), {"value": products.Queries(np.arange(n), np.arange(n) * 4, rng.normal(size=(4 * n, 8)), np.ones(4 * n, bool))})
    lists = lambda values, each: pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, each), pa.int32()), values)
    vecs = lists(lists(pa.array(rng.normal(size=chunks * 5 * 8)), 8), 5)
    asked = lists(pa.array(rng.integers(0, n, chunks * 450)), 450)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(chunks)), vecs, asked], names=["chunk_id", "vecs", "asked"])
    found = {}
    for task in (products._score_all, products._score_asked):
        tracemalloc.start()
        found[task] = [b.num_rows for b in task(block, 10)(iter([batch]))]
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 64 << 20, (task, peak >> 20)
    assert sum(found[products._score_all]) == 10 * n
