"""The stored layout of vectors, its matrix products and pruned reads, and prefetch by hashing."""

import numpy as np
import pytest

from leafmark.operators import lsh, retrieval, token_store, vectors
from leafmark.operators.lsh import Lsh

TOKENS = "chunk_id long, tok long, vec array<float>"


def unit(v):
    return v / np.linalg.norm(v, axis=-1, keepdims=True)


@pytest.fixture(scope="module")
def ragged(spark):
    """Chunks of 1 to 40 tokens, ids with gaps, two chunks alike."""
    rng = np.random.default_rng(4)
    rows = []
    for c in [*range(0, 60), *range(500, 540), 10_000]:
        rows += [(c, t, v) for t, v in enumerate(unit(rng.normal(size=(int(rng.integers(1, 40)), 12))).tolist())]
    rows += [(77, t, v) for c, t, v in rows if c == 3]
    return spark.createDataFrame(rows, TOKENS).repartition(4)


@pytest.fixture(scope="module")
def asked(spark):
    rng = np.random.default_rng(5)
    return spark.createDataFrame([(q, t, v) for q in range(9) for t, v in enumerate(unit(rng.normal(size=(q % 4 + 1, 12))).tolist())], "query_id long, tok long, vec array<float>")


def told(df):
    return {(r.query_id, r.chunk_id): round(r.score, 6) for r in df.collect()}


@pytest.mark.parametrize("span", [None, 7, 100_000])
def test_block_scores_are_max_sim(spark, ragged, asked, tmp_path, span):
    store = token_store.write(ragged, f"{tmp_path}/t", span=span)
    again = token_store.read(spark, f"{tmp_path}/t")
    assert (again.span, again.kinds) == (store.span, False)
    want = told(retrieval.max_sim(asked, ragged))
    assert told(token_store.block_scores(asked, again.rows())) == want
    assert told(token_store.block_scores(asked, store.rows(), block=3)) == want


def test_tasks_give_back_the_best_alone(spark, ragged, asked, tmp_path):
    store = token_store.write(ragged, f"{tmp_path}/t", span=20)
    want = retrieval.top(retrieval.max_sim(asked, ragged), 5).collect()
    rows = store.rows().repartition(3)
    some = token_store.block_scores(asked, rows, 5)
    assert some.count() <= 9 * 5 * 3 < 9 * ragged.select("chunk_id").distinct().count()
    assert {(r.query_id, r["rank"], r.chunk_id) for r in retrieval.top(some, 5).collect()} == {(r.query_id, r["rank"], r.chunk_id) for r in want}


def test_candidates_are_scored_alone(spark, ragged, asked, tmp_path):
    store = token_store.write(ragged, f"{tmp_path}/t", span=20)
    pairs = spark.createDataFrame([(0, 3), (0, 77), (5, 3), (8, 510), (8, 10_000), (2, 99_999), (99, 3)], "query_id long, chunk_id long")
    all_ = told(retrieval.max_sim(asked, ragged))
    want = {p: all_[p] for p in [(0, 3), (0, 77), (5, 3), (8, 510), (8, 10_000)]}
    assert told(token_store.candidate_scores(asked, store, pairs)) == want
    assert told(token_store.candidate_scores(asked, store, pairs, block=2)) == want
    assert token_store.candidate_scores(asked, store, pairs.limit(0)).collect() == []
    every = asked.select("query_id").distinct().crossJoin(ragged.select("chunk_id").distinct())
    some = token_store.candidate_scores(asked, store, every, k=3)
    best = lambda df: {(r.query_id, r["rank"], r.chunk_id) for r in retrieval.top(df, 3).collect()}
    assert best(some) == best(retrieval.max_sim(asked, ragged)) and some.count() < len(all_)


def read_by_scan(df):
    """Files and rows that the scan of a plan without shuffles has read."""
    df.collect()
    m = df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics()
    return m.apply("numFiles").value(), m.apply("numOutputRows").value()


def test_a_read_of_candidates_prunes_folders_and_row_groups(spark, tmp_path):
    n = 6400
    tokens = spark.range(n * 2).selectExpr("id div 2 as chunk_id", "id % 2 as tok", "array(cast(id as double), 1d) as vec")
    store = token_store.write(tokens, f"{tmp_path}/t", span=640)
    ids = spark.createDataFrame([(5,), (6,), (1300,), (6399,)], "chunk_id long")
    files, rows = read_by_scan(store.of(ids))
    assert files == 3 and rows <= 4 * 40 * 2 < n / 10
    plan = store.of(ids)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PushedFilters: [" in plan and "GreaterThanOrEqual(chunk_id" in plan
    assert {r.chunk_id for r in store.of(ids).collect()} >= {5, 6, 1300, 6399}


def test_many_runs_prune_by_folder(spark, tmp_path, monkeypatch):
    tokens = spark.range(-500, 500).selectExpr("id as chunk_id", "0L as tok", "array(1d, cast(id as double)) as vec")
    store = token_store.write(tokens, f"{tmp_path}/t", span=10)
    ids = spark.range(-205, 200, 20).selectExpr("id as chunk_id")
    want = {i // 10 for i in range(-205, 200, 20)}
    monkeypatch.setattr(token_store, "RUNS", 3)
    assert {r.chunk_id // 10 for r in store.of(ids).collect()} == want
    assert read_by_scan(store.of(ids))[0] == len(want)
    monkeypatch.setattr(token_store, "FOLDERS", 3)
    assert {r.chunk_id // 10 for r in store.of(ids).collect()} == want


def test_vectors_that_are_missing(spark, asked, tmp_path):
    tokens = spark.createDataFrame([(1, 0, None), (2, 0, [1.0] * 12), (None, 0, [1.0] * 12)], TOKENS)
    store = token_store.write(tokens, f"{tmp_path}/t")
    assert {r.chunk_id for r in token_store.block_scores(asked, store.rows()).collect()} == {2}
    none = token_store.write(tokens.limit(0), f"{tmp_path}/none")
    assert token_store.block_scores(asked, none.rows()).collect() == []
    assert token_store.block_scores(asked.limit(0), store.rows(), 3).collect() == []


@pytest.fixture(scope="module")
def clustered(spark):
    """400 chunks around 40 directions: 4 image tokens and a prefix token each. Queries are tokens of every hundredth vector."""
    rng = np.random.default_rng(7)
    centres = unit(rng.normal(size=(40, 64)))
    rows = [(c, t, v) for c in range(400) for t, v in enumerate(unit(centres[c % 40] + 0.05 * rng.normal(size=(5, 64))).tolist())]
    tokens = spark.createDataFrame(rows, TOKENS)
    return tokens, tokens.where("(chunk_id * 5 + tok) % 100 < 4").selectExpr("(chunk_id * 5 + tok) div 100 as query_id", "tok", "vec")


def test_neighbours_are_found_by_reading_few_chunks(spark, clustered, tmp_path):
    tokens, queries = clustered
    pooled = vectors.pooled(tokens, 2, 2)
    planes = Lsh(bits=15, tables=5, turns=3)
    lsh.write_index(pooled, f"{tmp_path}/lsh", planes)
    index = lsh.read_index(spark, f"{tmp_path}/lsh")
    assert index.select("chunk_id").distinct().count() == 400 and index.select("tab").distinct().count() == 5
    near = lsh.candidates(queries, index, planes)
    n = queries.select("query_id").distinct().count()
    assert near.count() < 0.25 * n * 400
    p, t = token_store.write(pooled, f"{tmp_path}/p"), token_store.write(tokens, f"{tmp_path}/t")
    found = lsh.two_stage(queries, index, p, t, 5, lsh=planes).collect()
    exact = retrieval.two_stage(queries, pooled, tokens, 5).collect()
    shared = {(r.query_id, r.chunk_id) for r in found} & {(r.query_id, r.chunk_id) for r in exact}
    assert len(shared) >= 0.95 * len(exact)
    scores = {(r.query_id, r.chunk_id): round(r.score, 6) for r in exact}
    assert all(scores[r.query_id, r.chunk_id] == round(r.score, 6) for r in found if (r.query_id, r.chunk_id) in scores)
    got = lsh.recall(spark.createDataFrame(found), spark.createDataFrame(exact)).agg({"recall": "avg"}).first()[0]
    assert abs(got - len(shared) / len(exact)) < 1e-9


def test_a_search_behind_the_index(spark, clustered, tmp_path):
    tokens, queries = clustered
    pooled, planes = vectors.pooled(tokens, 2, 2), Lsh(bits=15, tables=5, turns=3)
    lsh.write_index(pooled, f"{tmp_path}/lsh", planes)
    p, t = token_store.write(pooled, f"{tmp_path}/p"), token_store.write(tokens, f"{tmp_path}/t")
    chunks = tokens.selectExpr("chunk_id", "'c' as collection", "concat('t', chunk_id) as section_title").distinct()
    found = {r.query_id: r.results for r in retrieval.search(queries, p, t, chunks, 1, find=lsh.finder(lsh.read_index(spark, f"{tmp_path}/lsh"), planes)).collect()}
    exact = {r.query_id: r.results for r in retrieval.search(queries, p, t, chunks, 1, find=token_store.two_stage).collect()}
    assert len(exact) == 20 and found == exact


def test_recall_on_the_given_vectors(spark):
    """Random directions without neighbours, the hardest case: one in a hundred rows against all rows."""
    from leafmark.plans.queries import QUERIES

    rows = QUERIES["op_re2_lsh_recall"](spark, "/root/testdata/sf0.1").collect()
    assert len(rows) == 20 and sum(r.recall for r in rows) / 20 >= 0.9


def test_probes_are_the_nearest_buckets():
    h = Lsh(bits=6, tables=3, turns=2)
    v = unit(np.random.default_rng(1).normal(size=(50, 9)))
    m = h.margins(v)
    probes = h.probes(m)
    assert probes.shape == (50, 3, 4) and np.array_equal(probes[:, :, 0], h.buckets(m))
    for i, t in np.ndindex(50, 3):
        low = [1 << b for b in np.argsort(np.abs(m[i, t]))[:2]]
        own = probes[i, t, 0]
        assert set(probes[i, t]) == {own, own ^ low[0], own ^ low[1], own ^ low[0] ^ low[1]}


def test_queries_in_blocks_find_the_same(spark, clustered, tmp_path, monkeypatch):
    tokens, queries = clustered
    lsh.write_index(vectors.pooled(tokens, 2, 2), f"{tmp_path}/lsh")
    index = lsh.read_index(spark, f"{tmp_path}/lsh")
    whole = {tuple(r) for r in lsh.candidates(queries, index).collect()}
    monkeypatch.setattr(lsh, "PROBES", 20 * 8 * 7)
    assert {tuple(r) for r in lsh.candidates(queries, index).collect()} == whole
