"""Every registered query with SQL against DuckDB, and plans."""

import pytest

from conftest import SF
from helpers import same
from leafmark.plans.oracles import ORACLES
from leafmark.plans.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    same(QUERIES[name](spark, SF), duck, ORACLES[name])


def test_interval_join_is_an_equi_join(spark):
    plan = QUERIES["op_se2"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "SortMergeJoin" in plan or "BroadcastHashJoin" in plan


def test_label_filter_reaches_the_scan(spark, tmp_path):
    from leafmark.operators import elements
    from leafmark.plans.fixtures import view

    view(spark, SF, "fx_elements").write.parquet(f"{tmp_path}/e")
    plan = elements.of_labels(spark.read.parquet(f"{tmp_path}/e")).select("doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(label" in plan
    assert "ocr" not in plan.split("ReadSchema:")[1]


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_batches_are_within_budget(spark):
    rows = QUERIES["op_ve2"](spark, SF).collect()
    by = {}
    for r in rows:
        by.setdefault((r.shard, r.batch), []).append(r.tokens)
    assert all(len(v) == 1 or len(v) * max(v) <= 13_000 for v in by.values())


def test_two_stage_prefetches_ten_times_k(spark):
    import numpy as np

    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    vec = {r.vec_id: np.array(r.embedding, float) for r in rows}
    chunks = {}
    for i in sorted(vec):
        chunks.setdefault(i // 5, {})[i % 5] = vec[i]
    sides = {"r": lambda t: (t - 1) % 2 + 1 if t else 0, "c": lambda t: (t - 1) // 2 + 1 if t else 0}

    def best(q, side=None):
        """Chunks by descending MaxSim; all tokens, or their means."""
        out = {}
        for c, toks in chunks.items():
            groups = {}
            for t, v in toks.items():
                groups.setdefault(sides[side](t) if side else t, []).append(v)
            d = np.array([np.mean(g, axis=0) for g in groups.values()])
            out[c] = (q @ d.T).max(1).sum()
        return out, sorted(out, key=lambda c: (-round(out[c], 9), c))

    want = set()
    for k in range(len([i for i in vec if i % 100 == 0])):
        q = np.array([vec[100 * k + t] for t in range(4)])
        near = {c for side in "rc" for c in best(q, side)[1][:50]}
        want |= {(k, rank, c) for rank, c in enumerate([c for c in best(q)[1] if c in near][:5], 1)}
    assert {(r.query_id, r["rank"], r.chunk_id) for r in QUERIES["op_re2"](spark, SF).collect()} == want


def test_groups_of_batches_are_bounded(spark, monkeypatch):
    from collections import Counter

    from leafmark.plans import queries

    monkeypatch.setattr(queries, "SHARD_IDS", 20)
    assert {r.shard.split(":")[0] for r in QUERIES["op_ve2"](spark, SF).select("shard").distinct().collect()} == {r.source for r in spark.read.parquet(f"{SF}/documents.parquet").select("source").distinct().collect()}
    rows = QUERIES["op_ve2"](spark, SF).collect()
    assert len({r.item_id for r in rows}) == len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert max(Counter(r.shard for r in rows).values()) <= 20
