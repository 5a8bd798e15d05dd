"""Token counts and whitening against plain Python."""

import random

import numpy as np
import pytest

from conftest import SF
from llm.conftest import ODD, make
from leafmark.llm import token_counts, whitening
from leafmark.llm.queries import QUERIES


@pytest.fixture(scope="module")
def words_path():
    P = pytest.importorskip("public_tokenizers")
    return P.path("word_bpe_49k.json")


def counted(path, texts):
    from tokenizers import Tokenizer

    return [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(list(texts), add_special_tokens=False)]


def test_token_counts_are_the_librarys(spark, words_path):
    got = {r.doc_id: r for r in QUERIES["op12_token_counts"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d, n in zip(docs, counted(words_path, [d.text or "" for d in docs])):
        assert (got[d.doc_id].n_bytes, got[d.doc_id].n_tokens, got[d.doc_id].over_limit) == (len((d.text or "").encode()), n, n > 2048)


STRANGE = ["a\x1cb c", "x<|endoftext|>y <|startoftext|> z", "<|ENDOFTEXT|>", "don't I'LL 'S", "é ́x 가", "A B C D\x85E　F\x0bG", "ΣΑΣ Σ İI ß", "１２3 ½ ²", "中文字 日本", "😀👍🏽 a😀b", "\x00 \x01a", "e ́", " ́a", "﻿x ​x", "İ" * 300]


def test_odd_texts_and_small_tables(spark, words_path):
    texts = ODD + STRANGE
    docs = make(spark, texts)
    want = {(i, len((t or "").encode()), n) for (i, t), n in zip(enumerate(texts), counted(words_path, [t or "" for t in texts]))}
    for entries in (1, 4, 1000):
        assert {(r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.count(docs, words_path, entries=entries).collect()} == want
    assert token_counts.count(docs.limit(0), words_path).collect() == []
    null_id = token_counts.count(make(spark, ["a b", "a b"], [None, None]), words_path).collect()
    assert [(r.doc_id, r.n_tokens) for r in null_id] == [(None, 2)] * 2


def test_random_texts_count_as_a_whole(words_path):
    rng = random.Random(3)
    pool = [chr(c) for c in [*range(0, 0x250), *range(0x300, 0x370), *range(0x1FF0, 0x2070), 0x3000, 0x1680, 0xAC00, 0x1100, 0x1161, 0x1F600, 0x0130, 0x03A3]]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    table = token_counts.Table(words_path, cached=50)
    assert [table.count(t) for t in texts] == counted(words_path, texts)


def test_frequent_pieces_are_found_over_all_partitions(spark):
    from collections import Counter

    rng = random.Random(1)
    texts = [" ".join([*("common" for _ in range(rng.randint(0, 9))), *(f"w{rng.randint(0, 20)}" for _ in range(9)), *(f"rare{rng.randint(0, 10**6)}" for _ in range(30))]) for _ in range(300)]
    tally = Counter(w for t in texts for w in t.split())
    total, entries = sum(tally.values()), 64
    found = token_counts.frequent(make(spark, texts).repartition(40), entries)
    assert len(found) <= entries
    assert {w for w, c in tally.items() if c > total / entries} <= set(found)


def test_counting_shuffles_no_pieces(spark, words_path):
    plan = token_counts.count(spark.read.parquet(f"{SF}/documents.parquet"), words_path)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def expected(rows, k=16):
    kept = [(i, np.array(v, np.float64)) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([np.floor(64 * v).astype(np.int64) + 1_000_000 for _, v in kept])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    y = fit - fit.mean(0)
    cov = y.T @ y / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    w = (x - s / n) @ u / np.sqrt(e)
    return [i for i, _ in kept], n, [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s)) for r in x], w, e / np.trace(cov)


def check(got, rows, k=16):
    ids, n, deviation, w, explained = expected(rows, k)
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r
    assert len(got) == len(ids) * w.shape[1] and set(by) == set(ids)
    sign = np.sign([sum(by[i][c + 1].whitened * w[j, c] for j, i in enumerate(ids)) for c in range(w.shape[1])])
    for j, i in enumerate(ids):
        for c in range(w.shape[1]):
            r = by[i][c + 1]
            assert (r.n, r.deviation) == (n, deviation[j])
            assert abs(r.whitened * sign[c] - w[j, c]) < 1e-7 and abs(r.explained / explained[c] - 1) < 1e-9 and r.identity_error < 1e-8


def test_whitening_is_numpys(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check(QUERIES["op13_whitening"](spark, SF).collect(), rows)


VECTORS = "vec_id long, embedding array<float>, x string, _x string, n long, w long, i long"


def test_whitening_odd_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=20).tolist()) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 500)]
    rows += [(600, None), (601, [None] * 20), (602, [float("nan")] + [0.0] * 19), (603, [float("inf")] * 20)]
    df = spark.createDataFrame([(i, v, "a", "b", 1, 2, 3) for i, v in rows], VECTORS).repartition(5)
    check(whitening.whiten(df).collect(), rows)
    assert whitening.whiten(df.where("vec_id > 599")).collect() == [] and whitening.whiten(df.limit(0)).collect() == []
    few = whitening.whiten(df.where("vec_id = 7 or vec_id = 8")).collect()
    assert sum(r.whitened is not None for r in few) == 2 and len(few) == 32  # two points vary along one line
    assert all(r.whitened is None and r.explained == 0 for r in whitening.whiten(df.where("vec_id = 7")).collect())
    mixed = df.unionByName(spark.createDataFrame([(900, [1.0, 2.0], "a", "b", 1, 2, 3)], VECTORS))
    with pytest.raises(ValueError):
        whitening.whiten(mixed)
    check(whitening.whiten(mixed, dim=20).collect(), rows)


@pytest.mark.parametrize("values", [np.r_[1 + 1e-9 * np.arange(5), np.arange(2, 12)], np.r_[np.ones(6), 3 * np.ones(4), np.arange(5, 10)], np.logspace(0, -10, 15), np.r_[1, 1 + 1e-13, 2, 2 + 1e-6, np.arange(3, 14)]])
def test_eigenvectors_of_clusters(values):
    q = np.linalg.qr(np.random.default_rng(5).normal(size=(len(values), len(values))))[0]
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    e, x = whitening.eigen(a)
    assert np.abs(x.T @ x - np.eye(len(values))).max() < 1e-14
    assert np.abs(a @ x - x * e).max() < 2e-15 * np.abs(a).max() * len(values)
    assert np.abs(e - np.sort(values)[::-1]).max() < 1e-14 * values.max() * len(values)


def test_start_in_single_precision_is_not_enough():
    a = np.random.default_rng(2).normal(size=(64, 64))
    a = a @ a.T
    start = np.linalg.eigh(a.astype(np.float32))[1].astype(np.float64)
    single = np.abs(start.T @ start - np.eye(64)).max()
    e, x = whitening.eigen(a)
    assert single > 1e-8 and np.abs(x.T @ x - np.eye(64)).max() < 1e-14


def test_deviation_beyond_a_long():
    m = whitening.Whitening(10**9, np.array([0, 0], object), np.zeros((2, 1)), np.zeros(1))
    assert m.deviation(np.array([[10**6, 10**6], [1, 2]])) == [None, 5 * 10**18]
