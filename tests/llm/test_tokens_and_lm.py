"""Packing, records and the language model: round trips and plain Python; properties of their parts."""

import functools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmark.llm import eliasfano, lm, packing, records
from llm.conftest import ODD, make


@pytest.fixture(scope="module")
def encode(vocabulary):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary)
    return lambda x, end: np.array([*t.encode(x or "", add_special_tokens=False).ids, end], "<u4")


@pytest.fixture(scope="module")
def encoder(vocabulary):
    from leafmark.llm.tokens import Encoder

    return Encoder(vocabulary, entries=50)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*" ab'Zé.,!\n\t1漢²\x1c\u00a0\u2003_|<", "<|endoftext|>", "<|endof"]), max_size=24).map("".join), max_size=5))
def test_encoder_is_exact(encoder, encode, texts):
    assert encoder.encode(texts) == [encode(t, 0)[:-1].tobytes() for t in texts]


def pieces_hold(rows, texts, encode, capacity=1024):
    by, seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        seq[r.sequence_id].append(r)
    for i, t in texts.items():
        ids, at = encode(t, 0), 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    total = padding = 0
    for rs in seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= capacity
        total, padding = total + at, padding + (0 if at & (at - 1) == 0 else capacity - at)
    return padding / max(total, 1)


def test_packing(spark, vocabulary, encode):
    rnd = random.Random(1)
    texts = {i: " ".join(rnd.choice(["word", "other", "thing,"]) for _ in range(rnd.choice([0, 3, 100, 900, 3000]))) for i in range(150)} | {500 + k: t for k, t in enumerate(ODD)}
    rows = packing.pack(make(spark, list(texts.values()), list(texts)), vocabulary).collect()
    assert pieces_hold(rows, texts, encode) == 0
    assert packing.pack(make(spark, []), vocabulary).count() == 0


def test_added_tokens_are_the_librarys(spark, vocabulary, encode):
    text = "a <|endoftext|> b"
    ids = encode(text, 0)
    assert len(ids) == 5  # the added token is one id
    assert [(r.length, r.ids_crc32) for r in packing.pack(make(spark, [text]), vocabulary).orderBy("start").collect()] == [(4, zlib.crc32(ids[:4].tobytes())), (1, zlib.crc32(ids[4:].tobytes()))]
    end = encode(text, 2)
    assert [(r.n_tokens, r.ids_crc32) for r in records.read_back(*records.write(make(spark, [text]), vocabulary)).collect()] == [(5, zlib.crc32(end.tobytes()))]


def test_packing_of_odd_rows(spark, odd, vocabulary, encode):
    rows = packing.pack(odd, vocabulary).collect()
    own = {(i, len(encode(t, 0))) for i, t in enumerate(ODD)} | {(None, 1), (None, len(encode("null id text " * 9, 0)))}
    assert {(r.doc_id, r.doc_tokens) for r in rows} == own
    assert sum(r.length for r in rows) == sum(n for _, n in own) + len(encode("two words", 0))  # id 5 stands twice
    assert packing.pack(odd.limit(0), vocabulary).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=40))
def test_balance(lengths):
    lengths = np.array(lengths, np.int64)
    n = int(lengths.sum()) // 64
    pieces, over = packing.balance(lengths, 64, n)
    assert all(sum(x[2] for x in s) == 64 for s in pieces)
    got = defaultdict(int)
    for i, _, k in [*[x for s in pieces for x in s], *over]:
        got[i] += k
    assert dict(got) == dict(enumerate(lengths.tolist()))


def test_costs_are_even():
    rnd = random.Random(2)
    lengths = np.array([rnd.randint(1, 1023) for _ in range(2000)])
    pieces, _ = packing.balance(lengths, 1024, int(lengths.sum()) // 1024)
    costs = [sum(packing.cost(k) for _, _, k in s) for s in pieces]
    assert np.std(costs) / np.mean(costs) < 0.2


# records
@pytest.fixture(scope="module")
def written(spark, vocabulary, tmp_path_factory):
    rnd = random.Random(3)
    texts = {i: " ".join(rnd.choice(["é", "two", "x."]) for _ in range(rnd.randint(0, 300))) for i in rnd.sample(range(-50, 500), 200)} | {1000 + k: t for k, t in enumerate(ODD)}
    folder = f"file://{tmp_path_factory.mktemp('records')}/r"
    index, folder = records.write(make(spark, list(texts.values()), list(texts)), vocabulary, folder, shards=5)
    return texts, index, folder


def test_round_trip(written, encode):
    texts, index, folder = written
    got, at = {r.doc_id: r for r in records.read_back(index, folder).collect()}, 0
    for i in sorted(texts):
        ids = encode(texts[i], 2)
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_shuffled_reads(written, encode):
    texts, index, folder = written
    rows = records.read_shuffled(index, folder, 1).collect()
    assert {r.doc_id: list(r["ids"]) for r in rows} == {i: encode(t, 2).tolist() for i, t in texts.items()}
    assert [r.doc_id for r in rows] == [r.doc_id for r in records.read_shuffled(index, folder, 1).collect()] != sorted(texts)
    assert [r.place for r in rows] == sorted(r.place for r in rows)


def test_damage_is_seen(written):
    import glob

    _, _, folder = written
    path = max(glob.glob(f"{folder.removeprefix('file://')}/data/shard-*"), key=lambda p: len(open(p, "rb").read()))
    data = bytearray(open(path, "rb").read())
    n = int.from_bytes(data[:8], "little")
    rest = lambda d: (lambda k, it=iter([d[12 : 12 + n + 4]]): next(it)[:k])
    assert records.unframed(bytes(data[:12]), rest(bytes(data)))
    for at in (3, 9, 15, 12 + n):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            records.unframed(bytes(bad[:12]), rest(bytes(bad)))


def test_records_of_odd_rows(spark, odd, vocabulary):
    got = records.read_back(*records.write(odd, vocabulary)).collect()
    assert len(got) == len(ODD) + 3 and sum(r.doc_id is None for r in got) == 2
    assert records.read_back(*records.write(odd.limit(0), vocabulary)).count() == 0


# language model
@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=60), st.integers(0, 63))
def test_elias_fano(values, shift):
    values = np.array(sorted(v >> shift for v in values), np.uint64)
    e = eliasfano.EliasFano(eliasfano.build(values))
    assert (e.access(np.arange(len(values))) == values).all()
    ask = np.unique(np.r_[values, values + np.uint64(1), np.array([0], np.uint64)])
    at = e.find(ask)
    assert ((at >= 0) == np.isin(ask, values)).all() and (values[at[at >= 0]] == ask[at >= 0]).all()


def test_elias_fano_in_a_crowd(monkeypatch):
    values = np.r_[np.arange(0, 200_000, 2), 1 << 50].astype(np.uint64)
    e = eliasfano.EliasFano(eliasfano.build(values))
    calls, lows = [], eliasfano.EliasFano._lows
    monkeypatch.setattr(eliasfano.EliasFano, "_lows", lambda self, i: calls.append(1) or lows(self, i))
    at = e.find(np.arange(200_000, dtype=np.uint64))
    assert len(calls) <= 40 and (at[::2] == np.arange(100_000)).all() and (at[1::2] == -1).all()
    assert (e.access(np.arange(len(values))) == values).all()


def model(texts, ids, order=3, least=2):
    tok = {i: [*(x or "").encode().lower().split(), None] for i, x in zip(ids, texts)}
    train = [i for i in ids if zlib.crc32(str(i).encode()) % 10]
    c, b, t = Counter(), Counter(), Counter()
    for i in train:
        w = [None, *tok[i]]
        c.update(tok[i])
        b.update(zip(w, w[1:]))
        t.update(zip(w, w[1:], w[2:]))
    n, v, d = sum(c.values()), len(c), lm.DISCOUNT
    kw = {x for x in c if c[x] >= least}
    kb = {k: x for k, x in b.items() if x >= least}
    kt = {k: x for k, x in t.items() if x >= least}
    l2, l3 = defaultdict(float), defaultdict(float)
    for (a, _), x in kb.items():
        l2[a] += (x - d) / c[a]
    for (a, e, _), x in kt.items():
        l3[a, e] += (x - d) / kb[a, e]
    p1 = lambda w: (c[w] + 0.1) / (n + 0.1 * (v + 1))
    p2 = lambda a, w: p1(w) if a not in kw or order < 2 else ((kb[a, w] - d) / c[a] if (a, w) in kb else 0) + max(1 - l2[a], 1e-9) * p1(w)
    p3 = lambda x, a, w: p2(a, w) if x is False or (x, a) not in kb or order < 3 else ((kt[x, a, w] - d) / kb[x, a] if (x, a, w) in kt else 0) + max(1 - l3[x, a], 1e-9) * p2(a, w)
    out = {}
    for i in ids:
        s = [False, None, *tok[i]]
        out[i] = (zlib.crc32(str(i).encode()) % 10 == 0, len(tok[i]), sum(c[w] > 0 for w in tok[i]), n, sum(math.log10(p1(w)) for w in tok[i]), sum(math.log10(p3(*s[k : k + 3])) for k in range(len(tok[i]))))
    return out


@pytest.mark.parametrize("order,least,shard_tokens,chunk", [(1, 2, 10**6, 10**6), (2, 2, 10**6, 10**6), (3, 2, 10**6, 10**6), (3, 1, 10**6, 700), (3, 2, 150, 700)])
def test_scores(spark, monkeypatch, order, least, shard_tokens, chunk):
    rnd = random.Random(4)
    vocabulary = [f"w{k}" for k in range(40)]
    step = {w: rnd.sample(vocabulary, 4) for w in vocabulary}

    def text():
        w, out = rnd.choice(vocabulary), []
        for _ in range(rnd.randint(0, 80)):
            w = rnd.choice(step.get(w, vocabulary)) if rnd.random() < 0.9 else rnd.choice([*vocabulary, f"new{rnd.randrange(10**6)}"])
            out.append(w.upper() if rnd.random() < 0.2 else w)
        return " ".join(out)

    texts = [text() for _ in range(300)] + [None, ""]
    monkeypatch.setattr(lm, "SHARD_TOKENS", shard_tokens)
    # workers import the module anew, so what they read of it comes with the function
    monkeypatch.setattr(lm, "_encode", functools.partial(lm._encode, size=chunk))
    got = {r.doc_id: r for r in lm.score(make(spark, texts), order=order, min_ngram=least).collect()}
    want = model(texts, list(range(len(texts))), order, least)
    better = 0
    for i, (held, n, known, total, base, score) in want.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and abs(r.score - score) < 4e-4 * n
        better += held * (r.score - r.base_score)
    assert better > 0 or order == 1


def test_registered_query_scores_trigrams(spark, tmp_path):
    from leafmark.llm.queries import QUERIES

    texts = [f"{a} x {b}" for a, b in (("a", "b"), ("c", "d")) for _ in range(40)]
    make(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.score for r in QUERIES["op9_lm_scoring"](spark, str(tmp_path)).collect()}
    two, three = (model(texts, list(range(len(texts))), order) for order in (2, 3))
    assert all(abs(got[i] - three[i][-1]) < 4e-4 * 4 < abs(two[i][-1] - three[i][-1]) for i in got)


def test_scores_of_odd_rows(spark, odd):
    out = lm.score(odd).collect()
    assert len(out) == len(ODD) + 3 and all(r.held_out for r in out if r.doc_id is None)
    assert lm.score(odd.limit(0)).count() == 0
    none = lm.score(make(spark, ["a b"], [next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)])).collect()
    assert [(r.train_tokens, r.n_known, r.base_score) for r in none] == [(0, 0, 0.0)]


def test_frequent_words_take_less_room():
    rnd = np.random.default_rng(3)
    local = np.unique(rnd.permutation(60_000)[np.minimum(rnd.zipf(1.3, 300_000), 60_000) - 1], return_inverse=True)[1]
    words = int(local.max()) + 1
    c = lm.numbered(local, words)
    assert np.array_equal(lm.by_frequency(c["classes"])[c["ranks"]], local)
    assert len(lm.sent(c)) < 0.9 * len(lm.sent({"ids": lm.narrow(local)}))
    none = lm.numbered(np.zeros(3, np.int64), 1)
    assert lm.by_frequency(none["classes"])[none["ranks"]].tolist() == [0, 0, 0]


def test_requests_of_a_round_are_for_its_turns():
    info = {"tokens": 1000, "shards": 12, "least": 2}
    key = np.arange(50, dtype=np.uint64) << np.uint64(32)
    one = np.ones(50, np.int64)
    request = lm.Request(info, "a:0:1", key, one, one, np.arange(50), np.arange(50), one)
    rounds = [dict(request.blobs(range(k, k + 3))) for k in (0, 3)]
    assert all(s % lm.PASSES in range(3 * i, 3 * i + 3) for i in (0, 1) for s in rounds[i])
    assert rounds[0] and rounds[1] and rounds[0] | rounds[1] == dict(request.blobs(range(lm.PASSES)))


def test_few_pieces_are_remembered(spark, vocabulary, encode):
    from leafmark.llm.tokens import Encoder

    texts = [" ".join(f"w{i * 50 + k} common" for k in range(50)) for i in range(40)]
    short = Encoder(vocabulary, entries=200)
    for i in range(0, 40, 2):
        assert short.encode(texts[i : i + 2]) == Encoder(vocabulary).encode(texts[i : i + 2])
        assert len(short.young) + len(short.young.old) <= 2 * 200 + 2 * 101
    docs = make(spark, texts)
    told = lambda df: sorted(tuple(r) for r in df.collect())
    assert told(packing.pack(docs, vocabulary, entries=50)) == told(packing.pack(docs, vocabulary))


def test_packing_of_the_pipeline_gets_few_texts_at_once(spark, vocabulary, monkeypatch):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    import pyarrow as pa

    def rows_at_once(path, end_id, capacity, entries):
        names = [x.split()[0] for x in packing.SCHEMA.split(", ")]
        return lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows, entries][i == 1 :][:1], pa.int64()) for i in range(8)], names=names) for b in batches)

    monkeypatch.setattr(packing, "_pack", rows_at_once)
    docs = spark.range(5000).selectExpr("id as doc_id", "'a text' as text").coalesce(1)
    got = corpus_pipeline.pack(spark, docs, "").collect()
    assert sum(r.doc_id for r in got) == 5000 and max(r.doc_id for r in got) <= 1024
    assert all(r.start <= 1 << 16 for r in got)


# pipeline
def test_pipeline(spark, vocabulary, encode, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rnd = random.Random(8)
    para = lambda n: " ".join(f"{rnd.choice('bcdfg')}{rnd.randrange(10**5)}" for _ in range(n))
    item = para(30)
    clean = [para(120) for _ in range(10)]
    near = clean[0].split()
    near[50] = "changed"
    texts = [*clean, clean[1], " ".join(near), "short text", ("same words again " * 40), f"{para(60)} {item} {para(60)}", f"{para(80)} mail a@b.co +1 (017) 555-7713", None, ""]
    root = f"file://{tmp_path}"
    make(spark, texts).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "benchmark_decontamination", "personal_data", "packing"]
    kept = {i: t for i, t in enumerate(texts) if i < 10}
    kept[15] = re.sub(r"\+1 \(017\) 555-7713", "[PHONE]", texts[15].replace("a@b.co", "[EMAIL]"))
    rows = corpus_pipeline.run(spark, root).collect()
    assert {r.doc_id for r in rows} == set(kept)
    pieces_hold(rows, kept, encode)
    docs = spark.read.parquet(f"{root}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, root)
        assert out.columns == docs.columns
        docs = out


@pytest.mark.parametrize("top, n", [(1, 1), (3, 400), (1 << 20, 5000), (1 << 32, 5000), (5, 0)])
def test_distinct_pairs(top, n):
    rnd = np.random.default_rng(top)
    high, low = rnd.integers(0, top, n, dtype=np.uint64), rnd.integers(0, min(top, 1 << 32), n, dtype=np.uint64)
    u, back = np.unique(high << np.uint64(32) | low, return_inverse=True)
    a, b, at = lm.distinct(high, low)
    assert (a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)).tolist() == u.tolist() and at.tolist() == back.tolist()
    values, where = lm.runs(np.sort(low))
    want, which = np.unique(np.sort(low), return_inverse=True)
    assert values.tolist() == want.tolist() and where.tolist() == which.tolist()


def test_plain_words_go_straight_to_the_merges(vocabulary, encode, monkeypatch):
    from leafmark.llm import tokens

    own = tokens.Encoder(vocabulary)
    monkeypatch.setattr(tokens, "_HAS_SPACE", None)
    text = "some words of café and Österreich " + "x" * 300
    assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == encode(text, 0)[:-1].tolist()
