"""Models by name as a table function, and the substring index."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmark.operators import elements, models, retrieval, title_index


@pytest.fixture(scope="module")
def texts(spark):
    df = spark.createDataFrame([(1, "abba\ncd e"), (2, ""), (3, None)], "doc_id long, text string")
    df.createOrReplaceTempView("texts")
    models.register(spark)
    return df


def test_the_schema_is_the_models(spark, texts):
    one = spark.sql("SELECT d.doc_id, e.* FROM texts d, LATERAL embed('letters', d.text) e")
    many = spark.sql("SELECT d.doc_id, e.* FROM texts d, LATERAL embed('lines', d.text) e")
    assert one.columns == ["doc_id", "vec"] and many.columns == ["doc_id", "tok", "vec"]
    assert {r.doc_id: r.vec[:5] for r in one.collect()} == {1: [2.0, 2.0, 1.0, 1.0, 1.0], 2: [0.0] * 5, 3: [0.0] * 5}
    assert sorted((r.doc_id, r.tok, r.vec) for r in many.collect()) == [(1, 0, [4.0, 0.0]), (1, 1, [4.0, 1.0]), (2, 0, [0.0, 0.0]), (3, 0, [0.0, 0.0])]
    assert sorted(models.embed(texts, "lines").drop("text").collect()) == sorted(many.collect())


@pytest.mark.parametrize("call,told", [("'nothing', d.text", "no model nothing: one of letters, lines"), ("d.text, d.text", "constant name"), ("NULL, d.text", "constant name"), ("'lines', d.doc_id", "takes a text")])
def test_wrong_calls_fail_when_analysed(spark, texts, call, told):
    with pytest.raises(Exception, match=told):
        spark.sql(f"SELECT d.doc_id, e.* FROM texts d, LATERAL embed({call}) e").schema  # noqa: B018  nothing has run


def test_a_model_is_loaded_once_in_a_task(spark):
    def load():
        calls = []
        return lambda text: [(calls.append(text) or len(calls),)]

    own = {"counter": models.Model(load, T.StructType().add("n", T.LongType()))}
    rows = spark.range(0, 9, 1, 1).selectExpr("id", "'x' as text")
    assert sorted(r.n for r in models.embed(rows, "counter", own).collect()) == list(range(1, 10))


TITLES = ["1.1 Intro", "INTRO", "aaa", "aaaa a", "", None, "Ünïcode ß Straße", "1.1 intro to 1.1", "x", "xy", "中文标题", "a  b"]
KEYS = ["book", "pos"]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rng = random.Random(2)
    titles = TITLES + ["".join(rng.choice("abAB 1.") for _ in range(rng.randint(1, 25))) for _ in range(200)] + ["aaa"] * 30
    df = spark.createDataFrame([(i % 7, i, t) for i, t in enumerate(titles)], "book long, pos long, title string").repartition(3)
    at = str(tmp_path_factory.mktemp("titles") / "index")
    title_index.write(df, at, KEYS)
    return df, at, titles


def test_the_index_finds_what_a_scan_finds(spark, index):
    df, at, titles = index
    rng = random.Random(3)
    asked = ["", "  ", "a", "X", "aa", "aaa", "aaaa", "intro", " 1.1 INTRO ", "straße", "文标", "zzz", "a z", "1.1 intro to 1.1 and more", "%", "_", "a  b"]
    for t in rng.sample([t for t in titles if t], 12):
        i = rng.randrange(len(t))
        asked.append(t[i : i + rng.randint(1, 9)])
    for text in asked:
        want = sorted((r.book, r.pos) for r in retrieval.outline_search(df, text).collect())
        assert sorted((r.book, r.pos) for r in title_index.search(spark, at, text, KEYS).collect()) == want, text


def test_a_search_reads_its_pieces_alone(spark, index):
    _, at, _ = index
    plan = title_index.search(spark, at, "intro to", KEYS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PushedFilters: [IsNotNull(piece), EqualTo(piece,") == 2 and "Cartesian" not in plan


def test_reasons_and_pages_in_one_pass(spark):
    bad = spark.createDataFrame([(1, ["a", "b"]), (1, ["a"]), (2, ["b"])], "page_idx long, reasons array<string>")
    got = {(r.level, r.reason, r.page_idx): r.n for r in elements.rejection_cube(bad).collect()}
    assert got == {("reason", "a", None): 2, ("reason", "b", None): 2, ("page", None, 1): 2, ("page", None, 2): 1, ("both", "a", 1): 2, ("both", "b", 1): 1, ("both", "b", 2): 1}
    plan = elements.rejection_cube(bad)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1 and "Expand" in plan


def test_context_of_questions_has_its_own_bound(spark):
    none = spark.createDataFrame([], "query_id long")
    for k in (0, 21):
        with pytest.raises(ValueError):
            retrieval.assemble_context(none, none, none, none, none, k)


def test_context_of_questions_is_search_then_contexts(spark):
    from conftest import SF
    from leafmark.operators import vectors
    from leafmark.plans.fixtures import view
    from leafmark.plans.queries import QUERIES

    t = view(spark, SF, "fx_tokens")
    got = retrieval.assemble_context(view(spark, SF, "fx_replies").select("query_id"), view(spark, SF, "fx_query_tokens"), vectors.pooled(t, 2, 2), t, view(spark, SF, "fx_chunks"))
    flat = got.select("query_id", F.array_join(F.transform("chunk_ids", lambda x: x.cast("string")), "|").alias("chunk_ids"), F.array_join("image_paths", "|").alias("image_paths"), "found")
    assert sorted(flat.collect()) == sorted(QUERIES["op_re10"](spark, SF).collect())
