import pytest

#: Extra columns by names that the operators use inside, or once did.
EXTRA = "d h t k s new cls key family part text_hash stratum spans hits places term salt _d _h _n _s _new _copy _b _at".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, count long, " + ", ".join(f"{c} string" for c in EXTRA)


def make(spark, texts, ids=None):
    """documents of these texts, with extra columns whose names the operators use inside."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, x, "en", "s", None if x is None else len(x), 1, 3, *EXTRA) for i, x in zip(ids, texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


WORDS = "the quick brown fox jumps over a lazy dog while nobody looks at the moon above these hills".split()
ODD = [None, "", " \n\t ", "one", "two words", "two words", " ".join(WORDS), " ".join(WORDS), " ".join(WORDS * 2000), "é" * 5000, "A" * 60000, "x\x00y \x1c z", "1 2 " * 3000, "@" * 500 + "+" * 500]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows."""
    df = make(spark, ODD)
    none = (None,) * len(EXTRA)
    extra = spark.createDataFrame([(None, None, None, None, None, None, None, *none), (None, "null id text " * 9, "en", None, 1, None, None, *none), (5, "two words", "en", "s", 9, 1, 3, *EXTRA)], DOCS)
    return df.unionByName(extra)


@pytest.fixture(scope="session")
def vocabulary():
    P = pytest.importorskip("public_tokenizers")
    return P.path("byte_bpe_50k.json")
