"""Quality rules, decontamination, PII, URL filters and licenses against plain Python."""

import math
import random
import re
from collections import Counter, defaultdict
from math import comb

import pytest
from pyspark.sql import functions as F

from conftest import SF
from helpers import same
from leafmark.llm import decontamination, licenses, pii, quality, urls
from leafmark.llm.oracles import ORACLES
from leafmark.llm.queries import QUERIES
from llm.conftest import ODD, WORDS, make

LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    same(QUERIES[name](spark, SF), duck, ORACLES[name])


# quality rules
def base(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = defaultdict(list)
    for k in range(len(w) - 2):
        at[tuple(w[k : k + 3])].append(k)
    rep = {k + j for v in at.values() if len(v) > 1 for k in v for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep)


def test_quality_base_counts(spark, odd):
    rnd = random.Random(3)
    texts = ["\n".join(" ".join(rnd.choice(["a", "b", "c", "#x", "|", "dé"]) for _ in range(rnd.randint(0, 12))) for _ in range(rnd.randint(0, 9))) for _ in range(60)]
    texts.append(" ".join(rnd.choice("abcdefgh") + rnd.choice("xyz") for _ in range(3000)))  # far more repeated windows than a handful
    got = {r.doc_id: tuple(r)[3:8] for r in quality.judge(make(spark, texts), spark.createDataFrame([], LABELS)).collect()}
    assert got == {i: base(t) for i, t in enumerate(texts)}
    out = quality.judge(odd, spark.createDataFrame([(5, None, None), (None, 1, 0)], LABELS)).collect()
    assert len(out) == len(ODD) + 3
    assert all(tuple(r)[3:8] == base(ODD[r.doc_id]) for r in out if r.doc_id is not None)


@pytest.mark.parametrize("n,k,p", [(100, 0, 0.05), (100, 3, 0.05), (5000, 40, 0.0125), (50000, 500, 0.0125), (10, 9, 0.01)])
def test_binomial_tail(spark, n, k, p):
    from decimal import Decimal, getcontext

    getcontext().prec = 60
    want = sum(Decimal(comb(n, j)) * Decimal(p) ** j * (1 - Decimal(p)) ** (n - j) for j in range(k + 1)) if k <= n * p else 1
    got = spark.range(1).select(quality.binomial_tail(F.lit(n), F.lit(k), p).alias("x")).first().x
    assert abs(got / float(want) - 1) < 1e-8


def test_cutoffs_keep_the_good(spark):
    good, bad = " ".join(f"w{k}x" for k in range(60)), " ".join(f"w{k}#*" for k in range(60))
    texts = [good] * 3000 + [bad] * 300
    labels = spark.createDataFrame([(i, int(i < 3000), 0) for i in range(3300)], LABELS)
    kept = {r.doc_id for r in quality.filter_documents(make(spark, texts), labels).select("doc_id").collect()}
    assert kept == set(range(3000))
    few = quality.judge(make(spark, [good] * 10 + [bad]), labels.where("doc_id < 10"))
    assert {r.kept for r in few.collect()} == {True}  # so few labels prove nothing
    assert quality.filter_documents(make(spark, [good]), labels).columns == make(spark, [good]).columns


def test_quality_of_nothing(spark, odd):
    assert quality.judge(odd.limit(0), spark.createDataFrame([], LABELS)).count() == 0


def test_quality_of_odd_rows(spark, odd):
    kept = quality.filter_documents(odd, spark.createDataFrame([(5, None, None), (None, 1, 0)], LABELS))
    assert kept.columns == odd.columns
    want = [i for i, t in enumerate(ODD) if base(t)[0] >= 50 and 100 * base(t)[4] <= 50 * base(t)[0]]
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == want


def test_cutoffs_against_sql(spark):
    """A table on which cutoffs of several rules pass, in strata of which one proves nothing."""
    import duckdb

    rnd = random.Random(19)
    rows, labels = [], []
    for i in range(4200):
        bad = rnd.random() < 0.25
        w = [f"w{rnd.randrange(10**5)}" for _ in range(60)]
        if bad and i % 2:
            w = [x + rnd.choice(["#*", "|", ""]) for x in w]
        elif bad:
            w = [*w[:30], "\n", *[x for k in range(10) for x in (f"same{i} line{i}", "\n")]]
        rows.append((i, " ".join(w), rnd.choice(["en", "de", None]) if i > 60 else "rare"))
        labels.append((i, int(not bad or rnd.random() < 0.02), 0))
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, LABELS)
    c = duckdb.connect()
    c.register("documents", docs.toPandas())
    c.register("labels", lab.toPandas())
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    out = quality.judge(docs, lab)
    same(out.select(columns), c, ORACLES["op1_quality_rules"])
    assert {x for r in out.where("failed_rules is not null").collect() for x in r.failed_rules} >= {"symbols", "same_lines"}
    assert not [r for r in out.collect() if r.stratum == "rare" and r.failed_rules]


# decontamination
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hits(text, items, width=10):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    at, found = set(), set()
    for item, t in items:
        v = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
        n = min(width, len(v))
        for gram in {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else ():
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) == gram:
                    at |= set(range(k, k + n))
                    found.add(item)
    return len(w), len(at), sorted(map(str, found))


def test_decontamination(spark, odd):
    rnd = random.Random(4)
    word = lambda: rnd.choice(["the", "of", "Abc", "dé", "x1", "rare"])
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([0, 1, 3, 9, 10, 11, 30, 30])] + [(8, None), (None, "null item words " * 5), (9, "Two Words")]
    texts = [" ".join(word() for _ in range(rnd.randint(0, 60))) for _ in range(40)] + [f"{a[1]}, {b[1]}" for a in items[3:8] for b in items[3:8]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    known = [x for x in items if x[0] is not None]
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontamination.decontaminate(make(spark, texts), bench).collect()}
    assert got == {i: hits(t, known) for i, t in enumerate(texts)}
    out = decontamination.decontaminate(odd, bench).collect()
    assert len(out) == len(ODD) + 3 and {r.contaminated for r in out if r.doc_id in (4, 5)} == {True}
    left = decontamination.clean_documents(odd, bench)
    assert left.columns == odd.columns and 4 not in {r.doc_id for r in left.select("doc_id").collect()}
    assert decontamination.decontaminate(odd, bench.limit(0)).where("contaminated").count() == 0
    assert decontamination.decontaminate(odd.limit(0), bench).count() == 0


def test_proximity(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = make(spark, ["x " + " filler ".join(item.split()), "alpha " + "z " * 300 + "beta gamma"])
    found = decontamination.proximity_matches(docs, spark.createDataFrame([(1, item)], "item_id long, text string"), slop=20)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(0, 1)}


# personal data
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(v - 9 if v > 9 else v for i, c in enumerate(reversed(d)) for v in [int(c) * (1 + i % 2)]) % 10 == 0


def spans(text):
    out = []
    for o, (k, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 14 <= len(d) <= 19 and luhn(d), "phone": lambda: 10 <= len(d) <= 15}[k]()
            if ok:
                out.append((m.start(), o, k, m.end()))
    return [(k, a, b) for a, _, k, b in sorted(out)]


def test_base_spans(spark, odd):
    rnd = random.Random(5)
    bits = ["a@b.co", "@", ".", "_", "é", "+1 (017) 555-7713", "+", "4111 1111 1111 1111", "4111-1111", "1.2.3.4", "300.1.1.1", "007.0.0.1", " ", "-", "12", "x", "a@b", "\n", "𝄞"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 14))) for _ in range(400)] + ["a@b.co_d@e.fg", "1.2.3.4.5.6.7.8"]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans if s.base] for r in pii.find(make(spark, texts)).collect()}
    assert got == {i: spans(t) for i, t in enumerate(texts)}
    assert all([(s.kind, s.start, s.end) for s in r.spans if s.base] == spans(ODD[r.doc_id]) for r in pii.find(odd).collect() if r.doc_id is not None)


def test_added_spans_and_redaction(spark):
    key = "bed4d44cf2780ed3ef0cb916120773181bc8de67"
    texts = [f'é token = "{key}" and a@b.com', f"commit {key} of the build", "plain words only", None, "mail a@b.co, call +1 (017) 555-7713"]
    docs = make(spark, texts)
    got = {r.doc_id: {s.kind for s in r.spans} for r in pii.find(docs).collect()}
    assert got == {0: {"secret", "email"}, 1: set(), 2: set(), 3: set(), 4: {"email", "phone"}}
    out = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert out[0].text == 'é token = "[SECRET]" and [EMAIL]' and out[0].n_chars == len(out[0].text)
    assert out[1].text == texts[1] and out[3].text is None and out[4].text == "mail [EMAIL], call [PHONE]"
    assert pii.redact(docs).columns == docs.columns and pii.find(docs.limit(0)).count() == 0


def test_redaction_of_odd_rows(spark, odd):
    out = pii.redact(odd)
    assert out.columns == odd.columns and pii.redact(odd.limit(0)).count() == 0
    assert all(r.text == ODD[r.doc_id] for r in out.collect() if r.doc_id is not None)


def test_added_spans_are_mostly_right(spark):
    """Precision and recall of the spans that the method adds, on texts whose truth is known."""
    rnd = random.Random(15)
    digits = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    token = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
    say = lambda: " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(3, 9)))
    texts, truth = [], {}
    for i in range(800):
        national, ssn = f"({digits(3)}) {digits(3)}-{digits(4)}", f"{rnd.randint(100, 665)}-{rnd.randint(10, 99)}-{rnd.randint(1000, 9999)}"
        yes = [(f'api_key = "{{}}" {say()}', "secret", token(40)), (f"call me on tel {{}} {say()}", "phone", national), (f"social security number {{}} {say()}", "ssn", ssn), (f"write a mail to {{}} {say()}", "email", f"{rnd.choice(WORDS)} [at] {rnd.choice(WORDS)} [dot] com")]
        no = [(f"see commit {{}} {say()}", None, "".join(rnd.choice("0123456789abcdef") for _ in range(40))), (f"checksum {{}} {say()}", None, "".join(rnd.choice("0123456789abcdef") for _ in range(64))), (f"isbn {{}} {say()}", None, ssn), (f"{say()} {{}} {say()}", None, digits(5))]
        form, kind, value = rnd.choice(yes if i % 2 else no)
        texts.append(form.format(value))
        truth[i] = {(kind, form.index("{}"), form.index("{}") + len(value))} if kind else set()
    added = {r.doc_id: {(s.kind, s.start, s.end) for s in r.spans if not s.base} for r in pii.find(make(spark, texts)).collect()}
    right = sum(len(added[i] & truth[i]) for i in truth)
    assert right / sum(map(len, added.values())) >= 0.95 and right / sum(map(len, truth.values())) >= 0.8


def test_reliabilities():
    rnd = random.Random(6)
    counts = Counter()
    for _ in range(20000):
        y = rnd.random() < 0.4
        counts["k", tuple((1 if (rnd.random() < r) == y else -1) for r in (0.9, 0.85, 0.8, 0.6))] += 1
    right, post = pii.estimate([(k, v, n) for (k, v), n in counts.items()])
    assert [round(right[x], 1) for x in pii.LABELERS] == [0.9, 0.8, 0.8, 0.6] or abs(right["shape"] - 0.6) < 0.05
    assert post["k", (1, 1, 1, 1)] > 0.95 and post["k", (-1, -1, -1, -1)] < 0.05


# URL filters
def test_urls(spark):
    cases = {
        "http://A.Example.ORG/es/x?q#f": ("a.example.org", "/es/x", "example.org/es/", "block"), "http://example.org/en/12": ("example.org", "/en/12", "example.org/en/1", "block"), "http://notexample.org/en/12": ("notexample.org", "/en/12", "org/", "allow"),
        "https://x.com/fr/1": ("x.com", "/fr/1", "com/fr/", "allow"), "https://com/de/": ("com", "/de/", "com/de/", "block"), "http://x.net/a": ("x.net", "/a", None, "allow"), "http://example.org": ("example.org", "", None, "allow"),
        "nothing": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"), "a://b://c/d": ("b:", "//c/d", None, "allow"), "x://É.org/\né": ("É.org", "/\né", "org/", "allow"),
    }
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(cases)] + [(0, "http://A.Example.ORG/es/x?q#f", "h", 2), (None, None, None, None)], "page_id long, url string, html string, count long")
    out = urls.judge(pages, spark.createDataFrame([], LABELS)).collect()
    assert len(out) == len(cases) + 2 and urls.judge(pages.limit(0), spark.createDataFrame([], LABELS)).count() == 0
    long = "http://x.org/" + "a/" * 30_000 + "?" + "k=v&" * 10_000
    wide = spark.createDataFrame([(1, long, "h", "host", 1, ["t"])], "page_id long, url string, html string, host string, n long, tokens array<string>")
    assert [(r.host, len(r.path), r.rule) for r in urls.judge(wide, spark.createDataFrame([(1, 0, 1)], LABELS)).collect()] == [("x.org", 60_001, "org/")]
    assert all((r.host, r.path, r.rule, r.verdict) == cases[r.url] for r in out)


def test_mined_rules_against_brute_force(spark):
    rnd = random.Random(7)
    rows, labels = [], []
    for i in range(600):
        host, word, key = rnd.choice(["a.net", "b.net", "c.net"]), rnd.choice(["shop", "news"]), rnd.choice(["ref", "page"])
        rows.append((i, f"http://{host}/{word}/{i}?{key}=1"))
        labels.append((i, int(not (host == "a.net" and word == "shop" and rnd.random() < 0.95)), 0))
    pages, lab = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, LABELS)
    bad = {i for i, q, _ in labels if q == 0}
    baskets = {r.page_id: frozenset(r.tokens) for r in urls.parsed(pages).collect()}
    from itertools import combinations

    sets = {frozenset(c) for b in set(baskets.values()) for n in range(1, len(b) + 1) for c in combinations(sorted(b), n)}
    rules = {}
    for s in sets:
        on = [i for i, b in baskets.items() if s <= b]
        hit = sum(i in bad for i in on)
        n, z = len(on), 4.0
        if hit >= 10:
            p = hit / n
            sure = (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
            if sure >= 1.5 * len(bad) / len(baskets):
                rules[s] = p
    want = {i for i, b in baskets.items() if any(s <= b for s in rules)}
    out = urls.judge(pages, lab, given=()).collect()
    assert want and {r.page_id for r in out if r.verdict == "block"} == want
    kept = {frozenset(r.need) for r in urls.mine(urls.parsed(pages), lab, 0.001, 1.5, 4.0, 10).collect()}
    assert kept <= set(rules) and all(any(k <= s for k in kept) for s in rules)


# licenses
def test_licenses(spark, odd):
    t = licenses.TEMPLATES
    cut = t["BSD-conditions"].replace("conditions are met", "terms hold")
    docs = make(spark, [f"words before {t['GPL-3.0']} and after", f"é {t['MIT'].upper()}\n{t['MIT']}", f"x {cut} y", "Licensed under the terms", f"{'w ' * 5000}{t['MIT-grant']}", f"{t['Apache-2.0']} {t['CC-BY-NC-4.0']}"])
    got = {(r.doc_id, r.license) for r in licenses.scan(docs).collect()}
    assert got == {(0, "GPL-3.0"), (1, "MIT"), (2, "BSD-conditions"), (4, "MIT-grant"), (5, "Apache-2.0"), (5, "CC-BY-NC-4.0")}
    table = spark.createDataFrame([("own", "our own short terms of use apply here"), (None, "x"), ("y", None), ("z", "")], "name string, text string")
    mine = licenses.scan(make(spark, ["see: Our own short terms of use apply here!", "nothing"]), licenses.templates_of(table)).collect()
    assert [(r.doc_id, r.license, r.start_word, r.end_word) for r in mine] == [(0, "own", 1, 9)]
    assert [(r.start_word, r.end_word) for r in licenses.scan(docs).where("doc_id = 1").orderBy("start_word").collect()] == [(1, 6), (6, 11)]
    assert licenses.scan(odd).count() == licenses.scan(odd.limit(0)).count() == 0


def held(text, template, width=5):
    """The largest share of a template's shingles in any window of its length plus an eighth, word by word."""
    low = lambda t: re.findall(r"[0-9a-z\u0080-\U0010ffff]+", t.translate(LOW))
    w, v = low(text), low(template)
    n = min(width, len(v))
    own = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)}
    span = len(v) - n + 1 + max(1, (len(v) - n + 1) // 8) - 1
    at = [tuple(w[k : k + n]) for k in range(len(w) - n + 1)]
    return max((len(own & set(at[k : k + span])) / len(own) for k in range(max(1, len(at) - span + 1))), default=0)


def test_licenses_against_brute_force(spark):
    """Every window of every text against every template: nothing that holds enough is missed, nothing else is found."""
    rnd = random.Random(14)
    texts = []
    for name, t in sorted(licenses.TEMPLATES.items()):
        for edits in (0, 1, 2, 4):
            w = t.split()
            for _ in range(edits):
                w[rnd.randrange(len(w))] = rnd.choice(["changed", "", "the"])
            around = lambda: " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(0, 60)))
            texts.append(f"{around()} {' '.join(w)} {around()}")
    got = {(r.doc_id, r.license) for r in licenses.scan(make(spark, texts)).collect()}
    shares = {(i, name): held(x, t) for i, x in enumerate(texts) for name, t in licenses.TEMPLATES.items()}
    surely = {k for k, s in shares.items() if s >= licenses.CONTAINMENT}
    assert surely and got <= surely  # a window that is scanned is one of all windows
    assert len(got & surely) / len(surely) >= 0.97, sorted(surely - got)


@pytest.mark.parametrize("size", [1, 2, 5, 12, 40, 200])
def test_bands_find_what_holds_enough(size):
    """A window at the least similarity is missed about as seldom as promised."""
    assert (1 - licenses.similarity(size, 0.8) ** licenses.ROWS) ** licenses.bands(size, 0.8) <= licenses.MISS * 1.0001
    assert WORDS


def test_long_urls_are_not_broadcast(spark, monkeypatch):
    """A side of few rows is broadcast by its bytes."""
    from leafmark.llm import common

    # a rule that blocks all of 300 URLs of 100 kB each
    rows = [(i, f"http://bad.net/shop/{i}?" + "k" * 100_000) for i in range(300)] + [(i, f"http://good.net/news/{i}") for i in range(300, 1200)]
    labels = spark.createDataFrame([(i, int(i >= 300), 0) for i in range(1200)], LABELS)
    pages = spark.createDataFrame(rows, "page_id long, url string")
    plan = lambda: urls.judge(pages, labels, given=())._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan()
    monkeypatch.setattr(common.light, "__defaults__", (1 << 20,))
    assert "strategy=broadcast" not in plan()
    assert {r.page_id for r in urls.judge(pages, labels, given=()).where("verdict = 'block'").collect()} == set(range(300))
