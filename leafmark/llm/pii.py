"""Personal data by weak supervision.

Patterns propose candidate spans. Labelers vote on each (1 yes, -1 no, 0 abstain): its strict format (regex), words before
it that name or deny the kind (gazetteer), the characters around it (context), and the look of the value (shape). Counts of
vote patterns by kind, a table of bounded size, go through expectation-maximisation, which finds how reliable each labeler
is and how likely each pattern is personal data. A logistic regression trained on those likelihoods is the final span
classifier; beside the votes it sees the span itself: its length, shares of digits, capitals and different characters, and the
hashed word before it, so it can part spans that the labelers take for the same. The four base kinds (email, ip, card, phone) stay whenever their own check holds; the classifier decides on the
other candidates: secrets, national phone numbers, social security numbers, IBANs and spelled-out e-mail addresses.

Positions count code points, ends are exclusive. A null or empty text has no spans. Repeated rows are judged alike, each on
its own; null ids are kept. Without any candidate nothing is trained and nothing is added. Other columns are ignored, or
kept by redact().
"""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmark.llm.common import let, stored, unused

#: The base patterns; possessive forms and anchors only save the engine from trying again where nothing can match.
_OCTET = r"0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Further candidates: kind, pattern, what a text must hold to be searched at all.
MORE = {
    "secret": (r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*+[0-9])(?=[0-9_+/=-]*+[A-Za-z])[A-Za-z0-9_+/=-]{20,}+", r"[A-Za-z0-9_+/=-]{20}"),
    "national": (r"(?<![0-9+(-])\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9-])", r"[0-9]{3}[.-][0-9]{4}"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]{2}-[0-9]{4}"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}+(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}"),
    "spelled": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?: ?[\[(]dot[\])] ?[A-Za-z0-9-]++)++", r"[\[(]at[\])]"),
}
#: Gazetteer: words before a candidate that speak for its kind, and words that speak against any.
NAMES = {
    "email": "mail|contact|write", "ip": "ip|host|server|address|from", "card": "card|visa|credit|payment|pay", "phone": "tel|phone|call|fax|mobile|cell",
    "secret": "token|secret|passw|api|key|auth|credential|bearer", "national": "tel|phone|call|fax|mobile|cell", "ssn": "ssn|social|security", "iban": "iban|bank|account", "spelled": "mail|contact|write",
}
HARMLESS = "version|isbn|issn|commit|sha1|sha256|md5|checksum|build|doi|figure|section|page|id="
#: No labeler is believed beyond this, and a span is added at this probability, if so many more labelers speak for than against it.
MOST, ADDED, NET = 0.9, 0.95, 2
LABELERS = ("format", "gazetteer", "context", "shape")
#: What the classifier sees of a span beside the votes, each a small number from 0 on, and how many values it has.
LOOK = {"long": 2, "digits": 4, "capitals": 3, "variety": 3, "word": 9}
BASE, KINDS = tuple(PATTERNS), (*PATTERNS, *MORE)


def spans_of(text: Column, pattern: str) -> Column:
    """array of (start, end, value, before, after) of the leftmost non-overlapping matches."""

    def place(found: Column, gaps: Column) -> Column:
        step = lambda a, i: F.struct(
            (a["at"] + F.char_length(F.get(gaps, i)) + F.char_length(F.get(found, i))).alias("at"),
            F.concat(a["out"], F.array(F.struct((a["at"] + F.char_length(F.get(gaps, i))).cast("long").alias("start"), (a["at"] + F.char_length(F.get(gaps, i)) + F.char_length(F.get(found, i))).cast("long").alias("end"), F.get(found, i).alias("value"), F.right(F.get(gaps, i), F.lit(24)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(4)).alias("after")))).alias("out"),
        )
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:bigint,end:bigint,value:string,before:string,after:string>>").alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), start, step, lambda a: a["out"])

    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string,before:string,after:string>>")
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) == 0, none).otherwise(let(F.split(text, pattern, -1), lambda gaps: place(found, gaps))))


def luhn(digits: Column) -> Column:
    doubled = lambda d, i: F.when(i % 2 == 1, F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)).otherwise(d)
    values = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: doubled(c.cast("int"), i))
    return F.aggregate(values, F.lit(0), lambda a, d: a + d) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    """The check a match of a base kind has to pass."""
    if kind == "ip":
        return value.rlike(rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$")
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _votes(kind: str, s: Column) -> Column:
    """struct of the labelers' votes on a span of that kind."""
    value, before, after = s["value"], F.lower(s["before"]), s["after"]
    yes_no = lambda yes, no=F.lit(False): F.when(yes, 1).when(no, -1).otherwise(0)
    if kind == "secret":
        form = yes_no(value.rlike(r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$|^(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])[A-Za-z0-9+/_=-]{20,}$"), value.rlike(r"^[0-9-]+$"))
        context = yes_no(before.rlike("[=:\"'] ?[\"']?$"), before.rlike(r"[./\\]$"))
        shape = yes_no(value.rlike("[0-9].*[A-Za-z].*[0-9]"), value.rlike("[-_/=].*[-_/=].*[-_/=]"))
    else:
        form = {"iban": yes_no(F.length(F.regexp_replace(value, " ", "")).between(15, 34), F.lit(True)), "ssn": yes_no(~value.rlike("^(?:000|666|9)|-00-|-0000$"), F.lit(True))}.get(kind, F.lit(1))
        context = yes_no(before.rlike(r"(?:^|[\s:(<\[\"'])$") & ~after.rlike("^[A-Za-z0-9]"), before.rlike(r"[\w./-]$") | after.rlike("^[A-Za-z0-9]"))
        digits = F.regexp_replace(value, "[^0-9]", "")
        shape = yes_no(F.lit(False), digits.rlike(r"^([0-9])\1{6,}$") | digits.isin("1234567890", "0123456789", "123456789")) if kind not in ("email", "spelled") else yes_no(~value.rlike("(?i)noreply|example@"))
    gazetteer = yes_no(before.rlike(f"(?:{NAMES[kind]})[^\\n]{{0,12}}$"), before.rlike(f"(?:{HARMLESS})[^\\n]{{0,8}}$"))
    return F.struct(form.cast("int").alias("format"), gazetteer.cast("int").alias("gazetteer"), context.cast("int").alias("context"), shape.cast("int").alias("shape"))


def _look(s: Column) -> Column:
    """struct of LOOK: length over 24; digits, capitals and different characters by their share; the last word before by its hash."""
    value = s["value"]
    size = F.char_length(value)
    share = lambda pattern: F.char_length(F.regexp_replace(value, pattern, "")) / size
    variety = F.size(F.array_distinct(F.split(value, ""))) / size
    word = F.regexp_extract(F.lower(s["before"]), r"([a-z]+)[^a-z]*$", 1)
    return F.struct(
        (size >= 24).cast("int").alias("long"), F.least(F.floor(share("[^0-9]") * 4), F.lit(3)).cast("int").alias("digits"),
        F.when(share("[^A-Z]") == 0, 0).when(share("[^A-Z]") < 0.5, 1).otherwise(2).alias("capitals"), F.when(variety < 0.3, 0).when(variety < 0.6, 1).otherwise(2).alias("variety"),
        F.when(word == "", 0).otherwise(F.pmod(F.crc32(word), F.lit(LOOK["word"] - 1)) + 1).cast("int").alias("word"),
    )


def _shaped(found: Column, kind: str, order: int) -> Column:
    """The candidates of a kind with their votes; matches of a base kind that fail its check are dropped."""
    own = F.filter(found, lambda s: valid(kind, s["value"])) if kind in BASE else found
    return F.transform(own, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), s["end"].alias("end"), F.lit(kind in BASE).alias("base"), _votes(kind, s).alias("votes"), _look(s).alias("look")))


def candidate_spans(text: Column) -> Column:
    """array of (start, order, kind, end, base, votes, look) of a text, ordered; bases that fail are gone."""
    hints = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9](?:[ -]?[0-9]){13}"), "phone": text.contains("+")}
    hints |= {k: text.rlike(hint) for k, (_, hint) in MORE.items()}
    patterns = PATTERNS | {k: p for k, (p, _) in MORE.items()}
    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string,before:string,after:string>>")
    return F.sort_array(F.concat(*[_shaped(F.when(hints[k], spans_of(text, patterns[k])).otherwise(none), k, order) for order, k in enumerate(KINDS)]))


def candidates(docs: DataFrame) -> DataFrame:
    """Stored doc_id, h and the candidate spans."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), F.coalesce("text", F.lit("")).alias("t"))
    return stored(rows.select("doc_id", "h", candidate_spans(F.col("t")).alias("spans")), "candidates")


def estimate(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 50) -> tuple[dict, dict]:
    """EM over (kind, votes, count): reliabilities of the labelers, and the likelihood of each pattern.

    A labeler that votes is right with its reliability, labelers are independent given the truth, abstaining says nothing.
    """
    right = {j: 0.8 for j in range(len(LABELERS))}
    prior = {k: 0.5 for k, _, _ in patterns}
    post: dict = {}
    for _ in range(rounds):
        for kind, votes, _ in patterns:
            odds = math.log(prior[kind] / (1 - prior[kind])) + sum(v * math.log(right[j] / (1 - right[j])) for j, v in enumerate(votes))
            post[kind, votes] = 1 / (1 + math.exp(-odds))
        for j in right:
            hit = sum(n * (post[k, v] if v[j] > 0 else 1 - post[k, v]) for k, v, n in patterns if v[j])
            all_ = sum(n for _, v, n in patterns if v[j])
            right[j] = min(MOST, max(0.55, (hit + 8) / (all_ + 10)))
        for kind in prior:
            own = [(post[k, v], n) for k, v, n in patterns if k == kind]
            prior[kind] = min(0.5, max(0.05, (sum(p * n for p, n in own) + 1) / (sum(n for _, n in own) + 2)))
    return {LABELERS[j]: r for j, r in right.items()}, post


def train(found: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """(weights of the span classifier by feature, reliabilities). The table of patterns and looks is bounded by their values
    (81 x 648 a kind), few of which occur."""
    flat = found.select(F.explode("spans").alias("s")).groupBy("s.kind", *[f"s.votes.{x}" for x in LABELERS], *[f"s.look.{x}" for x in LOOK]).count()
    rows = flat.collect()
    if not rows:
        return {}, {}
    # every pattern there could be counts once, so that patterns not seen here are judged by the labelers' reliabilities too
    merged: dict = {(k, v): 0 for k in KINDS for v in product((-1, 0, 1), repeat=len(LABELERS))}
    for r in rows:
        key = (r["kind"], tuple(r[x] for x in LABELERS))
        merged[key] += r["count"]
    reliable, post = estimate([(k, v, n) for (k, v), n in merged.items()])
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors

    looks = [(x, v) for x, n in LOOK.items() for v in range(1, n)]
    names = [*LABELERS, *[f"is_{k}" for k in MORE], *[f"{x}_{v}" for x, v in looks]]
    data = []
    seen = [(r["kind"], tuple(r[x] for x in LABELERS), tuple(float(r[x] == v) for x, v in looks), r["count"]) for r in rows]
    plain = (0.0,) * len(looks)
    for kind, votes, look, n in [*seen, *[(k, v, plain, 1) for k, v in merged]]:
        p = post[kind, votes]
        x = Vectors.dense([*map(float, votes), *[float(kind == k) for k in MORE], *look])
        data += [(x, 1.0, p * n), (x, 0.0, (1 - p) * n)]
    frame = found.sparkSession.createDataFrame(data, ["features", "label", "w"])
    model = LogisticRegression(weightCol="w", regParam=1e-3, maxIter=50, standardization=False).fit(frame.coalesce(1))
    return dict(zip(names, map(float, model.coefficients))) | {"bias": float(model.intercept)}, reliable


def chosen(spans: Column, weights: dict[str, float]) -> Column:
    """array of (start, order, kind, end, base): the base spans and those the classifier adds beside them."""

    def score(s: Column) -> Column:
        total = F.lit(weights.get("bias", -10.0))
        for x in LABELERS:
            total = total + s["votes"][x] * weights.get(x, 0.0)
        for x, n in LOOK.items():
            total = total + F.get(F.array(*[F.lit(weights.get(f"{x}_{v}", 0.0)) for v in range(n)]), s["look"][x])
        return total + sum((F.when(s["kind"] == k, weights.get(f"is_{k}", 0.0)).otherwise(0.0) for k in MORE), F.lit(0.0))

    clear = lambda all_, s: ~F.exists(all_, lambda b: b["base"] & (b["start"] < s["end"]) & (s["start"] < b["end"]))
    net = lambda s: sum((s["votes"][x] for x in LABELERS), F.lit(0))
    kept = let(spans, lambda all_: F.filter(all_, lambda s: s["base"] | ((net(s) >= NET) & (score(s) > math.log(ADDED / (1 - ADDED))) & clear(all_, s))))
    # the kinds under which added spans are told
    public = lambda k: F.when(k == "national", "phone").when(k == "spelled", "email").otherwise(k)
    return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["order"].alias("order"), public(s["kind"]).alias("kind"), s["end"].alias("end"), s["base"].alias("base")))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, h and spans: array of (start, order, kind, end, base)."""
    found = candidates(docs)
    weights, _ = train(found)
    return found.select("doc_id", "h", chosen(F.col("spans"), weights).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; n_chars, where present, is counted again. Once the
    classifier is trained, spans are found again in each row, so no text is shuffled. All columns stay, whatever they are called; a
    null text stays null, an empty one empty; repeated rows are treated alike."""
    weights, _ = train(candidates(docs))
    spans, fresh_text = unused(docs, "s", "new")
    rows = docs.withColumn(spans, chosen(candidate_spans(F.coalesce("text", F.lit(""))), weights))
    text = F.col("text")

    def step(a: Column, s: Column) -> Column:
        fresh = s["start"] >= a["at"]
        piece = F.concat(F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(fresh, F.concat(a["out"], F.array(piece))).otherwise(a["out"]).alias("out"))

    done = F.aggregate(spans, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out")), step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, (a["at"] + 1).cast("int"), F.char_length(text))))
    out = rows.withColumn(fresh_text, F.when(F.size(spans) == 0, text).otherwise(done))
    counted = F.when(text.isNotNull(), F.char_length(fresh_text).cast("long"))
    shown = {"text": F.col(fresh_text).alias("text")} | ({"n_chars": counted.otherwise(F.col("n_chars")).alias("n_chars")} if "n_chars" in docs.columns else {})
    return out.select(*[shown.get(c, F.col(f"`{c}`")) for c in docs.columns])
