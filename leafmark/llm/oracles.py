"""DuckDB's SQL for the queries that SQL can express."""

from __future__ import annotations

from leafmark.llm.common import LOWER, UPPER

_WORD = r"[^\x20\x09-\x0D]+"
_LOW = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"

#: The grid of rules, with the metrics in SQL.
_METRICS = {"symbols": "n_symbols / greatest(word_chars, 1)", "same_lines": "n_dup_lines / greatest(n_lines, 1)", "repeats": "n_repeat_words / greatest(n_words, 1)", "long_words": "word_chars / greatest(n_words, 1)"}
_CUTOFFS = {"symbols": (0.3, 0.2, 0.1, 0.05, 0.02), "same_lines": (0.9, 0.75, 0.5, 0.3, 0.2), "repeats": (0.45, 0.35, 0.25, 0.15, 0.1), "long_words": (12.0, 10.0, 9.0, 8.0, 7.5)}
_GRID = [(name, i, c) for name, cuts in _CUTOFFS.items() for i, c in enumerate(cuts)]
_TAIL = "list_sum(list_transform(range(CAST(false_n + 1 AS BIGINT)), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({p}) + (n - j) * ln(1 - {p}))))"
_RISK, _DELTA = 0.05, 0.05

OP1 = f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, lang AS stratum, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
grams AS (SELECT k, i, concat_ws(chr(1), w[i], w[i + 1], w[i + 2]) AS g FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (SELECT k, i FROM (SELECT *, count(*) OVER (PARTITION BY k, g) AS c FROM grams) WHERE c > 1),
rep AS (SELECT k, count(DISTINCT p) AS r FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY k),
lines AS (SELECT k, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l FROM d),
f AS (SELECT k, doc_id, stratum, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars, len(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, len(l) AS n_lines, coalesce(r, 0) AS n_repeat_words
  FROM d JOIN lines USING (k) LEFT JOIN rep USING (k)),
m AS (SELECT *, {", ".join(f"{sql} AS m_{name}" for name, sql in _METRICS.items())} FROM f),
judged AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
held AS (SELECT m.*, quality > 0 AS good FROM m JOIN judged USING (doc_id)),
tests AS ({" UNION ALL ".join(f"SELECT stratum, '{n}' AS rule, {i} AS i, CAST({c} AS DOUBLE) AS cutoff, count(*) FILTER (WHERE good) AS n, count(*) FILTER (WHERE good AND m_{n} >= {c}) AS false_n, count(*) FILTER (WHERE NOT good AND m_{n} >= {c}) AS true_n FROM held GROUP BY stratum" for n, i, c in _GRID)}),
passed AS (SELECT * FROM tests WHERE n > 0 AND true_n > 0 AND false_n <= n * {_RISK / len(_METRICS)} AND {_TAIL.format(p=_RISK / len(_METRICS))} <= {_DELTA} / ((SELECT count(DISTINCT stratum) + max(CASE WHEN stratum IS NULL THEN 1 ELSE 0 END) FROM held) * {len(_GRID)})),
best AS (SELECT stratum, rule, cutoff FROM (SELECT *, row_number() OVER (PARTITION BY stratum, rule ORDER BY true_n DESC, i) AS rn FROM passed) WHERE rn = 1),
over AS (SELECT DISTINCT k FROM m JOIN best b ON m.stratum IS NOT DISTINCT FROM b.stratum AND ({" OR ".join(f"(rule = '{n}' AND m_{n} >= cutoff)" for n in _METRICS)}))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND k NOT IN (SELECT k FROM over) AS kept FROM f"""

_BENCH_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP4 = f"""WITH items AS (SELECT item_id, regexp_extract_all({_LOW}, '{_BENCH_WORD}') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS l, array_to_string(w[i : i + 9], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all({_LOW}, '{_BENCH_WORD}') AS w FROM documents),
pos AS (SELECT k, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM win)),
hit AS (SELECT k, i, pos.l AS l, item_id FROM pos JOIN win ON pos.l = win.l AND array_to_string(w[i : i + pos.l - 1], ' ') = g),
covered AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest(range(i, i + l)) AS p FROM hit) GROUP BY k),
found AS (SELECT k, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM hit GROUP BY k)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_hit, coalesce(len(ids), 0) AS n_items, sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated FROM d LEFT JOIN covered USING (k) LEFT JOIN found USING (k)"""

OP7 = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW}, '{_WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
reach AS (SELECT x AS doc_id, y AS r FROM links UNION SELECT reach.doc_id, links.y FROM reach JOIN links ON links.x = reach.r),
marks AS (SELECT doc_id, md5(string_agg(g, chr(1) ORDER BY g)) AS own FROM s GROUP BY doc_id),
degree AS (SELECT x AS doc_id, count(DISTINCT b.own) AS links FROM links JOIN marks a ON a.doc_id = x JOIN marks b ON b.doc_id = y WHERE a.own <> b.own GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, coalesce(links, 0) AS links FROM d LEFT JOIN n USING (doc_id) LEFT JOIN degree USING (doc_id) LEFT JOIN (SELECT doc_id, min(r) AS m FROM reach GROUP BY doc_id) USING (doc_id)"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
OP11 = f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all({_LOW}, '{_TERM}') AS w FROM documents),
tf AS (SELECT k, t, count(*) AS tf FROM (SELECT k, unnest(w) AS t FROM d) GROUP BY ALL),
total AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
weight AS (SELECT t, CAST(floor(1000 * ln((2 * n + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), total),
m AS (SELECT k, doc_id, 100 - 25 + (25 * len(w) * n) // l AS m FROM d, total),
i AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all({_LOW}, '{_TERM}') AS w FROM benchmark),
asked AS (SELECT q, item_id, unnest(w) AS t FROM i),
scores AS (SELECT q, item_id, k, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM asked JOIN weight USING (t) JOIN tf USING (t) JOIN m USING (k) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0) WHERE rank <= 20"""

ORACLES = {"op1_quality_rules": OP1, "op4_decontamination": OP4, "op7_jaccard_join": OP7, "op11_ranked_search": OP11}
