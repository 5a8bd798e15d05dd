"""The registered queries in DuckDB's SQL, on the same views."""

from __future__ import annotations

from leafmark.plans.fixtures import common_tables

_INSIDE = """CASE WHEN s.start_page = s.end_page AND s.end_page = e.page_idx THEN s.start_y <= e.y1 AND e.y1 < s.end_y
    WHEN e.page_idx = s.start_page THEN e.y1 >= s.start_y WHEN e.page_idx = s.end_page THEN e.y1 < s.end_y
    ELSE s.start_page < e.page_idx AND e.page_idx < s.end_page END"""
_FIT = "rw BETWEEN 0.045 AND 0.85 AND rh BETWEEN 0.015 AND 0.25 AND ra >= 0.0003 AND score >= 0.65"
_TITLE_ONLY = "start_page = end_page AND end_y - start_y < 170"
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def _fold(source: str, kept: str) -> str:
    return f"""SELECT doc_id, min(section_idx) AS section_idx, arg_min(title, section_idx) AS title, arg_min(start_page, section_idx) AS start_page, arg_min(start_y, section_idx) AS start_y,
        arg_max(end_page, section_idx) AS end_page, arg_max(end_y, section_idx) AS end_y, arg_min(ancestors, section_idx) AS ancestors, list_distinct(flatten(list(labels))) AS labels,
        CAST(sum(total_elements) AS BIGINT) AS total_elements, CAST(sum(formulas) AS BIGINT) AS formulas, CAST(sum(numbers) AS BIGINT) AS numbers
        FROM (SELECT *, sum(CASE WHEN {kept} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY section_idx) AS g FROM {source}) WHERE g > 0 GROUP BY doc_id, g"""


_DOT = "list_dot_product(CAST({} AS DOUBLE[]), CAST({} AS DOUBLE[]))"
_MAX_SIM = "SELECT query_id, chunk_id, sum(s) AS score FROM (SELECT q.query_id, q.tok, d.chunk_id, max({dot}) AS s FROM fx_query_tokens q, {docs} d {where} GROUP BY ALL) GROUP BY ALL"
_RANK = "row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id)"

#: The planes of operators.lsh: 20 tables of 11, by a rule; a query token looks beyond the three nearest of each table.
_NEXT = "SELECT i, j, (s * s + 12345 * s + 7) % 2147483647 AS s FROM ({})"
_PLANES = "SELECT i, j, CASE WHEN s % 2 = 0 THEN 1.0 ELSE -1.0 END AS h FROM (" + _NEXT.format(_NEXT.format(_NEXT.format("SELECT i, j, i * 1009 + j + 1 AS s FROM (SELECT unnest(range(220)) AS i), (SELECT unnest(range(64)) AS j)"))) + ")"

#: Steps that several queries build on, in order.
STEPS = common_tables() | {
    "sheets": "SELECT doc_id, page_idx, 800 + doc_id % 9 * 100 + page_idx * 3 AS width, 1200 + doc_id % 5 * 150 AS height FROM fx_pages",
    "crops": """SELECT p.doc_id, p.page_idx AS orig_page_idx, row_number() OVER (PARTITION BY p.doc_id ORDER BY p.page_idx) - 1 AS page_idx, greatest(a - 30, 0) AS x0, greatest(b - 30, 0) AS y0, least(c + 30, width) AS x1, least(d + 30, height) AS y1
        FROM fx_pages p JOIN (SELECT doc_id, page_idx, min(x1) AS a, min(y1) AS b, max(x2) AS c, max(y2) AS d FROM fx_elements WHERE label IN ('text', 'number') GROUP BY ALL) h USING (doc_id, page_idx)""",
    "measured": """SELECT *, w / width AS rw, h / height AS rh, w * h AS area, (w * h) / (width * height) AS ra FROM (SELECT e.*, p.width, p.height, x2 - x1 AS w, y2 - y1 AS h FROM fx_elements e JOIN fx_pages p USING (doc_id, page_idx) WHERE label = 'formula')""",
    "records": f"""SELECT doc_id, page_idx, ord, concat('page_', page_idx, '_formula_', row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY ord) - 1) AS formula_id, w AS width, h AS height, area,
        round_even(rw, 4) AS width_ratio, round_even(rh, 4) AS height_ratio, round_even(ra, 6) AS area_ratio FROM measured WHERE {_FIT}""",
    "rejected": f"SELECT * FROM measured WHERE NOT ({_FIT})",
    "best": """SELECT doc_id, page_idx, ord, y1, ocr, round(y1 / height * 100, 6) AS y_percent FROM (SELECT e.*, p.height, row_number() OVER (PARTITION BY e.doc_id, e.page_idx ORDER BY y1 DESC, ord) AS rn
        FROM fx_elements e JOIN fx_pages p USING (doc_id, page_idx) WHERE label = 'number' AND trim(coalesce(ocr, '')) <> '') WHERE rn = 1""",
    "typed": "SELECT *, coalesce(CAST(number AS VARCHAR), trim(ocr)) AS label FROM (SELECT *, regexp_full_match(trim(ocr), '[0-9]+') AS is_digit, CASE WHEN regexp_full_match(trim(ocr), '[0-9]+') THEN CAST(trim(ocr) AS BIGINT) END AS number FROM best)",
    "cuts": "SELECT doc_id, page_idx, greatest(0, y1 - 60) AS cut FROM best",
    "titles": "SELECT *, row_number() OVER w AS rn, lead(page_idx) OVER w AS np, lead(y1) OVER w AS ny FROM fx_elements WHERE label = 'paragraph_title' WINDOW w AS (PARTITION BY doc_id ORDER BY page_idx, y1, ord)",
    "sections": """SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS section_idx, title, title_ord, CAST(start_page AS BIGINT) AS start_page, CAST(start_y AS BIGINT) AS start_y, CAST(end_page AS BIGINT) AS end_page, CAST(end_y AS BIGINT) AS end_y FROM (
        SELECT doc_id, 0 AS k, 'noname' AS title, NULL AS title_ord, 0 AS start_page, 0 AS start_y, CASE WHEN y1 > 100 THEN page_idx ELSE page_idx - 1 END AS end_page, CASE WHEN y1 > 100 THEN y1 ELSE 99999999 END AS end_y FROM titles WHERE rn = 1 AND (y1 > 100 OR page_idx > 0)
        UNION ALL SELECT doc_id, rn, ocr, ord, page_idx, y1, CASE WHEN np IS NULL THEN 11 WHEN ny < 100 THEN np - 1 ELSE np END, CASE WHEN np IS NULL OR ny < 100 THEN 999999 ELSE ny END FROM titles)""",
    "assigned": f"SELECT e.doc_id, e.ord, e.label, min(s.section_idx) AS section_idx FROM fx_elements e JOIN sections s ON e.doc_id = s.doc_id AND ({_INSIDE}) WHERE label IN ('formula', 'number', 'formula_number') GROUP BY ALL",
    "formulas_in": f"SELECT e.doc_id, s.section_idx, e.ord, e.page_idx, e.x1, e.y1, e.x2, e.y2 FROM fx_elements e JOIN sections s ON e.doc_id = s.doc_id AND s.start_page <= s.end_page AND ({_INSIDE}) WHERE label = 'formula'",
    "summary": """SELECT s.doc_id, s.section_idx, s.title, concat(s.start_page, '-', s.end_page) AS page_range, coalesce(n, 0) AS total_elements, coalesce(f, 0) AS formulas, coalesce(m, 0) AS numbers FROM sections s
        LEFT JOIN (SELECT doc_id, section_idx, count(*) AS n, count(*) FILTER (WHERE label <> 'formula') AS m FROM assigned GROUP BY ALL) USING (doc_id, section_idx)
        LEFT JOIN (SELECT doc_id, section_idx, count(*) AS f FROM formulas_in GROUP BY ALL) USING (doc_id, section_idx)""",
    "labels": "SELECT s.doc_id, s.section_idx, coalesce(list(t.label ORDER BY t.page_idx) FILTER (WHERE t.label IS NOT NULL), []) AS labels FROM sections s LEFT JOIN typed t ON t.doc_id = s.doc_id AND t.page_idx BETWEEN s.start_page AND s.end_page GROUP BY ALL",
    "heads": r"""SELECT * FROM (SELECT doc_id, section_idx AS idx, title, CASE WHEN regexp_matches(title, '^\s*([0-9]+|[IVX]+)章') THEN regexp_extract(title, '^\s*([0-9]+|[IVX]+)章', 1)
        WHEN regexp_matches(title, '^\s*[0-9]+(\.[0-9]+)*[0-9.]*[)）]') THEN '' ELSE regexp_extract(title, '^\s*([0-9]+(\.[0-9]+)*)', 1) END AS key FROM sections) WHERE key <> ''""",
    "parents": r"SELECT c.doc_id, c.idx, max(p.idx) AS parent FROM heads c JOIN heads p ON p.doc_id = c.doc_id AND c.key LIKE '%.%' AND p.key = regexp_replace(c.key, '\.[0-9]+$', '') AND p.idx < c.idx GROUP BY ALL",
    "chain": "SELECT h.doc_id, h.idx, parent AS top, CASE WHEN parent IS NULL THEN [] ELSE [parent] END AS path FROM heads h LEFT JOIN parents USING (doc_id, idx) UNION ALL SELECT c.doc_id, c.idx, p.parent, list_prepend(p.parent, c.path) FROM chain c JOIN parents p ON p.doc_id = c.doc_id AND p.idx = c.top",
    "tree": "SELECT doc_id, idx, key, path AS ancestors FROM (SELECT doc_id, idx, arg_max(path, len(path)) AS path FROM chain GROUP BY ALL) JOIN heads USING (doc_id, idx)",
    "judged": """SELECT s.*, (s.section_idx = 0 AND s.title = 'noname') OR t.ancestors IS NOT NULL AS kept, CASE WHEN s.section_idx = 0 AND s.title = 'noname' THEN [] ELSE coalesce(t.ancestors, []) END AS ancestors FROM sections s LEFT JOIN tree t ON t.doc_id = s.doc_id AND t.idx = s.section_idx""",
    "named": "SELECT a.doc_id, a.section_idx, string_agg(s.title, '|' ORDER BY a.pos) AS names FROM (SELECT doc_id, section_idx, unnest(ancestors) AS a, generate_subscripts(ancestors, 1) AS pos FROM judged) a JOIN sections s ON s.doc_id = a.doc_id AND s.section_idx = a.a GROUP BY ALL",
    "rows0": "SELECT j.*, u.total_elements, u.formulas, u.numbers, l.labels FROM judged j JOIN summary u USING (doc_id, section_idx) JOIN labels l USING (doc_id, section_idx)",
    "rows3": _fold("rows0", "kept"),
    "rows4": f"SELECT * FROM rows3 r WHERE NOT (({_TITLE_ONLY}) AND EXISTS (SELECT 1 FROM (SELECT doc_id, unnest(ancestors) AS a FROM rows3) x WHERE x.doc_id = r.doc_id AND x.a = r.section_idx))",
    "rows5": _fold("(SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY section_idx) AS rn FROM rows4)", f"rn = 1 OR NOT ({_TITLE_ONLY})"),
    "slices0": """SELECT s.doc_id, s.section_idx, p.page_idx, p.width, c.cut, CASE WHEN p.page_idx = s.start_page THEN s.start_y ELSE 0 END AS y_start, CASE WHEN p.page_idx = s.end_page THEN least(s.end_y, p.height) ELSE p.height END AS uncut_end
        FROM sections s JOIN fx_pages p ON p.doc_id = s.doc_id AND p.page_idx BETWEEN s.start_page AND s.end_page LEFT JOIN cuts c ON c.doc_id = p.doc_id AND c.page_idx = p.page_idx""",
    "slices": """SELECT *, coalesce(sum(y_end - y_start) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS merged_start, sum(y_end - y_start) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS merged_end
        FROM (SELECT *, least(uncut_end, coalesce(cut, uncut_end)) AS y_end FROM slices0) WHERE (cut IS NULL OR y_start < cut) AND y_end > y_start WINDOW w AS (PARTITION BY doc_id, section_idx ORDER BY page_idx)""",
    "placed": """SELECT f.doc_id, f.section_idx, f.page_idx, f.ord, f.x1, CAST(merged_start + f.y1 - y_start AS BIGINT) AS y1, f.x2, CAST(merged_start + f.y2 - y_start AS BIGINT) AS y2 FROM formulas_in f JOIN slices s USING (doc_id, section_idx, page_idx)
        WHERE (cut IS NULL OR cut = 0 OR (f.y1 < cut AND f.y2 <= cut)) AND y_start <= f.y1 AND f.y1 < y_end AND y_start <= f.y2 AND f.y2 <= y_end""",
    "dims": "SELECT chunk_id, tok, unnest(CAST(vec AS DOUBLE[])) AS v, generate_subscripts(vec, 1) - 1 AS dim FROM fx_tokens",
    "pooled": """SELECT chunk_id, kind, pos, dim, avg(v) AS v FROM (SELECT chunk_id, 'mean_r' AS kind, CASE WHEN tok = 0 THEN 0 ELSE (tok - 1) % 2 + 1 END AS pos, dim, v FROM dims
        UNION ALL SELECT chunk_id, 'mean_c', CASE WHEN tok = 0 THEN 0 ELSE CAST(floor((tok - 1) / 2) AS BIGINT) + 1 END, dim, v FROM dims) GROUP BY ALL""",
    "pooled_vecs": "SELECT chunk_id, kind, pos, list(v ORDER BY dim) AS vec FROM pooled GROUP BY ALL",
    "scores": _MAX_SIM.format(dot=_DOT.format("q.vec", "d.vec"), docs="fx_tokens", where=""),
    "stage_c": f"SELECT *, {_RANK} AS r FROM (" + _MAX_SIM.format(dot=_DOT.format("q.vec", "d.vec"), docs="pooled_vecs", where="WHERE d.kind = 'mean_c'") + ")",
    "stage_r": f"SELECT *, {_RANK} AS r FROM (" + _MAX_SIM.format(dot=_DOT.format("q.vec", "d.vec"), docs="pooled_vecs", where="WHERE d.kind = 'mean_r'") + ")",
    "found": f"SELECT * FROM (SELECT query_id, chunk_id, score, {_RANK} AS rank FROM scores JOIN (SELECT query_id, chunk_id FROM stage_c WHERE r <= 50 UNION SELECT query_id, chunk_id FROM stage_r WHERE r <= 50) USING (query_id, chunk_id)) WHERE rank <= 5",
    "planes": _PLANES,
    "bucket_of": """SELECT DISTINCT chunk_id, tab, bucket FROM (SELECT chunk_id, kind, pos, i // 11 AS tab, CAST(sum(CASE WHEN m > 0 THEN 1 << CAST(i % 11 AS INTEGER) ELSE 0 END) AS BIGINT) AS bucket
        FROM (SELECT chunk_id, kind, pos, i, sum(v * h) AS m FROM pooled JOIN planes ON j = dim GROUP BY ALL) GROUP BY ALL)""",
    "query_sides": """SELECT query_id, tok, i // 11 AS tab, i % 11 AS b, m, row_number() OVER (PARTITION BY query_id, tok, i // 11 ORDER BY abs(m), i) AS near FROM (SELECT query_id, tok, i, sum(v * h) AS m
        FROM (SELECT query_id, tok, unnest(CAST(vec AS DOUBLE[])) AS v, generate_subscripts(vec, 1) - 1 AS dim FROM fx_query_tokens) JOIN planes ON j = dim GROUP BY ALL)""",
    "looked_into": """SELECT DISTINCT query_id, tab, CAST(xor(own, turned) AS BIGINT) AS bucket FROM (SELECT query_id, tok, tab, f, CAST(sum(CASE WHEN m > 0 THEN 1 << CAST(b AS INTEGER) ELSE 0 END) AS BIGINT) AS own,
        CAST(sum(CASE WHEN near <= 3 AND (f >> CAST(near - 1 AS INTEGER)) % 2 = 1 THEN 1 << CAST(b AS INTEGER) ELSE 0 END) AS BIGINT) AS turned FROM query_sides, (SELECT unnest(range(8)) AS f) GROUP BY ALL)""",
    "lsh_near": "SELECT DISTINCT query_id, chunk_id FROM bucket_of JOIN looked_into USING (tab, bucket)",
    "lsh_found": f"SELECT * FROM (SELECT query_id, chunk_id, score, {_RANK} AS rank FROM scores JOIN (" + " UNION ".join(f"SELECT query_id, chunk_id FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY r) AS r FROM {stage} JOIN lsh_near USING (query_id, chunk_id)) WHERE r <= 50" for stage in ("stage_c", "stage_r")) + ") USING (query_id, chunk_id)) WHERE rank <= 5",
    "near": f"SELECT DISTINCT query_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id, tok ORDER BY round(s, 9) DESC, chunk_id, doc_tok) AS r FROM (SELECT q.query_id, q.tok, d.chunk_id, d.tok AS doc_tok, {_DOT.format('q.vec', 'd.vec')} AS s FROM fx_query_tokens q, fx_tokens d)) WHERE r <= 20",
    "titles_of": """SELECT b.*, CASE WHEN has_report THEN concat(coalesce(t, 'Document'), ' (', total_pages, ' pages)') ELSE concat('Book ', book_index) END AS title, CASE WHEN has_report THEN total_pages ELSE 0 END AS shown_pages FROM fx_books b
        LEFT JOIN (SELECT collection, book_index, arg_min(trim(title), pos) AS t FROM fx_toc_sections WHERE trim(title) <> '' AND lower(trim(title)) <> 'noname' GROUP BY ALL) USING (collection, book_index)""",
    "listed": "SELECT collection, book_index, count(*) AS n, string_agg(concat(k, ';', title, ';', start_page, ';', formulas), ',' ORDER BY pos) AS full_list, string_agg(title, ',' ORDER BY pos) AS simple_list FROM (SELECT *, row_number() OVER (PARTITION BY collection, book_index ORDER BY pos) - 1 AS k FROM fx_toc_sections) GROUP BY ALL",
    "gated": """SELECT *, reason IS NULL AS accepted FROM (SELECT *, CASE WHEN batch = 'src3' THEN 'metadata_mismatch' WHEN NOT ends_with(lower(name), '.pdf') THEN 'not_pdf' WHEN size_bytes > 524288000 THEN 'too_large' END AS reason FROM fx_files)""",
    "asked": r"""SELECT conv_id AS session_id, regexp_replace(coalesce(arg_min(text, turn) FILTER (WHERE role = 'user'), ''), '^\s+|\s+$', '', 'g') AS t, count(*) FILTER (WHERE role = 'user') AS turns, count(*) AS messages, max(turn) AS last_turn FROM conversations GROUP BY ALL""",
    "waiting": "SELECT *, row_number() OVER (PARTITION BY shard ORDER BY tokens, seq) AS k FROM (SELECT concat(batch, ':', CAST(floor(seq / 20000) AS BIGINT)) AS shard, seq, pages * 90 + 200 + seq % 97 AS tokens FROM fx_files)",
    "batched": """SELECT shard, seq, tokens, k, 0 AS batch, 1 AS size FROM waiting WHERE k = 1
        UNION ALL SELECT w.shard, w.seq, w.tokens, w.k, CASE WHEN (b.size + 1) * w.tokens > 13000 THEN b.batch + 1 ELSE b.batch END, CASE WHEN (b.size + 1) * w.tokens > 13000 THEN 1 ELSE b.size + 1 END FROM batched b JOIN waiting w ON w.shard = b.shard AND w.k = b.k + 1""",
    "points": "SELECT collection, chunk_id % 6 AS f, chunk_id AS position, section_title FROM fx_chunks",
}
# the same steps on the folded sections
STEPS |= {f"b_{k}": STEPS[k].replace("sections s", "rows5 s").replace("formulas_in f", "b_formulas_in f").replace("slices0", "b_slices0").replace("slices s", "b_slices s") for k in ("formulas_in", "slices0", "slices", "placed")}
_RAW = "CASE ord % 6 WHEN 0 THEN concat('Page ', ocr) WHEN 1 THEN concat(ocr, ' – ', ord) WHEN 2 THEN '--' WHEN 3 THEN NULL ELSE ocr END"
_FLAT = "doc_id, section_idx, title, start_page, start_y, end_page, end_y, array_to_string(list_sort(labels), '|') AS labels, total_elements, formulas, numbers"
_BOOKS = "SELECT collection, book_index, CAST(book_index AS VARCHAR) AS book_folder, title, shown_pages AS total_pages, CASE WHEN has_report THEN total_sections ELSE 0 END AS total_sections, md5(CASE WHEN has_report THEN coalesce({}, '') ELSE '' END) AS sections_md5{} FROM titles_of LEFT JOIN listed USING (collection, book_index)"
_NUMBERS = ", CASE WHEN has_report THEN page_numbers END AS page_numbers"
_F = 28.0
_FINALS = {
    "op_pg1": "SELECT doc_id, CAST(greatest(45, floor(500990 / (width * height) * 300)) AS BIGINT) AS dpi FROM sheets WHERE page_idx = 0",
    "op_pg2": "SELECT * FROM sheets WHERE page_idx < 5",
    "op_pg3": "SELECT doc_id, page_idx * 2 + s AS page_idx, CASE s WHEN 0 THEN 0 ELSE w2 END AS x0, CASE s WHEN 0 THEN w2 ELSE width END AS x1, CASE s WHEN 0 THEN w2 ELSE width - w2 END AS width, height FROM (SELECT *, width // 2 AS w2 FROM sheets), (VALUES (0), (1)) v(s)",
    "op_pg4": "SELECT doc_id, page_idx, x0, y0, width - least(900, width - x0) AS x1, height - least(1300, height - y0) AS y1 FROM (SELECT *, least(50, width) AS x0, least(100, height) AS y0 FROM sheets)",
    "op_pg5": "SELECT * FROM crops",
    "op_pg6": "SELECT doc_id, page_idx, x1 - x0 AS width, max(x1 - x0) OVER (PARTITION BY doc_id) AS max_width, (max(x1 - x0) OVER (PARTITION BY doc_id) - (x1 - x0)) // 2 AS offset_x FROM crops",
    "op_pg7": """SELECT doc_id, page_idx, CASE WHEN NOT far THEN gw END AS grid_w, CASE WHEN NOT far THEN gh END AS grid_h, CASE WHEN NOT far THEN gw * gh END AS tokens FROM (SELECT *, CAST(floor(floor(w / 14) / 2) AS BIGINT) AS gw, CAST(floor(floor(h / 14) / 2) AS BIGINT) AS gh FROM (
        SELECT *, NOT inside AND greatest(height, width) / least(height, width) > 200 AS far,
          CASE WHEN inside THEN 588 WHEN h1 * w1 > 1003520 THEN greatest(28, floor(width / dn / 28) * 28) WHEN h1 * w1 < 3136 THEN ceil(width * up / 28) * 28 ELSE w1 END AS w,
          CASE WHEN inside THEN tall WHEN h1 * w1 > 1003520 THEN greatest(28, floor(height / dn / 28) * 28) WHEN h1 * w1 < 3136 THEN ceil(height * up / 28) * 28 ELSE h1 END AS h
        FROM (SELECT *, tall * 588 BETWEEN 3136 AND 1003520 AS inside, sqrt(height * width / 1003520) AS dn, sqrt(3136 / (height * width)) AS up FROM (
          SELECT *, round_even(588 / width * height / 28, 0) * 28 AS tall, round_even(height / 28, 0) * 28 AS h1, round_even(width / 28, 0) * 28 AS w1 FROM (SELECT doc_id, page_idx, width, CASE WHEN page_idx = 11 THEN height * 40 ELSE height END AS height FROM sheets)))))""",
    "op_el1": "SELECT doc_id, page_idx, ord, label, x1, y1, x2, y2 FROM fx_elements WHERE label <> 'text'",
    "op_el2": "SELECT label, count(*) AS n FROM fx_elements GROUP BY ALL",
    "op_el3": "SELECT doc_id, page_idx, ord, greatest(x1 - 10, 0) AS cx1, greatest(y1 - 10, 0) AS cy1, least(x2 + 10, width) AS cx2, least(y2 + 10, height) AS cy2 FROM fx_elements JOIN fx_pages USING (doc_id, page_idx)",
    "op_el4": f"SELECT doc_id, page_idx, ord, score FROM measured WHERE {_FIT}",
    "op_el5": "SELECT * FROM records",
    "op_el6_reasons": """SELECT reason, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM rejected), 6) AS percent FROM (SELECT unnest(list_filter([CASE WHEN rw < 0.045 THEN 'width_too_small' END, CASE WHEN rh < 0.015 THEN 'height_too_small' END, CASE WHEN ra < 0.0003 THEN 'area_too_small' END,
        CASE WHEN rw > 0.85 THEN 'width_too_large' END, CASE WHEN rh > 0.25 THEN 'height_too_large' END, CASE WHEN score < 0.65 THEN 'score_too_low' END], lambda x: x IS NOT NULL)) AS reason FROM rejected) GROUP BY ALL""",
    "op_el6_sizes": " UNION ALL ".join(f"SELECT '{m}' AS metric, round(min(CAST({c} AS DOUBLE)), 6) AS lowest, round(max(CAST({c} AS DOUBLE)), 6) AS highest, round(avg(CAST({c} AS DOUBLE)), 6) AS mean, count(*) AS n FROM rejected" for m, c in {"width": "w", "height": "h", "area": "area", "width_ratio": "rw", "height_ratio": "rh", "area_ratio": "ra"}.items()),
    "op_el6_pages": "SELECT page_idx, count(*) AS n FROM rejected GROUP BY ALL",
    "op_el7": "SELECT doc_id, formula_id, CASE WHEN ord % 3 <> 0 THEN concat('tex', ord) ELSE '' END AS ocr_content FROM records",
    "op_pn1": "SELECT * FROM best",
    "op_pn2": "SELECT doc_id, page_idx, label, number, is_digit FROM typed",
    "op_pn3": "SELECT * FROM cuts",
    "op_pn4": "SELECT doc_id, section_idx, array_to_string(labels, '|') AS labels FROM labels",
    "op_pn5": rf"""SELECT ord, CASE WHEN raw IS NULL OR raw = '' THEN '' WHEN regexp_matches(raw, '(?i)^(trang|page)\b') THEN raw WHEN bare = '' THEN raw
        WHEN len(parts) = 2 AND parts[1] <> '' AND parts[2] <> '' THEN concat('Trang ', parts[1], ' - ', parts[2]) ELSE concat('Trang ', bare) END AS shown
        FROM (SELECT *, string_split_regex(bare, '\s*[-–—]\s*') AS parts FROM (SELECT *, regexp_replace(raw, '^[\s–—-]+|[\s–—-]+$', '', 'g') AS bare FROM (SELECT ord, {_STRIP.format(_RAW)} AS raw FROM fx_elements)))""",
    "op_pn6": "SELECT doc_id, section_idx, array_to_string(labels[1:4], '|') AS shown, greatest(0, len(labels) - 4) AS hidden FROM labels",
    "op_se1": "SELECT * FROM sections",
    "op_se2": "SELECT doc_id, ord, section_idx FROM assigned",
    "op_se3": "SELECT doc_id, section_idx, count(*) AS formulas FROM formulas_in GROUP BY ALL",
    "op_se4": "SELECT * FROM summary",
    "op_se5": """SELECT p.doc_id, p.n AS total_pages, coalesce(s.n, 0) AS total_sections, coalesce(t.l, '') AS page_numbers, coalesce(t.n, 0) AS numbered_pages FROM (SELECT doc_id, count(*) AS n FROM fx_pages GROUP BY ALL) p
        LEFT JOIN (SELECT doc_id, count(*) AS n FROM sections GROUP BY ALL) s USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n, string_agg(concat(page_idx, '=', label), '|' ORDER BY page_idx) AS l FROM typed GROUP BY ALL) t USING (doc_id)""",
    "op_hi1": "SELECT doc_id, idx, key, array_to_string(ancestors, '|') AS ancestors FROM tree",
    "op_hi2": "SELECT doc_id, section_idx, kept, array_to_string(ancestors, '|') AS ancestors, coalesce(names, '') AS ancestor_titles FROM judged LEFT JOIN named USING (doc_id, section_idx)",
    "op_hi3": f"SELECT {_FLAT} FROM rows3",
    "op_hi4": f"SELECT {_FLAT} FROM rows4",
    "op_hi5": f"SELECT {_FLAT} FROM rows5",
    "op_hi6": "SELECT doc_id, count(*) AS total_sections FROM rows5 GROUP BY ALL",
    "op_st1": "SELECT doc_id, section_idx, page_idx, width, y_start, y_end, uncut_end, cut, CAST(merged_start AS BIGINT) AS merged_start, CAST(merged_end AS BIGINT) AS merged_end FROM slices",
    "op_st2": """SELECT s.doc_id, s.section_idx, coalesce(w, 100) AS width, CAST(coalesce(h, 100) AS BIGINT) AS height, CAST(coalesce(c, 0) AS BIGINT) AS saved_pixels, coalesce(n, 0) AS n_slices FROM sections s
        LEFT JOIN (SELECT doc_id, section_idx, max(width) AS w, sum(y_end - y_start) AS h, sum(CASE WHEN cut IS NULL THEN 0 ELSE uncut_end - y_end END) AS c, count(*) AS n FROM slices GROUP BY ALL) USING (doc_id, section_idx)""",
    "op_st3": "SELECT * FROM placed",
    "op_st4": r"""SELECT j.doc_id, j.section_idx, j.title AS section_title, coalesce(f.f, '') AS formulas, array_to_string(l.labels, '|') AS section_pages, CASE WHEN start_page <= end_page THEN array_to_string(range(start_page, end_page + 1), '|') ELSE '' END AS section_pages_index, coalesce(names, '') AS ancestors,
        concat('section_', lpad(CAST(j.section_idx AS VARCHAR), CAST(greatest(2, len(CAST(j.section_idx AS VARCHAR))) AS INTEGER), '0'), '_', trim(substring(regexp_replace(j.title, '[<>:"/\\|?*]', '_', 'g'), 1, 50)), '.png') AS image_path FROM judged j JOIN labels l USING (doc_id, section_idx) LEFT JOIN named USING (doc_id, section_idx)
        LEFT JOIN (SELECT doc_id, section_idx, string_agg(concat('tex', ord, ':', page_idx, ':', y1), '|' ORDER BY ord) AS f FROM placed GROUP BY ALL) f USING (doc_id, section_idx)""",
    "op_st4_books": """SELECT j.doc_id, j.section_idx, j.title AS section_title, coalesce(f.f, '') AS formulas, array_to_string(list_sort(labels), '|') AS section_pages, CASE WHEN start_page <= end_page THEN array_to_string(range(start_page, end_page + 1), '|') ELSE '' END AS section_pages_index, coalesce(names, '') AS ancestors
        FROM rows5 j LEFT JOIN named USING (doc_id, section_idx) LEFT JOIN (SELECT doc_id, section_idx, string_agg(concat('tex', ord, ':', page_idx, ':', y1), '|' ORDER BY ord) AS f FROM b_placed JOIN records USING (doc_id, page_idx, ord) GROUP BY ALL) f USING (doc_id, section_idx)""",
    "op_st5": r"""SELECT doc_id, section_idx, concat('section_', lpad(CAST(section_idx AS VARCHAR), CAST(greatest(2, len(CAST(section_idx AS VARCHAR))) AS INTEGER), '0'), '_', trim(substring(regexp_replace(t, '[<>:"/\\|?*]', '_', 'g'), 1, 50)), '.png') AS file
        FROM (SELECT *, CASE WHEN section_idx % 3 = 0 THEN concat('<a:b>"/\|?* ', title, '   ', repeat(title, 8)) ELSE title END AS t FROM sections)""",
    "op_ve1": "SELECT chunk_id, kind, pos, dim, round(v, 6) + 0.0 AS v FROM pooled",
    "op_ve2": """SELECT shard, seq AS item_id, tokens, batch FROM batched""",
    "op_ve3": "SELECT doc_id, concat_ws('|', " + ", ".join(f"len(t) - len(replace(t, '{c}', ''))" for c in "abcdefgh") + ") AS vec FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)",
    "op_ve4": "SELECT chunk_id, tok, dim, round(v / CASE WHEN n > 0 THEN n ELSE 1 END, 6) + 0.0 AS v FROM dims JOIN (SELECT chunk_id, tok, sqrt(sum(v * v)) AS n FROM dims GROUP BY ALL) USING (chunk_id, tok)",
    "op_re1": "SELECT query_id, chunk_id, round(score, 6) + 0.0 AS score FROM scores",
    "op_re1_top": f"SELECT * FROM (SELECT query_id, {_RANK} AS rank, chunk_id, round(score, 6) + 0.0 AS score FROM scores) WHERE rank <= 10",
    "op_re2_stored": "SELECT query_id, rank, chunk_id, round(score, 6) + 0.0 AS score FROM found",
    "op_re2_lsh": "SELECT query_id, rank, chunk_id, round(score, 6) + 0.0 AS score FROM lsh_found",
    "op_re2_lsh_recall": "SELECT f.query_id, round(count(l.chunk_id) / count(*), 6) AS recall FROM found f LEFT JOIN lsh_found l ON l.query_id = f.query_id AND l.chunk_id = f.chunk_id GROUP BY f.query_id",
    "op_re2": "SELECT query_id, rank, chunk_id, round(score, 6) + 0.0 AS score FROM found",
    "op_re3": f"SELECT * FROM (SELECT query_id, {_RANK} AS rank, chunk_id, round(score, 6) + 0.0 AS score FROM scores JOIN near USING (query_id, chunk_id)) WHERE rank <= 4",
    "op_re4": "SELECT * FROM (SELECT collection, chunk_id, section_title, row_number() OVER (PARTITION BY collection ORDER BY chunk_id) AS rn FROM fx_chunks WHERE section_title = 'Section 3') WHERE rn <= 10",
    "op_re5": "SELECT * FROM fx_toc_sections WHERE contains(lower(title), 'customer#0000001')",
    "op_re6": """SELECT query_id, string_agg(concat(chunk_id, ':', section_title, ':', image_path, ':', coalesce(formula || '@' || page, ''), ':', page, ':', coalesce(parent, ''), ':', display_name, ':',
        CASE WHEN image_path = '' THEN '-' ELSE md5(concat('data:image/png;base64,', base64(encode(image_path)))) END, ':', CASE WHEN chunk_id % 2 = 0 THEN concat('slice', chunk_id) ELSE '' END), '|' ORDER BY rank) AS results, count(*) AS total_results FROM found JOIN fx_chunks USING (chunk_id) GROUP BY ALL""",
    "op_re7": "SELECT * FROM fx_chunks WHERE chunk_id IN (SELECT chunk_id FROM found)",
    "op_re8": "SELECT * FROM (SELECT collection, chunk_id, image_path, row_number() OVER (PARTITION BY collection ORDER BY chunk_id) AS rn FROM fx_chunks WHERE section_title = 'noname' AND image_path <> '') WHERE rn <= 20",
    "op_re9": rf"""SELECT query_id, rewritten, CASE WHEN rewritten IS NULL THEN question ELSE concat(question, '(', rewritten, ')') END AS search_text FROM (SELECT *, CASE WHEN regexp_matches(reply, '(?s)<query>(.*?)</query>') THEN {_STRIP.format("regexp_extract(reply, '(?s)<query>(.*?)</query>', 1)")} END AS rewritten FROM fx_replies)""",
    "op_re10": """SELECT q.query_id, coalesce(string_agg(CAST(chunk_id AS VARCHAR), '|' ORDER BY rank), '') AS chunk_ids, coalesce(string_agg(image_path, '|' ORDER BY rank) FILTER (WHERE image_path <> ''), '') AS image_paths, count(chunk_id) > 0 AS found
        FROM fx_replies q LEFT JOIN (SELECT * FROM found JOIN fx_chunks USING (chunk_id)) f ON f.query_id = q.query_id GROUP BY q.query_id""",
    "op_tc1": _BOOKS.format("full_list", _NUMBERS),
    "op_tc2": "SELECT collection, book_index, title, shown_pages AS total_pages FROM titles_of",
    "op_tc3": _BOOKS.format("simple_list", ""),
    "op_tc4": "SELECT collection, count(*) AS books, CAST(sum(coalesce(n, 0)) AS BIGINT) AS sections, CAST(sum(shown_pages) AS BIGINT) AS pages FROM titles_of LEFT JOIN listed USING (collection, book_index) GROUP BY ALL",
    "op_up1": "SELECT batch, name, accepted, reason FROM gated",
    "op_up2": """SELECT batch, count(*) FILTER (WHERE accepted) > 0 AS success, count(*) FILTER (WHERE accepted) AS processed_files, CAST(coalesce(sum(pages) FILTER (WHERE accepted), 0) AS BIGINT) AS chunks, CAST(coalesce(sum(pages) FILTER (WHERE accepted), 0) AS BIGINT) AS total_pages,
        md5(coalesce(string_agg(concat(name, '=', pages), '|' ORDER BY name) FILTER (WHERE accepted), '')) AS files_md5, md5(coalesce(string_agg(concat(name, ': ', reason), '|' ORDER BY concat(name, ': ', reason)) FILTER (WHERE NOT accepted), '')) AS errors_md5 FROM gated GROUP BY batch""",
    "op_up2_errors": "SELECT batch, name, reason FROM gated WHERE NOT accepted",
    "op_up2_pages": "SELECT batch, name, arg_max(pages, seq) AS pages FROM gated WHERE accepted GROUP BY ALL",
    "op_ss1": "SELECT session_id, CASE WHEN len(t) > 38 THEN concat(substring(t, 1, 38), '...') ELSE t END AS title, turns, messages FROM asked",
    "op_ss2": "SELECT session_id % 7 AS collection, arg_max(session_id, last_turn * 1000 + session_id) AS session_id, max(last_turn * 1000 + session_id) AS updated_at FROM asked GROUP BY session_id % 7",
    "op_src1": "SELECT collection, book_index, row_number() OVER (PARTITION BY collection, book_index ORDER BY pos) - 1 AS pos, title FROM fx_toc_sections",
    "op_src2": """SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY CASE ord % 5 WHEN 0 THEN 999999 ELSE ord % 90 END, CASE ord % 5 WHEN 0 THEN 999999 WHEN 1 THEN 0 ELSE ord % 7 END, path) - 1 AS page_idx, path FROM (SELECT doc_id, ord, concat('/p/', ord, '/', CASE ord % 5 WHEN 0 THEN concat('scan', ord) WHEN 1 THEN concat('page_', ord % 90) ELSE concat('page_', ord % 90, '_', ord % 7) END,
        CASE ord % 11 WHEN 1 THEN '.JPG' ELSE '.png' END) AS path FROM fx_elements WHERE ord % 11 <> 0)""",
    "op_src3": "SELECT doc_id, section_idx, title FROM sections",
    "op_src4": "SELECT collection, book_index, has_report, concat('Book ', book_index) AS title, CASE WHEN has_report THEN total_pages ELSE 0 END AS total_pages, CASE WHEN has_report THEN 3 ELSE 0 END AS total_sections FROM fx_books",
    "op_src5": "SELECT page_id, md5(concat('data:image/png;base64,', base64(encode(html)))) AS uri_md5 FROM pages",
    "op_snk1": "SELECT collection, position, CASE WHEN f < 3 THEN concat('again ', section_title) ELSE section_title END AS section_title, CASE WHEN f < 3 THEN 2 ELSE 1 END AS load_seq FROM points",
    "op_snk2": "SELECT collection, count(*) AS points FROM points WHERE collection <> 'c3' GROUP BY ALL UNION ALL SELECT 'a new one', 0",
    "op_snk3": _BOOKS.format("full_list", _NUMBERS),
    "op_snk4": "SELECT * FROM summary",
    "op_snk5": "SELECT collection, count(DISTINCT f) AS files, count(*) AS chunks, count(*) FILTER (WHERE section_title <> 'noname') AS named FROM points GROUP BY ALL",
}
_FINALS |= {
    "op_re3_stored": _FINALS["op_re3"],
    "op_re5_index": _FINALS["op_re5"],
    "op_src5_images": """SELECT chunk_id, coalesce(n, 0) AS images, md5(coalesce(u, '')) AS uris_md5 FROM fx_chunks LEFT JOIN (SELECT page_id // 5 AS folder_id, count(*) AS n, string_agg(concat('data:image/png;base64,', base64(encode(html))), '|' ORDER BY md5(CAST(page_id AS VARCHAR))) AS u FROM pages GROUP BY ALL) ON folder_id = chunk_id""",
    "op_re6_stored": _FINALS["op_re6"],
    "op_up2_summary": """SELECT batch, processed_files > 0 AS success, processed_files, rejected_files, chunks, coalesce(files_digest, 0) AS files_digest, errors_digest FROM (SELECT batch, count(*) FILTER (WHERE accepted) AS processed_files, count(*) FILTER (WHERE NOT accepted) AS rejected_files, CAST(coalesce(sum(pages) FILTER (WHERE accepted), 0) AS BIGINT) AS chunks,
        CAST(coalesce(sum(CAST('0x' || substr(md5(concat(name, ': ', reason)), 1, 7) AS BIGINT)) FILTER (WHERE NOT accepted), 0) AS BIGINT) AS errors_digest FROM gated GROUP BY ALL)
        LEFT JOIN (SELECT batch, CAST(sum(CAST('0x' || substr(md5(concat(name, '=', pages)), 1, 7) AS BIGINT)) AS BIGINT) AS files_digest FROM (SELECT batch, name, arg_max(pages, seq) AS pages FROM gated WHERE accepted GROUP BY ALL) GROUP BY ALL) USING (batch)""",
    "op_el6_cube": """SELECT CASE GROUPING_ID(reason, page_idx) WHEN 0 THEN 'both' WHEN 1 THEN 'reason' ELSE 'page' END AS level, reason, page_idx, count(*) AS n FROM (SELECT page_idx, unnest(list_filter([CASE WHEN rw < 0.045 THEN 'width_too_small' END, CASE WHEN rh < 0.015 THEN 'height_too_small' END,
        CASE WHEN ra < 0.0003 THEN 'area_too_small' END, CASE WHEN rw > 0.85 THEN 'width_too_large' END, CASE WHEN rh > 0.25 THEN 'height_too_large' END, CASE WHEN score < 0.65 THEN 'score_too_low' END], lambda x: x IS NOT NULL)) AS reason FROM rejected) GROUP BY GROUPING SETS ((reason), (reason, page_idx))
        UNION ALL SELECT 'page', NULL, page_idx, count(*) FROM rejected GROUP BY page_idx""",
    "op_tc4_levels": """SELECT CASE GROUPING_ID(collection, book_index) WHEN 0 THEN 'book' WHEN 1 THEN 'collection' ELSE 'all' END AS level, collection, book_index, count(*) AS books, CAST(sum(coalesce(n, 0)) AS BIGINT) AS sections, CAST(sum(shown_pages) AS BIGINT) AS pages
        FROM titles_of LEFT JOIN listed USING (collection, book_index) GROUP BY GROUPING SETS ((collection, book_index), (collection), ())""",
    "op_tc1_nested": """SELECT collection AS collection_name, count(*) AS total_books, md5(string_agg(concat(book_index, ';', title, ';', shown_pages, ';', CASE WHEN has_report THEN total_sections ELSE 0 END, ';', coalesce(short, '')), '|' ORDER BY book_index)) AS books_md5 FROM titles_of
        LEFT JOIN (SELECT collection, book_index, string_agg(concat(k, ':', title), ',' ORDER BY pos) AS short FROM (SELECT *, row_number() OVER (PARTITION BY collection, book_index ORDER BY pos) - 1 AS k FROM fx_toc_sections) GROUP BY ALL) USING (collection, book_index) GROUP BY ALL""",
    "op_ve3_models": "SELECT doc_id, 'letters' AS model, 0 AS tok, vec FROM (" + _FINALS["op_ve3"] + ") UNION ALL SELECT doc_id, 'lines', tok - 1, concat(len(line), '|', len(line) - len(replace(line, ' ', ''))) FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS tok FROM documents)",
}
_FINALS |= {f"op_src{n}_source": _FINALS[f"op_src{n}"] for n in (1, 3, 4)}
_FINALS["op_snk5_books"] = "SELECT collection, count(DISTINCT book_index) AS files, count(*) AS chunks, count(*) FILTER (WHERE title <> 'noname') AS named FROM fx_toc_sections GROUP BY ALL"
_WITH = "WITH RECURSIVE " + ",\n".join(f"{k} AS ({v})" for k, v in STEPS.items())
ORACLES = {k: f"{_WITH}\n{v}" for k, v in _FINALS.items()}
