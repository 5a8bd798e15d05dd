"""Derived views over the given tables, in SQL that Spark and DuckDB both read. Names in braces are tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_CHUNK = "CAST(floor(vec_id / 5) AS BIGINT)"
VIEWS = {
    "fx_pages": """SELECT u.user_id AS doc_id, p.page_idx, CAST(1000 AS BIGINT) AS width, CAST(1600 AS BIGINT) AS height
        FROM (SELECT DISTINCT user_id FROM {events}) u CROSS JOIN (SELECT CAST(col0 AS BIGINT) AS page_idx FROM (VALUES (0),(1),(2),(3),(4),(5),(6),(7),(8),(9),(10),(11)) v(col0)) p""",
    "fx_elements": """SELECT user_id AS doc_id, CAST(floor(value) AS BIGINT) % 12 AS page_idx, event_id AS ord,
        CASE event_type WHEN 'click' THEN 'paragraph_title' WHEN 'view' THEN 'formula' WHEN 'purchase' THEN 'number' WHEN 'error' THEN 'formula_number' ELSE 'text' END AS label,
        event_id % 400 AS x1, (event_id * 37) % 1400 AS y1, event_id % 400 + 20 + (event_id * 13) % 580 AS x2, (event_id * 37) % 1400 + 10 + (event_id * 7) % 190 AS y2,
        CAST((event_id * 31) % 100 AS DOUBLE) / 100 AS score,
        CASE WHEN event_type = 'purchase' AND event_id % 5 = 0 THEN '  '
             WHEN event_type = 'purchase' AND event_id % 5 = 1 THEN concat('-', CAST(event_id % 300 AS VARCHAR(10)), '-')
             WHEN event_type = 'purchase' THEN concat('0', CAST(event_id % 300 AS VARCHAR(10)))
             WHEN event_type = 'click' AND event_id % 4 = 0 THEN concat(CAST(event_id % 3 + 1 AS VARCHAR(10)), ' Intro')
             WHEN event_type = 'click' AND event_id % 4 = 1 THEN concat(CAST(event_id % 3 + 1 AS VARCHAR(10)), '.', CAST(event_id % 2 + 1 AS VARCHAR(10)), ' Scope')
             WHEN event_type = 'click' AND event_id % 4 = 2 THEN concat(CAST(event_id % 3 + 1 AS VARCHAR(10)), '.', CAST(event_id % 7 % 2 + 1 AS VARCHAR(10)), '.', CAST(event_id % 5 AS VARCHAR(10)), ' Detail')
             WHEN event_type = 'click' THEN concat('(', CAST(event_id % 9 AS VARCHAR(10)), ') item') ELSE 'x' END AS ocr FROM {events}""",
    "fx_tokens": f"SELECT {_CHUNK} AS chunk_id, vec_id % 5 AS tok, embedding AS vec FROM {{embeddings}}",
    # a query for every row whose id is divisible by 100: its vector and the three after it
    "fx_query_tokens": "SELECT CAST(floor(vec_id / 100) AS BIGINT) AS query_id, vec_id % 100 AS tok, embedding AS vec FROM {embeddings} WHERE vec_id % 100 < 4",
    "fx_chunks": f"""SELECT chunk_id, concat('c', CAST(chunk_id % 5 AS VARCHAR(10))) AS collection,
        CASE WHEN chunk_id % 7 = 0 THEN 'noname' ELSE concat('Section ', CAST(chunk_id % 10 AS VARCHAR(10))) END AS section_title,
        CASE WHEN chunk_id % 11 = 0 THEN '' ELSE concat('/img/', CAST(chunk_id AS VARCHAR(10)), '.png') END AS image_path,
        CASE WHEN chunk_id % 4 <> 0 THEN concat('x_', CAST(chunk_id AS VARCHAR(10))) END AS formula, chunk_id % 90 AS page,
        CASE WHEN chunk_id % 3 <> 0 THEN concat('Chapter ', CAST(chunk_id % 6 AS VARCHAR(10))) END AS parent, concat('file', CAST(chunk_id % 6 AS VARCHAR(10)), '.pdf') AS display_name
        FROM (SELECT DISTINCT {_CHUNK} AS chunk_id FROM {{embeddings}}) c""",
    "fx_books": """SELECT r_name AS collection, CAST(n_nationkey AS BIGINT) AS book_index, n_nationkey % 6 <> 5 AS has_report, CAST(10 + n_nationkey % 7 AS BIGINT) AS total_pages,
        CAST(n_nationkey % 4 AS BIGINT) AS total_sections, concat('0=', CAST(n_nationkey AS VARCHAR(10))) AS page_numbers
        FROM {nation} JOIN {region} ON n_regionkey = r_regionkey""",
    "fx_toc_sections": """SELECT r_name AS collection, CAST(n_nationkey AS BIGINT) AS book_index, c_custkey AS pos,
        CASE WHEN c_custkey % 9 < 4 THEN 'noname' WHEN c_custkey % 9 = 4 THEN '  ' ELSE c_name END AS title, c_custkey % 40 AS start_page, c_custkey % 5 AS formulas
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey WHERE n_nationkey % 6 <> 5""",
    "fx_replies": """SELECT conv_id AS query_id, text AS question,
        CASE conv_id % 3 WHEN 0 THEN text ELSE concat('ok <query> ', substring(text, 1, 20), ' </query> end') END AS reply
        FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM {conversations} WHERE role = 'user') t WHERE rn = 1""",
    "fx_files": """SELECT source AS batch, concat('f', CAST(doc_id AS VARCHAR(20)), CASE doc_id % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '.txt' ELSE '.pdf' END) AS name,
        n_chars * 200000 AS size_bytes, doc_id AS seq, n_chars % 50 AS pages FROM {documents}""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", sql))})


def common_tables() -> dict[str, str]:
    """The views as DuckDB reads them."""
    return {k: re.sub(r"\{(\w+)\}", r"\1", v) for k, v in VIEWS.items()}
