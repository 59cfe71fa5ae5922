"""Registered queries of the core and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paperloom import composed, parity
from paperloom.operators import nested


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = nested.child_rows(table(spark, sf_dir, "openalex_responses"))
    return rows.select("response_id", "result_no", "child", "child_no", "child_key")


def p4_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.works(table(spark, sf_dir, "openalex_responses"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p4_found": p4_found, "p4_works": p4_works} | parity.QUERIES

#: SQL for the works of the readable bodies, shared by the checks of problem 4.
_WORKS_SQL = """
bodies AS (SELECT response_id, CAST(body AS JSON) AS j FROM openalex_responses WHERE json_valid(body)),
lists AS (SELECT response_id, CASE json_type(j, '$.results') WHEN 'ARRAY' THEN CAST(json_extract(j, '$.results') AS JSON[])
          WHEN 'OBJECT' THEN [json_extract(j, '$.results')] ELSE [] END AS ws FROM bodies),
numbered AS (SELECT response_id, unnest(range(len(ws))) AS result_no, unnest(ws) AS w FROM lists),
works AS (SELECT response_id, CAST(result_no AS BIGINT) AS result_no, w FROM numbered WHERE json_type(w) = 'OBJECT')
"""

ORACLE: dict[str, str] = {
    "p4_found": f"""
WITH {_WORKS_SQL},
lists_a AS (SELECT response_id, result_no, CASE json_type(w, '$.authorships') WHEN 'ARRAY' THEN CAST(json_extract(w, '$.authorships') AS JSON[])
          WHEN 'OBJECT' THEN [json_extract(w, '$.authorships')] ELSE [] END AS xs FROM works),
authors AS (SELECT response_id, result_no, unnest(range(len(xs))) AS child_no, unnest(xs) AS a FROM lists_a),
terms AS (SELECT response_id, result_no, unnest(json_keys(w, '$.abstract_inverted_index')) AS word, json_extract(w, '$.abstract_inverted_index') AS ix
          FROM works WHERE json_type(w, '$.abstract_inverted_index') = 'OBJECT'),
spots AS (SELECT response_id, result_no, word, unnest(CAST(map_extract_value(CAST(ix AS MAP(VARCHAR, JSON)), word) AS JSON[])) AS p
          FROM terms WHERE json_type(map_extract_value(CAST(ix AS MAP(VARCHAR, JSON)), word)) = 'ARRAY')
SELECT response_id, result_no, 'author' AS child, CAST(child_no AS BIGINT) AS child_no, json_extract_string(a, '$.author.id') AS child_key
FROM authors WHERE json_type(a, '$.author.id') = 'VARCHAR' AND trim(json_extract_string(a, '$.author.id')) <> ''
UNION ALL
SELECT response_id, result_no, 'source', 0, json_extract_string(w, '$.primary_location.source.display_name')
FROM works WHERE json_type(w, '$.primary_location.source.display_name') = 'VARCHAR' AND trim(json_extract_string(w, '$.primary_location.source.display_name')) <> ''
UNION ALL
SELECT DISTINCT response_id, result_no, 'term', CAST(CAST(p AS VARCHAR) AS BIGINT), word
FROM spots WHERE json_type(p) IN ('UBIGINT', 'BIGINT') AND NOT starts_with(CAST(p AS VARCHAR), '-') AND trim(word) <> ''
""",
    "p4_works": f"""
WITH {_WORKS_SQL}
SELECT response_id, result_no, json_extract_string(w, '$.id') AS work_id, json_extract_string(w, '$.doi') AS doi,
  json_extract_string(w, '$.display_name') AS display_name, TRY_CAST(json_extract_string(w, '$.publication_year') AS BIGINT) AS publication_year,
  TRY_CAST(json_extract_string(w, '$.cited_by_count') AS BIGINT) AS cited_by_count, json_extract_string(w, '$.best_oa_location.pdf_url') AS pdf_url
FROM works
""",
} | parity.ORACLE
