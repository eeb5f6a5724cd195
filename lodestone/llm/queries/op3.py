"""op3: every document without its source's boilerplate lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.common import table
from lodestone.llm.line_dedup import drop_boilerplate

RATIO, LEAST = 0.1, 5


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_boilerplate(docs, host="source", ratio=RATIO, least=LEAST).select("doc_id", "source", "text", "n_lines", "n_dropped")


#: The dropped lines of a relation that has doc_id, source and text; shared with the pipeline.
LINES = """
{name}_gone AS (
  SELECT source, line FROM (
    SELECT source, line, count(*) AS pages FROM (SELECT source, unnest(list_distinct(list_transform(string_split(text, chr(10)), lambda x: trim(x)))) AS line FROM {of}) GROUP BY 1, 2)
  JOIN (SELECT source AS s, count(*) AS total FROM {of} GROUP BY 1) ON source IS NOT DISTINCT FROM s
  WHERE line <> '' AND pages >= {least} AND pages > {ratio} * total),
{name}_sets AS (SELECT source AS s, list(line) AS gone FROM {name}_gone GROUP BY 1)"""
KEPT = "list_filter(string_split(text, chr(10)), lambda x: gone IS NULL OR NOT list_contains(gone, trim(x)))"

SQL = f"""WITH {LINES.format(name='d', of='documents', least=LEAST, ratio=RATIO)}
SELECT doc_id, source, array_to_string({KEPT}, chr(10)) AS text, coalesce(len(string_split(text, chr(10))), 0) AS n_lines,
       coalesce(len(string_split(text, chr(10))) - len({KEPT}), 0) AS n_dropped
FROM documents LEFT JOIN d_sets ON source IS NOT DISTINCT FROM s"""

QUERIES = {"op3_line_dedup": op3_line_dedup}
ORACLE_SQL = {"op3_line_dedup": SQL}
