"""op1: near-duplicate components of all documents, on two-word shingles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.common import table
from lodestone.llm.near_dup import near_duplicates


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


#: Every pair that shares a shingle is compared, and components are found by recursion.
SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words),
shingles AS (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS h FROM sets),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS inter FROM shingles a JOIN shingles b ON a.h = b.h AND a.doc_id < b.doc_id
  WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2),
links AS (SELECT a, b FROM shared WHERE 100 * inter >= 80 * (n + m - inter)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT edges.b, c FROM reached JOIN edges ON a = doc_id)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, component_id, s.doc_id = component_id AS kept
FROM sets s JOIN (SELECT doc_id, min(c) AS component_id FROM reached GROUP BY 1) r USING (doc_id)
"""

QUERIES = {"op1_minhash_dedup": op1_minhash_dedup}
ORACLE_SQL = {"op1_minhash_dedup": SQL}
