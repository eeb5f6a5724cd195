"""op5: every document's licence phrases and notices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.common import table
from lodestone.llm.license_scan import scan_licenses
from lodestone.llm.license_templates import BASE, NOTICES, must_hold


def op5_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"), BASE + NOTICES)


def _template_rows(k: int = 3) -> str:
    rows = []
    for number, t in enumerate(BASE + NOTICES):
        w = t.text.split()
        must = must_hold(t, k)
        rows += [f"({number}, '{t.label}', {str(t.base).upper()}, {len(w)}, {len(must)}, {i}, {str(i in must).upper()}, '{' '.join(w[i : i + k])}')" for i in range(len(w) - k + 1)]
    return ", ".join(rows)


SQL = (
    r"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
grams AS (SELECT r, pos, w[pos + 1] || ' ' || w[pos + 2] || ' ' || w[pos + 3] AS gram FROM (SELECT r, w, unnest(range(len(w) - 2)) AS pos FROM words WHERE len(w) >= 3)),
templates(template, label, base, n_template, n_must, place, must, gram) AS (VALUES """
    + _template_rows()
    + r"""),
hits AS (SELECT r, template, label, base, n_template, n_must, must, pos, place, pos - place AS diagonal FROM grams JOIN templates USING (gram)),
diagonals AS (SELECT r, template, label, base, n_template, n_must, diagonal, list(DISTINCT place) AS ats, coalesce(list(DISTINCT place) FILTER (must), []) AS musts, min(pos) AS first, max(pos) AS last FROM hits GROUP BY ALL),
apart AS (SELECT *, CASE WHEN base THEN 1 ELSE coalesce((diagonal - lag(diagonal) OVER w > 3)::INT, 1) END AS new FROM diagonals WINDOW w AS (PARTITION BY r, template ORDER BY diagonal)),
grouped AS (SELECT *, sum(new) OVER (PARTITION BY r, template ORDER BY diagonal) AS g FROM apart),
near AS (
  SELECT x.r, x.template, x.g, x.diagonal, len(list_distinct(flatten(list(y.ats)))) AS near FROM grouped x
  JOIN grouped y ON x.r = y.r AND x.template = y.template AND x.g = y.g AND y.diagonal BETWEEN x.diagonal AND x.diagonal + 6 GROUP BY ALL),
spans AS (
  SELECT r, template, label, base, n_template, n_must, g, len(list_distinct(flatten(list(ats)))) AS votes, len(list_distinct(flatten(list(musts)))) AS must, max(near) AS near, max(last) + 3 - min(first) AS n_span, min(diagonal) AS diagonal
  FROM grouped JOIN near USING (r, template, g, diagonal) GROUP BY ALL),
shares AS (SELECT *, CASE WHEN n_span <= n_template + 6 THEN votes ELSE near END / (n_template - 2) AS share FROM spans),
named AS (
  SELECT r, count(*) FILTER (base AND share = 1) AS n_base, min(diagonal) FILTER (base AND share = 1) AS first_word, max(diagonal) FILTER (base AND share = 1) AS last_word,
         array_to_string(list_sort(list_distinct(list(label) FILTER (base AND share = 1))), ',') AS base_labels,
         array_to_string(list_sort(list_distinct(list(label) FILTER (CASE WHEN base THEN share = 1 ELSE share >= 0.8 AND must = n_must END))), ',') AS labels, max(share) AS score FROM shares GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM words LEFT JOIN named USING (r)
"""
)

QUERIES = {"op5_license_diagonals": op5_license_diagonals}
ORACLE_SQL = {"op5_license_diagonals": SQL}
