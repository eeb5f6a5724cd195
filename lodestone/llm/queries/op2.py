"""op2: every page's url under the rules and the host reputation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import table
from lodestone.llm.url_reputation import ADDRESS, TWO_PART, Rule, filter_urls

RULES = [
    Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"),
]


def op2_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A labelled outcome is bad if its quality is 0 or it is toxic; labels share the pages' ids."""
    bad = (F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("int")
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return filter_urls(table(spark, sf_dir, "pages"), outcomes, RULES)


def _case(value) -> str:
    when = [
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{value(r)}'"
        for r in sorted(RULES, key=lambda r: -len(r.text))
    ]
    return f"CASE {' '.join(when)} END"


def _last(n: int) -> str:
    return f"array_to_string(string_split(name, '.')[-{n}:], '.')"


_WEIGHT = """(SELECT 1 / least(0.5, greatest(0.001, coalesce((sum(n * pow(bad / n - rate, 2)) - sum(rate * (1 - rate)))
    / nullif(sum(rate * (1 - rate) * (n - 1)), 0), 0.5))) - 1 FROM {0} WHERE n > 0)"""

SQL = f"""
WITH RECURSIVE judged AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s).*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s).*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
outcomes AS (
  SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
hosts AS (
  SELECT host, CASE WHEN regexp_matches(name, '{ADDRESS}') THEN name WHEN regexp_matches(name, '{TWO_PART}') THEN {_last(3)} ELSE {_last(2)} END AS domain,
         CASE WHEN regexp_matches(name, '{ADDRESS}') THEN '' WHEN regexp_matches(name, '{TWO_PART}') THEN {_last(2)} ELSE {_last(1)} END AS suffix, n, bad
  FROM (SELECT *, regexp_replace(regexp_replace(host, '^(?s).*@', ''), ':[0-9]*$|\\.+$|\\.+:[0-9]*$', '') AS name
        FROM (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM judged LEFT JOIN outcomes USING (page_id) GROUP BY 1))),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT coalesce(sum(bad) / nullif(sum(n), 0), 0.5) FROM hosts) AS rate FROM hosts GROUP BY 1),
suffix_post AS (SELECT suffix, (bad + k * rate) / (n + k) AS post FROM (SELECT *, {_WEIGHT.format('suffixes')} AS k FROM suffixes)),
domains AS (SELECT d.*, post AS rate FROM (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY 1, 2) d JOIN suffix_post USING (suffix)),
domain_post AS (SELECT domain, suffix, (bad + k * rate) / (n + k) AS post FROM (SELECT *, {_WEIGHT.format('domains')} AS k FROM domains)),
rated AS (SELECT hosts.*, post AS rate FROM hosts JOIN domain_post USING (domain, suffix)),
host_post AS (SELECT host, greatest(mean * weight, 1e-9) AS a, greatest((1 - mean) * weight, 1e-9) AS b
  FROM (SELECT host, (bad + k * rate) / (n + k) AS mean, n + k AS weight FROM (SELECT *, {_WEIGHT.format('rated')} AS k FROM rated))),
-- the share of Beta(a, b) below one half, by the continued fraction of the incomplete beta function
sides AS (SELECT host, a AS p, b AS q, 0.5 > (a + 1) / (a + b + 2) AS swap FROM host_post),
turned AS (SELECT host, swap, CASE WHEN swap THEN q ELSE p END AS a, CASE WHEN swap THEN p ELSE q END AS b FROM sides),
steps(host, swap, a, b, m, c, d, h) AS (
  SELECT host, swap, a, b, 0, 1.0::DOUBLE, 1 / (1 - (a + b) * 0.5 / (a + 1)), 1 / (1 - (a + b) * 0.5 / (a + 1)) FROM turned
  UNION ALL
  SELECT host, swap, a, b, m + 1, 1 + v / c1, 1 / (1 + v * d1), h * d1 * c1 * (1 / (1 + v * d1)) * (1 + v / c1) FROM (
    SELECT *, 1 / (1 + u * d) AS d1, 1 + u / c AS c1 FROM (
      SELECT *, (m + 1) * (b - m - 1) * 0.5 / ((a + 2 * m + 1) * (a + 2 * m + 2)) AS u, -(a + m + 1) * (a + b + m + 1) * 0.5 / ((a + 2 * m + 2) * (a + 2 * m + 3)) AS v FROM steps WHERE m < 300))),
below AS (SELECT host, swap, exp((a + b) * ln(0.5) + lgamma(a + b) - lgamma(a) - lgamma(b)) * h / a AS part FROM steps WHERE m = 300),
blocked AS (SELECT host, 'block' AS method FROM below WHERE CASE WHEN swap THEN 1 - part ELSE part END <= 0.05)
SELECT page_id, host, path, {_case(lambda r: r.text)} AS rule,
       coalesce({_case(lambda r: r.verdict)}, method, 'allow') AS verdict
FROM judged LEFT JOIN blocked USING (host)
"""

QUERIES = {"op2_url_reputation": op2_url_reputation}
ORACLE_SQL = {"op2_url_reputation": SQL}
