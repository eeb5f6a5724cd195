"""op4: every page's main text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.common import table
from lodestone.llm.html_mincut import extract


def op4_html_mincut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op4_html_mincut": op4_html_mincut}
ORACLE_SQL: dict[str, str] = {}
