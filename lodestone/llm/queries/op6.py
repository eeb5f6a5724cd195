"""op6: every document's expected severity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.common import table
from lodestone.llm.toxicity import fit, score


def op6_toxicity_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", "severity", "grade", "toxic")


QUERIES = {"op6_toxicity_ordinal": op6_toxicity_ordinal}
ORACLE_SQL: dict[str, str] = {}
