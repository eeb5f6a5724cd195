"""The driver's tables in the shapes that operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import keywords
from lodestone.operators.index import Index, build, repeats


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, each as one chunk; its source is the path, its language the type and the only tag."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_id"), "text", F.col("source").alias("source_path"), F.col("lang").alias("doc_type"), F.col("lang").alias("tags"))


def index(spark: SparkSession, sf_dir: str) -> Index:
    """Unstemmed, so that SQL can say the same; by rows, unless ids repeat, as statistics and searches then need no postings."""
    held = chunks(spark, sf_dir)
    return build(held, stem=False).kept() if repeats(held) else build(held, stem=False, unique=True)


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as queries."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def asked_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir).select("query_id", keywords(F.col("query")).alias("terms"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def asked_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no vectors of questions: item n is asked with vector n, and chunk n has vector n."""
    held = vectors(spark, sf_dir).select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    return asked(spark, sf_dir).join(held, "query_id")
