"""op7: every text stored as audio samples, sniffed and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import table
from lodestone.llm.media_sniff import sniff, store_audio

BLOCK = 576


def payload(text: Column) -> Column:
    """UTF-8 bytes with bytes 255 appended up to a positive multiple of the block."""
    data = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    lack = F.when(F.octet_length(data) == 0, BLOCK).otherwise(F.pmod(-F.octet_length(data), F.lit(BLOCK)))
    return F.concat(data, F.unhex(F.repeat(F.lit("FF"), lack)))


def op7_media_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        F.struct("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")).alias("doc"), payload(F.col("text")).alias("payload")
    )
    stored = store_audio(docs, key="doc", payload="payload").withColumn("declared", F.lit("application/octet-stream"))
    found = sniff(stored, key="key", content="media", declared="declared")
    return found.select(
        "key.doc_id", "key.n_bytes", F.octet_length("samples").cast("long").alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring("samples", -32, 32)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), "feature",
    )


QUERIES = {"op7_media_sniff": op7_media_sniff}
ORACLE_SQL: dict[str, str] = {}
