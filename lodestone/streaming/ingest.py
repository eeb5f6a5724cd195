"""Incremental ingestion of a folder as a stream, and windowed counts of events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators.store import Table, marks, to_ingest
from lodestone.sources.files import hashed


def watch(spark: SparkSession, path: str, pattern: str = "*", per_trigger: int = 1000) -> DataFrame:
    """New files of a folder; each is seen once per checkpoint."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    reader = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True)
    return reader.option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger).load(path)


def ingest(files: DataFrame, history: Table, work: Callable[[DataFrame], DataFrame], checkpoint: str, *, collection: str = "default") -> StreamingQuery:
    """Run ``work`` on files that history doesn't hold as ingested, and mark what came of them.

    ``work`` takes a batch's files (with file_hash) and returns file_hash and error_msg.  Marks are
    upserts by hash and work skips what is marked, so a batch that is run again changes nothing.
    """
    def one(batch: DataFrame, _: int) -> None:
        due = to_ingest(hashed(batch).dropDuplicates(["file_hash"]), history.read())
        done = due.select("file_hash", "path").join(work(due), "file_hash")
        outcomes = done.select(
            "file_hash", F.col("path").alias("file_path"), F.when(F.col("error_msg").isNull(), "success").otherwise("failed").alias("status"),
            F.lit(collection).alias("collection"), "error_msg", F.current_timestamp().alias("at"),
        )
        history.upsert(marks(history.read(), outcomes))

    return files.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, *, every: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events and their mean value by type and window; rows later than ``late`` are dropped by the watermark."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", every), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).select("window.start", "event_type", "n", "mean")
