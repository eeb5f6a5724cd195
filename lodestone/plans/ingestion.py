"""The ingestion pipeline: all due files of a folder in one set of plans.

Files that history holds as ingested are left out; the others are parsed, split, cleaned, enriched,
embedded, and put in place of what the stores held of the same path, in the table of chunks and in the
index alike.  A file that fails is marked with its error and keeps nothing else from being ingested.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import schema
from lodestone.functions import numeric, text
from lodestone.operators import chunking, index
from lodestone.operators.store import Table, marks, to_ingest
from lodestone.sources import files as sources
from lodestone.sources.embeddings import Embed, embed


@dataclass
class Stores:
    """The tables of one library, in folders below ``root``."""

    spark: SparkSession
    root: str

    def _table(self, name: str, columns: str, *key: str, partition: str | None = None) -> Table:
        return Table(self.spark, f"{self.root}/{name}", columns, key, partition)

    @property
    def chunks(self) -> Table:
        columns = "chunk_id string, doc_id string, chunk_index int, text string, title string, summary string, tags string, source_path string, doc_type string, source_ref string, embedding array<float>, collection string"
        return self._table("chunks", columns, "chunk_id", partition="collection")

    @property
    def postings(self) -> Table:
        return self._table("postings", f"{schema.POSTINGS}, collection string", "chunk_id", "term", partition="collection")

    @property
    def lengths(self) -> Table:
        return self._table("lengths", f"{schema.DOC_LENGTHS}, collection string", "chunk_id", partition="collection")

    @property
    def history(self) -> Table:
        return self._table("history", schema.HISTORY, "file_hash")

    @property
    def images(self) -> Table:
        return self._table("images", schema.IMAGES, "image_id")

    def all(self) -> dict[str, Table]:
        return {"chunks": self.chunks, "postings": self.postings, "lengths": self.lengths, "history": self.history, "images": self.images}

    def index_of(self, collection: str) -> index.Index:
        """Files are sorted by collection, so that row groups of others aren't read."""
        of = lambda table: table.read().filter(F.col("collection") == collection).drop("collection")
        return index.Index(of(self.postings), of(self.lengths))


def enriched(chunks: DataFrame) -> DataFrame:
    """Chunks with cleaned text, and title, summary and tags by rule; blank chunks are left out."""
    cleaned = chunks.withColumn("text", text.clean(F.col("text"))).filter("text <> ''")
    c = F.col("text")
    return cleaned.withColumns({"title": text.chunk_title(c), "summary": text.chunk_summary(c), "tags": F.array_join(text.chunk_tags(c), ",")})


def chunked(documents: DataFrame, *, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Chunks of parsed documents with their stored ids, which take the hash of the final text."""
    plain = chunking.plain_chunks(documents, size=size, overlap=overlap).drop("chunk_id")
    rows = enriched(chunking.inherit(plain, documents.select("doc_id", "source_path", "doc_type")))
    return rows.withColumn("chunk_id", numeric.chunk_id(F.col("source_path"), F.col("chunk_index"), F.col("text")))


def ingest(spark: SparkSession, stores: Stores, folder: str, encode: Embed, *, collection: str = "default", extensions: tuple[str, ...] = (".pdf", ".docx", ".html", ".txt", ".md"), size: int = 1000, overlap: int = 200, force: bool = False) -> DataFrame:
    """file_hash, path, chunk_count, success and error of every file that was due."""
    found = sources.hashed(sources.discover(spark, folder, extensions)).dropDuplicates(["file_hash"])
    due = found if force else to_ingest(found, stores.history.read())
    parsed = sources.parse(due).withColumn("doc_type", F.lower(F.regexp_extract("source_path", r"\.([^.]+)$", 1))).persist()
    good = parsed.filter("error is null and trim(text) <> ''")
    rows = embed(chunked(good, size=size, overlap=overlap), encode).withColumns({"collection": F.lit(collection), "source_ref": F.col("doc_id")}).persist()
    made = index.build(rows.select("chunk_id", "text"))
    prefixes = good.select(numeric.hash8(F.col("source_path")).alias("__prefix")).distinct()
    for table, new in ((stores.chunks, rows), (stores.postings, made.postings.withColumn("collection", F.lit(collection))), (stores.lengths, made.lengths.withColumn("collection", F.lit(collection)))):
        gone = table.read().join(prefixes, (F.substring_index("chunk_id", "_", 1) == F.col("__prefix")) & (F.col("collection") == collection), "left_semi")
        table.replace(gone.select(*table.key), new.select(*table.schema.fieldNames()))
    counts = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    error = F.when(F.col("error").isNotNull(), F.col("error")).when(F.coalesce(F.trim("text"), F.lit("")) == "", F.lit("no text"))
    results = parsed.join(counts, "doc_id", "left").select(
        F.col("doc_hash").alias("file_hash"), F.col("source_path").alias("path"), F.coalesce("chunk_count", F.lit(0).cast("long")).alias("chunk_count"), error.isNull().alias("success"), error.alias("error")).persist()
    outcomes = results.select(
        "file_hash", F.col("path").alias("file_path"), F.when(F.col("success"), "success").otherwise("failed").alias("status"), F.lit(collection).alias("collection"),
        F.col("error").alias("error_msg"), F.current_timestamp().alias("at"))
    stores.history.upsert(marks(stores.history.read(), outcomes))
    return results
