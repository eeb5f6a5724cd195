"""Tables that are kept: upsert by key, delete, collections, histories, images and cascades.

A store is a folder of Parquet files, dealt into buckets by a hash of the key.  A write puts the buckets that
it changes into a new version's folder, and then commits a manifest, which names every bucket's folder.
Manifests are numbered, and a new one gets its name by a rename that fails if the name is taken: readers
see one state or the other, a write that dies before its rename changes nothing, and of two writes at
once the later one fails.  Folders that neither the last manifest nor the one before it names are removed.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.schema import struct

BUCKET = "__bucket"


class Table:
    """A keyed table under a folder; files are sorted by ``partition`` if given, so that a filter on it skips row groups."""

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType, key: tuple[str, ...], partition: str | None = None, buckets: int = 16) -> None:
        self.spark, self.path, self.schema, self.key, self.partition, self.buckets = spark, path.rstrip("/"), struct(schema), key, partition, buckets

    def _at(self, name: str = ""):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _numbers(self) -> list[int]:
        """Of the manifests, oldest first."""
        files, folder = self._at("_manifests")
        return sorted(int(f.getPath().getName()) for f in files.listStatus(folder) if f.getPath().getName().isdigit()) if files.exists(folder) else []

    def _manifest(self, number: int) -> dict[str, str]:
        return json.loads(self.spark.sparkContext.wholeTextFiles(f"{self.path}/_manifests/{number:020d}", 1).first()[1])["folders"]

    def _current(self) -> tuple[int, dict[str, str]]:
        numbers = self._numbers()
        return (numbers[-1], self._manifest(numbers[-1])) if numbers else (0, {})

    def _commit(self, number: int, folders: dict[str, str]) -> None:
        files, target = self._at(f"_manifests/{number:020d}")
        _, made = self._at(f"_manifests/tmp-{uuid.uuid4().hex}")
        out = files.create(made)
        out.write(bytearray(json.dumps({"buckets": self.buckets, "folders": folders}).encode()))
        out.close()
        if files.exists(target) or not files.rename(made, target):
            files.delete(made, False)
            raise RuntimeError(f"another write to {self.path} was committed first")

    def _tidy(self) -> None:
        """Remove what the last two manifests don't name."""
        numbers = self._numbers()
        named = {folder.split("/")[0] for n in numbers[-2:] for folder in self._manifest(n).values()}
        files, top = self._at()
        for status in files.listStatus(top):
            name = status.getPath().getName()
            if name.startswith("v-") and name not in named:
                files.delete(status.getPath(), True)
        for number in numbers[:-2]:
            files.delete(self._at(f"_manifests/{number:020d}")[1], False)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _of(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def read(self) -> DataFrame:
        return self._of(sorted(self._current()[1].values()))

    def _put(self, df: DataFrame, number: int, kept: dict[str, str]) -> None:
        """``df`` as a new version's buckets, beside those that are ``kept``."""
        version = f"v-{uuid.uuid4().hex}"
        rows = df.select(*self.schema.fieldNames()).withColumn(BUCKET, self._bucket())
        rows = rows.repartition(BUCKET).sortWithinPartitions(BUCKET, *([self.partition] if self.partition else []))
        rows.write.partitionBy(BUCKET).parquet(f"{self.path}/{version}")
        files, folder = self._at(version)
        names = [f.getPath().getName() for f in files.listStatus(folder)]
        self._commit(number + 1, kept | {n.split("=")[1]: f"{version}/{n}" for n in names if n.startswith(f"{BUCKET}=")})
        self._tidy()

    def write(self, df: DataFrame) -> None:
        """All rows; what was there goes."""
        self._put(df, self._current()[0], {})

    def replace(self, gone: Column | DataFrame, new: DataFrame | None = None) -> None:
        """Rows that ``gone`` names leave, and ``new`` comes; only the buckets of either are written.

        ``gone`` is a predicate, or a table of keys.
        """
        number, folders = self._current()
        held = self._of(sorted(folders.values()))
        leave = held.filter(gone) if isinstance(gone, Column) else gone
        touched = leave.select(self._bucket().alias("b"))
        touched = touched if new is None else touched.union(new.select(self._bucket().alias("b")))
        numbers = {str(r.b) for r in touched.distinct().collect()}
        if not numbers:
            return
        old = self._of(sorted(f for b, f in folders.items() if b in numbers))
        left = old.filter(~F.coalesce(gone, F.lit(False))) if isinstance(gone, Column) else old.join(gone.select(*self.key).distinct(), list(self.key), "left_anti")
        rows = left if new is None else left.unionByName(new, allowMissingColumns=True)
        self._put(rows, number, {b: f for b, f in folders.items() if b not in numbers})

    def upsert(self, new: DataFrame) -> None:
        self.replace(new.select(*self.key), new)

    def delete(self, where: Column) -> int:
        """Rows for which ``where`` holds leave; how many there were."""
        n = self.read().filter(where).count()
        if n:
            self.replace(where)
        return n


def upserted(held: DataFrame, new: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Rows of ``new`` in place of those with their key."""
    return held.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new, allowMissingColumns=True)


def by_metadata(filters: dict[str, object]) -> Column:
    if not filters:
        raise ValueError("a delete by metadata needs a filter")
    return reduce(lambda a, b: a & b, [F.col(k) == v for k, v in filters.items()])


def records(chunks: DataFrame, vectors: DataFrame, dim: int | None = None) -> DataFrame:
    """Chunks with their vectors, by id; a chunk or vector without its other half fails the job."""
    both = chunks.join(vectors.select("chunk_id", "embedding", F.lit(True).alias("__v")), "chunk_id", "full")
    whole = F.col("__v").isNotNull() & F.col("text").isNotNull() & (F.size("embedding") > 0)
    if dim:
        whole &= F.size("embedding") == dim
    checked = F.when(whole, F.col("chunk_id")).otherwise(F.raise_error(F.concat(F.lit("chunk and vector do not match: "), F.col("chunk_id"))).cast("string"))
    return both.withColumn("chunk_id", checked).drop("__v")


def get_by_ids(chunks: DataFrame, ids: list[str]) -> DataFrame:
    """One row for each asked id, in order; the other columns are null for one that is missing."""
    asked = chunks.sparkSession.createDataFrame(list(enumerate(ids)), "pos int, chunk_id string")
    found = chunks.join(F.broadcast(asked.select("chunk_id").distinct()), "chunk_id", "left_semi")
    return asked.join(found, "chunk_id", "left").orderBy("pos")


def collections(chunks: DataFrame) -> DataFrame:
    """collection and its number of chunks; names that begin with _ or hnsw: are the store's own."""
    shown = ~F.col("collection").startswith("_") & ~F.col("collection").startswith("hnsw:")
    return chunks.filter(shown).groupBy("collection").agg(F.count(F.lit(1)).alias("n_chunks"))


def to_ingest(files: DataFrame, history: DataFrame) -> DataFrame:
    """Files whose hash hasn't been ingested with success."""
    return files.join(history.filter("status = 'success'").select("file_hash"), "file_hash", "left_anti")


def marks(history: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Rows of history for outcomes (file_hash, file_path, status, collection, error_msg, at).

    The first time of processing stays; success clears the error.
    """
    old = history.select("file_hash", F.col("processed_at").alias("__first"))
    return outcomes.join(old, "file_hash", "left").select(
        "file_hash", "file_path", "status", "collection", F.when(F.col("status") != "success", F.col("error_msg")).alias("error_msg"),
        F.coalesce("__first", "at").alias("processed_at"), F.col("at").alias("updated_at"),
    )


def marked(history: DataFrame, outcomes: DataFrame) -> DataFrame:
    """History after outcomes."""
    return upserted(history, marks(history, outcomes), ("file_hash",))


def registered(images: DataFrame, new: DataFrame) -> DataFrame:
    """Images after registration; a caption that was there stays."""
    old = images.select("image_id", F.col("caption").alias("__caption"))
    kept = new.join(old, "image_id", "left").withColumn("caption", F.coalesce("caption", "__caption")).drop("__caption")
    return upserted(images, kept, ("image_id",))


def captioned(images: DataFrame, captions: DataFrame) -> DataFrame:
    """Images with new captions; ids that aren't there are left out."""
    new = captions.select("image_id", F.col("caption").alias("__new"))
    return images.join(new, "image_id", "left").withColumn("caption", F.coalesce("__new", "caption")).drop("__new")


def image_stats(images: DataFrame, files: DataFrame) -> DataFrame:
    """One row: images, and bytes of those whose file exists; files has path and length."""
    sized = images.join(files.select(F.col("path").alias("file_path"), "length"), "file_path", "left")
    return sized.agg(F.count(F.lit(1)).alias("images"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def cascade(stores: dict[str, tuple[Table, Column]]) -> dict[str, object]:
    """Delete a document everywhere; per store the rows that went, or the error it gave."""
    done: dict[str, object] = {}
    for name, (table, where) in stores.items():
        try:
            done[name] = table.delete(where)
        except Exception as error:  # one store's failure must not keep the others from being cleaned
            done[name] = error
    return done


def reset(stores: dict[str, Table], collection: str | None = None, *, execute: bool = False) -> dict[str, int]:
    """Rows of each store that a reset takes; nothing is deleted unless ``execute``."""
    where = F.lit(True) if collection is None else F.col("collection") == collection
    return {name: (table.delete(where) if execute else table.read().filter(where).count()) for name, table in stores.items()}


def once_per_key(rows: DataFrame, key: Column, compute, cache: DataFrame | None = None) -> DataFrame:
    """``rows`` with `value`: computed once for each distinct key that the cache (cache_key, value) lacks.

    ``compute`` takes a table of (cache_key, and the columns of rows) with one row for each key.
    """
    keyed = rows.withColumn("cache_key", key)
    distinct = keyed.dropDuplicates(["cache_key"])
    fresh = distinct if cache is None else distinct.join(cache, "cache_key", "left_anti")
    made = compute(fresh).select("cache_key", "value")
    return keyed.join(made if cache is None else cache.select("cache_key", "value").unionByName(made), "cache_key", "left")
