"""What the operators of this package share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, through Spark's own reader, so that any store that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and all run on one machine, as in tests, a temporary folder is made and remembered.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("lodestone.local.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("lodestone.local.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again.

    The written table replaces the lineage: a lost executor costs no more than the tasks that ran on
    it, and columns that a later step does not name are never read back.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    _written[made] = path
    return made


#: Where the tables lie that ``cut`` made.
_written: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``cut`` made and that no result reads any more."""
    for made in tables:
        if (path := _written.pop(made, None)) is not None:
            jvm = made.sparkSession.sparkContext._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(made.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


#: Words of 64 bits in the filter of ``flagged``, which bounds what is broadcast.
FILTER_WORDS = 1 << 18


def flagged(df: DataFrame, columns: list[str], wanted: DataFrame, name: str) -> DataFrame:
    """``df`` and a boolean ``name``: true if the columns' values are a row of ``wanted``, and by chance for others.

    Each row of ``wanted`` sets one bit, and only words with a bit set are broadcast; the fuller they are, the more others are true.
    For joins that would move wide rows and find few of them. The columns' types have to be those of ``wanted``.
    """
    hashed = lambda names: F.xxhash64(F.lit(11), *[F.col(f"`{c}`") for c in names])
    word, bits, at = (spare(df, x) for x in ("__word", "__bits", "__at"))
    place = lambda names: F.pmod(hashed(names), F.lit(FILTER_WORDS))
    bit = lambda names: F.shiftrightunsigned(hashed(names), 58).cast("int")
    held = wanted.select(place(wanted.columns).alias(word), bit(wanted.columns).alias(at))
    held = held.groupBy(word).agg(F.bit_or(F.expr(f"shiftleft(1L, `{at}`)")).alias(bits))
    met = df.withColumn(word, place(columns)).withColumn(at, bit(columns)).join(F.broadcast(held), word, "left")
    found = F.expr(f"coalesce(shiftrightunsigned(`{bits}`, `{at}`) & 1L, 0L)") == 1
    return met.select(*[F.col(f"`{c}`") for c in df.columns], found.alias(name))


def likely(df: DataFrame, columns: list[str], wanted: DataFrame) -> DataFrame:
    """The rows of ``df`` whose columns' values are a row of ``wanted``, and others by chance."""
    name = spare(df, "__likely")
    return flagged(df, columns, wanted, name).filter(F.col(name)).drop(name)


def spare(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have yet, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the given names; further columns, clashing or not, stay out."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def texts(batch, column: str = "text") -> Iterator[str]:
    """The column's values as Python strings, null as an empty one."""
    for value in batch.column(column).to_pylist():
        yield value or ""


def parts(batches: Iterator, rows: int = 256) -> Iterator:
    """The batches in slices of a few rows, so that a worker holds few values as Python objects."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


#: Rows of an Arrow batch at most: texts can be long, and a batch is held on both sides of the pipe.
BATCH_ROWS = 1000


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``df.mapInArrow`` with small batches; the session's limit is lowered for it, and never raised."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df.mapInArrow(function, schema)
