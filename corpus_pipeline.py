"""A corpus pipeline: toxic documents go, boilerplate lines go, one of each group of near-duplicates
stays, and what is left is packed into sequences.

Every stage works on all that the one before it kept, and returns the columns of documents; the last
returns the pieces.  Rows that repeat a doc_id are documents of their own to every decision; of rows that
repeat both id and text, and hold words, one stays.  Null texts hold nothing toxic, no lines and no shingles,
all of them stay, and they are packed as the end id alone.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import cut, discard, flagged, spare, table
from lodestone.llm.line_dedup import drop_boilerplate
from lodestone.llm.near_dup import near_duplicates
from lodestone.llm.packing import pack_documents
from lodestone.llm.toxicity import fit, score

#: One row per piece of a document; no text is returned.
ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model, fitted on the labels of these documents, doesn't call toxic."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    names = tuple(spare(docs, f"__{x}") for x in ("severity", "grade", "toxic"))
    return score(docs, model, names=names).filter(~F.col(names[2])).drop(*names)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their source's boilerplate lines, and their lengths."""
    left = drop_boilerplate(docs, host="source", ratio=0.1, least=5)
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, on five-word shingles at a similarity of 0.8: the one with the least id, and of its rows the one with the least hash of the text."""
    found = cut(near_duplicates(docs, width=5, percent=80).filter("group is not null").select("doc_id", "text_hash", "group"), "pipeline-grouped")
    # Both sums are written, as Spark splits a hot group only in a join without an aggregation below it.
    first = cut(found.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("stays")), "pipeline-first")
    seen = cut(found.groupBy("group", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("rows")), "pipeline-seen")
    stays = F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (F.col("text_hash") == F.col("stays.text_hash"))
    decided = cut(seen.join(first, "group").select(F.col("doc_id").alias("id"), "text_hash", stays.alias("stays"), "rows"), "pipeline-decided")
    discard(found, first, seen)
    texts = F.xxhash64("text")
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (texts == F.col("text_hash"))
    gone = decided.filter(~F.col("stays")).select("id", "text_hash")
    # Only texts that a filter of bounded size takes for one of those that go are moved to meet them.
    doubt, key, named = (spare(docs, f"__{x}") for x in ("doubt", "key", "hash"))
    marked = flagged(docs.withColumns({key: F.col("doc_id").cast("long"), named: texts}), [key, named], gone, doubt)
    left = marked.filter(F.col(doubt)).join(gone, same, "left_anti").unionByName(marked.filter(~F.col(doubt))).drop(doubt, key, named)
    again = decided.filter("stays and rows > 1")
    if again.isEmpty():
        return left
    return left.join(again, same, "left_anti").unionByName(left.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    pieces = pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", drop_lines),
    ("near-duplicates", drop_near_duplicates),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
