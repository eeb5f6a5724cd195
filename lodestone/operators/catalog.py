"""Catalog views, checks between stores, and counts of ingestion stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.numeric import hash8
from lodestone.functions.text import document_tags, document_title, normal_words, tokens


def document_list(history: DataFrame, chunks: DataFrame, images: DataFrame) -> DataFrame:
    """Every ingested document with its number of chunks and images, oldest first."""
    c = chunks.groupBy("source_path").agg(F.count(F.lit(1)).alias("n_chunks")).withColumnRenamed("source_path", "file_path")
    i = images.groupBy("doc_hash").agg(F.count(F.lit(1)).alias("n_images")).withColumnRenamed("doc_hash", "file_hash")
    rows = history.filter("status = 'success'").join(c, "file_path", "left").join(i, "file_hash", "left")
    return rows.fillna(0, ["n_chunks", "n_images"]).orderBy("processed_at", "file_hash")


def collection_stats(documents: DataFrame) -> DataFrame:
    """Documents, chunks and images by collection, and in all (collection null): one rollup."""
    return documents.rollup("collection").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chunks").alias("chunks"), F.sum("n_images").alias("images"))


def document_summary(chunks: DataFrame) -> DataFrame:
    """doc_id, title, summary (the first that isn't empty, in chunk order), tags and chunk_count.

    chunks has doc_id, chunk_index, text, title, source_path, summary, tags (a comma list) and doc_type.
    """
    told = F.when(F.trim(F.coalesce("summary", F.lit(""))) != "", F.col("chunk_index"))
    per = chunks.groupBy("doc_id").agg(
        F.min_by(F.struct("text", "title", "source_path", "tags", "doc_type"), "chunk_index").alias("first"),
        F.min_by("summary", told).alias("summary"), F.count(F.lit(1)).alias("chunk_count"),
    )
    f = lambda c: F.col(f"first.{c}")
    return per.select("doc_id", document_title(f("text"), f("title"), f("source_path")).alias("title"), F.coalesce("summary", F.lit("")).alias("summary"), document_tags(f("tags"), f("doc_type")).alias("tags"), "chunk_count")


def chunks_of(chunks: DataFrame, doc_id: str) -> DataFrame:
    """Chunks that refer to a document, or, if none does, those whose id holds its id."""
    refers = chunks.filter(F.col("source_ref") == doc_id)
    none = refers.limit(1).agg((F.count(F.lit(1)) == 0).alias("none"))
    return refers.unionByName(chunks.filter(F.contains("chunk_id", F.lit(doc_id))).crossJoin(F.broadcast(none)).filter("none").drop("none"))


def stage_stats(chunks: DataFrame) -> DataFrame:
    """One row of counts over chunks with refined_by, enriched_by, caption and table_summary."""
    some = lambda c: F.count_if(F.coalesce(F.col(c), F.lit("")) != "")
    kinds = [F.count_if(F.col(c) == v).alias(f"{c}_{v}") for c in ("refined_by", "enriched_by") for v in ("rule", "llm")]
    return chunks.agg(F.count(F.lit(1)).alias("chunks"), F.coalesce(F.floor(F.sum(F.length("text")) / F.count(F.lit(1))), F.lit(0)).alias("mean_chars"), *kinds, some("caption").alias("captioned"), some("table_summary").alias("summarised"))


def batch_stats(rows: DataFrame, size: int) -> DataFrame:
    """One row: batches of ``size``, and rows that have a vector or not."""
    if size <= 0:
        raise ValueError(f"size must be positive, got {size}")
    n = F.count(F.lit(1))
    return rows.agg(F.ceil(n / size).alias("batches"), F.count_if(F.col("embedding").isNotNull()).alias("successful"), F.count_if(F.col("embedding").isNull()).alias("failed"))


def ingest_summary(results: DataFrame) -> DataFrame:
    return results.agg(F.count_if("success").alias("ok"), F.count_if(~F.col("success")).alias("failed"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks"), F.coalesce(F.sum("image_count"), F.lit(0)).alias("images"))


def alignment(chunks: DataFrame, postings: DataFrame, lengths: DataFrame) -> DataFrame:
    """chunk_id and side ('chunks' or 'index') of ids that only one store has; chunks without terms are exempt."""
    indexed = postings.select("chunk_id").distinct()
    wordless = F.size(tokens(F.col("text"))) == 0
    left = chunks.filter(~wordless).join(indexed, "chunk_id", "left_anti").select("chunk_id", F.lit("chunks").alias("side"))
    right = indexed.join(chunks, "chunk_id", "left_anti").select("chunk_id", F.lit("index").alias("side"))
    return left.unionByName(right)


def alignment_counts(chunks: DataFrame, postings: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row: ids in either store, chunk-term rows that repeat, and chunks that the index counts."""
    repeated = postings.groupBy("chunk_id", "term").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").agg(F.count(F.lit(1)).alias("repeated_postings"))
    return (
        chunks.agg(F.count_distinct("chunk_id").alias("chunks")).crossJoin(postings.agg(F.count_distinct("chunk_id").alias("indexed")))
        .crossJoin(lengths.agg(F.count(F.lit(1)).alias("num_docs"))).crossJoin(repeated)
    )


def not_ingested(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Corpus files (path) whose prefix no chunk has."""
    held = chunks.select(F.substring_index("chunk_id", "_", 1).alias("prefix")).distinct()
    return files.withColumn("prefix", hash8(F.col("path"))).join(held, "prefix", "left_anti")


def foreign_chunks(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks whose prefix no corpus file has."""
    known = files.select(hash8(F.col("path")).alias("prefix"))
    return chunks.withColumn("prefix", F.substring_index("chunk_id", "_", 1)).join(known, "prefix", "left_anti")


#: Where on a page, as a share of its words, feature windows stand, and their lengths.
POSITIONS, LENGTHS = (0.1, 0.3, 0.5, 0.7, 0.9), (8, 6)


def windows(words: Column) -> Column:
    """Feature windows of a page: runs of words at fixed relative places.  The words are made once, as a lambda's variable."""
    def of(w: Column) -> Column:
        n = F.size(w)
        start = lambda at: F.least(F.floor(n * at), F.greatest(n - 8, F.lit(0))).cast("int")
        found = F.array(*[F.slice(w, start(at) + 1, length) for at in POSITIONS for length in LENGTHS])
        sizes = F.array(*[F.lit(length) for _ in POSITIONS for length in LENGTHS])
        return F.filter(F.zip_with(found, sizes, lambda x, k: F.when(F.size(x) == k, F.array_join(x, " "))), lambda x: x.isNotNull())

    return F.get(F.transform(F.array(words), of), F.lit(0))


def page_verdicts(pages: DataFrame, library: DataFrame, *, words_least: int = 30, alpha_least: float = 0.2) -> DataFrame:
    """doc_id, page, words and verdict: blank_or_image, figure_page, in_library or MISSING.

    pages has doc_id, page and text, library doc_id and text (chunks); a window of the page must stand
    in the document's library text, one join by document.
    """
    joined = F.array_join(normal_words(F.col("text")), " ")
    held = library.withColumn("normal", joined).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("chunk_index", "normal"))).getField("normal"), " ").alias("held"))
    rows = pages.select("doc_id", "page", normal_words(F.col("text")).alias("w")).join(held, "doc_id", "left")
    long = F.size(F.filter("w", lambda x: x.rlike("^[a-z]{4,}$")))
    hits = F.size(F.filter(windows(F.col("w")), lambda x: F.contains(F.coalesce("held", F.lit("")), x)))
    verdict = F.when(F.size("w") < words_least, "blank_or_image").when(long / F.size("w") < alpha_least, "figure_page").when(hits > 0, "in_library").otherwise("MISSING")
    return rows.select("doc_id", "page", F.size("w").alias("words"), verdict.alias("verdict"))


def integrity(pages: DataFrame, library: DataFrame, chunks: DataFrame, postings: DataFrame, lengths: DataFrame, files: DataFrame) -> DataFrame:
    """check and n of all that is amiss: missing pages, files without chunks, foreign chunks, ids in one store only."""
    missing = page_verdicts(pages, library).filter("verdict = 'MISSING'")
    found = {"missing_pages": missing, "not_ingested": not_ingested(files, chunks), "foreign_chunks": foreign_chunks(files, chunks), "unaligned": alignment(chunks, postings, lengths)}
    out = None
    for name, rows in found.items():
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "n")
        out = one if out is None else out.unionByName(one)
    return out
