"""Queries of parsing decisions, counts, histories, images and placement."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestone.functions import numeric
from lodestone.operators import catalog, chunking, evaluation, filters, hybrid, store
from lodestone.plans import tables as t
from lodestone.plans.retrieval import BENCH_VECTORS, ASKED, POSTINGS, _ranked, dense_sql, sparse
from lodestone.sources import files

BOX = "struct<x0:double,top:double,x1:double,bottom:double>"


def _box(x):
    return F.struct(x.alias("x0"), (x / 2).alias("top"), (x + 10).alias("x1"), (x / 2 + 10).alias("bottom")).cast(BOX)


def q_needs_ocr(spark, d):
    """A source stands in for a file, its documents for pages."""
    docs = t.table(spark, d, "documents")
    pages = docs.select(F.col("source").alias("doc_id"), F.row_number().over(W.partitionBy("source").orderBy("doc_id")).alias("page"), "text")
    return files.needs_ocr(pages)


def q_page_batches(spark, d):
    docs = t.table(spark, d, "documents").select("doc_id", F.when(F.col("lang") != "es", F.floor(F.col("n_chars") / 500).cast("int") + 1).alias("n_pages"))
    return files.batches(docs, 3)


def q_parse_replay(spark, d):
    """Labelled documents are in the cache, toxic ones with a batch missing."""
    docs = t.table(spark, d, "documents").select(F.sha2(F.col("doc_id").cast("string"), 256).alias("file_hash"), F.col("doc_id").cast("string").alias("path"), "doc_id")
    cache = t.table(spark, d, "labels").join(docs, "doc_id").select("file_hash", F.lit("v1").alias("version_stamp"), F.lit(1).alias("batch"), F.when(F.col("toxic") == 1, 2).otherwise(1).alias("n_batches"), F.lit("held").alias("text"))
    texts, due = files.replay(docs.select("file_hash", "path"), cache, F.lit("v1"))
    return texts.select("path", "text").unionByName(due.select("path", F.lit(None).cast("string").alias("text")))


def q_table_only(spark, d):
    rows = t.table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 10, F.col("p_size") % 2 == 0).alias("ct"), (F.col("p_size") % 3 == 0).alias("cx"), F.when(F.col("p_size") % 5 == 0, "table").otherwise("text").alias("st"))
    return rows.select("p_partkey", filters.is_table_only(F.col("ct"), F.col("cx"), F.col("st")).alias("table_only"))


def q_batch_stats(spark, d):
    return catalog.batch_stats(t.table(spark, d, "embeddings"), 64)


def q_stage_stats(spark, d):
    rows = t.table(spark, d, "conversations").select(
        "text", F.when(F.col("role") == "user", "rule").otherwise("llm").alias("refined_by"), F.lit("rule").alias("enriched_by"), F.when(F.col("turn") == 1, "c").alias("caption"), F.lit("").alias("table_summary"))
    return catalog.stage_stats(rows)


def q_ingest_summary(spark, d):
    rows = t.table(spark, d, "labels").select((F.col("quality") == 1).alias("success"), F.col("doc_id").alias("chunk_count"), F.col("toxic").alias("image_count"))
    return catalog.ingest_summary(rows)


def q_feed_report(spark, d):
    """Conversations stand in for documents; pages of toxic labels are excluded."""
    kind = F.when(F.length("text") % 6 == 0, "figure").otherwise("text")
    sections = t.table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), kind.alias("type"), "text", F.col("turn").alias("page"))
    excluded = t.table(spark, d, "labels").filter("toxic = 1").select((F.col("doc_id") % 50).alias("doc_id"), F.lit(1).cast("long").alias("page"))
    return evaluation.feed_report(sections, excluded).select("doc_id", "kept", "figures", "excluded", F.sha2("feed", 256).alias("feed"))


def q_nearest_chunk(spark, d):
    """Suppliers stand in for images, customers for chunks, nations for documents."""
    images = t.table(spark, d, "supplier").select(F.col("s_nationkey").alias("doc_id"), F.col("s_suppkey").alias("image_id"), (F.col("s_suppkey") % 5).alias("page"), _box(F.col("s_acctbal")).alias("bbox"))
    held = t.table(spark, d, "customer").select(F.col("c_nationkey").alias("doc_id"), F.col("c_custkey").alias("chunk_id"), F.col("c_custkey").alias("chunk_index"), (F.col("c_custkey") % 5).alias("page_num"), _box(F.col("c_acctbal")).alias("bbox"))
    return chunking.nearest_chunk(images, held)


def q_history_marked(spark, d):
    """Labels are the history, toxic ones ran again and passed."""
    rows = t.table(spark, d, "labels").select(
        F.col("doc_id").cast("string").alias("file_hash"), F.lit("p").alias("file_path"), F.when(F.col("quality") == 1, "success").otherwise("failed").alias("status"), F.lit("c").alias("collection"),
        F.when(F.col("quality") == 0, "old error").alias("error_msg"), F.timestamp_seconds("doc_id").alias("processed_at"), F.timestamp_seconds("doc_id").alias("updated_at"))
    again = t.table(spark, d, "labels").filter("toxic = 1").select(
        F.col("doc_id").cast("string").alias("file_hash"), F.lit("p2").alias("file_path"), F.lit("success").alias("status"), F.lit("c").alias("collection"), F.lit("ignored").alias("error_msg"), F.timestamp_seconds(F.lit(99)).alias("at"))
    made = store.marked(rows, again)
    return made.select("file_hash", "file_path", "status", "error_msg", F.unix_seconds("processed_at").alias("processed_at"), F.unix_seconds("updated_at").alias("updated_at"))


def q_registered_images(spark, d):
    """Suppliers stand in for images; those of even keys register again without a caption, and get one."""
    s = t.table(spark, d, "supplier")
    images = s.select(F.col("s_suppkey").alias("image_id"), F.when(F.col("s_suppkey") % 3 == 0, "old").alias("caption"))
    again = store.registered(images, s.filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("image_id"), F.lit(None).cast("string").alias("caption")))
    return store.captioned(again, s.filter("s_suppkey % 5 = 0").select(F.col("s_suppkey").alias("image_id"), F.lit("new").alias("caption")))


def q_once_per_key(spark, d):
    """A value computed once for each distinct text."""
    docs = t.table(spark, d, "documents").select("doc_id", "text")
    return store.once_per_key(docs, F.sha2("text", 256), lambda rows: rows.select("cache_key", F.min("doc_id").over(W.partitionBy("cache_key")).isNotNull().cast("string").alias("value"))).select("doc_id", "cache_key", "value")


def q_metadata_maps(spark, d):
    rows = t.table(spark, d, "nation").select("n_nationkey", F.create_map(F.lit("name"), "n_name", F.lit("_hidden"), F.lit("x"), F.lit("text"), F.lit("y"), F.lit("none"), F.lit(None).cast("string")).alias("m"))
    text = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null"))))), ";")
    return rows.select("n_nationkey", text(numeric.stored_metadata(F.col("m"))).alias("stored"), text(numeric.shown_metadata(F.col("m"))).alias("shown"))


def q_compare_paths(spark, d):
    return _ranked(hybrid.compare(t.asked_vectors(spark, d), t.chunks(spark, d), t.index(spark, d), t.vectors(spark, d)).filter("path <> 'fused'"))


def q_verdict_windows(spark, d):
    """Feature windows of every document, as one hash."""
    from lodestone.functions.text import normal_words

    return t.table(spark, d, "documents").select("doc_id", F.sha2(F.array_join(catalog.windows(normal_words(F.col("text"))), "|"), 256).alias("windows"))


_W = r"list_filter(string_split(regexp_replace(lower(regexp_replace(text, '-\s*\n\s*', '', 'g')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"
_WINDOWS = ", ".join(f"w[least(floor(len(w) * {at}::DOUBLE), greatest(len(w) - 8, 0))::INT + 1 : least(floor(len(w) * {at}::DOUBLE), greatest(len(w) - 8, 0))::INT + {n}]" for at in catalog.POSITIONS for n in catalog.LENGTHS)
_SIZES = ", ".join(str(n) for _ in catalog.POSITIONS for n in catalog.LENGTHS)

ORACLE_SQL = {
    "q_needs_ocr": """WITH p AS (SELECT source, text AS x, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page FROM documents)
SELECT source AS doc_id, sum(length(trim(x))) < count(*) * 25 AS ocr FROM p WHERE page <= 3 GROUP BY 1""",
    "q_page_batches": """WITH p AS (SELECT doc_id, CASE WHEN lang <> 'es' THEN floor(n_chars / 500)::INT + 1 END AS n FROM documents)
SELECT doc_id, 1::INTEGER AS first_page, NULL::INTEGER AS last_page FROM p WHERE n IS NULL OR n <= 3 UNION ALL
SELECT doc_id, s::INTEGER, least(s + 2, n)::INTEGER FROM (SELECT doc_id, n, unnest(generate_series(1, n, 3)) AS s FROM p WHERE n > 3)""",
    "q_parse_replay": "SELECT doc_id::VARCHAR AS path, CASE WHEN toxic = 0 THEN 'held' END AS text FROM documents LEFT JOIN labels USING (doc_id)",
    "q_table_only": "SELECT p_partkey, CASE WHEN p_size > 10 THEN p_size % 2 = 0 AND p_size % 3 <> 0 ELSE p_size % 5 = 0 END AS table_only FROM part",
    "q_batch_stats": "SELECT ceil(count(*) / 64)::BIGINT AS batches, count(embedding) AS successful, count(*) - count(embedding) AS failed FROM embeddings",
    "q_stage_stats": """SELECT count(*) AS chunks, floor(sum(length(text)) / count(*))::BIGINT AS mean_chars, count(*) FILTER (role = 'user') AS refined_by_rule, count(*) FILTER (role <> 'user') AS refined_by_llm,
  count(*) AS enriched_by_rule, 0::BIGINT AS enriched_by_llm, count(*) FILTER (turn = 1) AS captioned, 0::BIGINT AS summarised FROM conversations""",
    "q_ingest_summary": "SELECT count(*) FILTER (quality = 1) AS ok, count(*) FILTER (quality <> 1) AS failed, sum(doc_id)::BIGINT AS chunks, sum(toxic)::BIGINT AS images FROM labels",
    "q_feed_report": """WITH e AS (SELECT DISTINCT doc_id % 50 AS doc_id FROM labels WHERE toxic = 1),
s AS (SELECT conv_id AS doc_id, turn, text, CASE WHEN length(text) % 6 = 0 THEN 'figure' WHEN turn = 1 AND conv_id IN (SELECT doc_id FROM e) THEN 'excluded' ELSE 'kept' END AS kind FROM conversations)
SELECT doc_id, count(*) FILTER (kind = 'kept') AS kept, count(*) FILTER (kind = 'figure') AS figures, count(*) FILTER (kind = 'excluded') AS excluded,
  sha256(coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (kind = 'kept' AND trim(coalesce(text, '')) <> ''), '')) AS feed FROM s GROUP BY 1""",
    "q_nearest_chunk": """SELECT s_nationkey AS doc_id, s_suppkey AS image_id, c_custkey AS chunk_id FROM supplier JOIN customer ON s_nationkey = c_nationkey
QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY (s_suppkey % 5 = c_custkey % 5 AND s_acctbal = c_acctbal) DESC, abs(s_suppkey % 5 - c_custkey % 5),
  pow((s_acctbal + (s_acctbal + 10)) / 2 - (c_acctbal + (c_acctbal + 10)) / 2, 2) + pow((s_acctbal / 2 + (s_acctbal / 2 + 10)) / 2 - (c_acctbal / 2 + (c_acctbal / 2 + 10)) / 2, 2), c_custkey) = 1""",
    "q_history_marked": """SELECT doc_id::VARCHAR AS file_hash, CASE WHEN toxic = 1 THEN 'p2' ELSE 'p' END AS file_path, CASE WHEN toxic = 1 OR quality = 1 THEN 'success' ELSE 'failed' END AS status,
  CASE WHEN toxic <> 1 AND quality = 0 THEN 'old error' END AS error_msg, doc_id AS processed_at, CASE WHEN toxic = 1 THEN 99 ELSE doc_id END::BIGINT AS updated_at FROM labels""",
    "q_registered_images": "SELECT s_suppkey AS image_id, CASE WHEN s_suppkey % 5 = 0 THEN 'new' WHEN s_suppkey % 3 = 0 THEN 'old' END AS caption FROM supplier",
    "q_once_per_key": "SELECT doc_id, sha256(text) AS cache_key, 'true' AS value FROM documents",
    "q_metadata_maps": "SELECT n_nationkey, '_hidden=x;name=' || n_name || ';text=y' AS stored, 'name=' || n_name || ';none=null' AS shown FROM nation",
    "q_compare_paths": f"""WITH {POSTINGS}, {ASKED}, {sparse(10)}, {dense_sql(10, BENCH_VECTORS)}
SELECT query_id, 'dense' AS path, chunk_id, round(score, 6) AS score, rank FROM dense UNION ALL SELECT s.query_id, 'sparse', chunk_id, round(score, 6), rank FROM sparse s JOIN embeddings ON vec_id = s.query_id""",
    "q_verdict_windows": f"""WITH d AS (SELECT doc_id, {_W} AS w FROM documents), x AS (SELECT doc_id, list_zip([{_WINDOWS}], [{_SIZES}]) AS z FROM d)
SELECT doc_id, sha256(array_to_string(list_transform(list_filter(z, lambda p: len(p[1]) = p[2]), lambda p: array_to_string(p[1], ' ')), '|')) AS windows FROM x""",
}

QUERIES = {name: value for name, value in globals().items() if name.startswith("q_") and callable(value)}
