"""Queries of evaluation, catalog, stores and traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions.numeric import hash8
from lodestone.operators import catalog, evaluation, index, store, traces
from lodestone.plans import tables as t
from lodestone.plans.retrieval import ASKED, POSTINGS, sparse
from lodestone.streaming.ingest import windowed_counts


def _truth(spark, d):
    """Documents whose normalised text holds a benchmark item's."""
    from lodestone.functions.text import normalise

    items = t.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), normalise(F.col("text")).alias("needle"))
    docs = t.table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "source", normalise(F.col("text")).alias("hay"))
    return evaluation.holding(items, docs).select("query_id", "chunk_id", "source")


def _results(spark, d):
    found = index.bm25(t.index(spark, d), t.asked_terms(spark, d), k=10)
    return found.join(t.chunks(spark, d).select("chunk_id", F.col("source_path").alias("source")), "chunk_id")


def q_context_match(spark, d):
    contexts = t.table(spark, d, "benchmark").select(F.col("item_id").alias("context_id"), "text")
    return evaluation.match_contexts(contexts, t.chunks(spark, d), least=0.5)


def q_hit_rate_mrr(spark, d):
    found = evaluation.id_metrics(_results(spark, d), _truth(spark, d).select("query_id", "chunk_id"), t.asked(spark, d))
    return found.withColumn("mrr", F.round("mrr", 9))


def q_source_metrics(spark, d):
    found = evaluation.source_metrics(_results(spark, d), _truth(spark, d).select("query_id", "source"), t.asked(spark, d), k=5)
    return found.withColumn("source_precision", F.round("source_precision", 9))


def q_metric_means(spark, d):
    """Event values stand in for metrics; infinities, nulls and NaN leave the mean."""
    value = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).when(F.col("event_id") % 11 == 0, F.lit(float("inf"))).when(F.col("event_id") % 5 == 0, F.lit(None)).otherwise(F.col("value"))
    rows = t.table(spark, d, "events").select(F.col("event_type").alias("metric"), value.alias("value"))
    return evaluation.metric_means(rows).withColumn("mean", F.round("mean", 6))


def q_merged_metrics(spark, d):
    rows = t.table(spark, d, "events").select(F.col("user_id").alias("query_id"), F.col("event_type").alias("metric"), "value", F.col("event_id").alias("evaluator_idx"))
    return evaluation.merged_metrics(rows)


def q_dense_references(spark, d):
    return t.table(spark, d, "conversations").select("conv_id", "turn", evaluation.is_dense_reference(F.col("text"), 40).alias("dense"))


def q_quota_select(spark, d):
    pool = t.table(spark, d, "part").select("p_partkey", F.col("p_type").alias("kind"), F.col("p_partkey").alias("pool_idx"))
    return evaluation.select_by_quota(pool, 100).select("p_partkey", "kind")


def q_type_distribution(spark, d):
    return evaluation.type_distribution(t.table(spark, d, "part").withColumnRenamed("p_type", "kind"))


def q_resolve_verdicts(spark, d):
    """Labels stand in for a review's ledger: toxic rows out, rows of low quality replaced by the next."""
    pool = t.table(spark, d, "documents").select(F.col("doc_id").alias("pool_idx"), "source")
    verdict = F.when(F.col("toxic") == 1, "remove").when(F.col("quality") == 0, "repair").otherwise("pass")
    ledger = t.table(spark, d, "labels").select(F.col("doc_id").alias("pool_idx"), verdict.alias("verdict"), (F.col("doc_id") + 1).alias("replaced_by_pool_idx"))
    return evaluation.resolve_verdicts(pool, ledger)


def _history(spark, d):
    ok = F.when(F.col("quality") == 1, "success").otherwise("failed")
    docs = t.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("file_hash"))
    return t.table(spark, d, "labels").join(docs, "doc_id").select("file_hash", ok.alias("status"))


def q_incremental_skip(spark, d):
    files = t.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("file_hash"))
    return store.to_ingest(files, _history(spark, d)).select("doc_id", "file_hash")


def q_upsert(spark, d):
    """Labelled documents with a new language, over all documents."""
    docs = t.table(spark, d, "documents").select("doc_id", "lang", "source")
    new = t.table(spark, d, "labels").select("doc_id", F.lit("xx").alias("lang"), F.lit("new").alias("source"))
    return store.upserted(docs, new, ("doc_id",))


def q_get_by_ids(spark, d):
    ids = ["7", "no such id", "3", "0"]
    rows = t.chunks(spark, d).withColumn("chunk_id", F.col("chunk_id").cast("string"))
    return store.get_by_ids(rows, ids).select(F.col("pos").cast("long").alias("pos"), "chunk_id", "source_path")


def q_collections(spark, d):
    rows = t.table(spark, d, "documents").select(F.when(F.col("lang") == "fr", "_hidden").otherwise(F.col("lang")).alias("collection"))
    return store.collections(rows)


def q_collection_stats(spark, d):
    rows = t.table(spark, d, "documents").select(F.col("lang").alias("collection"), F.ceil(F.col("n_chars") / 1000).alias("n_chunks"), F.lit(0).cast("long").alias("n_images"))
    return catalog.collection_stats(rows)


def q_document_list(spark, d):
    docs = t.table(spark, d, "documents")
    history = docs.groupBy("source").agg(F.min("doc_id").alias("at")).select(
        F.sha2("source", 256).alias("file_hash"), F.col("source").alias("file_path"), F.lit("success").alias("status"), F.timestamp_seconds("at").alias("processed_at"))
    images = docs.filter("lang = 'de'").select(F.sha2("source", 256).alias("doc_hash"))
    return catalog.document_list(history, docs.select(F.col("source").alias("source_path")), images).select("file_path", "n_chunks", "n_images")


def q_document_summary(spark, d):
    """A source stands in for a document, and its documents for that document's chunks."""
    rows = t.table(spark, d, "documents").select(
        F.col("source").alias("doc_id"), F.col("doc_id").alias("chunk_index"), "text", F.lit("").alias("title"), F.concat(F.lit("a/"), "source", F.lit("_of-this.md")).alias("source_path"),
        F.when(F.col("lang") == "de", F.concat(F.lit("S "), F.col("doc_id"))).alias("summary"), F.concat("lang", F.lit(", x")).alias("tags"), F.lit("md").alias("doc_type"))
    return catalog.document_summary(rows).select("doc_id", "title", "summary", F.array_join("tags", "|").alias("tags"), "chunk_count")


def q_store_alignment(spark, d):
    """The index holds labelled documents only; documents without words are exempt."""
    chunks = t.chunks(spark, d)
    held = index.build(chunks.join(t.table(spark, d, "labels").select(F.col("doc_id").alias("chunk_id")), "chunk_id", "left_semi"), stem=False)
    return catalog.alignment(chunks.filter("doc_type <> 'es'"), held.postings, held.lengths)


def q_alignment_counts(spark, d):
    held = t.index(spark, d)
    return catalog.alignment_counts(t.chunks(spark, d), held.postings, held.lengths)


def q_foreign_chunks(spark, d):
    """Orders' customers are the files; suppliers' and customers' prefixes the chunks."""
    files = t.table(spark, d, "customer").select(F.col("c_name").alias("path"))
    rows = t.table(spark, d, "supplier").select(F.col("s_name").alias("name")).unionByName(t.table(spark, d, "customer").select(F.col("c_name").alias("name")))
    chunks = rows.select("name", F.concat(hash8(F.col("name")), F.lit("_0000_x")).alias("chunk_id"))
    return catalog.foreign_chunks(files, chunks).select("name", "prefix")


def q_not_ingested(spark, d):
    files = t.table(spark, d, "documents").select(F.col("source").alias("path")).distinct()
    chunks = t.table(spark, d, "documents").filter("lang = 'es'").select(F.concat(hash8(F.col("source")), F.lit("_0000_x")).alias("chunk_id"))
    return catalog.not_ingested(files, chunks)


def q_page_verdicts(spark, d):
    """Every document is a page; the library holds those that are labelled."""
    docs = t.table(spark, d, "documents")
    pages = docs.select("doc_id", F.lit(1).alias("page"), "text")
    library = docs.join(t.table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").select("doc_id", F.lit(0).alias("chunk_index"), "text")
    return catalog.page_verdicts(pages, library).select("doc_id", "page", F.col("words").cast("long").alias("words"), "verdict")


def _traces(spark, d):
    """A user's events of one type are a trace; its stages are the events in order of time."""
    stage = F.struct(F.col("event_type").alias("stage"), F.col("ts").cast("string").alias("timestamp"), F.when(F.col("event_id") % 3 > 0, F.col("value")).alias("elapsed_ms"), F.col("props").alias("data"))
    rows = t.table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", stage.alias("s")))).alias("x"), F.min("ts").alias("first"))
    return rows.select(F.format_string("t%06d", "user_id").alias("trace_id"), F.when(F.col("user_id") % 2 == 0, "query").otherwise("ingestion").alias("trace_type"), F.date_format("first", "yyyy-MM-dd'T'HH:mm:ss").alias("started_at"), F.transform("x", lambda x: x["s"]).alias("stages"), F.lit("{}").alias("metadata"))


def q_trace_recent(spark, d):
    return traces.recent(_traces(spark, d), trace_type="query", n=100).select("trace_id", "started_at")


def q_stage_timings(spark, d):
    return traces.stage_timings(_traces(spark, d))


def q_trace_diagnosis(spark, d):
    return traces.diagnosis(_traces(spark, d), ["click", "purchase", "no such stage"]).select("trace_id", F.array_join(F.array_sort("missing"), "|").alias("missing"), "has_error", "no_result")


def q_windowed_counts(spark, d):
    """The stream's plan over the whole table at once."""
    return windowed_counts(t.table(spark, d, "events")).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("mean", 6).alias("mean"))


_NORM = r"lower(trim(regexp_replace(text, '\s+', ' ', 'g')))"
TRUTH = f"""needles AS (SELECT item_id AS query_id, {_NORM} AS needle FROM benchmark), hays AS (SELECT doc_id AS chunk_id, source, {_NORM} AS hay FROM documents),
truth AS (SELECT query_id, chunk_id, source FROM needles JOIN hays ON contains(hay, needle))"""
_FOUND = f"WITH {POSTINGS}, {ASKED}, {sparse(10)}, {TRUTH}"
_W = r"list_filter(string_split(regexp_replace(lower(regexp_replace(text, '-\s*\n\s*', '', 'g')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"
_STAGES = """ev AS (SELECT printf('t%06d', user_id) AS trace_id, user_id, event_id, event_type AS stage, CASE WHEN event_id % 3 > 0 THEN value END AS elapsed_ms, props, ts FROM events)"""
_HASH = "left(sha256({}), 8)"

ORACLE_SQL = {
    "q_context_match": f"""WITH {TRUTH}, inside AS (SELECT query_id AS context_id, min_by(chunk_id, (length(hay), chunk_id)) AS chunk_id FROM needles JOIN hays ON contains(hay, needle) GROUP BY 1),
ct AS (SELECT DISTINCT query_id AS context_id, unnest(regexp_extract_all(needle, '[a-z0-9]+')) AS token FROM needles WHERE query_id NOT IN (SELECT context_id FROM inside)),
ht AS (SELECT DISTINCT chunk_id, unnest(regexp_extract_all(hay, '[a-z0-9]+')) AS token FROM hays),
n AS (SELECT context_id, count(*) AS n FROM ct GROUP BY 1), shared AS (SELECT context_id, chunk_id, count(*) AS b FROM ct JOIN ht USING (token) GROUP BY 1, 2),
f AS (SELECT context_id, chunk_id FROM shared JOIN n USING (context_id) WHERE b / n >= 0.5 QUALIFY row_number() OVER (PARTITION BY context_id ORDER BY b / n DESC, chunk_id) = 1)
SELECT item_id AS context_id, coalesce(inside.chunk_id, f.chunk_id) AS chunk_id FROM benchmark LEFT JOIN inside ON item_id = inside.context_id LEFT JOIN f ON item_id = f.context_id""",
    "q_hit_rate_mrr": f"""{_FOUND}, h AS (SELECT query_id, min(rank) AS first FROM sparse SEMI JOIN truth USING (query_id, chunk_id) GROUP BY 1)
SELECT item_id AS query_id, CASE WHEN first IS NOT NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS hit_rate, round(coalesce(1.0::DOUBLE / first, 0), 9) AS mrr FROM benchmark LEFT JOIN h ON item_id = query_id""",
    "q_source_metrics": f"""{_FOUND}, g AS (SELECT s.query_id, (EXISTS (SELECT 1 FROM truth t WHERE t.query_id = s.query_id AND t.source = d.source))::INT AS hit FROM sparse s JOIN documents d ON doc_id = chunk_id WHERE rank <= 5),
p AS (SELECT query_id, max(hit)::DOUBLE AS r, avg(hit) AS p FROM g GROUP BY 1)
SELECT item_id AS query_id, coalesce(r, 0) AS source_recall, round(coalesce(p, 0), 9) AS source_precision FROM benchmark LEFT JOIN p ON item_id = query_id""",
    "q_metric_means": "SELECT event_type AS metric, round(coalesce(avg(value) FILTER (event_id % 7 <> 0 AND event_id % 11 <> 0 AND event_id % 5 <> 0), 0), 6) AS mean FROM events GROUP BY 1",
    "q_merged_metrics": "SELECT user_id AS query_id, event_type AS metric, max_by(value, event_id) AS value FROM events GROUP BY 1, 2",
    "q_dense_references": r"SELECT conv_id, turn, len(list_filter(string_split_regex(trim(text), '\s+'), lambda w: w <> '')) > 40 AS dense FROM conversations",
    "q_quota_select": """WITH c AS (SELECT p_type, count(*) AS n_kind, min(p_partkey) AS first FROM part GROUP BY 1),
e AS (SELECT *, 100 * n_kind / sum(n_kind) OVER () AS exact, floor(100 * n_kind / sum(n_kind) OVER ()) AS base FROM c),
q AS (SELECT p_type, least(n_kind, base + CASE WHEN row_number() OVER (ORDER BY round(exact - base, 9) DESC, first) <= 100 - sum(base) OVER () AND base < n_kind THEN 1 ELSE 0 END) AS quota FROM e)
SELECT p_partkey, p_type AS kind FROM part JOIN q USING (p_type) QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) <= quota""",
    "q_type_distribution": "SELECT p_type AS kind, count(*) AS n FROM part GROUP BY 1",
    "q_resolve_verdicts": """SELECT d.doc_id AS pool_idx, d.source, l.doc_id AS asked_idx FROM labels l JOIN documents a ON a.doc_id = l.doc_id
JOIN documents d ON d.doc_id = CASE WHEN quality = 0 THEN l.doc_id + 1 ELSE l.doc_id END WHERE toxic <> 1""",
    "q_incremental_skip": "SELECT doc_id, sha256(text) AS file_hash FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents JOIN labels USING (doc_id) WHERE quality = 1)",
    "q_upsert": "SELECT doc_id, lang, source FROM documents ANTI JOIN labels USING (doc_id) UNION ALL SELECT doc_id, 'xx', 'new' FROM labels",
    "q_get_by_ids": "SELECT pos::BIGINT AS pos, chunk_id, source AS source_path FROM (VALUES (0, '7'), (1, 'no such id'), (2, '3'), (3, '0')) v(pos, chunk_id) LEFT JOIN documents ON doc_id::VARCHAR = chunk_id",
    "q_collections": "SELECT lang AS collection, count(*) AS n_chunks FROM documents WHERE lang <> 'fr' GROUP BY 1",
    "q_collection_stats": "SELECT lang AS collection, count(*) AS documents, sum(ceil(n_chars / 1000))::BIGINT AS chunks, 0::BIGINT AS images FROM documents GROUP BY ROLLUP (lang)",
    "q_document_list": "SELECT source AS file_path, count(*) AS n_chunks, count(*) FILTER (lang = 'de') AS n_images FROM documents GROUP BY 1",
    "q_document_summary": r"""WITH f AS (SELECT source AS doc_id, arg_min(text, doc_id) AS text, arg_min(lang, doc_id) AS lang, coalesce(arg_min('S ' || doc_id, doc_id) FILTER (lang = 'de'), '') AS summary, count(*) AS chunk_count FROM documents GROUP BY 1)
SELECT doc_id, upper(left(doc_id, 1)) || lower(doc_id[2:]) || ' Of This' AS title, summary, lang || '|x|MD' AS tags, chunk_count FROM f""",
    "q_store_alignment": f"""WITH {POSTINGS}, held AS (SELECT DISTINCT chunk_id FROM postings SEMI JOIN labels ON doc_id = chunk_id), c AS (SELECT doc_id AS chunk_id, text FROM documents WHERE lang <> 'es')
SELECT chunk_id, 'chunks' AS side FROM c ANTI JOIN held USING (chunk_id) WHERE len(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+[+#]+|[\\p{{L}}\\p{{N}}_]+')) > 0
UNION ALL SELECT chunk_id, 'index' FROM held ANTI JOIN c USING (chunk_id)""",
    "q_alignment_counts": f"WITH {POSTINGS} SELECT (SELECT count(*) FROM documents) AS chunks, (SELECT count(DISTINCT chunk_id) FROM postings) AS indexed, (SELECT count(*) FROM lengths) AS num_docs, 0::BIGINT AS repeated_postings",
    "q_foreign_chunks": f"SELECT s_name AS name, {_HASH.format('s_name')} AS prefix FROM supplier WHERE {_HASH.format('s_name')} NOT IN (SELECT {_HASH.format('c_name')} FROM customer)",
    "q_not_ingested": f"SELECT DISTINCT source AS path, {_HASH.format('source')} AS prefix FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE lang = 'es')",
    "q_page_verdicts": f"""WITH w AS (SELECT doc_id, {_W} AS w, doc_id IN (SELECT doc_id FROM labels) AS held FROM documents)
SELECT doc_id, 1::INTEGER AS page, len(w) AS words, CASE WHEN len(w) < 30 THEN 'blank_or_image' WHEN len(list_filter(w, lambda x: regexp_full_match(x, '[a-z]{{4,}}'))) / len(w) < 0.2 THEN 'figure_page' WHEN held THEN 'in_library' ELSE 'MISSING' END AS verdict FROM w""",
    "q_trace_recent": f"WITH {_STAGES} SELECT trace_id, strftime(min(ts), '%Y-%m-%dT%H:%M:%S') AS started_at FROM ev WHERE user_id % 2 = 0 GROUP BY 1 ORDER BY started_at DESC, trace_id LIMIT 100",
    "q_stage_timings": f"WITH {_STAGES} SELECT trace_id, stage, max_by(coalesce(elapsed_ms, 0), event_id) AS elapsed_ms FROM ev GROUP BY 1, 2",
    "q_trace_diagnosis": f"""WITH {_STAGES} SELECT trace_id, CASE WHEN bool_or(stage = 'click') THEN '' ELSE 'click|' END || 'no such stage' || CASE WHEN bool_or(stage = 'purchase') THEN '' ELSE '|purchase' END AS missing,
  bool_or(contains(lower(props), '"error"')) AS has_error, bool_or(regexp_matches(lower(props), '"(?:result_count|count)"\\s*:\\s*0\\b')) AS no_result FROM ev GROUP BY 1""",
    "q_windowed_counts": "SELECT strftime(time_bucket(INTERVAL '5 minutes', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL",
}

QUERIES = {name: value for name, value in globals().items() if name.startswith("q_") and callable(value)}
