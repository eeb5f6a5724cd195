"""Queries of the index, dense search, fusion and hybrid search."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions.stopwords import DEFAULT, ENGLISH
from lodestone.functions.text import WORD
from lodestone.operators import dense, fusion, hybrid
from lodestone.operators.index import bm25, build, remove_prefixes, term_counts, top_terms
from lodestone.plans import tables as t


def quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in sorted(values))


TOKENS = f"regexp_extract_all(lower(coalesce(text, '')), '{WORD}')"
STOP = f"({quoted(ENGLISH)})"
POSTINGS = f"""
occ AS (SELECT doc_id AS chunk_id, unnest({TOKENS}) AS term FROM documents),
postings AS (SELECT chunk_id, term, count(*) AS tf FROM occ WHERE length(term) >= 2 AND term NOT IN {STOP} GROUP BY 1, 2),
lengths AS (SELECT d.doc_id AS chunk_id, coalesce(dl, 0)::BIGINT AS dl, coalesce(unique_terms, 0) AS unique_terms FROM documents d
  LEFT JOIN (SELECT chunk_id, sum(tf) AS dl, count(*) AS unique_terms FROM postings GROUP BY 1) p ON d.doc_id = p.chunk_id),
corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl, sum(dl)::BIGINT AS total_terms FROM lengths),
stats AS (SELECT term, count(*) AS df, ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM postings, corpus GROUP BY 1)"""
ASKED = f"""
words AS (SELECT item_id AS query_id, unnest({TOKENS}) AS term, generate_subscripts({TOKENS}, 1) AS pos FROM benchmark),
firsts AS (SELECT query_id, term, min(pos) AS pos FROM words WHERE length(term) >= 2 AND term NOT IN ({quoted(DEFAULT)}) GROUP BY 1, 2),
asked AS (SELECT query_id, term FROM firsts QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pos) <= 20)"""


def sparse(k: int) -> str:
    return f"""
scored AS (SELECT query_id, p.chunk_id, sum(idf * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * dl / CASE avgdl WHEN 0 THEN 1 ELSE avgdl END))) AS score
  FROM asked JOIN postings p USING (term) JOIN stats USING (term) JOIN lengths l ON l.chunk_id = p.chunk_id, corpus GROUP BY 1, 2),
sparse AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM scored QUALIFY rank <= {k})"""


def dense_sql(k: int, queries: str, where: str = "TRUE") -> str:
    return f"""
near AS (SELECT q.query_id, v.vec_id AS chunk_id, greatest(0, 0.5 + 0.5 * list_dot_product(q.v, v.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])))) AS score
  FROM ({queries}) q, embeddings v WHERE {where}),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM near QUALIFY rank <= {k})"""


BENCH_VECTORS = "SELECT item_id AS query_id, embedding::DOUBLE[] AS v FROM benchmark JOIN embeddings ON item_id = vec_id"
LABELLED = "SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE label = 0"


def _r(df, *columns, digits: int = 6):
    """Scores rounded, ranks as bigint: sums in another order differ in their last bits."""
    return df.withColumns({c: F.round(c, digits) for c in columns if c in df.columns})


def _ranked(df):
    return _r(df.withColumn("rank", F.col("rank").cast("long")), "score")


def q_postings(spark, d):
    return t.index(spark, d).postings


def q_doc_lengths(spark, d):
    return t.index(spark, d).lengths


def q_corpus_stats(spark, d):
    return _r(t.index(spark, d).corpus_stats(), "avgdl")


def q_term_stats(spark, d):
    return _r(t.index(spark, d).term_stats(), "idf")


def q_stemmed_terms(spark, d):
    return term_counts(t.chunks(spark, d))


def q_top_terms(spark, d):
    return top_terms(t.index(spark, d)).withColumn("rank", F.col("rank").cast("long"))


def q_bm25_batch(spark, d):
    return _ranked(bm25(t.index(spark, d), t.asked_terms(spark, d), k=10))


def q_prefix_delete(spark, d):
    from lodestone.functions.numeric import hash8

    rows = t.chunks(spark, d).withColumn("chunk_id", F.concat_ws("_", hash8(F.col("source_path")), F.col("chunk_id").cast("string")))
    gone = spark.range(1).select(hash8(F.lit("src0")))
    return _r(remove_prefixes(build(rows, stem=False), gone).term_stats(), "idf")


def q_dense_batch(spark, d):
    queries = t.vectors(spark, d).filter("label = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    return _ranked(dense.topk(t.vectors(spark, d), queries, k=10))


def q_dense_filtered(spark, d):
    queries = t.asked_vectors(spark, d).select("query_id", "vector")
    return _ranked(dense.topk(t.vectors(spark, d), queries, k=10, where=dense.conjunction({"label": 3, "tags": "not pushed"})))


def q_near_dup_vectors(spark, d):
    return dense.similar_pairs(t.vectors(spark, d).withColumnRenamed("chunk_id", "id"), threshold=0.6)


def _lists(spark, d):
    queries = t.asked_vectors(spark, d)
    near = dense.topk(t.vectors(spark, d), queries.select("query_id", "vector"), k=20)
    return near, bm25(t.index(spark, d), t.asked_terms(spark, d), k=20)


def q_rrf(spark, d):
    return _r(fusion.rrf(fusion.together(*_lists(spark, d)), top_k=10).withColumn("rank", F.col("rank").cast("long")), "score", digits=9)


def q_rrf_weighted(spark, d):
    return _r(fusion.rrf(fusion.together(*_lists(spark, d)), weights=[0.3, 0.7], top_k=10).withColumn("rank", F.col("rank").cast("long")), "score", digits=9)


def q_interleave(spark, d):
    return _ranked(fusion.interleave(fusion.together(*_lists(spark, d)), top_k=10))


def q_dense_sparse_intersection(spark, d):
    return fusion.in_both(*_lists(spark, d))


def q_hybrid(spark, d):
    found = hybrid.search(t.asked_vectors(spark, d), t.chunks(spark, d), t.index(spark, d), t.vectors(spark, d), top_k=10)
    return _r(found.select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"), "source_path"), "score", digits=9)


def q_citations(spark, d):
    found = hybrid.search(t.asked(spark, d), t.chunks(spark, d), t.index(spark, d), None, top_k=5)
    return hybrid.citations(found).withColumn("index", F.col("index").cast("long"))


def q_rerank_by_length(spark, d):
    """A scorer in SQL's reach: the shorter the text, the better."""
    found = hybrid.search(t.asked(spark, d), t.chunks(spark, d), t.index(spark, d), None, top_k=10)
    scorer = lambda rows: rows.withColumn("rerank_score", (-F.length("text")).cast("double"))
    return hybrid.rerank(found, scorer, top_k=5).select("query_id", "chunk_id", "rerank_score", F.col("rank").cast("long").alias("rank"))


_BOTH = f"WITH {POSTINGS}, {ASKED}, {sparse(20)}, {dense_sql(20, BENCH_VECTORS)}, lists AS (SELECT query_id, chunk_id, rank, score, 0 AS list_idx FROM dense UNION ALL SELECT query_id, chunk_id, rank, score, 1 FROM sparse)"


def _fused(weight: str) -> str:
    return f"""{_BOTH}, f AS (SELECT query_id, chunk_id, sum({weight} * 1.0 / (60 + rank)) AS score FROM lists GROUP BY 1, 2)
SELECT query_id, chunk_id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, chunk_id) AS rank FROM f QUALIFY rank <= 10"""


ORACLE_SQL = {
    "q_postings": f"WITH {POSTINGS} SELECT * FROM postings",
    "q_doc_lengths": f"WITH {POSTINGS} SELECT * FROM lengths",
    "q_corpus_stats": f"WITH {POSTINGS} SELECT n, round(avgdl, 6) AS avgdl, total_terms FROM corpus",
    "q_term_stats": f"WITH {POSTINGS} SELECT term, df, round(idf, 6) AS idf FROM stats",
    "q_top_terms": f"WITH {POSTINGS} SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY tf DESC, term) AS rank FROM postings QUALIFY rank <= 10",
    "q_bm25_batch": f"WITH {POSTINGS}, {ASKED}, {sparse(10)} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM sparse",
    "q_prefix_delete": f"WITH {POSTINGS.replace('FROM documents', 'FROM kept')} SELECT term, df, round(idf, 6) AS idf FROM stats".replace("WITH ", "WITH kept AS (SELECT * FROM documents WHERE source <> 'src0'),", 1),
    "q_dense_batch": f"WITH {dense_sql(10, LABELLED)} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM dense",
    "q_dense_filtered": f"WITH {dense_sql(10, BENCH_VECTORS, 'v.label = 3')} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM dense",
    "q_near_dup_vectors": """WITH p AS (SELECT a.vec_id AS "left", b.vec_id AS "right", list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))) AS s FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)
SELECT "left", "right", round(s, 4) AS similarity FROM p WHERE s >= 0.6""",
    "q_rrf": _fused("1"),
    "q_rrf_weighted": _fused("CASE list_idx WHEN 0 THEN 0.3 ELSE 0.7 END"),
    "q_interleave": f"""{_BOTH}, one AS (SELECT * FROM lists QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY rank, list_idx) = 1)
SELECT query_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY rank, list_idx) AS rank FROM one QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY one.rank, list_idx) <= 10""",
    "q_dense_sparse_intersection": f"{_BOTH} SELECT query_id, chunk_id FROM dense INTERSECT SELECT query_id, chunk_id FROM sparse",
    "q_hybrid": f"""{_BOTH}, f AS (SELECT query_id, chunk_id, sum(1.0 / (60 + rank)) AS score, count(DISTINCT list_idx) AS lists FROM lists GROUP BY 1, 2),
j AS (SELECT f.*, source AS source_path FROM f JOIN documents ON doc_id = chunk_id)
SELECT query_id, chunk_id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, chunk_id) AS rank, source_path FROM j QUALIFY rank <= 10""",
    "q_citations": f"""WITH {POSTINGS}, {ASKED}, {sparse(20)}, s AS (SELECT sparse.*, source, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat FROM sparse JOIN documents ON doc_id = chunk_id WHERE rank <= 5)
SELECT query_id, rank AS index, chunk_id, source, round(score, 4) AS score,
  CASE WHEN length(flat) <= 200 THEN flat ELSE regexp_replace(left(flat, 200), ' [^ ]*$', '') || '...' END AS text_snippet FROM s""",
    "q_rerank_by_length": f"""WITH {POSTINGS}, {ASKED}, {sparse(20)}, s AS (SELECT sparse.query_id, chunk_id, rank AS old, -length(text)::DOUBLE AS rerank_score FROM sparse JOIN documents ON doc_id = chunk_id WHERE rank <= 10)
SELECT query_id, chunk_id, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, old) AS rank FROM s QUALIFY rank <= 5""",
}

QUERIES = {name: value for name, value in globals().items() if name.startswith("q_") and callable(value)}
