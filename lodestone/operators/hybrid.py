"""Hybrid search for a batch of queries in one plan, and reranking."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestone.operators import dense as dense_search
from lodestone.operators.filters import drop_references, matches, process_queries
from lodestone.operators.fusion import fuse_or_pass, together
from lodestone.operators.index import Index, bm25, ranked, sent

LOG = logging.getLogger(__name__)


def search(
    queries: DataFrame, chunks: DataFrame, index: Index | None, vectors: DataFrame | None, *, top_k: int = 10, dense_k: int = 20, sparse_k: int = 20,
    rrf_k: int = 60, without_references: bool = True,
) -> DataFrame:
    """query_id, chunk_id, score, score_kind, rank and text.

    ``queries`` has query_id, query, and vector if ``vectors`` is given; ``chunks`` has chunk_id, text,
    source_path, doc_type and tags.  Both paths are ranked on narrow rows; texts join the survivors.
    Bibliography chunks leave before the cut to ``top_k``, filters apply after it.  With one path
    missing the other is used raw; with both missing it is an error.
    """
    if index is None and vectors is None:
        raise RuntimeError("neither a dense nor a sparse path is available")
    asked = process_queries(queries)
    lists = []
    if vectors is not None:
        lists.append(dense_search.topk(vectors, queries.select("query_id", "vector"), k=dense_k))
    if index is not None:
        lists.append(bm25(index, asked.select("query_id", "terms"), k=sparse_k))
    hits = sent(queries, fuse_or_pass(together(*lists), k=rrf_k), dense_k + sparse_k)
    fused = chunks.select("chunk_id", "text", "source_path", "doc_type", "tags").join(hits, "chunk_id")
    if without_references:
        # a condition on a hit's text, as Spark would look for entries in every chunk, before the join, if it were one on the text alone
        fused = drop_references(fused.withColumn("__hit_text", F.when(F.col("rank") >= 1, F.col("text"))), "__hit_text").drop("__hit_text")
    cut = ranked(fused.drop("rank"), top_k, F.desc(F.round("score", 12)), F.col("chunk_id"))
    wanted = asked.select("query_id", F.col("doc_type").alias("want_type"), F.col("source_path").alias("want_source"), F.col("tags").alias("want_tags"))
    c = F.col
    kept = cut.join(wanted, "query_id").filter(matches(
        doc_type=c("doc_type"), source_path=c("source_path"), tags=c("tags"), want_type=c("want_type"), want_source=c("want_source"), want_tags=c("want_tags")))
    return ranked(kept.drop("rank"), None, F.desc(F.round("score", 12)), F.col("chunk_id")).select("query_id", "chunk_id", "score", "score_kind", "rank", "text", "source_path")


Scorer = Callable[[DataFrame], DataFrame]


def rerank(results: DataFrame, scorer: Scorer | None, *, top_k: int) -> DataFrame:
    """Results ordered by the scorer's rerank_score; its column is null where it gave none.

    ``scorer`` takes results and returns them with rerank_score, which needs no join, or else query_id, chunk_id
    and rerank_score alone.  Without one the order stays.  Queries with one result stay as they are; a scorer that
    fails on planning leaves the order and marks the rows, and so does a null score for the rows of its query.
    """
    plain = results.withColumns({"rerank_score": F.lit(None).cast("double"), "rerank_fallback": F.lit(False)})
    if scorer is None:
        return plain.filter(F.col("rank") <= top_k)
    try:
        scores = scorer(results)
    except Exception:
        LOG.exception("the scorer failed; the order stays")
        return plain.withColumn("rerank_fallback", F.lit(True)).filter(F.col("rank") <= top_k)
    added = set(results.columns) <= set(scores.columns)
    joined = scores.select(*results.columns, "rerank_score") if added else results.join(scores.select("query_id", "chunk_id", "rerank_score"), ["query_id", "chunk_id"])
    failed = F.max(F.col("rerank_score").isNull()).over(W.partitionBy("query_id"))
    joined = joined.withColumn("rerank_fallback", failed).withColumnRenamed("rank", "original_rank")
    joined = joined.withColumn("rerank_score", F.when(~F.col("rerank_fallback"), F.col("rerank_score")))
    return ranked(joined, top_k, F.desc("rerank_score"), F.col("original_rank")).drop("original_rank")


def pair_scorer(score: Callable, query: str = "original_query", text: str = "text", window: int = 1024) -> Scorer:
    """A scorer from a pandas UDF of (query, text); both are cut to the model's window."""
    return lambda results: results.withColumn("rerank_score", score(F.col(query), F.substring(F.col(text), 1, window * 4)))


def guarded_scorer(score: Callable[[list[str], list[str]], list[float]], query: str = "original_query", text: str = "text", window: int = 1024) -> Scorer:
    """A scorer from a function of queries and texts that may fail while it runs: the scores of a batch that fails are null."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for asked, texts in batches:
            try:
                made = [float(x) for x in score(asked.tolist(), texts.tolist())]
                if len(made) != len(asked):
                    raise ValueError(f"{len(made)} scores for {len(asked)} texts")
            except Exception:
                LOG.exception("the scorer failed on a batch")
                made = [None] * len(asked)
            yield pd.Series(made, dtype="Float64")

    return pair_scorer(run, query, text, window)


def model_scores(replies: DataFrame) -> Scorer:
    """A scorer from a model's replies (query_id, reply): unknown ids and unscored results drop out."""
    from lodestone.functions.text import parse_scores

    listed = replies.select("query_id", F.explode(parse_scores(F.col("reply"))).alias("s")).select("query_id", F.col("s.passage_id").alias("chunk_id"), F.col("s.score").alias("rerank_score"))
    return lambda results: results.select("query_id", "chunk_id").join(listed, ["query_id", "chunk_id"])


def citations(results: DataFrame, *, n: int = 200) -> DataFrame:
    """Numbered citations with a snippet and the score to four places."""
    from lodestone.functions.text import snippet

    return results.select("query_id", F.col("rank").alias("index"), "chunk_id", F.col("source_path").alias("source"), F.round("score", 4).alias("score"), snippet(F.col("text"), n).alias("text_snippet"))


def compare(queries: DataFrame, chunks: DataFrame, index: Index, vectors: DataFrame, *, k: int = 10, rrf_k: int = 60) -> DataFrame:
    """Both paths and their fusion side by side: query_id, path ('dense', 'sparse' or 'fused'), chunk_id, score, rank."""
    asked = process_queries(queries)
    paths = {"dense": dense_search.topk(vectors, queries.select("query_id", "vector"), k=k), "sparse": bm25(index, asked.select("query_id", "terms"), k=k)}
    fused = fuse_or_pass(together(*paths.values()), k=rrf_k).filter(F.col("rank") <= k)
    out = fused.select("query_id", F.lit("fused").alias("path"), "chunk_id", "score", "rank")
    for name, rows in paths.items():
        out = out.unionByName(rows.select("query_id", F.lit(name).alias("path"), "chunk_id", "score", "rank"))
    return out
