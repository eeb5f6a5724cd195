"""The library's three tools, and evaluation of a set of questions, over its stores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import catalog, evaluation, hybrid, store
from lodestone.operators.response import content_blocks
from lodestone.plans.ingestion import Stores
from lodestone.sources.embeddings import Embed

#: More results than this are never given at once.
MOST_RESULTS = 20


class Library:
    """Search, listing and summaries of what has been ingested below ``root``."""

    def __init__(self, stores: Stores, encode: Embed | None = None, scorer: hybrid.Scorer | None = None, pool_multiplier: int = 2) -> None:
        self.stores, self.encode, self.scorer, self.pool_multiplier = stores, encode, scorer, pool_multiplier

    def search(self, questions: list[str], *, collection: str = "default", top_k: int | None = None) -> DataFrame:
        """Results of all questions in one plan; a deeper pool is fetched if a scorer will reorder it."""
        k = min(top_k or 5, MOST_RESULTS)
        pool = k * self.pool_multiplier if self.scorer else k
        rows = [(str(i), q, self.encode([q])[0] if self.encode else None) for i, q in enumerate(questions)]
        queries = self.stores.spark.createDataFrame(rows, "query_id string, query string, vector array<float>")
        chunks = self.stores.chunks.read().filter(F.col("collection") == collection)
        found = hybrid.search(queries, chunks, self.stores.index_of(collection), chunks if self.encode else None, top_k=pool, dense_k=max(20, pool), sparse_k=max(20, pool))
        if self.scorer:
            found = found.join(queries.select("query_id", F.col("query").alias("original_query")), "query_id")
        return hybrid.rerank(found, self.scorer, top_k=k)

    def query_knowledge_hub(self, query: str, top_k: int | None = None, collection: str | None = None) -> list[dict]:
        if not query.strip():
            raise ValueError("query must not be blank")
        rows = hybrid.citations(self.search([query], collection=collection or "default", top_k=top_k)).orderBy("index").collect()
        return content_blocks(query, rows, [])

    def list_collections(self, include_stats: bool = True) -> list[dict]:
        found = store.collections(self.stores.chunks.read()).orderBy("collection").collect()
        return [r.asDict() if include_stats else {"collection": r.collection} for r in found]

    def get_document_summary(self, doc_id: str) -> dict:
        found = catalog.document_summary(catalog.chunks_of(self.stores.chunks.read(), doc_id)).collect()
        if not found:
            raise KeyError(f"no document {doc_id!r}")
        return found[0].asDict()

    def delete_document(self, source_path: str) -> dict[str, object]:
        """The document leaves all stores; per store how many rows, or the error."""
        prefix = self.stores.spark.range(1).select(F.substring(F.sha2(F.lit(source_path), 256), 1, 8)).first()[0]
        of_prefix, all_ = F.col("chunk_id").startswith(prefix + "_"), self.stores.all()
        where = {"chunks": of_prefix, "postings": of_prefix, "lengths": of_prefix, "history": F.col("file_path") == source_path, "images": F.col("file_path") == source_path}
        return store.cascade({name: (all_[name], where[name]) for name in all_})

    def evaluate(self, golden: DataFrame, *, collection: str = "default", top_k: int = 5, judges: dict[str, Callable] | None = None) -> DataFrame:
        """query_id, metric and value of all of a golden set's questions (query, expected_chunk_ids, expected_sources)."""
        cases = golden.select("query", F.coalesce("expected_chunk_ids", F.array().cast("array<string>")).alias("ids"), F.coalesce("expected_sources", F.array().cast("array<string>")).alias("sources")).collect()
        results = self.search([c.query for c in cases], collection=collection, top_k=top_k).withColumn("source", F.col("source_path"))
        spark, table = self.stores.spark, [(str(i), c.query, c.ids, c.sources) for i, c in enumerate(cases)]
        truth = spark.createDataFrame(table, "query_id string, query string, ids array<string>, sources array<string>")
        ids = evaluation.id_metrics(results, truth.select("query_id", F.explode("ids").alias("chunk_id")), truth)
        sources = evaluation.source_metrics(results, truth.select("query_id", F.explode("sources").alias("source")), truth, k=top_k)
        wide = ids.join(sources, "query_id")
        values = wide.unpivot(["query_id"], ["hit_rate", "mrr", "source_recall", "source_precision"], "metric", "value")
        return values.unionByName(evaluation.judged(results, judges)) if judges else values


#: Tools by name, with the names of their arguments.
TOOLS = {"query_knowledge_hub": ("query", "top_k", "collection"), "list_collections": ("include_stats",), "get_document_summary": ("doc_id",)}


def call(library: Library, tool: str, arguments: dict) -> dict:
    """A tool's result, or its error by kind: an unknown tool, wrong arguments, or a failure inside."""
    if tool not in TOOLS:
        return {"error": "method not found", "message": tool}
    if set(arguments) - set(TOOLS[tool]):
        return {"error": "invalid params", "message": ", ".join(sorted(set(arguments) - set(TOOLS[tool])))}
    try:
        return {"result": getattr(library, tool)(**arguments)}
    except (TypeError, ValueError, KeyError) as error:
        return {"error": "invalid params", "message": str(error)}
