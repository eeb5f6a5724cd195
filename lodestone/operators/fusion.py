"""Fusing ranked lists.  A list has query_id, chunk_id, rank, score, and list_idx for its place among the lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestone.functions.numeric import rrf_score
from lodestone.operators.index import ranked


def together(*lists: DataFrame) -> DataFrame:
    """All lists as one table, numbered in order."""
    rows = [x.select("query_id", "chunk_id", "rank", "score", F.lit(i).alias("list_idx")) for i, x in enumerate(lists)]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def rrf(lists: DataFrame, *, k: int = 60, weights: list[float] | None = None, top_k: int | None = None) -> DataFrame:
    """Reciprocal rank fusion; ``weights`` one for each list, none negative."""
    part = rrf_score(F.col("rank"), k)
    if weights is not None:
        if any(w < 0 for w in weights):
            raise ValueError("weights must not be negative")
        part = part * F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col("list_idx"))
    scored = lists.groupBy("query_id", "chunk_id").agg(F.sum(part).alias("score"))
    return ranked(scored, top_k if top_k and top_k > 0 else None, F.desc(F.round("score", 12)), F.col("chunk_id"))


def fuse_or_pass(lists: DataFrame, *, k: int = 60) -> DataFrame:
    """RRF for queries with more than one list; a query with one keeps that list's own scores.  The lists are read once."""
    alone = F.col("n_lists") == 1
    counted = lists.withColumn("n_lists", F.size(F.collect_set("list_idx").over(W.partitionBy("query_id"))))
    rows = counted.groupBy("query_id", "chunk_id", "n_lists", F.when(alone, F.col("rank")).alias("own")).agg(F.sum(rrf_score(F.col("rank"), k)).alias("fused"), F.max("score").alias("raw"))
    scored = rows.withColumn("score", F.when(alone, F.col("raw")).otherwise(F.col("fused")))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), F.col("chunk_id")))
    kind = F.when(alone, "raw").otherwise("rrf").alias("score_kind")
    return scored.select("query_id", "chunk_id", "score", F.when(alone, F.col("own")).otherwise(place).alias("rank"), kind)


def interleave(lists: DataFrame, *, top_k: int) -> DataFrame:
    """Round robin by rank, earlier lists first; a chunk counts where it comes first."""
    first = F.row_number().over(W.partitionBy("query_id", "chunk_id").orderBy("rank", "list_idx"))
    rows = lists.withColumn("__n", first).filter("__n = 1").select("query_id", "chunk_id", "score", F.col("rank").alias("list_rank"), "list_idx")
    return ranked(rows, top_k, F.col("list_rank"), F.col("list_idx")).drop("list_rank", "list_idx")


def in_both(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("query_id", "chunk_id").intersect(b.select("query_id", "chunk_id"))
