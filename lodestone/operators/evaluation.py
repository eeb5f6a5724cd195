"""Retrieval metrics, ground truth by containment, and building a test set."""

from __future__ import annotations

import logging
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestone.functions.text import ascii_tokens, basename, normalise

LOG = logging.getLogger(__name__)
#: Characters of the pieces by which a needle of one or two words is found.
GRAM = 3


def id_metrics(results: DataFrame, truth: DataFrame, queries: DataFrame) -> DataFrame:
    """hit_rate and mrr by query: results (query_id, chunk_id, rank), truth (query_id, chunk_id).

    Queries without truth, or without a hit, have 0 for both.
    """
    hits = results.join(truth.distinct(), ["query_id", "chunk_id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("first"))
    rows = queries.select("query_id").join(hits, "query_id", "left")
    mrr = F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0))
    return rows.select("query_id", F.when(F.col("first").isNotNull(), 1.0).otherwise(0.0).alias("hit_rate"), mrr.alias("mrr"))


def source_metrics(results: DataFrame, truth: DataFrame, queries: DataFrame, *, k: int = 5) -> DataFrame:
    """source_recall and source_precision at k, on file names.

    results has query_id, rank and source, truth query_id and source.  Blank sources never match, but
    count among what was returned.
    """
    name = lambda c: basename(F.coalesce(F.col(c), F.lit("")))
    want = truth.select("query_id", name("source").alias("name")).filter("name <> ''").distinct().withColumn("hit", F.lit(1.0))
    got = results.filter(F.col("rank") <= k).select("query_id", name("source").alias("name")).join(want, ["query_id", "name"], "left")
    per = got.groupBy("query_id").agg(F.coalesce(F.max("hit"), F.lit(0.0)).alias("r"), F.avg(F.coalesce("hit", F.lit(0.0))).alias("p"))
    zero = F.lit(0.0)
    return queries.select("query_id").join(per, "query_id", "left").select("query_id", F.coalesce("r", zero).alias("source_recall"), F.coalesce("p", zero).alias("source_precision"))


def metric_means(values: DataFrame) -> DataFrame:
    """Mean of each metric over finite values that aren't null; 0 if there are none."""
    v = F.col("value")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return values.groupBy("metric").agg(F.coalesce(F.avg(F.when(finite, v)), F.lit(0.0)).alias("mean"))


def merged_metrics(values: DataFrame) -> DataFrame:
    """Of several evaluators' values (query_id, metric, value, evaluator_idx) the later one's."""
    return values.groupBy("query_id", "metric").agg(F.max_by("value", "evaluator_idx").alias("value"))


def report(values: DataFrame) -> DataFrame:
    """One row: every metric's mean to four places, as a map."""
    means = metric_means(values).select("metric", F.round("mean", 4).alias("mean"))
    return means.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "mean")))).alias("metrics"))


def judged(cases: DataFrame, judges: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """query_id, metric and value of external judges, each a function of cases to (query_id, value).

    A judge that gives no value for a query, or fails before it returns, leaves the value out; it is never 0.
    """
    out = cases.sparkSession.createDataFrame([], "query_id string, metric string, value double")
    for metric, judge in judges.items():
        try:
            given = judge(cases).select(F.col("query_id").cast("string"), F.lit(metric).alias("metric"), F.col("value").cast("double"))
        except Exception:  # one judge's failure must not keep the others' values
            LOG.exception("the judge of %s failed; its values are left out", metric)
            continue
        out = out.unionByName(given.filter("value is not null"))
    return out


def holding(needles: DataFrame, hays: DataFrame) -> DataFrame:
    """Rows of ``hays`` (with hay) and ``needles`` (with needle) where the one's normalised text holds the other's.

    A needle's first and last word may be parts of the hay's words, but those between are words of it: the
    longest of them is the anchor by which both sides join.  A needle without such a word is anchored by
    its first ``GRAM`` characters, or as many as it has.  Empty and null needles are held by nothing.
    """
    asked = needles.filter("needle <> ''").withColumn("__words", F.split("needle", " "))
    inner = F.slice("__words", 2, F.greatest(F.size("__words") - 2, F.lit(0)))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    asked = asked.withColumn("__anchor", longest).drop("__words")
    words = hays.withColumn("__anchor", F.explode(F.array_distinct(F.split("hay", " "))))
    found = words.join(asked.filter("__anchor is not null"), "__anchor").filter(F.contains("hay", "needle"))
    short = asked.filter("__anchor is null").withColumn("__anchor", F.substring("needle", 1, GRAM))
    if not short.isEmpty():
        places = F.sequence(F.lit(1), F.greatest(F.length("hay"), F.lit(1)))
        grams = [F.transform(places, lambda i, n=n: F.substring(F.col("hay"), i, F.lit(n))) for n in range(1, GRAM + 1)]
        pieces = hays.withColumn("__anchor", F.explode(F.array_distinct(F.concat(*grams))))
        found = found.unionByName(pieces.join(short, "__anchor").filter(F.contains("hay", "needle")))
    return found.drop("__anchor")


def match_contexts(contexts: DataFrame, chunks: DataFrame, *, least: float = 0.5) -> DataFrame:
    """context_id and chunk_id: the tightest chunk that holds the context, else the chunk that covers most of its tokens.

    contexts has context_id and text, chunks chunk_id and text.  Both steps join tokens, not pairs, at any
    number of contexts; ties go to the smaller id.
    """
    c = contexts.select("context_id", normalise(F.col("text")).alias("needle"))
    h = chunks.select("chunk_id", normalise(F.col("text")).alias("hay"))
    inside = holding(c, h).groupBy("context_id").agg(F.min(F.struct(F.length("hay").alias("n"), "chunk_id")).alias("best"))
    inside = inside.select("context_id", F.col("best.chunk_id").alias("chunk_id"))
    words = lambda df, key, text: df.select(key, F.explode(F.array_distinct(ascii_tokens(F.col(text)))).alias("token"))
    left = c.join(inside, "context_id", "left_anti")
    sizes = left.select("context_id", F.size(F.array_distinct(ascii_tokens(F.col("needle")))).alias("n")).filter("n > 0")
    shared = words(h, "chunk_id", "hay").join(words(left, "context_id", "needle"), "token").groupBy("context_id", "chunk_id").agg(F.count(F.lit(1)).alias("both"))
    ratio = shared.join(sizes, "context_id").withColumn("ratio", F.col("both") / F.col("n")).filter(F.col("ratio") >= least)
    best = W.partitionBy("context_id").orderBy(F.desc("ratio"), "chunk_id")
    fallback = ratio.withColumn("__n", F.row_number().over(best)).filter("__n = 1").select("context_id", "chunk_id")
    return contexts.select("context_id").join(inside.unionByName(fallback), "context_id", "left")


def contexts_in_feed(contexts: DataFrame, feed: str) -> DataFrame:
    """context_id and whether the context stands in the feed's text."""
    hay = normalise(F.lit(feed))
    needle = F.coalesce(F.col("text"), F.lit(""))
    return contexts.select("context_id", ((needle != "") & F.contains(hay, normalise(needle))).alias("in_feed"))


def is_dense_reference(reference: Column, most: int = 150) -> Column:
    return F.coalesce(F.size(F.filter(F.split(F.trim(reference), r"\s+"), lambda w: w != "")) > most, F.lit(False))


def low_recall(batches: DataFrame, least: float = 0.4) -> DataFrame:
    return batches.filter(F.col("context_recall") < least)


def rerun_quota(gap: int, arrived: int, retained: int) -> int:
    """How many more to ask for, at the yield so far, and two to spare."""
    if min(gap, arrived, retained) <= 0:
        raise ValueError("gap, arrived and retained must be positive")
    return math.ceil(gap * arrived / retained) + 2


def select_by_quota(pool: DataFrame, n: int, *, kind: str = "kind", order: str = "pool_idx") -> DataFrame:
    """``n`` rows of the pool with its mix of kinds, by largest remainder, in pool order within a kind.

    A quota never exceeds its kind's rows, as n is at most the pool, so nothing needs redistribution.
    Quotas are found on one row per kind.
    """
    counts = pool.groupBy(kind).agg(F.count(F.lit(1)).alias("n_kind"), F.min(order).alias("first"))
    total = F.sum("n_kind").over(W.partitionBy())
    sized = counts.withColumn("exact", F.lit(n) * F.col("n_kind") / total).withColumn("base", F.floor("exact"))
    place = F.row_number().over(W.partitionBy().orderBy(F.desc(F.round(F.col("exact") - F.col("base"), 9)), "first"))
    extra = F.when((place <= n - F.sum("base").over(W.partitionBy())) & (F.col("base") < F.col("n_kind")), 1).otherwise(0)
    quotas = sized.select(kind, F.least(F.col("base") + extra, F.col("n_kind")).alias("quota"))
    rank = F.row_number().over(W.partitionBy(kind).orderBy(order))
    return pool.withColumn("__rank", rank).join(quotas, kind).filter(F.col("__rank") <= F.col("quota")).drop("__rank", "quota")


def resolve_verdicts(pool: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rows of the pool after review: passed as they are, repaired by their replacement, others out.

    pool has pool_idx; ledger has pool_idx, verdict and replaced_by_pool_idx.
    """
    verdicts = pool.select("pool_idx").join(ledger, "pool_idx").filter("verdict in ('pass', 'repair')")
    taken = verdicts.select(F.col("pool_idx").alias("asked_idx"), F.when(F.col("verdict") == "repair", F.col("replaced_by_pool_idx")).otherwise(F.col("pool_idx")).alias("pool_idx"))
    return pool.join(taken, "pool_idx")


def rejected(ledger: DataFrame) -> DataFrame:
    return ledger.filter("verdict = 'remove'")


def final_entries(rows: DataFrame) -> DataFrame:
    """Test cases in their fixed order of fields, null where missing; write with ignoreNullFields off."""
    fields = ("user_input", "reference", "reference_contexts", "reference_context_ids", "persona_name", "query_style", "query_length")
    return rows.select(*[F.col(f) if f in rows.columns else F.lit(None).cast("string").alias(f) for f in fields])


def feed_report(sections: DataFrame, excluded: DataFrame) -> DataFrame:
    """One row: kept, figure and excluded sections, and the kept text in order; excluded has doc_id and page."""
    gone = excluded.select("doc_id", "page").distinct().withColumn("gone", F.lit(True))
    kind = F.when(F.col("type") == "figure", "figure").when(F.col("gone"), "excluded").otherwise("kept")
    rows = sections.join(gone, ["doc_id", "page"], "left").withColumn("kind", kind)
    kept = F.when((F.col("kind") == "kept") & (F.trim(F.coalesce("text", F.lit(""))) != ""), F.struct("doc_id", "pos", "text"))
    return rows.groupBy("doc_id").agg(
        F.count_if(F.col("kind") == "kept").alias("kept"), F.count_if(F.col("kind") == "figure").alias("figures"), F.count_if(F.col("kind") == "excluded").alias("excluded"),
        F.array_join(F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["text"]), "\n\n").alias("feed"),
    )


def assembled(contexts: DataFrame, *, first: int | None = None) -> DataFrame:
    """query_id and its texts in rank order, each under its number; ``first`` texts, plain, as the fallback answer."""
    rows = contexts if first is None else contexts.filter(F.col("rank") <= first)
    text = F.col("x.text") if first else None
    ordered = F.array_sort(F.collect_list(F.struct("rank", "text")))
    line = (lambda x: x["text"]) if text is not None else (lambda x: F.concat(F.lit("["), x["rank"].cast("string"), F.lit("]\n"), x["text"]))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(ordered, line), "\n\n").alias("context"))


def type_distribution(pool: DataFrame, kind: str = "kind") -> DataFrame:
    return pool.groupBy(kind).agg(F.count(F.lit(1)).alias("n"))


def personas(pool: DataFrame) -> DataFrame:
    return pool.agg(F.array_sort(F.collect_set("persona_name")).alias("personas"))
