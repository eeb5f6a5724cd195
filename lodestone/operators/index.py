"""The inverted index: build, add, remove, and BM25 for a batch of queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestone.functions.numeric import bm25_part, idf
from lodestone.functions.stem import stem as stem_word
from lodestone.functions.stem import stem_terms, stem_udf
from lodestone.functions.stopwords import ENGLISH
from lodestone.functions.text import terms as terms_of
from lodestone.functions.text import tokens

#: Shorter terms are not indexed.
LEAST = 2
#: Asked terms, or hits, up to which they go to every task; beyond them they are shuffled.
MOST_SENT = 200_000
#: Stands for a whole chunk among its terms; shorter than any term.
WHOLE = ""


@dataclass(frozen=True)
class Index:
    """postings (chunk_id, term, tf) and lengths (chunk_id, dl, unique_terms); statistics follow from them.

    Chunks without terms have a length of 0 and count in N and in the mean length, on every path.
    ``rows``, if given, is what both are made of: chunk_id, of which none is null or repeated, and all of its terms.
    What needs a few terms, or counts, is made of it within each row, so that no table of postings is moved or kept.
    """

    postings: DataFrame
    lengths: DataFrame
    rows: DataFrame | None = None

    def kept(self) -> Index:
        """The same index with both tables kept in memory, or on disk where it is short, for several queries."""
        return Index(self.postings.persist(), self.lengths.persist())

    def of_terms(self, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Postings of a table's terms, with dl and each chunk's in one partition, and the row of n and avgdl.

        With ``rows`` both read one shuffled table, in which each chunk has a row of its own beside its wanted terms: what
        reads it has no filter and drops no column, as Spark would push those under the shuffle and make it twice.
        """
        if self.rows is None:
            found = self.postings.join(wanted, "term").repartition("chunk_id")
            return found.join(self.lengths.select("chunk_id", "dl"), "chunk_id"), self.corpus_stats().select("n", "avgdl")
        every = wanted.unionByName(wanted.sparkSession.range(1).select(F.lit(WHOLE).alias("term")))
        found = self.rows.select("chunk_id", F.size("terms").cast("long").alias("dl"), F.explode(F.array_append("terms", WHOLE)).alias("term"))
        found = found.join(every, "term").repartition("chunk_id").groupBy("chunk_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))
        n = F.count_if(F.col("term") == WHOLE)
        return found, found.agg(n.alias("n"), F.coalesce(F.sum(F.when(F.col("term") == WHOLE, F.col("dl"))) / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("avgdl"))

    def save(self, path: str) -> Index:
        """Both tables written, postings in files by ranges of terms, so that a query reads few of them."""
        self.postings.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
        self.lengths.write.mode("overwrite").parquet(f"{path}/lengths")
        return load(self.postings.sparkSession, path)

    def term_stats(self) -> DataFrame:
        once = self.postings if self.rows is None else self.rows.select(F.explode(F.array_distinct("terms")).alias("term"))
        df = once.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        return df.crossJoin(F.broadcast(self.corpus_stats().select("n"))).select("term", "df", idf(F.col("n"), F.col("df")).alias("idf"))

    def corpus_stats(self) -> DataFrame:
        """One row: n, avgdl and total_terms."""
        return self.lengths.agg(
            F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total_terms"),
        )


def load(spark: SparkSession, path: str) -> Index:
    """A saved index; a folder without one is an error of Spark's reader."""
    return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths"))


def term_rows(chunks: DataFrame, *, chunk_id: str = "chunk_id", text: str = "text", stem: bool = True) -> DataFrame:
    """A row per occurrence of a term.

    Stop-words are left out before stemming, and after it where a stem is that of a stop-word.
    """
    rows = chunks.select(F.col(chunk_id).alias("chunk_id"), F.explode(tokens(F.col(text))).alias("term"))
    rows = rows.filter(~F.col("term").isin(*sorted(ENGLISH)) & (F.length("term") >= LEAST))
    if not stem:
        return rows
    stems = sorted(ENGLISH | {stem_word(w) for w in ENGLISH})
    return stem_terms(rows).filter(~F.col("term").isin(*stems) & (F.length("term") >= LEAST))


def term_counts(chunks: DataFrame, *, text: str = "text") -> DataFrame:
    """term and n, how often each stem of ``term_rows`` occurs: words are counted before they are stemmed, so that no occurrence is moved."""
    words = chunks.select(F.explode(terms_of(F.col(text), least=LEAST)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    stems = sorted(ENGLISH | {stem_word(w) for w in ENGLISH})
    stemmed = words.select(stem_udf("term").alias("term"), "n").filter(~F.col("term").isin(*stems) & (F.length("term") >= LEAST))
    return stemmed.groupBy("term").agg(F.sum("n").alias("n"))


def build(chunks: DataFrame, *, chunk_id: str = "chunk_id", text: str = "text", stem: bool = True, unique: bool = False) -> Index:
    """Index of a table of chunks, one per id; ``unique`` says that no id is null or repeated, and unstemmed terms then stay in their rows."""
    postings = term_rows(chunks, chunk_id=chunk_id, text=text, stem=stem).groupBy("chunk_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    zero = F.lit(0).cast("long")
    if unique and not stem:
        rows = chunks.select(F.col(chunk_id).alias("chunk_id"), terms_of(F.col(text), least=LEAST).alias("terms"))
        size = lambda x: F.size(x).cast("long")
        return Index(postings, rows.select("chunk_id", size("terms").alias("dl"), size(F.array_distinct("terms")).alias("unique_terms")), rows)
    counts = postings.groupBy("chunk_id").agg(F.sum("tf").alias("dl"), F.count(F.lit(1)).alias("unique_terms"))
    lengths = chunks.select(F.col(chunk_id).alias("chunk_id")).distinct().join(counts, "chunk_id", "left")
    return Index(postings, lengths.select("chunk_id", F.coalesce("dl", zero).alias("dl"), F.coalesce("unique_terms", zero).alias("unique_terms")))


def repeats(chunks: DataFrame, chunk_id: str = "chunk_id") -> bool:
    """Whether an id is null or stands in more than one row."""
    counts = chunks.groupBy(F.col(chunk_id).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return not counts.filter("n > 1 or id is null").isEmpty()


def add(index: Index, more: Index, *, replaced_prefixes: DataFrame | None = None) -> Index:
    """Chunks of ``more`` take the place of those with their id, or with a prefix in the one-column table."""
    held = index if replaced_prefixes is None else remove_prefixes(index, replaced_prefixes)
    ids = more.lengths.select("chunk_id")
    merged = lambda old, new: old.join(ids, "chunk_id", "left_anti").unionByName(new)
    return Index(merged(held.postings, more.postings), merged(held.lengths, more.lengths))


def remove_prefixes(index: Index, prefixes: DataFrame) -> Index:
    """Without the chunks of some documents: a chunk id's prefix ends at its first underscore."""
    gone = prefixes.select(F.col(prefixes.columns[0]).alias("__prefix"))
    keep = lambda df: df.join(gone, F.substring_index("chunk_id", "_", 1) == F.col("__prefix"), "left_anti")
    return Index(keep(index.postings), keep(index.lengths))


def ranked(scored: DataFrame, k: int | None, *order: Column) -> DataFrame:
    """rank from 1 within each query; Spark keeps k rows a query before it shuffles."""
    out = scored.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order)))
    return out.filter(F.col("rank") <= k) if k else out


def sent(asked: DataFrame, rows: DataFrame, times: int = 1) -> DataFrame:
    """``rows`` to every task, if ``asked`` has few enough rows that ``times`` as many are at most ``MOST_SENT``."""
    most = MOST_SENT // times
    return F.broadcast(rows) if asked.limit(most + 1).count() <= most else rows


def bm25(index: Index, queries: DataFrame, *, k: int | None = 10, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """query_id, chunk_id, score and rank; ``queries`` has query_id and terms (an array, each once).

    Queries come in a batch.  Postings are cut to the terms that any of them asks before anything else,
    and document frequencies are counted over what is left.  A chunk's postings are in one partition, so
    that only its best scores are moved.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term")).filter(F.col("term") != WHOLE)
    some, corpus = index.of_terms(asked.select("term").distinct())
    df = some.groupBy("term").agg(F.count_if((F.col("tf") > 0) & (F.col("dl") >= 0)).alias("df")).crossJoin(F.broadcast(corpus))
    weights = sent(asked, df.select("term", "avgdl", idf(F.col("n"), F.col("df")).alias("idf")).join(asked, "term"))
    hits = some.join(weights, "term")
    part = bm25_part(F.col("idf"), F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b)
    scored = hits.groupBy("query_id", "chunk_id").agg(F.sum(part).alias("score"))
    return ranked(scored, k, F.desc(F.round("score", 9)), F.col("chunk_id"))


def top_terms(index: Index, n: int = 10) -> DataFrame:
    """The most frequent terms of each chunk."""
    order = W.partitionBy("chunk_id").orderBy(F.desc("tf"), "term")
    return index.postings.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def attach(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with their chunk's columns; hits whose chunk is gone are left out."""
    return hits.join(chunks, "chunk_id")
