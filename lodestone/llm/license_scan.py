"""Licence scan by diagonal voting.

Every rolling k-gram of a document's words joins, by hash and then by its words, the positions of the
same k-gram in the templates.  A hit at word p of the document and word t of a template votes for the
diagonal p - t.  Votes are counted per document, template and diagonal; diagonals at most ``drift``
apart merge (a word left out or put in moves the rest to the next diagonal); a merged group is verified
when it holds enough of the template's k-grams in a span not much longer than the template, or when
neighbours in it, at most ``2 * drift`` apart and so in such a span, do: a notice that is repeated back
to back merges into a long group, and counts as one place does.  The words that tell a notice from others, as
its version, must stand in it unbroken.  As k-grams are compared word by word, a
diagonal that has all of a phrase's k-grams is a place of that phrase.

Edge cases: a null or empty text has no words, no places, empty labels and score 0; texts shorter than
k words cannot hit; texts of any length are scanned whole; rows that repeat an id are scanned each; ids
may be null; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestone.llm.common import pick
from lodestone.llm.license_templates import Template, must_hold

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed value: runs of 0-9, a-z and all characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def rolling(tokens: Column, k: int) -> Column:
    """Array of (pos, gram) for every k words in a row."""
    at = F.sequence(F.lit(0), F.size(tokens) - k)
    grams = F.transform(at, lambda i: F.struct(i.cast("long").alias("pos"), F.concat_ws(" ", *[F.get(tokens, i + j) for j in range(k)]).alias("gram")))
    return F.when(F.size(tokens) >= k, grams).otherwise(F.array().cast("array<struct<pos:bigint,gram:string>>"))


def template_grams(df: DataFrame, templates: list[Template], k: int) -> DataFrame:
    """A row per template position; the list is part of the program, so its size is bounded."""
    rows = []
    for number, t in enumerate(templates):
        w = t.text.split()
        must = must_hold(t, k)
        rows += [(number, t.label, t.base, len(w), len(must), i, i in must, " ".join(w[i : i + k])) for i in range(len(w) - k + 1)]
    schema = "template int, label string, base boolean, n_template long, n_must long, at long, must boolean, gram string"
    return df.sparkSession.createDataFrame(rows, schema).withColumn("hash", F.xxhash64("gram"))


def scan_licenses(
    docs: DataFrame, templates: list[Template], *, doc_id: str = "doc_id", text: str = "text", k: int = 3, drift: int = 3, least: float = 0.8,
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document.

    ``score`` is the best share of a template's k-grams that one group of diagonals holds.  Every
    document sends one row without a k-gram along, so that those without hits need no second scan.
    """
    tokens = pick(docs, doc_id=doc_id, text=text).select(F.monotonically_increasing_id().alias("row"), "doc_id", words(F.col("text")).alias("words"))
    none = F.array(F.struct(F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("string").alias("gram")))
    grams = (
        tokens.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), F.explode(F.concat(none, rolling(F.col("words"), k))).alias("g"))
        .select("row", "doc_id", "n_words", "g.pos", "g.gram").withColumn("hash", F.xxhash64("gram"))
    )
    found = template_grams(docs, templates, k)
    hits = grams.alias("g").join(F.broadcast(found.alias("t")), (F.col("g.hash") == F.col("t.hash")) & (F.col("g.gram") == F.col("t.gram")), "left")
    hits = hits.filter("template is not null or pos < 0").select("row", "doc_id", "n_words", "pos", "template", "label", "base", "n_template", "n_must", "at", "must", (F.col("pos") - F.col("at")).alias("diagonal"))
    key = ["row", "doc_id", "n_words", "template", "label", "base", "n_template", "n_must"]
    diagonals = hits.groupBy(*key, "diagonal").agg(F.collect_set("at").alias("at"), F.collect_set(F.when(F.col("must"), F.col("at"))).alias("must"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    along = W.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(along) > drift).cast("int"), F.lit(1))
    grouped = diagonals.withColumn("group", F.sum(F.when(F.col("base"), 1).otherwise(apart)).over(along.rowsBetween(W.unboundedPreceding, 0)))
    near = F.filter(F.collect_list(F.struct("group", "at")).over(along.rangeBetween(0, drift * 2)), lambda x: x["group"] == F.col("group"))
    grouped = grouped.withColumn("near", F.size(F.array_distinct(F.flatten(F.transform(near, lambda x: x["at"])))))
    spans = grouped.groupBy(*key, "group").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("votes"), F.max("near").alias("near"),
        F.size(F.array_distinct(F.flatten(F.collect_list("must")))).alias("must"), (F.max("last") + k - F.min("first")).alias("n_span"), F.min("diagonal").alias("diagonal"),
    )
    votes = F.when(F.col("n_span") <= F.col("n_template") + drift * 2, F.col("votes")).otherwise(F.col("near"))
    share = votes / (F.col("n_template") - k + 1)
    spans = spans.withColumn("share", F.coalesce(share, F.lit(0.0)))
    place = F.when(F.col("base") & (F.col("share") == 1), F.col("diagonal"))
    base = F.when(F.col("base") & (F.col("share") == 1), F.col("label"))
    label = F.when(F.col("base"), base).otherwise(F.when((F.col("share") >= least) & (F.col("must") == F.col("n_must")), F.col("label")))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return spans.groupBy("row", "doc_id", "n_words").agg(
        F.count(place).alias("n_base"), F.min(place).alias("first_word"), F.max(place).alias("last_word"),
        joined(base).alias("base_labels"), joined(label).alias("labels"), F.max("share").alias("score"),
    ).drop("row")
