"""Query syntax, and predicates before and after fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import FILTER, blank, is_reference_section, keywords, strip

#: Filter keys as they may be written.
KEYS = {"collection": "collection", "col": "collection", "type": "doc_type", "doc_type": "doc_type", "source": "source_path", "src": "source_path", "tag": "tags", "tags": "tags"}


def parse(query: Column) -> Column:
    """Struct of text, collection, doc_type, source_path (last one given) and tags (all given).

    Only the known keys are filters and leave the text; any other word:value stays.
    """
    names = F.create_map(*[F.lit(x) for pair in KEYS.items() for x in pair])
    piece = F.transform(F.split(blank(query), " "), lambda p: F.struct(
        p.alias("word"), F.try_element_at(names, F.lower(F.regexp_extract(p, FILTER, 1))).alias("key"),
        F.regexp_extract(p, FILTER, 2).alias("value"), F.regexp_extract(p, rf"^(.*?){FILTER}$", 1).alias("rest"),
    ))
    left = F.transform(piece, lambda p: F.when(p["key"].isNull(), p["word"]).otherwise(p["rest"]))
    values = lambda key: F.transform(F.filter(piece, lambda p: p["key"].eqNullSafe(F.lit(key))), lambda p: p["value"])
    last = lambda key: F.try_element_at(values(key), F.lit(-1))
    return F.struct(
        blank(F.array_join(left, " ")).alias("text"), last("collection").alias("collection"), last("doc_type").alias("doc_type"),
        last("source_path").alias("source_path"), F.flatten(F.transform(values("tags"), lambda v: F.split(v, ","))).alias("tags"),
    )


def process_queries(queries: DataFrame, *, query: str = "query") -> DataFrame:
    """query_id, original_query, terms and the parsed filters; dense search is asked the original text."""
    parsed = queries.select("query_id", F.col(query).alias("original_query"), parse(F.col(query)).alias("p"))
    return parsed.select("query_id", "original_query", F.col("p.text").alias("text"), keywords(F.col("p.text")).alias("terms"), "p.collection", "p.doc_type", "p.source_path", "p.tags")


def merged(parsed: Column, explicit: Column) -> Column:
    """Filters of the query under explicit ones (maps)."""
    return F.map_from_entries(F.concat(F.map_entries(F.map_filter(parsed, lambda k, _: ~F.map_contains_key(explicit, k))), F.map_entries(explicit)))


def matches(*, doc_type: Column, source_path: Column, tags: Column, want_type: Column, want_source: Column, want_tags: Column) -> Column:
    """The predicate after fusion: equality of type, part of the path, any of the tags; null wants nothing.

    ``tags`` is a comma list; a collection is a partition of the table and always true here.
    """
    listed = F.transform(F.split(F.coalesce(tags, F.lit("")), ","), strip)
    return (
        (want_type.isNull() | F.coalesce(doc_type == want_type, F.lit(False)))
        & (want_source.isNull() | F.coalesce(F.contains(source_path, want_source), F.lit(False)))
        & (want_tags.isNull() | (F.size(want_tags) == 0) | F.arrays_overlap(listed, want_tags))
    )


def drop_references(rows: DataFrame, text: str = "text") -> DataFrame:
    """Without bibliography chunks; before a limit, so that deeper ranks move up."""
    return rows.filter(~is_reference_section(F.col(text)))


def is_table_only(contains_table: Column, contains_text: Column, section_type: Column) -> Column:
    flagged = F.coalesce(contains_table, F.lit(False)) & ~F.coalesce(contains_text, F.lit(False))
    return F.when(contains_table.isNotNull(), flagged).otherwise(F.coalesce(section_type == "table", F.lit(False)))


def require_text(df: DataFrame, column: str) -> DataFrame:
    """Fails the job on a blank value, as an empty query or text is a caller's error."""
    told = F.concat(F.lit(f"{column} must not be blank"))
    return df.withColumn(column, F.when(F.length(F.trim(F.coalesce(F.col(column), F.lit("")))) > 0, F.col(column)).otherwise(F.raise_error(told).cast("string")))
