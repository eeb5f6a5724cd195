"""Line dedup by site-relative frequency, in DataFrame functions only.

Pages are grouped by host.  A line (without the blanks U+0020 around it) is boilerplate of its host when more than ``ratio`` of the
host's pages, and at least ``least`` of them, contain it.  Boilerplate lines are dropped; all other lines
stay as they are and in order.

Lines are counted by 128 bits of their MD5, so that the shuffle carries no text; equal lines of a task's
pages are summed before it.  A host can't have more boilerplate lines than its mean number of lines a
page divided by ``ratio``, so the table of them is short; it is written first, and Spark broadcasts it
if its files are below ``spark.sql.autoBroadcastJoinThreshold``, and else joins by host, splitting hosts
that are hot.  A page's own lines meet its host's list in one hashed intersection, and its lines are
then looked up among those few.

Edge cases: a null text stays null and holds no lines; lines end at line feeds alone, so tabs and carriage
returns are part of a line, which differs from one without them and isn't blank; blank lines are never
dropped; a line that a page repeats counts once for that page and is dropped everywhere in it; null hosts
are one host; repeated rows are pages of their own; a page may end up empty; an empty table gives an empty
result; all columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut, spare


#: Fixed value: the MD5 of no bytes, which is the key of a blank line.
BLANK = "d41d8cd98f00b204e9800998ecf8427e"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    """128 bits that stand for the line; null if it is blank."""
    return F.nullif(F.md5(F.encode(F.trim(line), "UTF-8")), F.lit(BLANK))


def boilerplate(pages: DataFrame, *, host: str, text: str, ratio: float, least: int) -> DataFrame:
    """host and lines (the keys of its boilerplate lines) of every host that has any."""
    seen = pages.select(F.col(f"`{host}`").alias("host"), F.col(f"`{text}`").alias("text"))
    totals = seen.groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    counts = seen.select("host", F.explode(F.array_compact(F.array_distinct(F.transform(lines_of(F.col("text")), line_key)))).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("pages"))
    common = counts.filter(F.col("pages") >= least).alias("c").join(totals.alias("t"), F.col("c.host").eqNullSafe(F.col("t.host")))
    common = common.filter(F.col("pages") > ratio * F.col("total")).select("c.host", "line")
    return common.groupBy("host").agg(F.collect_set("line").alias("lines"))


def drop_boilerplate(pages: DataFrame, *, host: str = "source", text: str = "text", ratio: float = 0.1, least: int = 5) -> DataFrame:
    """``pages`` with the text left over, and in ``n_lines`` and ``n_dropped`` what there was and what went.

    The last two take the place of input columns of their names.
    """
    table = cut(boilerplate(pages, host=host, text=text, ratio=ratio, least=least), "line-dedup")
    key, gone, held, found = (spare(pages, f"__{x}") for x in ("host", "lines", "held", "found"))
    table = table.select(F.col("host").alias(key), F.col("lines").alias(gone))
    joined = pages.join(table, F.col(f"`{host}`").eqNullSafe(F.col(key)), "left").drop(key)
    said = F.col(f"`{text}`")
    # each step names what the next one reads more than once
    joined = joined.withColumn(held, F.when(F.col(gone).isNotNull(), F.transform(lines_of(said), lambda x: F.struct(x.alias("line"), line_key(x).alias("key")))))
    joined = joined.withColumn(found, F.array_intersect(F.col(f"{held}.key"), F.col(gone))).drop(gone)
    kept = F.filter(held, lambda x: x["key"].isNull() | ~F.array_contains(found, x["key"]))
    joined = joined.withColumn(held, F.when(F.size(found) > 0, F.transform(kept, lambda x: x["line"])))
    n_lines = F.coalesce(F.size(lines_of(said)), F.lit(0)).cast("long")
    n_dropped = F.coalesce(n_lines - F.size(held), F.lit(0).cast("long"))
    return joined.withColumns({text: F.coalesce(F.array_join(held, "\n"), said), "n_lines": n_lines, "n_dropped": n_dropped}).drop(held, found)
