"""Trace analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recent(traces: DataFrame, *, trace_type: str | None = None, keyword: str | None = None, n: int = 100) -> DataFrame:
    """Newest traces first; times are ISO strings, so their order is that of strings."""
    rows = traces if trace_type is None else traces.filter(F.col("trace_type") == trace_type)
    if keyword:
        told = F.lower(F.concat(F.to_json(F.struct("stages")), F.coalesce("metadata", F.lit(""))))
        rows = rows.filter(F.contains(told, F.lit(keyword.lower())))
    return rows.orderBy(F.desc("started_at"), "trace_id").limit(n)


def stage_timings(traces: DataFrame) -> DataFrame:
    """trace_id, stage and elapsed_ms: of a stage named twice the last, a missing time as 0."""
    rows = traces.select("trace_id", F.posexplode("stages").alias("pos", "s"))
    return rows.groupBy("trace_id", F.col("s.stage").alias("stage")).agg(F.max_by(F.coalesce("s.elapsed_ms", F.lit(0.0)), "pos").alias("elapsed_ms"))


def diagnosis(traces: DataFrame, expected: list[str]) -> DataFrame:
    """trace_id, missing stages, whether any stage tells an error, and whether it ended with no result."""
    names = F.transform("stages", lambda s: s["stage"])
    data = lambda s: F.lower(F.coalesce(s["data"], F.lit("")))
    return traces.select(
        "trace_id", F.array_except(F.array(*[F.lit(x) for x in expected]), names).alias("missing"),
        F.exists("stages", lambda s: F.contains(data(s), F.lit('"error"'))).alias("has_error"),
        F.exists("stages", lambda s: data(s).rlike(r'"(?:result_count|count)"\s*:\s*0\b')).alias("no_result"),
    )


def elapsed(started: Column, finished: Column) -> Column:
    """Milliseconds between two ISO times, to two places."""
    micros = lambda t: F.unix_micros(F.to_timestamp(t))
    return F.round((micros(finished) - micros(started)) / 1000.0, 2)
