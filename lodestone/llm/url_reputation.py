"""URL filter: empirical-Bayes host reputation under explicit allow and block rules.

Labelled page outcomes are counted per host.  Counts shrink through three beta-binomial priors: a
suffix's prior is the corpus rate, a registered domain's is its suffix, a host's is its domain.  How
strongly a level shrinks is estimated from the spread of its groups (method of moments).  A host's bad
rate then has a beta posterior; the host is blocked when its lower quantile reaches ``max_bad``.

Domains are read from the host without user names, ports and final dots; an address is a domain of its own
under the empty suffix.

Edge cases: a null url, or one without ``://``, has an empty host and path and is judged like any other
host; a null or unmatched page id is an unlabelled page; labels that repeat an id count once, as bad if
any of them is; a null label value is no label; of fitting rules of equal length the one listed last wins; repeated pages are judged, and counted,
once per row; empty tables give empty results; further columns of either table are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import map_arrow

#: Labels under which domains are registered where the last label is a country's, as in co.uk.
SECOND_LEVELS = ("ac", "co", "com", "edu", "go", "gob", "gouv", "gov", "mil", "ne", "net", "nom", "or", "org", "sch")
TWO_PART = rf"(^|\.)({'|'.join(SECOND_LEVELS)})\.[a-z]{{2}}$"
ADDRESS = r"^([0-9]{1,3}\.){3}[0-9]{1,3}$|^\["
#: Spread estimates are held in this range: prior weights from 1 to 999 pages.
LEAST_RHO, MOST_RHO = 0.001, 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host, its subdomains and every path that starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end; A-Z in lower case; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def named(host: Column) -> Column:
    """The host without a user's name, a port and final dots."""
    return F.regexp_replace(F.regexp_replace(host, r"^(?s).*@", ""), r":[0-9]*$|\.+$|\.+:[0-9]*$", "")


def suffix_of(host: Column) -> Column:
    name = named(host)
    two = F.when(name.rlike(TWO_PART), F.substring_index(name, ".", -2)).otherwise(F.substring_index(name, ".", -1))
    return F.when(name.rlike(ADDRESS), "").otherwise(two)


def domain_of(host: Column) -> Column:
    name = named(host)
    two = F.when(name.rlike(TWO_PART), F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))
    return F.when(name.rlike(ADDRESS), name).otherwise(two)


def beta_below(x: np.ndarray, a: np.ndarray, b: np.ndarray, log_beta: np.ndarray) -> np.ndarray:
    """The share of a beta distribution below x, by the continued fraction of the incomplete beta function."""
    swap = x > (a + 1) / (a + b + 2)
    x, a, b = np.where(swap, 1 - x, x), np.where(swap, b, a), np.where(swap, a, b)
    c, d = np.ones_like(x), 1 / (1 - (a + b) * x / (a + 1))
    total, m = d.copy(), 0
    while True:
        m += 1
        for up in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + up * d), 1 + up / c
            total *= d * c
        if np.abs(d * c - 1).max(initial=0) < 1e-13:
            break
    with np.errstate(divide="ignore", invalid="ignore"):
        part = np.where(x > 0, np.exp(a * np.log(x) + b * np.log1p(-x) - log_beta) * total / a, 0.0)
    return np.where(swap, 1 - part, part)


def beta_quantile(share: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where ``share`` of each beta distribution lies below, by Newton's steps held in a shrinking interval."""
    log_beta = np.array([lgamma(u) + lgamma(v) - lgamma(u + v) for u, v in zip(a, b)])
    low, high, x = np.zeros_like(a), np.ones_like(a), a / (a + b)
    for _ in range(100):
        off = beta_below(x, a, b, log_beta) - share
        low, high = np.where(off < 0, x, low), np.where(off < 0, high, x)
        with np.errstate(all="ignore"):
            to = x - off / np.exp((a - 1) * np.log(x) + (b - 1) * np.log1p(-x) - log_beta)
        to = np.where((to > low) & (to < high), to, np.where(low > 0, (low + high) / 2, high * 1e-3))
        if (np.abs(to - x) <= 1e-12 * x).all():
            return to
        x = to
    return x


def _spread(groups: DataFrame, name: str) -> DataFrame:
    """One row: the prior weight of a level whose groups have n, bad and their parent's rate."""
    var = F.col("rate") * (1 - F.col("rate"))
    seen = groups.filter("n > 0")
    raw = F.try_divide(
        F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("rate"), F.lit(2))) - F.sum(var),
        F.sum(var * (F.col("n") - 1)),
    )
    rho = F.least(F.lit(MOST_RHO), F.greatest(F.lit(LEAST_RHO), F.coalesce(raw, F.lit(MOST_RHO))))
    return seen.agg((1 / rho - 1).alias(name))


def host_reputation(pages: DataFrame, outcomes: DataFrame, *, tail: float = 0.05) -> DataFrame:
    """host, domain, suffix, n, bad and the bounds of the bad rate that leave ``tail`` of the posterior on each side.

    ``pages`` has page_id and host, ``outcomes`` has page_id and bad (0 or 1).  Levels above the host
    are aggregated from host rows, so that no step sees a page twice; the only rows that are broadcast
    are the one-row priors of each level.  Quantiles are found a batch of hosts at a time.
    """
    labels = outcomes.filter("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    hosts = (
        pages.select("page_id", "host").join(labels, "page_id", "left")
        .groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad"))
        .withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    )
    total = hosts.agg(F.coalesce(F.try_divide(F.sum("bad"), F.sum("n")), F.lit(0.5)).alias("rate"))
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]

    def shrunk(groups: DataFrame, to: str) -> DataFrame:
        held = groups.crossJoin(F.broadcast(_spread(groups, "k")))
        return held.withColumn(to, (F.col("bad") + F.col("k") * F.col("rate")) / (F.col("n") + F.col("k")))

    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    suffixes = shrunk(domains.groupBy("suffix").agg(*sums).crossJoin(F.broadcast(total)), "post")
    domains = shrunk(domains.join(suffixes.select("suffix", F.col("post").alias("rate")), "suffix"), "post")
    hosts = hosts.join(domains.select("domain", "suffix", F.col("post").alias("rate")), ["domain", "suffix"])
    hosts = shrunk(hosts, "mean").withColumn("weight", F.col("n") + F.col("k"))
    said = ["host", "domain", "suffix", "n", "bad"]

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mean, weight = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("mean", "weight"))
            a, b = np.maximum(mean * weight, 1e-9), np.maximum((1 - mean) * weight, 1e-9)
            made = [pa.array(beta_quantile(share, a, b)) for share in (tail, 1 - tail)]
            yield pa.RecordBatch.from_arrays([*map(batch.column, said), *made], names=[*said, "bad_low", "bad_high"])

    return map_arrow(hosts.select(*said, "mean", "weight"), bounds, "host string, domain string, suffix string, n long, bad long, bad_low double, bad_high double")


def matching_rule(host: Column, path: Column, rules: list[Rule], value) -> Column:
    """``value(rule)`` of the longest rule that fits, else null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        found = F.when(fits, F.lit(value(rule))).otherwise(found)
    return found


def filter_urls(
    pages: DataFrame, outcomes: DataFrame, rules: list[Rule], *, page_id: str = "page_id", url: str = "url",
    max_bad: float = 0.5, tail: float = 0.05,
) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages``.

    ``rules`` is a list in the program, so it is bounded and becomes one expression.  Verdicts of the
    method join by host; only blocked hosts take part, as a plain equi-join whose hot hosts Spark splits.
    """
    judged = pages.select(F.col(page_id).alias("page_id"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    blocked = host_reputation(judged, outcomes, tail=tail).filter(F.col("bad_low") >= max_bad).select("host", F.lit("block").alias("method"))
    host, path = F.col("host"), F.col("path")
    return judged.join(blocked, "host", "left").select(
        "page_id", "host", "path",
        matching_rule(host, path, rules, lambda r: r.text).alias("rule"),
        F.coalesce(matching_rule(host, path, rules, lambda r: r.verdict), F.col("method"), F.lit("allow")).alias("verdict"),
    )
