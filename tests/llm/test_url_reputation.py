"""Rules and reputation against plain Python."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm.queries.op2 import RULES
from lodestone.llm.url_reputation import Rule, beta_quantile, domain_of, filter_urls, host_reputation, suffix_of


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    path = rest[cut:]
    end = min([path.find(c) for c in "?#" if c in path] or [len(path)])
    return "".join(c.lower() if c.isascii() else c for c in rest[:cut]), path[:end]


def ruled(host, path):
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


URLS = [
    "http://www.example.com/en/x?y#z", "https://example.com/en/", "HTTP://A.Example.COM/EN/", "http://example.com/en", "http://b.com/", "http://com/x", "http://notcom/", "http://x.net/es/1", "http://x.net/fr/",
    "http://x.net/de/", "ftp://h", "http://h?q=/en/", "http://h#f", "nothing", "", None, "http://a.com//://b", "x://ÄB.net/es/", "://c.net/fr/q", "http://line\nbreak.com/a\nb",
]


def test_rules(spark):
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(URLS)], "page_id long, url string, HOST string, n int")
    none = spark.createDataFrame([], "page_id long, bad int")
    out = {r.page_id: r for r in filter_urls(pages, none, RULES).collect()}
    for i, url in enumerate(URLS):
        host, path = parts(url)
        rule = ruled(host, path)
        assert (out[i].host, out[i].path, out[i].rule, out[i].verdict) == (host, path, rule.text if rule else None, rule.verdict if rule else "allow")


def posterior(rows):
    """Mean and weight by host, by the formulas of the method of moments."""
    hosts = defaultdict(lambda: [0, 0])
    for host, bad in rows:
        hosts[host][0] += bad is not None
        hosts[host][1] += bad or 0

    def level(groups, rate):
        seen = [(n, b, rate[g]) for g, (n, b) in groups.items() if n]
        top = sum(n * (b / n - m) ** 2 for n, b, m in seen) - sum(m * (1 - m) for _, _, m in seen)
        under = sum(m * (1 - m) * (n - 1) for n, _, m in seen)
        k = 1 / min(0.5, max(0.001, top / under if under else 0.5)) - 1
        return {g: ((b + k * rate[g]) / (n + k), n + k) for g, (n, b) in groups.items()}

    def up(groups, of):
        out = defaultdict(lambda: [0, 0])
        for g, (n, b) in groups.items():
            out[of(g)][0] += n
            out[of(g)][1] += b
        return out

    domains = up(hosts, lambda h: ".".join(h.split(".")[-2:]))
    suffixes = up(domains, lambda d: d.split(".")[-1])
    n, b = map(sum, zip(*suffixes.values()))
    s = level(suffixes, dict.fromkeys(suffixes, b / n))
    d = level(domains, {g: s[g.split(".")[-1]][0] for g in domains})
    return level(hosts, {h: d[".".join(h.split(".")[-2:])][0] for h in hosts})


def below(x, a, b, n=200_000):
    """The share of Beta(a, b) below x, by the midpoints of the log odds."""
    grid = np.linspace(-400, 400, 2 * n)
    log = a * -np.logaddexp(0, -grid) + b * -np.logaddexp(0, grid)
    weight = np.exp(log - log.max())
    return float(weight[grid <= math.log(x / (1 - x))].sum() / weight.sum())


def test_quantiles():
    a, b = np.array([0.5, 1.0, 3.2, 40.0, 5000.0, 1e6, 0.3]), np.array([0.5, 2.0, 0.7, 900.0, 5000.0, 30.0, 7.0])
    for share in (0.05, 0.5, 0.95):
        for x, u, v in zip(beta_quantile(share, a, b), a, b):
            assert 0 <= x <= 1 and (x < 1e-9 or below(x, u, v, 400_000) == pytest.approx(share, abs=2e-3))
    assert beta_quantile(0.05, np.array([1.0]), np.array([1.0]))[0] == pytest.approx(0.05)
    assert beta_quantile(0.05, np.array([3.0]), np.array([1.0]))[0] == pytest.approx(0.05 ** (1 / 3))


def test_domains_and_suffixes(spark):
    want = {
        "a.b.example.com": ("example.com", "com"), "a.example.co.uk": ("example.co.uk", "co.uk"), "x.com.mx:8080": ("x.com.mx", "com.mx"), "user:pw@shop.example.org:80": ("example.org", "org"),
        "example.net.": ("example.net", "net"), "10.0.0.1": ("10.0.0.1", ""), "10.0.0.1:81": ("10.0.0.1", ""), "[2001:db8::1]:443": ("[2001:db8::1]", ""), "localhost": ("localhost", "localhost"), "": ("", ""), "web.de": ("web.de", "de"),
    }
    rows = spark.createDataFrame([(h,) for h in want], "host string").select("host", domain_of(F.col("host")).alias("d"), suffix_of(F.col("host")).alias("s")).collect()
    assert {r.host: (r.d, r.s) for r in rows} == want


def test_reputation_and_method_verdicts(spark):
    rng = random.Random(4)
    rate = {f"h{i}.d{i % 7}.{'org' if i % 2 else 'info'}": rng.choice([0.02, 0.1, 0.95]) for i in range(40)}
    rows = [(h, rng.choice([int(rng.random() < p), int(rng.random() < p), None])) for h, p in rate.items() for _ in range(rng.randint(1, 60))]
    pages = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(rows)], "page_id long, host string")
    labels = [(i, b) for i, (_, b) in enumerate(rows)] + [(0, 0), (None, 1), (10**9, 1)]
    outcomes = spark.createDataFrame(labels, "page_id long, bad int")
    want = posterior([(h, max(b or 0, 0) if i == 0 else b) for i, (h, b) in enumerate(rows)])
    got = {r.host: r for r in host_reputation(pages, outcomes).collect()}
    for host, (mean, weight) in want.items():
        assert below(got[host].bad_low, mean * weight, (1 - mean) * weight) == pytest.approx(0.05, abs=1e-3)
        assert below(got[host].bad_high, mean * weight, (1 - mean) * weight) == pytest.approx(0.95, abs=1e-3)
    urls = pages.selectExpr("page_id", "concat('http://', host, '/p') as url")
    verdicts = {r.host: r.verdict for r in filter_urls(urls, outcomes, [Rule("allow", "none", "/")]).collect()}
    assert verdicts == {h: "block" if got[h].bad_low >= 0.5 else "allow" for h in want} and set(verdicts.values()) == {"allow", "block"}


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert filter_urls(pages, spark.createDataFrame([], "page_id long, bad int"), RULES).count() == 0
