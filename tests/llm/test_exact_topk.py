"""Search against scoring every pair."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from lodestone.llm.exact_topk import CELL_SEGMENTS, SEGMENTS, Cells, block_topk, search, statistics


def brute(rows, k, every):
    ok = [(i, [math.floor(64 * x) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for a, (qid, q) in enumerate(ok):
        if qid % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(q, c)), i) for b, (i, c) in enumerate(ok) if b != a and len(c) == len(q))
            out += [(qid, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize(("dim", "scale"), [(5, 1.0), (64, 0.3), (20, 3e6)])
def test_against_all_pairs(spark, dim, scale):
    rng = random.Random(dim)
    rows = [(i, [rng.choice([0.0, 0.5, rng.gauss(0, 1)]) * scale for _ in range(dim)]) for i in range(300)]
    rows += [(i, list(rows[0][1])) for i in range(300, 340)] + [(40, list(rows[0][1])), (40, list(rows[7][1]))]
    rows += [(None, rows[0][1]), (500, None), (501, [1.0, None]), (502, [float("nan")] * dim), (503, [float("inf")] * dim), (504, [1.0, 2.0]), (505, [3.0, -1.0]), (520, [1.0, 1.0]), (521, [])]
    df = spark.createDataFrame([(i, e, "x") for i, e in rows], "vec_id long, embedding array<double>, RANK string")
    out = search(df, lambda v: v % 20 == 0, k=7, query_block=8, candidate_block=90).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in out) == brute(rows, 7, 20)


def test_empty_table(spark):
    assert search(spark.createDataFrame([], "vec_id long, embedding array<float>"), lambda v: v % 20 == 0).count() == 0


@pytest.mark.parametrize("mark", [3e38, 3.4028234663852886e38, -3e38, 1e200])
def test_components_near_the_limit(spark, mark):
    """Rows of a mark for what is missing, among others, empty no query's results; scores keep to 64 bits."""
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) for _ in range(20)]) for i in range(400)]
    rows += [(400, [mark] * 20), (401, [mark if j % 2 else -mark for j in range(20)]), (402, [mark] + [0.0] * 19), (420, [0.0] * 20)]
    out = search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda v: v % 20 == 0, k=7, candidate_block=150).collect()
    held = [(q, r, i, max(-(2**63), min(2**63 - 1, s))) for q, r, i, s in brute(rows, len(rows), 20)]
    want = []
    for q in {q for q, *_ in held}:
        want += [(q, r, i, s) for r, (_, i, s) in enumerate(sorted((-s, i, s) for a, _, i, s in held if a == q)[:7], 1)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in out) == sorted(want)


def test_bounds_leave_pairs_out(spark):
    """Of clustered vectors most cells are never wanted, and of vectors without structure the finest level leaves pairs out."""
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(40, 64)) * 3
    x = centers[np.repeat(np.arange(40), 150)] + rng.normal(size=(6000, 64)) * 0.2
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    out = search(df, lambda v: v % 20 == 0, k=7, query_block=64, candidate_block=500, sample=2000).collect()
    f = np.floor(64 * x.astype(np.float32).astype(float))
    for q in range(0, 6000, 20):
        scores = f @ f[q]
        scores[q] = -np.inf
        want = np.lexsort((np.arange(6000), -scores))[:7]
        assert [(r.vec_id, r.score) for r in sorted((r for r in out if r.query_id == q), key=lambda r: r.rank)] == [(int(i), int(scores[i])) for i in want]
    held = Cells(np.arange(0, 6000, 3), f[::3], f[::150])
    cell = held.nearest(f)
    mean, deviation = np.split(statistics(f, CELL_SEGMENTS), 2, axis=1)
    held.low, held.high, held.deviation = (np.array([op(v[cell == c], axis=0) for c in range(40)]) for op, v in ((np.min, mean), (np.max, mean), (np.max, deviation)))
    queries = np.arange(0, 6000, 20)
    floors = held.thresholds(f[queries], queries, 7)
    assert held.wanted(f[queries], floors).mean() < 0.1
    told: dict[int, int] = {}
    block_topk(f[queries], queries, floors, f, np.arange(6000), np.arange(6000), 7, told)
    assert told[0] == 300 * 6000 and told[SEGMENTS[0]] >= told[SEGMENTS[1]] >= told[SEGMENTS[-1]] and told[SEGMENTS[-1]] < 0.05 * told[0]
    g = np.floor(64 * rng.normal(size=(4000, 64)) / 8)
    told = {}
    block_topk(g[:200], np.arange(200), np.full(200, -np.inf), g, np.arange(4000), np.arange(4000), 20, told)
    assert told[SEGMENTS[-1]] < 0.8 * told[0]
