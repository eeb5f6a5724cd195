"""Held-out accuracy, the order of thresholds, and inputs at the edges."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np

from lodestone.llm.queries.op6 import op6_toxicity_ordinal
from lodestone.llm.toxicity import DEGREES, TOXIC, Model, fit, fit_thresholds, labelled_sample, score

BAD = ["vexor", "vexoria", "grumbek", "grumbeks", "zolptic"]


def corpus(n, seed):
    rng = random.Random(seed)
    plain = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(plain, k=rng.randint(5, 120))
        toxic = int(rng.random() < 0.2)
        for _ in range(rng.randint(2, 9) * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(BAD) + rng.choice(["", "em", "ur"]))
        docs.append((seed * 10_000 + i, " ".join(words), "x"))
        labels.append((seed * 10_000 + i, toxic))
    return docs, labels


def test_held_out_documents(spark):
    docs, labels = corpus(600, 1)
    others, truth = corpus(400, 2)
    schema = "doc_id long, text string, SEVERITY string"
    model = fit(spark.createDataFrame(docs, schema), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert model.thresholds == sorted(model.thresholds) and len(model.thresholds) == 3
    rows = {r.doc_id: r for r in score(spark.createDataFrame(others, schema), model).collect()}
    right = [rows[i].toxic == bool(t) for i, t in truth]
    assert np.mean(right) > 0.98
    assert all((r.grade > 0) == r.toxic for r in rows.values()) and {r.grade for r in rows.values()} >= {0, 1, 2}


def test_thresholds_recover_order():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (2000, 3))
    z = x @ np.array([3.0, 1.0, 0.0]) + rng.logistic(size=2000)
    grades = (z > 0).astype(int) + (z > 2)
    w, theta = fit_thresholds([np.flatnonzero(r).tolist() for r in x], grades, np.zeros(3), 2, 500, 0.0)
    assert abs(w[0] - 3) < 0.4 and abs(w[1] - 1) < 0.3 and abs(theta[1] - theta[0] - 2) < 0.3


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a " * 50_000), (2, "")], "doc_id long, text string")
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    model = fit(docs, none)
    assert not model.weights
    out = score(docs, model).collect()
    assert len(out) == 4 and not any(r.toxic for r in out)
    assert score(docs.limit(0), model).count() == 0
    assert Model({"a": 1.0}, [-1.0, 0.5]).judge(0.0)[0] > 0.5


def judged_plainly(text, model):
    """Severity, grade and toxic by the formulas, from the list of all of a text's words and beginnings."""
    words = re.findall(r"\w+", (text or "").lower())
    x = sum(w for f, w in model.weights.items() if any(f == v or f[-1] == "*" and len(v) > len(f) - 1 and v.startswith(f[:-1]) for v in words))
    above = [1 / (1 + math.exp(t - x)) for t in model.thresholds]
    each = [a - b for a, b in zip(above, [*above[1:], 0.0])]
    return sum((j + 1) * p for j, p in enumerate(each)), (1 + each.index(max(each)) if above[0] > TOXIC else 0), above[0] > TOXIC


def test_the_query_against_the_formulas(spark, tmp_path):
    docs, labels = corpus(500, 3)
    docs += [(90_000, None, "x"), (90_001, "", "x"), (90_002, "vexor " * 60_000, "x"), (90_003, "a " * 60_000, "x"), (docs[0][0], "same id", "x")]
    labels += [(90_002, 1), (90_003, 0), (None, 1)]
    spark.createDataFrame(docs, "doc_id long, text string, grade string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d = str(tmp_path)
    model = fit(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    got = Counter((r.doc_id, round(r.severity, 6), r.grade, r.toxic) for r in op6_toxicity_ordinal(spark, d).collect())
    want = Counter((i, round(s, 6), g, t) for i, text, _ in docs for s, g, t in [judged_plainly(text, model)])
    assert got == want and sum(n for (_, _, g, _), n in got.items() if g) > 50


def test_fit_is_a_minimum():
    """No step away from the fitted weights lowers the loss, computed here pair by pair."""
    rng = np.random.default_rng(4)
    x = rng.integers(0, 2, (400, 4))
    grades = np.clip((x @ np.array([2.0, 1.0, 0.5, 0.0]) + rng.logistic(size=400)).astype(int), 0, 2)
    rows = [np.flatnonzero(r).tolist() for r in x]
    w, theta = fit_thresholds(rows, grades, np.zeros(4), 2, 3000, 0.0)

    def loss(w, theta):
        total = 0.0
        for row, grade in zip(rows, grades):
            for j, t in enumerate(theta):
                p = 1 / (1 + math.exp(t - sum(w[f] for f in row)))
                total -= (1.0 if j == 0 else DEGREES) * math.log(p if grade > j else 1 - p)
        return total

    best = loss(w, theta)
    for _ in range(60):
        dw, dt = rng.normal(size=4) * 0.05, rng.normal(size=2) * 0.05
        assert loss(np.maximum(0, w + dw), np.sort(theta + dt)) >= best - 1e-3


def test_the_sample_is_bounded_in_rows(spark):
    docs = spark.createDataFrame([(i % 5, f"text {i}") for i in range(200)], "doc_id long, text string")
    drawn = labelled_sample(docs, spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id long, toxic int"), 4)
    assert drawn.count() == 4
