"""Toxicity as an ordered severity: cumulative-link (proportional-odds) regression on sparse text features.

Features are the words of a text and the beginnings of those words, so that inflected forms share
weight; each counts once a text.  Only features that speak for toxicity are kept, so that a text
without any is judged by the thresholds alone.  One weight vector serves all thresholds: the log odds of a severity
above j are ``w . x - theta_j``.  The output is the expected severity, whether a severity above 0 is likely
enough to reject the text, and the grade: 0 if it isn't, else the likeliest one above 0.

The model is fitted on a bounded sample of labelled documents (``sample``, the first by a hash of the id, a
row for each);
candidate features are counted over that sample in Spark and the ``features`` that tell the classes
apart best are kept.  Labels say toxic or not.  Grades above 1 split the toxic rows of the sample evenly
by how much of the text is made of telling words, so that severity stands for density of abuse.

Edge cases: null or empty texts have no features and get the intercepts' severity; texts of any length
are read whole; labels with a null id or value are left out, repeated ones count as toxic if any is;
of documents that share a labelled id the least text is fitted on; with no label of either class the model has no weights and calls nothing toxic; repeated rows are
scored each; empty tables give empty results; all columns of the input are carried along, and output
columns take the place of input columns of their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import cut, map_arrow, parts, pick, texts

WORD = re.compile(r"\w+")
PREFIXES = (3, 4, 5, 6)
#: A feature speaks for toxicity from this log-likelihood ratio (chi-square with one degree, p about 1e-5).
EVIDENCE = 20.0
#: A feature is at least e times as frequent in toxic texts as in others.
LEAST_ODDS = 1.0
#: Where weights start, as a share of their features' log odds.
START = 0.2
#: A text is called toxic from this probability of a severity above 0: about three times the share of toxic labels.
TOXIC = 0.3
#: The weight of thresholds above the first in the loss: telling toxic from not comes before telling degrees.
DEGREES = 0.1
#: A word's features are kept for so many distinct words per task.
REMEMBERED = 200_000
#: Partial counts of a task leave it when there are so many features.
COUNTED = 200_000
OUTPUT = {"severity": T.DoubleType(), "grade": T.IntegerType(), "toxic": T.BooleanType()}


def word_features(word: str) -> list[str]:
    """The word itself, and its beginnings where it goes on."""
    return [word, *[word[:n] + "*" for n in PREFIXES if len(word) > n]]


def text_features(text: str) -> set[str]:
    return {f for word in set(WORD.findall(text.lower())) for f in word_features(word)}


@dataclass
class Model:
    """Weights by feature and ascending thresholds; the number of grades is one more than thresholds."""

    weights: dict[str, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=lambda: [20.0])

    def probabilities(self, x: float) -> list[float]:
        """Of a severity above 0, above 1, ..."""
        return [1 / (1 + math.exp(min(700.0, t - x))) for t in self.thresholds]

    def judge(self, x: float) -> tuple[float, int, bool]:
        above = [*self.probabilities(x), 0.0]
        toxic = above[0] > TOXIC
        grade = 1 + max(range(len(above) - 1), key=lambda j: above[j] - above[j + 1]) if toxic else 0
        return sum(above), grade, toxic


class Scores(dict):
    """The weighted features of a word, kept for words seen before."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.weights = weights

    def __missing__(self, word: str) -> tuple[tuple[str, float], ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = tuple((f, self.weights[f]) for f in word_features(word) if f in self.weights)
        return found

    def of(self, text: str) -> float:
        found: dict[str, float] = {}
        for word in set(WORD.findall(text.lower())):
            if hit := self[word]:
                found.update(hit)
        return sum(found[f] for f in sorted(found))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """text and toxic of at most ``sample`` labelled documents, one row an id; the ids are so few that they are broadcast."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.filter("text is not null").join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic")


def telling_features(sample: DataFrame, features: int, least: int) -> list[tuple[str, float]]:
    """The features with the largest log-likelihood ratio between the classes, and their log odds."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def partial() -> Iterator[pa.RecordBatch]:
            names = list(counts[0].keys() | counts[1].keys())
            for start in range(0, len(names), 50_000):
                some = names[start : start + 50_000]
                yield pa.RecordBatch.from_pydict({"feature": some, "clean": [counts[0].get(f, 0) for f in some], "bad": [counts[1].get(f, 0) for f in some]})
            for held in counts:
                held.clear()

        for batch in batches:
            for text, toxic in zip(texts(batch), batch.column("toxic").to_pylist()):
                counts[toxic > 0].update(text_features(text) | {""})
                if len(counts[0]) + len(counts[1]) > COUNTED:
                    yield from partial()
        yield from partial()

    totals = map_arrow(sample, count, "feature string, clean long, bad long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("bad").alias("bad"))
    held = cut(totals, "toxicity-features")
    rows = held.filter("feature = ''").collect()
    clean, bad = (rows[0].clean, rows[0].bad) if rows else (0, 0)
    if not clean or not bad:
        return []
    a, b, n = F.col("bad"), F.col("clean"), float(clean + bad)

    def part(seen, row, column):
        return seen * F.ln(F.greatest(seen, F.lit(1e-9)) * n / (row * column))

    both = a + b
    g2 = part(a, both, bad) + part(b, both, clean) + part(bad - a, n - both, bad) + part(clean - b, n - both, clean)
    odds = F.ln((a + 0.5) / (bad + 1.0)) - F.ln((b + 0.5) / (clean + 1.0))
    best = held.filter("feature <> ''").filter((both >= least) & (both < n)).select("feature", odds.alias("odds"), (2 * g2).alias("g2"))
    best = best.filter((F.col("odds") >= LEAST_ODDS) & (F.col("g2") >= EVIDENCE))
    return [(r.feature, r.odds) for r in best.orderBy(F.desc("g2"), "feature").limit(features).collect()]


def fit_thresholds(rows: list[list[int]], grades: np.ndarray, start: np.ndarray, top: int, rounds: int, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by Adam on the mean cumulative-link loss.

    Thresholds stay in order, and weights, which begin at ``start``, at or above 0: every feature was
    chosen because it speaks for toxicity, and a mild one among toxic texts must not speak against it.
    """
    size, part = len(start), np.where(np.arange(top) == 0, 1.0, DEGREES)
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    which = np.array([f for r in rows for f in r], dtype=np.int64)
    above = (grades[:, None] > np.arange(top)[None, :]).astype(float)
    share = np.clip(above.mean(axis=0), 1e-4, 1 - 1e-4)
    p = np.concatenate([start, np.log((1 - share) / share)])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, rounds + 1):
        w, theta = p[:size], p[size:]
        x = np.bincount(at, weights=w[which], minlength=len(rows))
        off = (1 / (1 + np.exp(np.clip(theta[None, :] - x[:, None], -500, 500))) - above) * part
        g = np.concatenate([np.bincount(which, weights=off.sum(axis=1)[at], minlength=size) / len(rows) + ridge * w, -off.mean(axis=0)])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        p[:size] = np.maximum(p[:size], 0.0)
        p[size:] = np.maximum.accumulate(p[size:])
    return p[:size], p[size:]


def fit(
    docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", sample: int = 16_384,
    features: int = 2048, grades: int = 3, least: int = 4, rounds: int = 400, ridge: float = 1e-5,
) -> Model:
    """A model of severities 0 to ``grades`` from at most ``sample`` labelled rows."""
    drawn = cut(labelled_sample(pick(docs, doc_id=doc_id, text=text), pick(labels, doc_id=doc_id, toxic=toxic), sample), "toxicity-sample")
    best = telling_features(drawn, features, least)
    if not best:
        return Model()
    number = {f: i for i, (f, _) in enumerate(best)}
    odds = {f: o for f, o in best if o > 1}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            made = []
            for text, bad in zip(texts(batch), batch.column("toxic").to_pylist()):
                tokens = WORD.findall(text.lower())
                mass = sum(max((odds.get(f, 0.0) for f in word_features(w)), default=0.0) for w in tokens) / max(1, len(tokens)) if bad > 0 else 0.0
                made.append((sorted(number[f] for f in text_features(text) if f in number), int(bad > 0), mass))
            found, toxics, masses = zip(*made)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), pa.array(toxics), pa.array(masses)], names=["found", "toxic", "mass"])

    rows = sorted(map_arrow(drawn, encode, "found array<int>, toxic long, mass double").collect())
    bad = np.array([r.toxic for r in rows])
    mass = np.array([r.mass for r in rows])
    cuts = np.quantile(mass[bad > 0], [j / grades for j in range(1, grades)])
    severity = bad * (1 + np.searchsorted(cuts, mass, side="right"))
    weights, thresholds = fit_thresholds([list(r.found) for r in rows], severity, START * np.array([o for _, o in best]), grades, rounds, ridge)
    return Model({f: round(float(weights[i]), 6) for f, i in number.items()}, [round(float(t), 6) for t in thresholds])


def score(docs: DataFrame, model: Model, *, text: str = "text", names: tuple[str, str, str] = tuple(OUTPUT)) -> DataFrame:
    """``docs`` with severity, grade and toxic, or these under other names; the model has a bounded number of features."""
    output = dict(zip(names, OUTPUT.values()))
    kept = [f for f in docs.schema.fields if f.name.lower() not in {n.lower() for n in output}]
    schema = T.StructType(kept + [T.StructField(n, t) for n, t in output.items()])
    carried = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(model.weights)
        for batch in parts(batches):
            made = [model.judge(scores.of(value)) for value in texts(batch, text)]
            severity, grade, toxic = zip(*made)
            arrays = [batch.column(n) for n in carried] + [pa.array(severity), pa.array(grade, pa.int32()), pa.array(toxic)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*carried, *output])

    return map_arrow(docs, run, schema)
