"""Boilerplate by host against plain counting."""

from __future__ import annotations

import random
from collections import Counter

from lodestone.llm.line_dedup import drop_boilerplate


def brute(rows, ratio, least):
    total, seen = Counter(h for h, _ in rows), Counter()
    for h, t in rows:
        seen.update((h, x) for x in {x.strip(" ") for x in (t or "").split("\n")} - {""})
    gone = {k for k, n in seen.items() if n >= least and n > ratio * total[k[0]]}
    return [t if t is None else "\n".join(x for x in t.split("\n") if (h, x.strip(" ")) not in gone) for h, t in rows]


def test_against_plain_counting(spark):
    rng = random.Random(2)
    common = [f"common {i}" for i in range(6)]
    rows = []
    for _ in range(400):
        host = rng.choice(["a", "a", "a", "b", "c", None])
        lines = [rng.choice(common[:2] if host == "a" else common) if rng.random() < 0.3 else rng.choice(["", " ", f"own {rng.random()}", " common 1 "]) for _ in range(rng.randint(0, 7))]
        rows.append((host, rng.choice([None, ""]) if rng.random() < 0.05 else "\n".join(lines)))
    rows += [("solo", "one\ntwo")] * 3 + [("long", "x\n" * 20_000)]
    df = spark.createDataFrame([(i, h, t, "n", "k") for i, (h, t) in enumerate(rows)], "doc_id long, source string, text string, N_LINES string, `a.b` string")
    out = drop_boilerplate(df, ratio=0.15, least=4).orderBy("doc_id").collect()
    assert [r.text for r in out] == brute(rows, 0.15, 4)
    assert sum(r.n_dropped for r in out) > 50
    assert all(r.n_lines == (0 if t is None else t.count("\n") + 1) for r, (_, t) in zip(out, rows))


def test_empty_table(spark):
    assert drop_boilerplate(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0
