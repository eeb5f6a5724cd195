"""Components against comparing every pair; signatures against similarity."""

from __future__ import annotations

import random
import re
from pathlib import Path

import numpy as np
import pytest

from lodestone.llm import near_dup
from lodestone.llm.common import likely, shared_dir
from lodestone.llm.components import components
from lodestone.llm.minhash import odd_sketch, shingles, signature
from lodestone.llm.near_dup import near_duplicates, sketches_allow


def shingle_set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} - {()}


def brute(rows, width, percent=80):
    sets = [shingle_set(t, width) for _, t in rows]
    top = list(range(len(rows)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                top[root(i)] = root(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[root(i)] = min(d, ids.get(root(i), d))
    return sorted(((d if d is not None else -1, len(sets[i]), c if (c := ids.get(root(i)) if sets[i] else d) is not None else -1) for i, (d, _) in enumerate(rows)))


def corpus(rng, families, size):
    rows, vocabulary = [], ["".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(3000)]
    for _ in range(families):
        base = rng.choices(vocabulary, k=rng.randint(1, 150))
        for _ in range(rng.choice([1, 1, 2, size])):
            edited = [rng.choice(vocabulary) if rng.random() < 0.06 else w for w in base]
            rows.append((len(rows), rng.choice([" ", "\n"]).join(edited) if rng.random() < 0.8 else " ".join(base).upper()))
    return rows


@pytest.mark.parametrize("width", [2, 5])
def test_against_all_pairs(spark, width):
    rng = random.Random(width)
    rows = corpus(rng, 60, 40)
    rows += [(9000, None), (9001, ""), (9002, " \n"), (9003, "One"), (9004, "one"), (9004, "other words here"), (None, rows[3][1]), (None, "no id at all"), (9005, "w " * 30_000)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, KEPT string").repartition(5)
    out = near_duplicates(df, width=width).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in out) == brute(rows, width)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_signatures_estimate_similarity():
    a, b = (shingles(" ".join(str(i) for i in range(lo, lo + 1000)), 1) for lo in (0, 250))
    agree = np.mean(signature(a, 400) == signature(b, 400))
    assert abs(agree - 750 / 1250) < 0.06


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(7, 7)]
    out = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(out[i] == 0 for i in range(201)) and all(out[i] == 1000 for i in range(1000, 1300)) and len(out) == 501


def test_a_bucket_of_many_nodes(spark):
    """Two words and one of 700 others: all sets share bands, and are linked or not by their other words."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(24)]
    rows = [(i, " ".join([*base[: 20 + i % 5], f"own{i}", *([f"end{i % 9}"] * (i % 2))])) for i in range(700)]
    rows += [(None, f"{' '.join(base)} null{i}") for i in range(300)] + [(None, "the same text of several words")] * 200 + [(5, f"id five again {rng.random()}") for _ in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    out = near_duplicates(df, width=2).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in out) == brute(rows, 2)


def test_blocks_of_long_sets(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_SHINGLES", 300)
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    rng = random.Random(12)
    rows = corpus(rng, 30, 40)
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == brute(rows, 2)


def test_written_tables_are_removed(spark):
    shared = Path(shared_dir(spark)) / "lodestone"
    before = set(shared.glob("*")) if shared.exists() else set()
    near_duplicates(spark.createDataFrame(corpus(random.Random(3), 20, 10), "doc_id long, text string"), width=2).collect()
    left = {p.name.rsplit("-", 1)[0] for p in set(shared.glob("*")) - before}
    assert left <= {"near-dup-signatures", "near-dup-nodes", "components"}


def moved(spark, run):
    """Bytes that ``run`` writes to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = sum(x.shuffleWrite() for x in executors(store()))
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return sum(x.shuffleWrite() for x in executors(store())) - before


def executors(store):
    found = store.executorList(False)
    return [type("", (), {"shuffleWrite": found.apply(i).totalShuffleWrite})() for i in range(found.size())]


def test_texts_without_a_bucket_in_common_stay_where_they_are(spark):
    rng = random.Random(21)
    rows = [(i, " ".join(f"{rng.getrandbits(40):x}" for _ in range(2000))) for i in range(300)]
    rows += [(1000 + i, rows[i][1] + " more") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()
    df.count()
    out = []
    assert moved(spark, lambda: out.extend(near_duplicates(df, width=2).collect())) < 0.5 * sum(len(t) for _, t in rows)
    assert {r.doc_id: r.component_id for r in out} == {i: i % 1000 for i, _ in rows}


def test_families_of_neighbours_that_are_no_links_move_few_sets(spark):
    """Sets that share buckets, and differ by more than a link allows: only their sketches meet in blocks."""
    rng = random.Random(22)
    rows = []
    for family in range(12):
        base = [f"{family}-{i}" for i in range(600)]
        rows += [(len(rows) + i, " ".join(f"x{rng.getrandbits(40):x}" if j % 8 == 0 else w for j, w in enumerate(base))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()
    df.count()
    out = []
    sets = sum(8 * len(shingle_set(t, 2)) for _, t in rows)
    assert moved(spark, lambda: out.extend(near_duplicates(df, width=2).collect())) < 3 * sets
    assert all(r.kept for r in out)


@pytest.mark.parametrize("percent", [50, 80, 95])
def test_sketches_rule_out_no_similar_sets(percent):
    rng = np.random.default_rng(percent)
    ruled_out = 0
    for _ in range(2000):
        n = int(rng.integers(1, 600))
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        b = np.unique(np.concatenate([a[: int(rng.integers(0, n + 1))], rng.integers(0, 1 << 63, int(rng.integers(1, max(2, n // 4))), dtype=np.uint64)]))
        a = np.unique(a)
        both = len(np.intersect1d(a, b))
        allowed = sketches_allow(odd_sketch(a), odd_sketch(b), len(a), len(b), percent)
        assert allowed or 100 * both < percent * (len(a) + len(b) - both)
        ruled_out += not allowed
    assert ruled_out > 100


def test_a_filter_keeps_all_that_are_wanted(spark, monkeypatch):
    monkeypatch.setattr("lodestone.llm.common.FILTER_WORDS", 64)
    rows = [(i if i % 7 else None, f"t{i // 2}", i) for i in range(5000)]
    df = spark.createDataFrame(rows, "id long, text string, __at int")
    wanted = df.filter("__at % 50 < 2").select("id", "text")
    left = likely(df, ["id", "text"], wanted)
    assert left.columns == df.columns
    found = {tuple(r) for r in left.collect()}
    assert found <= set(rows) and {r for r in rows if r[2] % 50 < 2} <= found and len(found) < 1500
    assert likely(df, ["id"], wanted.select("id").limit(0)).count() == 0


def test_rows_that_repeat_id_and_text_in_several_partitions(spark):
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(5, base)] * 60 + [(i, f"{base} e{i % 3}") for i in range(30)] + [(None, f"{base} e4")] * 20
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    out = near_duplicates(df, width=2).collect()
    assert len(out) == len(rows) and {r.component_id for r in out} == {0} and sum(r.kept for r in out) == 1
