"""Each stage on the smallest tables against a plain version of its decision."""

from __future__ import annotations

import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_near_dup import brute as brute_groups, moved

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    steps = dict(corpus_pipeline.STAGES)
    clean = steps["toxicity"](spark, docs, SF).cache()
    assert clean.columns == docs.columns
    left = {r.doc_id for r in clean.collect()}
    assert not [d for d, t in labels.items() if not t and d not in left]
    assert len([d for d, t in labels.items() if t and d not in left]) >= 0.3 * sum(labels.values())

    cleaned = steps["line dedup"](spark, clean, SF).cache()
    before, after = clean.orderBy("doc_id").collect(), cleaned.orderBy("doc_id").collect()
    assert [r.text for r in after] == brute_lines([(r.source, r.text) for r in before], 0.1, 5)
    assert all(r.n_chars == len(r.text) for r in after) and cleaned.columns == docs.columns

    single = steps["near-duplicates"](spark, cleaned, SF).cache()
    want = {d for d, _, c in brute_groups([(r.doc_id, r.text) for r in after], 5) if d == c}
    assert {r.doc_id for r in single.collect()} == want and single.columns == docs.columns

    pieces = steps["packing"](spark, single, SF).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = {r.doc_id: len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in single.collect()}
    assert {r.doc_id: r.doc_tokens for r in pieces} == tokens
    assert sum(r.length for r in pieces) == sum(tokens.values())
    assert corpus_pipeline.run(spark, SF).count() == len(pieces)


def test_rows_that_repeat_an_id(spark):
    """Of equal rows with words one stays, and of one id's rows each that is no near-duplicate of another."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (1, text), (1, text + " more"), (2, text), (3, "quite other words"), (3, "quite other words"), (3, "and a third text"), (4, None), (4, None), (None, text + " x"), (None, "null id alone"), (None, "null id alone")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = dict(corpus_pipeline.STAGES)["near-duplicates"](spark, docs, SF).collect()
    assert len([r for r in out if r.doc_id == 1]) == 1 and not [r for r in out if r.doc_id == 2]
    left = sorted((str(r.doc_id), str(r.text)) for r in out if r.doc_id != 1)
    assert left == sorted([("3", "quite other words"), ("3", "and a third text"), ("4", "None"), ("4", "None"), ("None", "null id alone")])


def test_texts_that_stay_are_not_moved(spark):
    rng = random.Random(31)
    rows = [(i, " ".join(f"{rng.getrandbits(40):x}" for _ in range(2000))) for i in range(300)]
    rows += [(1000 + i, rows[i][1] + " more") for i in range(5)] + [(None, rows[9][1] + " end")]
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(4).cache()
    docs.count()
    out, threshold = [], spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert moved(spark, lambda: out.extend(corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect())) < 0.5 * sum(len(t) for _, t in rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert sorted(r.doc_id for r in out) == list(range(300))
