"""Text and numeric functions on hand-made cases."""

from __future__ import annotations

import math
import re

import pytest
from pyspark.sql import functions as F

from lodestone.functions import numeric, text
from lodestone.functions.stem import stem


def value(spark, expr, *args):
    names = [f"c{i}" for i in range(len(args))]
    types = ", ".join(f"{n} {'string' if isinstance(a, str) or a is None else 'double'}" for n, a in zip(names, args))
    return spark.createDataFrame([args], types).select(expr(*map(F.col, names)).alias("v")).first().v


@pytest.mark.parametrize(("word", "want"), [
    ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("motoring", "motor"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"),
    ("sky", "sky"), ("relational", "relat"), ("optimization", "optim"), ("used", "us"), ("is", "is"), ("BM25", "bm25"), ("adoption", "adopt"), ("controll", "control"),
])
def test_stem(word, want):
    assert stem(word) == want


@pytest.mark.parametrize(("raw", "want"), [
    ("a  b\n\n\n\nc  \n", "a b\n\nc"), ("x <!-- n\n --> y <b>z</b>", "x y z"), ("  ", ""), ("plain", "plain"),
    ("t\n─────────────\nPage 3\n─────────────\nu", "t\n\nu"), ("keep\n```\na  <b>  \n```\ndone  it", "keep\n```\na  <b>  \n```\ndone it"),
])
def test_clean(spark, raw, want):
    assert value(spark, text.clean, raw) == want


@pytest.mark.parametrize(("raw", "want"), [
    ("# Heading one\nbody", "Heading one"), ("Short first line\nbody.", "Short first line"), ("A sentence here. Another one.", "A sentence here"), ("", "Untitled"),
    ("w" * 160 + ". x", "w" * 147 + "..."),
])
def test_title(spark, raw, want):
    assert value(spark, text.chunk_title, raw) == want


def test_summary_tags_and_snippet(spark):
    assert value(spark, text.chunk_summary, "One. Two! Three? Four.") == "One. Two! Three?"
    assert len(value(spark, text.chunk_summary, "x" * 600)) == 500
    assert value(spark, text.chunk_tags, "New York uses camelCase and snake_case with **bold term** here") == ["New York", "bold term", "camelCase", "snake_case"]
    assert value(spark, lambda c: text.snippet(c, 12), "hello  wide\nworld") == "hello wide..."


def test_tables(spark):
    html = "<table><tr><th>a</th><th>b</th></tr><tr><td>1|2</td></tr></table>"
    assert value(spark, text.html_table_markdown, html) == "| a | b |\n| --- | --- |\n| 1\\|2 |  |"
    grid = spark.createDataFrame([([["n", "v"], [" x ", None, "y"]],)], "g array<array<string>>")
    r = grid.select(text.grid_plain(F.col("g")).alias("p"), text.grid_html(F.col("g")).alias("h")).first()
    assert r.p == "n: x | v:  | col2: y" and r.h == "<table><tr><th>n</th><th>v</th></tr><tr><td>x</td><td></td><td>y</td></tr></table>"


def test_replies_and_captions(spark):
    r = value(spark, text.parse_enrichment, "Title: T\nSummary: S s\nTags: a, b")
    assert (r.title, r.summary, list(r.tags)) == ("T", "S s", ["a", "b"])
    got = value(spark, text.parse_scores, '```json\n[{"passage_id": "p", "score": 2}]\n```')
    assert [(x.passage_id, x.score) for x in got] == [("p", 2.0)]
    df = spark.createDataFrame([("see [IMAGE: i1] and [IMAGE: i2] [IMAGE: i1]", {"i1": "a cat"})], "t string, c map<string,string>")
    r = df.select(text.image_ids(F.col("t")).alias("ids"), text.stitch_captions(F.col("t"), F.col("c")).alias("s")).first()
    assert list(r.ids) == ["i1", "i2"] and r.s.count("(Description: a cat)") == 2
    assert value(spark, text.clean_latex, "```latex\n$$x^2$$\n```") == "x^2"
    assert value(spark, lambda t, s, k: text.with_table_summary(t, s, k), "body", "sum", "table") == "(Table Summary: sum)\n\nbody"


def test_titles_and_tags_of_documents(spark):
    assert value(spark, text.document_title, "x\n# Head\n", "", "a/b_c.md") == "Head"
    assert value(spark, text.document_title, "x", None, "a/my_file-name.md") == "My File Name"
    assert value(spark, text.document_tags, "a, b", "pdf") == ["a", "b", "PDF"]
    assert value(spark, text.first_title, "\n line \n# H") == "H"


def test_numbers(spark):
    assert math.isclose(value(spark, numeric.idf, 10.0, 7.0), math.log(3.5 / 7.5))
    assert value(spark, lambda r: numeric.rrf_score(r), 1.0) == 1 / 61
    with pytest.raises(ValueError, match="positive"):
        numeric.rrf_score(F.lit(1), 0)
    vectors = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>")
    r = vectors.select(numeric.similarity_score(numeric.cosine(F.col("a"), F.col("b"))).alias("s"), numeric.cosine(F.col("a"), F.col("z")).alias("n")).first()
    assert r.s == 0.5 and r.n is None
    images = spark.createDataFrame([("x.JPG", bytearray(b"")), ("x", bytearray(b"\x89PNG\r\n")), ("x.bin", None)], "p string, c binary")
    assert [r[0] for r in images.select(numeric.mime_type(F.col("p"), F.col("c"))).collect()] == ["image/jpeg", "image/png", "image/png"]
    assert re.fullmatch(r"[0-9a-f]{8}_12345_[0-9a-f]{8}", value(spark, lambda a, b: numeric.chunk_id(a, F.lit(12345), b), "p", "t"))
    meta = spark.createDataFrame([({"a": None},), ({"a": "1", "b": None},)], "m map<string,string>")
    assert [r[0] for r in meta.select(numeric.stored_metadata(F.col("m"))).collect()] == [{"_placeholder": "true"}, {"a": "1"}]
    size = spark.range(1).select(numeric.scaled_size(F.lit(400.0), F.lit(200.0), 100).alias("s")).first().s
    assert (size.width, size.height) == (100, 50)
