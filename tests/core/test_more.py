"""Layout chunks, comparison of paths, the integrity check and the parse cache."""

from __future__ import annotations

from lodestone.operators import catalog, chunking, hybrid, index
from lodestone.sources import files


def test_layout_chunks(spark):
    rows = spark.createDataFrame([("d", 5, "body", ["A", "B"], ["text", "table"], 2), ("d", 1, "x", None, ["picture"], 1)], "doc_id string, piece int, text string, headings array<string>, labels array<string>, page int")
    got = chunking.layout_chunks(rows).orderBy("chunk_index").collect()
    assert [(r.text, r.contains_table, r.contains_text, r.contains_figure) for r in got] == [("x", False, False, True), ("A\nB\nbody", True, True, False)]


def test_compare_and_integrity(spark):
    chunks = spark.createDataFrame([("p_0", "cats sleep", "d", "t", ""), ("p_1", "dogs bark", "d", "t", "")], "chunk_id string, text string, source_path string, doc_type string, tags string")
    built = index.build(chunks)
    vectors = spark.createDataFrame([("p_0", [1.0, 0.0]), ("p_1", [0.0, 1.0])], "chunk_id string, embedding array<float>")
    queries = spark.createDataFrame([("q", "dogs", [1.0, 0.0])], "query_id string, query string, vector array<float>")
    got = {(r.path, r["rank"]): r.chunk_id for r in hybrid.compare(queries, chunks, built, vectors).collect()}
    assert got["dense", 1] == "p_0" and ("fused", 1) in got
    pages = spark.createDataFrame([("d", 1, "alpha beta gamma " * 20)], "doc_id string, page int, text string")
    library = spark.createDataFrame([("d", 0, "other words")], "doc_id string, chunk_index int, text string")
    paths = spark.createDataFrame([("/a.pdf",)], "path string")
    report = {r.check: r.n for r in catalog.integrity(pages, library, chunks, built.postings, built.lengths, paths).collect()}
    assert report == {"missing_pages": 1, "not_ingested": 1, "foreign_chunks": 2, "unaligned": 0}


def test_parse_cache(spark):
    schema = "file_hash string, version_stamp string, batch int, n_batches int, text string"
    held = spark.createDataFrame([("a", "v1", 1, 1, "old"), ("b", "v1", 1, 1, "b")], schema)
    got = files.cached(held, spark.createDataFrame([("a", "v2", 1, 1, "new")], schema))
    assert sorted((r.file_hash, r.text) for r in got.collect()) == [("a", "new"), ("b", "b")]
