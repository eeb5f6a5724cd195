"""Operators on small tables, and the invariants between them."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import catalog, chunking, dense, evaluation, filters, fusion, hybrid, index, store, traces
from lodestone.schema import CHUNKS

TEXTS = [("a_0000_1", "Neural nets learn. Neural nets are deep."), ("a_0001_2", "The cat sat on the mat"), ("b_0000_3", "Deep cats learn"), ("b_0001_4", "???")]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame([(i, t, "docs/" + i[0], "md", "x, y") for i, t in TEXTS], "chunk_id string, text string, source_path string, doc_type string, tags string")


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_index_and_bm25(spark, chunks):
    built = index.build(chunks)
    stats = built.corpus_stats().first()
    assert (stats.n, stats.total_terms) == (4, 12)
    assert rows(built.lengths.filter("chunk_id = 'b_0001_4'"), "dl") == [(0,)]
    df = {r.term: r.df for r in built.term_stats().collect()}
    assert df["learn"] == 2 and df["cat"] == 2 and "the" not in df
    found = index.bm25(built, spark.createDataFrame([("q", ["neural", "cat"])], "query_id string, terms array<string>"), k=2).collect()
    assert found[0].chunk_id == "a_0000_1" and [r["rank"] for r in found] == [1, 2]


def test_common_terms_have_negative_idf(spark):
    built = index.build(spark.createDataFrame([(str(i), "same word") for i in range(3)] + [("9", "other")], "chunk_id string, text string"), stem=False)
    assert built.term_stats().filter("term = 'same'").first().idf < 0
    found = index.bm25(built, spark.createDataFrame([("q", ["same"])], "query_id string, terms array<string>"))
    assert found.count() == 3 and found.first().score < 0


def test_index_by_rows_is_the_same(spark, chunks):
    """Without a shuffle of postings for the statistics, and one for a search."""
    plain, made = index.build(chunks, stem=False), index.build(chunks, stem=False, unique=True)
    assert made.corpus_stats().collect() == plain.corpus_stats().collect()
    for a, b, names in ((made.lengths, plain.lengths, ("chunk_id", "dl", "unique_terms")), (made.term_stats(), plain.term_stats(), ("term", "df", "idf"))):
        assert rows(a, *names) == rows(b, *names)
    asked = spark.createDataFrame([("q", ["neural", "cat", "learn"]), ("r", ["deep"]), ("s", ["nothing"])], "query_id string, terms array<string>")
    found = [[(x, round(y, 9), *z) for x, y, *z in rows(index.bm25(i, asked), "chunk_id", "score", "query_id", "rank")] for i in (made, plain)]
    assert found[0] == found[1] and len(found[0]) == 5
    assert "hashpartitioning(chunk_id" not in made.corpus_stats()._jdf.queryExecution().toString()
    assert not index.repeats(chunks) and index.repeats(chunks.unionByName(chunks.limit(1)))
    assert rows(index.term_counts(chunks), "term", "n") == rows(index.term_rows(chunks).groupBy("term").agg(F.count(F.lit(1)).alias("n")), "term", "n")


def test_search_moves_no_texts(spark, chunks):
    """Hits go to the chunks, and only hits are read for entries of a bibliography."""
    asked = spark.createDataFrame([("q", "neural cats")], "query_id string, query string")
    plan = hybrid.search(asked, chunks, index.build(chunks, stem=False, unique=True), None)._jdf.queryExecution().optimizedPlan().toString()
    before = plan.split("strategy=broadcast")[0]
    assert "strategy=broadcast" in plan and "rank" in next(x for x in before.splitlines() if "Springer" in x)


def test_add_and_remove_are_inverse(spark, chunks):
    whole = index.build(chunks)
    part = index.build(chunks.filter("chunk_id like 'a%'"))
    more = index.build(chunks.filter("chunk_id like 'b%'"))
    joined = index.add(part, more)
    assert rows(joined.postings, "chunk_id", "term", "tf") == rows(whole.postings, "chunk_id", "term", "tf")
    assert rows(index.add(joined, more).lengths, "chunk_id") == rows(whole.lengths, "chunk_id")
    gone = spark.createDataFrame([("b",)], "p string")
    assert rows(index.remove_prefixes(joined, gone).lengths, "chunk_id") == rows(part.lengths, "chunk_id")


def test_saved_index(spark, chunks, tmp_path):
    built = index.build(chunks)
    again = built.save(str(tmp_path / "index"))
    assert rows(again.term_stats(), "term", "df") == rows(built.term_stats(), "term", "df")


def lists(spark):
    a = spark.createDataFrame([("q", c, r, 1.0 / r) for r, c in enumerate("xyz", 1)] + [("p", "x", 1, 0.4)], "query_id string, chunk_id string, rank int, score double")
    b = spark.createDataFrame([("q", c, r, 9.0 - r) for r, c in enumerate("yw", 1)], "query_id string, chunk_id string, rank int, score double")
    return a, b


def test_fusion(spark):
    both = fusion.together(*lists(spark))
    fused = fusion.rrf(both.filter("query_id = 'q'")).collect()
    assert [r.chunk_id for r in fused] == ["y", "x", "w", "z"] and math.isclose(fused[0].score, 1 / 61 + 1 / 62)
    assert [r.chunk_id for r in fusion.rrf(both.filter("query_id = 'q'"), top_k=2).collect()] == ["y", "x"]
    assert fusion.rrf(both, weights=[0.0, 1.0], top_k=1).filter("query_id = 'q'").first().chunk_id == "y"
    with pytest.raises(ValueError, match="negative"):
        fusion.rrf(both, weights=[-1.0, 1.0])
    kinds = {r.query_id: (r.score_kind, r.score) for r in fusion.fuse_or_pass(both).filter("rank = 1").collect()}
    assert kinds["p"] == ("raw", 0.4) and kinds["q"][0] == "rrf"
    assert [r.chunk_id for r in fusion.interleave(both.filter("query_id = 'q'"), top_k=3).orderBy("rank").collect()] == ["x", "y", "w"]
    assert rows(fusion.in_both(*lists(spark)), "chunk_id") == [("y",)]


def test_query_syntax(spark):
    df = spark.createDataFrame([("type:PDF tag:a,b nets http://x tags:c src:d/e",)], "q string")
    p = df.select(filters.parse(F.col("q")).alias("p")).first().p
    assert (p.text, p.doc_type, p.source_path, list(p.tags), p.collection) == ("nets http://x", "PDF", "d/e", ["a", "b", "c"], None)
    merged = df.select(filters.merged(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3"))).alias("m")).first().m
    assert merged == {"a": "1", "b": "3"}


def test_hybrid_and_rerank(spark, chunks):
    built = index.build(chunks, stem=False)
    vectors = spark.createDataFrame([(i, [float(n), 1.0]) for n, (i, _) in enumerate(TEXTS)], "chunk_id string, embedding array<float>")
    queries = spark.createDataFrame([("q", "neural cat tag:y source:docs/a", [1.0, 0.0])], "query_id string, query string, vector array<float>")
    found = hybrid.search(queries, chunks, built, vectors, top_k=4).collect()
    assert {r.source_path for r in found} == {"docs/a"} and [r["rank"] for r in found] == list(range(1, len(found) + 1))
    assert hybrid.search(queries, chunks, built, None).first().score_kind == "raw"
    with pytest.raises(RuntimeError):
        hybrid.search(queries, chunks, None, None)
    base = hybrid.search(queries, chunks, built, vectors)
    assert hybrid.rerank(base, None, top_k=1).count() == 1

    def broken(_):
        raise OSError("no model")

    assert all(r.rerank_fallback for r in hybrid.rerank(base, broken, top_k=5).collect())
    asked = base.withColumn("original_query", F.col("query_id"))
    by_length = hybrid.rerank(asked, hybrid.guarded_scorer(lambda q, t: [-len(x) for x in t]), top_k=5).collect()
    assert [r.rerank_score for r in sorted(by_length, key=lambda r: r["rank"])] == sorted((-float(len(r.text)) for r in base.collect()), reverse=True)
    failing = hybrid.rerank(asked, hybrid.guarded_scorer(lambda q, t: [1.0] * (len(t) + 1)), top_k=5)
    assert rows(failing, "chunk_id", "rank") == rows(base, "chunk_id", "rank") and all(r.rerank_fallback and r.rerank_score is None for r in failing.collect())
    replies = spark.createDataFrame([("q", '[{"passage_id": "a_0001_2", "score": 9}, {"passage_id": "zz", "score": 10}]')], "query_id string, reply string")
    assert rows(hybrid.rerank(base, hybrid.model_scores(replies), top_k=5), "chunk_id", "rank") == [("a_0001_2", 1)]


def test_dense(spark):
    held = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [-1.0, 0.0]), ("z", [0.0, 0.0]), ("s", [1.0])], "chunk_id string, embedding array<float>")
    asked = spark.createDataFrame([("q", [2.0, 0.0])], "query_id string, vector array<float>")
    assert [(r.chunk_id, r.score) for r in dense.topk(held, asked, k=3).collect()] == [("a", 1.0), ("b", 0.5), ("c", 0.0)]
    plan = dense.topk(held, asked, k=3)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_metrics(spark):
    found = spark.createDataFrame([("q", "a", 1, "x\\d.pdf"), ("q", "b", 2, "d/e.pdf"), ("q", "c", 3, ""), ("r", "a", 1, "n")], "query_id string, chunk_id string, rank int, source string")
    truth = spark.createDataFrame([("q", "b", "/t/e.pdf")], "query_id string, chunk_id string, source string")
    queries = spark.createDataFrame([("q",), ("r",), ("s",)], "query_id string")
    assert rows(evaluation.id_metrics(found, truth.select("query_id", "chunk_id"), queries), "query_id", "hit_rate", "mrr") == [("q", 1.0, 0.5), ("r", 0.0, 0.0), ("s", 0.0, 0.0)]
    got = rows(evaluation.source_metrics(found, truth.select("query_id", "source"), queries), "query_id", "source_recall", "source_precision")
    assert got == [("q", 1.0, pytest.approx(1 / 3)), ("r", 0.0, 0.0), ("s", 0.0, 0.0)]
    values = spark.createDataFrame([("q", "m", 1.0), ("r", "m", float("nan")), ("s", "m", 0.0), ("q", "n", None)], "query_id string, metric string, value double")
    assert rows(evaluation.metric_means(values), "metric", "mean") == [("m", 0.5), ("n", 0.0)]
    assert evaluation.report(values).first().metrics == {"m": 0.5, "n": 0.0}
    assert evaluation.rerun_quota(5, 10, 4) == 15
    with pytest.raises(ValueError, match="positive"):
        evaluation.rerun_quota(0, 1, 1)


def test_quota_selection(spark):
    pool = spark.createDataFrame([(i, "a" if i < 7 else "b" if i < 9 else "c") for i in range(10)], "pool_idx long, kind string")
    assert rows(evaluation.select_by_quota(pool, 5), "kind", "pool_idx") == [("a", 0), ("a", 1), ("a", 2), ("a", 3), ("b", 7)]


def test_contexts(spark, chunks):
    contexts = spark.createDataFrame([(1, "cat SAT  on"), (2, "nets learn deep things"), (3, "nothing like it at all"), (4, "")], "context_id long, text string")
    assert dict(rows(evaluation.match_contexts(contexts.filter("context_id < 4"), chunks), "context_id", "chunk_id")) == {1: "a_0001_2", 2: "a_0000_1", 3: None}
    assert rows(evaluation.contexts_in_feed(contexts, "the Cat sat on it"), "context_id", "in_feed")[0] == (1, True)


def test_segments_and_chunks(spark):
    schema = "doc_id string, pos int, type string, text string, page int, bbox struct<x0:double,top:double,x1:double,bottom:double>, html string"
    data = [("d", 0, "header", "h", 1), ("d", 1, "text", "intro", 1), ("d", 2, "title", "T", 2), ("d", 3, "text", "body", 3), ("d", 4, "table", "r1\nr2", 3), ("d", 5, "odd", "tail", 4), ("d", 6, "equation", " ", 4)]
    found = chunking.segments(spark.createDataFrame([(*x, None, None) for x in data], schema))
    assert [(r.type, r.text, r.page) for r in found.orderBy("segment").collect()] == [("text", "intro", 1), ("text", "T\n\nbody", 2), ("table", "r1\nr2", 3), ("text", "tail", 4)]
    made = chunking.chunks(found, size=100, overlap=10).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in made] == [0, 1, 2, 3] and made[2].table_html == "r1\nr2" and made[0].chunk_id.startswith("d_0000_")


def test_splitting():
    text = " ".join(f"Sentence number {i} is here." for i in range(300)) + "\n\n" + "x" * 2500
    pieces = chunking.split_recursive(text, 500, 100)
    assert all(0 < len(p) <= 500 for p in pieces) and all(f"number {i} " in " ".join(pieces) for i in range(300))
    assert sum(p.count("x") for p in pieces) >= 2500 and chunking.split_recursive("  ", 10, 2) == []


def test_packing_rows_and_items(spark):
    df = spark.createDataFrame([("aa\nbb\ncc\ndddddddd", "pre\n- one\n- two\n3. three")], "t string, l string")
    r = df.select(chunking.packed(F.split("t", "\n"), 6, "\n").alias("p"), chunking.list_items(F.col("l")).alias("i")).first()
    assert list(r.p) == ["aa\nbb", "cc", "dddddddd"]
    assert list(r.i) == ["pre\n- one\n", "- two\n", "3. three"]


def test_images_meet_their_chunk(spark):
    box = "struct<x0:double,top:double,x1:double,bottom:double>"
    images = spark.createDataFrame([("d", "i", 2, (0.0, 0.0, 2.0, 2.0)), ("d", "j", 9, None)], f"doc_id string, image_id string, page int, bbox {box}")
    held = spark.createDataFrame([("d", "c0", 0, 2, (8.0, 8.0, 9.0, 9.0)), ("d", "c1", 1, 2, (0.0, 0.0, 2.0, 2.0)), ("d", "c2", 2, 8, None)], f"doc_id string, chunk_id string, chunk_index int, page_num int, bbox {box}")
    assert rows(chunking.nearest_chunk(images, held), "image_id", "chunk_id") == [("i", "c1"), ("j", "c2")]
    words = spark.createDataFrame([("d", 1, 0.0, 10.0, "b"), ("d", 1, 5.0, 11.0, "c"), ("d", 1, 0.0, 13.9, "x"), ("d", 1, -1.0, 12.5, "a")], "doc_id string, page int, x0 double, top double, text string")
    assert rows(chunking.lines_of_words(words), "line", "text") == [(0, "a b c"), (1, "x")]


def test_images_meet_their_chunk_among_many(spark, monkeypatch):
    """By lists and by trees in several blocks, without a row for each image and chunk."""
    box = "struct<x0:double,top:double,x1:double,bottom:double>"
    rng = np.random.default_rng(7)
    draw = lambda n: [None if i % 17 == 0 else tuple(float(v) for v in rng.integers(0, 12, 4)) for i in range(n)]
    page = lambda i: None if i % 19 == 0 else int(i % 7)
    images = [("d", i, page(i) if i % 3 else 20, b) for i, b in enumerate(draw(150))]
    held = [("d", i, 500 - i, page(i), b) for i, b in enumerate(draw(500))]

    def wanted(image):
        def key(chunk):
            same = image[2] == chunk[3] and image[3] == chunk[4]
            pages = math.inf if image[2] is None or chunk[3] is None else abs(image[2] - chunk[3])
            far = math.inf
            if image[3] and chunk[4]:
                far = sum(((image[3][a] + image[3][b]) / 2 - (chunk[4][a] + chunk[4][b]) / 2) ** 2 for a, b in ((0, 2), (1, 3)))
            return not same, pages, far, chunk[2]
        return min(held, key=key)[1]

    i = spark.createDataFrame(images, f"doc_id string, image_id int, page int, bbox {box}")
    c = spark.createDataFrame(held, f"doc_id string, chunk_id int, chunk_index int, page_num int, bbox {box}")
    want = sorted((x[1], wanted(x)) for x in images)
    assert rows(chunking.nearest_chunk(i, c), "image_id", "chunk_id") == want
    monkeypatch.setattr(chunking, "FEW", 4)
    monkeypatch.setattr(chunking, "BLOCK", 30)
    assert rows(chunking.nearest_chunk(i, c), "image_id", "chunk_id") == want


def test_nearest_chunk_makes_no_pairs(spark):
    """4,000 images on a page of 20,000 chunks: the joins make a row for each image, not 80 million."""
    box = lambda x: F.struct(x.alias("x0"), x.alias("top"), x.alias("x1"), x.alias("bottom"))
    i = spark.range(4000).select(F.lit("d").alias("doc_id"), F.col("id").alias("image_id"), F.lit(1).alias("page"), box(F.col("id") * 5.0).alias("bbox"))
    c = spark.range(20000).select(F.lit("d").alias("doc_id"), F.col("id").alias("chunk_id"), F.col("id").alias("chunk_index"), F.lit(2).alias("page_num"), box(F.col("id") + 0.25).alias("bbox"))
    found = chunking.nearest_chunk(i, c)
    assert found.filter("chunk_id <> image_id * 5").count() == 0 and found.count() == 4000
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().toString()


def test_words_at_one_place_keep_their_order(spark):
    words = [("d", 1, 5.0, 10.0, t, n) for n, t in enumerate("zebra yak ape cat".split())]
    df = spark.createDataFrame(words[::-1], "doc_id string, page int, x0 double, top double, text string, pos int").repartition(4)
    assert rows(chunking.lines_of_words(df), "text") == [("zebra yak ape cat",)]


def test_windows_make_their_words_once(spark):
    from lodestone.functions.text import normal_words

    df = spark.createDataFrame([(" ".join(f"w{i}" for i in range(100)),), ("a b c",), (None,)], "text string")
    made = df.select(catalog.windows(normal_words(F.col("text"))).alias("w"))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("[^a-z0-9]+") == 1
    found = [r.w for r in made.collect()]
    assert found[0][:2] == [" ".join(f"w{i}" for i in range(10, 10 + n)) for n in (8, 6)] and len(found[0]) == 10
    assert found[1:] == [[], []]


def test_store(spark, tmp_path):
    table = store.Table(spark, str(tmp_path / "chunks"), "chunk_id string, collection string, n int", ("chunk_id",), "collection")
    assert table.read().count() == 0
    table.upsert(spark.createDataFrame([("a", "c", 1), ("b", "c", 1)], "chunk_id string, collection string, n int"))
    table.upsert(spark.createDataFrame([("b", "c", 2), ("e", "d", 1)], "chunk_id string, collection string, n int"))
    assert rows(table.read(), "chunk_id", "n") == [("a", 1), ("b", 2), ("e", 1)]
    with pytest.raises(ValueError, match="filter"):
        store.by_metadata({})
    assert store.reset({"chunks": table}, "d") == {"chunks": 1}
    assert store.cascade({"chunks": (table, store.by_metadata({"collection": "c"})), "bad": (table, F.col("nope") == 1)})["chunks"] == 2
    assert rows(table.read(), "chunk_id") == [("e",)]


def test_histories(spark):
    old = spark.createDataFrame([("h", "p", "failed", "c", "boom", 1), ("k", "p", "success", "c", None, 2)], "file_hash string, file_path string, status string, collection string, error_msg string, t int")
    old = old.withColumns({"processed_at": F.timestamp_seconds("t"), "updated_at": F.timestamp_seconds("t")}).drop("t")
    new = spark.createDataFrame([("h", "p", "success", "c", "ignored", 9)], "file_hash string, file_path string, status string, collection string, error_msg string, t int").withColumn("at", F.timestamp_seconds("t")).drop("t")
    r = {x.file_hash: x for x in store.marked(old, new).collect()}
    assert r["h"].error_msg is None and r["h"].processed_at.second == 1 and r["h"].updated_at.second == 9
    files = spark.createDataFrame([("h",), ("k",)], "file_hash string")
    assert rows(store.to_ingest(files, old), "file_hash") == [("h",)]
    images = spark.createDataFrame([("i", "kept")], "image_id string, caption string")
    assert rows(store.registered(images, spark.createDataFrame([("i", None)], "image_id string, caption string")), "caption") == [("kept",)]
    done = store.once_per_key(files.union(files), F.col("file_hash"), lambda d: d.select("cache_key", F.lit("v").alias("value")))
    assert done.count() == 4 and {r.value for r in done.collect()} == {"v"}


def test_catalog(spark, chunks):
    built = index.build(chunks)
    assert catalog.alignment(chunks, built.postings, built.lengths).count() == 0
    assert rows(catalog.alignment(chunks.limit(0), built.postings, built.lengths), "side") == [("index",)] * 3
    page = " ".join(f"word{i} alpha" for i in range(40))
    pages = spark.createDataFrame([("d", 1, page), ("d", 2, "few words"), ("d", 3, "12 34 5 " * 30), ("d", 4, "beta gamma " * 40)], "doc_id string, page int, text string")
    library = spark.createDataFrame([("d", 0, page.upper())], "doc_id string, chunk_index int, text string")
    assert [v for _, v in rows(catalog.page_verdicts(pages, library), "page", "verdict")] == ["in_library", "blank_or_image", "figure_page", "MISSING"]
    assert "chunk_id" in CHUNKS


def test_traces(spark):
    stage = "array<struct<stage:string,timestamp:string,elapsed_ms:double,data:string>>"
    df = spark.createDataFrame([("t", "query", "2024-01-01T00:00:00", [("a", "", 1.0, "{}"), ("a", "", None, '{"count": 0}')], "{}")], f"trace_id string, trace_type string, started_at string, stages {stage}, metadata string")
    assert rows(traces.stage_timings(df), "stage", "elapsed_ms") == [("a", 0.0)]
    r = traces.diagnosis(df, ["a", "b"]).first()
    assert list(r.missing) == ["b"] and r.no_result and not r.has_error
    assert traces.recent(df, keyword="COUNT").count() == 1 and traces.recent(df, trace_type="x").count() == 0


def seeded(n, dim, seed):
    return np.random.default_rng(seed).standard_normal((n, dim)).astype(np.float32)


def test_similar_pairs_of_many_vectors(spark):
    """More rows than a batch of queries may have, against all products."""
    x = seeded(10_100, 16, 1)
    x[7], x[10_050] = x[3], -x[3]
    held = [(i, v.tolist()) for i, v in enumerate(x)] + [(20_000, [0.0] * 16), (20_001, None), (20_002, [1.0, None]), (20_003, [1.0]), (20_004, [2.0]), (None, x[3].tolist()), (3, x[3].tolist())]
    out = dense.similar_pairs(spark.createDataFrame(held, "id long, embedding array<float>"), threshold=0.85).collect()
    x = np.concatenate([x, x[3:4]]).astype(np.float64)
    ids, unit = np.array([*range(10_100), 3]), x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    i, j = np.nonzero(unit @ unit.T >= 0.85)
    want = sorted((int(a), int(b)) for a, b in zip(ids[i], ids[j]) if a < b)
    assert sorted((r.left, r.right) for r in out) == sorted([*want, (20_003, 20_004)]) and (3, 7) in want
    assert all(r.similarity == pytest.approx(float(unit[r.left] @ unit[r.right]), abs=6e-5) for r in out if r.left < 20_000)


def test_dense_of_many_queries(spark):
    q, x = seeded(10_050, 8, 2), seeded(60, 8, 3)
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)] + [(20_000, None), (20_001, [1.0])], "query_id long, vector array<float>")
    held = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(60, [0.0] * 8), (61, None)], "chunk_id long, embedding array<float>")
    got = {(r.query_id, r["rank"]): r.chunk_id for r in dense.topk(held, asked, k=3).collect()}
    unit = lambda v: v / np.sqrt((v * v).sum(axis=1, keepdims=True))
    best = np.argsort(-(unit(q.astype(np.float64)) @ unit(x.astype(np.float64)).T), axis=1)[:, :3]
    assert got == {(i, r + 1): int(best[i, r]) for i in range(len(q)) for r in range(3)}


def test_blocks_of_strings(spark, monkeypatch):
    """Ids of another kind, and several blocks of either side, give what one block gives."""
    x = seeded(90, 3, 4)
    rows_ = spark.createDataFrame([(f"é{i % 7}_{i}", v.tolist()) for i, v in enumerate(x)], "id string, embedding array<double>")
    asked, held = rows_.select(F.col("id").alias("query_id"), F.col("embedding").alias("vector")), rows_.withColumnRenamed("id", "chunk_id")
    pairs = lambda: sorted(map(tuple, dense.similar_pairs(rows_, threshold=0.8).collect()))
    found = lambda: sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 9)) for r in dense.topk(held, asked, k=4).collect())
    once = pairs(), found()
    monkeypatch.setattr(dense, "BLOCK", 16)
    monkeypatch.setattr(dense, "MOST_ROWS", 20)
    assert (pairs(), found()) == once and len(once[0]) > 50 and all(a < b for a, b, _ in once[0])
