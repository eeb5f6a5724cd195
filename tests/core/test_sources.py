"""Readers, settings, embeddings and the ingesting stream."""

from __future__ import annotations

import json
import logging
import sys
import threading
import zipfile
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from lodestone.operators.store import Table
from lodestone.plans import lifecycle
from lodestone.schema import HISTORY
from lodestone.sources import embeddings, files, models, records
from lodestone.streaming.ingest import ingest, watch, windowed_counts

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(path):
    body = f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Bo</w:t></w:r><w:r><w:t>dy</w:t></w:r></w:p></w:body></w:document>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", body)


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    docx(tmp_path / "sub" / "a.DOCX")
    (tmp_path / "b.txt").write_text("# Title\ntext")
    (tmp_path / "c.docx").write_bytes(b"broken")
    found = files.discover(spark, str(tmp_path), (".docx", ".txt"))
    parsed = {r.source_path.rsplit("/", 1)[1]: r for r in files.parse(found).collect()}
    assert parsed["a.DOCX"].text == "## Head\n\nBody" and parsed["b.txt"].title == "Title"
    assert parsed["c.docx"].text is None and "BadZipFile" in parsed["c.docx"].error and parsed["b.txt"].doc_id.startswith("doc_")
    with pytest.raises(ValueError, match="no parser"):
        files.parse(found, "no such")
    stamp = F.lit("s1")
    cache = files.hashed(found).select("file_hash", F.lit("s1").alias("version_stamp"), F.lit(1).alias("batch"), F.when(F.col("path").endswith("b.txt"), 1).otherwise(2).alias("n_batches"), F.lit("cached").alias("text"))
    texts, due = files.replay(files.hashed(found), cache, stamp)
    assert texts.count() == 1 and due.count() == 2


def test_batches_and_ocr(spark):
    docs = spark.createDataFrame([("a", 5), ("b", None), ("c", 2)], "doc_id string, n_pages int")
    got = sorted((r.doc_id, r.first_page, r.last_page) for r in files.batches(docs, 2).collect() if r.doc_id != "b")
    assert got == [("a", 1, 2), ("a", 3, 4), ("a", 5, 5), ("c", 1, None)]
    pages = spark.createDataFrame([("a", 1, "x" * 30), ("a", 2, " "), ("b", 1, "x" * 30)], "doc_id string, page int, text string")
    assert {r.doc_id: r.ocr for r in files.needs_ocr(pages).collect()} == {"a": True, "b": False}
    assert all(r.ocr for r in files.needs_ocr(pages, "always").collect())


def test_golden_sets(spark, tmp_path):
    case = {"user_input": "q1", "reference": "r"}
    (tmp_path / "a.jsonl").write_text(json.dumps(case) + "\n")
    (tmp_path / "b.json").write_text(json.dumps([case, case]))
    (tmp_path / "c.json").write_text(json.dumps({"version": "4", "test_cases": [{"query": "q2", "expected_sources": ["s"], "expected_chunk_ids": []}]}))
    assert [records.golden(spark, str(tmp_path / n)).count() for n in ("a.jsonl", "b.json", "c.json")] == [1, 2, 1]
    r = records.golden(spark, str(tmp_path / "c.json")).first()
    assert (r.query, list(r.expected_sources), r.reference) == ("q2", ["s"], None)
    (tmp_path / "d.jsonl").write_text("{bad\n")
    with pytest.raises(Exception, match="FAILFAST|Malformed|MALFORMED"):
        records.golden(spark, str(tmp_path / "d.jsonl")).collect()


def test_traces(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("a", "query")], "trace_id string, trace_type string")
    records.append_traces(rows, path)
    records.append_traces(rows, path)
    (tmp_path / "t" / "x.txt").write_text('{"trace_id": "b"}\n\n{broken\n')
    assert sorted(r.trace_id for r in records.traces(spark, path).collect()) == ["a", "a", "b"]


def test_settings():
    assert records.settings({"splitting": {"chunk_size": 5}}).splitting.chunk_size == 5
    for bad in ({"nope": {}}, {"splitting": {"x": 1}}, {"splitting": {"chunk_size": "5"}}, {"reranking": {"provider": "y"}}):
        with pytest.raises(ValueError):
            records.settings(bad)


def test_settings_of_yaml_and_their_cards(spark, tmp_path):
    (tmp_path / "s.yaml").write_text("reranking:\n  enabled: true\n  provider: llm\nembedding: {provider: http, model: m, dimensions: 8}\nsplitting:\n")
    held = records.settings(str(tmp_path / "s.yaml"))
    assert (held.reranking.provider, held.embedding.model, held.splitting.chunk_size) == ("llm", "m", 1000)
    assert records.settings({"embedding": {"model": "x"}}).embedding.provider == "hashing"
    for bad in ("- a", "llm: 3", "embedding: {size: 3}"):
        (tmp_path / "s.yaml").write_text(bad)
        with pytest.raises(ValueError):
            records.settings(str(tmp_path / "s.yaml"))
    found = {r.component: r for r in records.cards(spark, held).collect()}
    assert found["reranking"].provider == "llm" and json.loads(found["embedding"].details) == {"dimensions": 8} and "vision" not in found


def test_log_lines():
    record = logging.makeLogRecord({"name": "n", "levelname": "INFO", "msg": "got %s", "args": ("é",), "stage": "load", "odd": {1}})
    got = json.loads(records.JsonLines().format(record))
    assert (got["message"], got["logger"], got["stage"], got["odd"], got["level"]) == ("got é", "n", "load", "{1}", "INFO") and "msg" not in got
    try:
        raise KeyError("k")
    except KeyError:
        record.exc_info = sys.exc_info()
    assert "KeyError" in json.loads(records.JsonLines().format(record))["exception"]


def test_tables_and_media_of_word_files(spark, tmp_path):
    p = lambda x: f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>"
    row = lambda *xs: "<w:tr>" + "".join(f"<w:tc>{p(x)}</w:tc>" for x in xs) + "</w:tr>"
    body = f"<w:document {W}><w:body>{p('before')}<w:tbl>{row('a', 'b|c')}{row('1')}</w:tbl>{p('after')}<w:tbl/></w:body></w:document>"
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", body)
        z.writestr("word/media/image2.png", b"two")
        z.writestr("word/media/image1.png", b"one")
    (tmp_path / "b.docx").write_bytes(b"broken")
    assert files.docx_text((tmp_path / "a.docx").read_bytes()) == "before\n\n| a | b\\|c |\n| --- | --- |\n| 1 |  |\n\nafter"
    got = files.docx_media(files.discover(spark, str(tmp_path), (".docx",))).orderBy("seq").collect()
    assert [(r.name, bytes(r.content), r.page, r.image_id == f"{r.doc_hash[:8]}_1_{r.seq}") for r in got] == [("image1.png", b"one", 1, True), ("image2.png", b"two", 1, True)]


class Service(BaseHTTPRequestHandler):
    """A model's service that refuses its first call for load."""

    calls = 0

    def do_POST(self):  # noqa: N802
        body, kind = json.loads(self.rfile.read(int(self.headers["Content-Length"]))), type(self)
        kind.calls += 1
        status = 429 if kind.calls == 1 else 400 if body["model"] == "bad" else 200
        if "input" in body:
            reply = {"data": [{"index": i, "embedding": [float(len(x)), 0.0]} for i, x in reversed(list(enumerate(body["input"])))]}
        else:
            reply = {"choices": [{"message": {"content": body["messages"][-1]["content"].upper()}}]}
        self.send_response(status)
        self.end_headers()
        self.wfile.write(json.dumps(reply).encode())

    def log_message(self, *_):
        pass


def test_services(spark):
    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    address = f"http://127.0.0.1:{server.server_port}/v1"
    try:
        assert embeddings.provider("http", address=address, model="m", pause=0.0)(["a", "bcd"]) == [[1.0, 0.0], [3.0, 0.0]] and Service.calls == 2
        rows = spark.createDataFrame([(1, "ab"), (2, None), (3, " ")], "id int, text string")
        ask = lambda model: {r.id: r.reply for r in rows.select("id", models.replies(F.col("text"), models.http_chat(address, model)).alias("reply")).collect()}
        assert ask("m") == {1: "AB", 2: None, 3: None} and ask("bad")[1] is None
        with pytest.raises(models.ServiceError, match="400"):
            models.http_chat(address, "bad")("x")
    finally:
        server.shutdown()
        server.server_close()


def test_embeddings(spark):
    rows = spark.createDataFrame([("a", "some words"), ("b", "some words"), ("c", "other")], "id string, text string")
    got = {r.id: list(r.embedding) for r in embeddings.embed(rows, embeddings.provider("hashing", dim=16), dim=16).collect()}
    assert got["a"] == got["b"] != got["c"] and abs(sum(x * x for x in got["a"]) - 1) < 1e-5
    with pytest.raises(Exception, match="blank"):
        embeddings.embed(rows.withColumn("text", F.lit(" ")), embeddings.hashing(8)).collect()
    with pytest.raises(ValueError, match="no embedding provider"):
        embeddings.provider("x")


def test_stream_ingests_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in ("a", "b"):
        (tmp_path / "in" / f"{n}.txt").write_text(n)
    history = Table(spark, str(tmp_path / "history"), HISTORY, ("file_hash",))
    seen = []

    def work(due):
        seen.extend(r.path for r in due.collect())
        return due.select("file_hash", F.when(F.col("path").endswith("b.txt"), "bad file").alias("error_msg"))

    for _ in range(2):
        ingest(watch(spark, str(tmp_path / "in")), history, work, str(tmp_path / "checkpoint")).awaitTermination()
        (tmp_path / "in" / "c.txt").write_text("a")
    assert len(seen) == 2 and sorted(r.status for r in history.read().collect()) == ["failed", "success"]


def test_windows(spark):
    rows = spark.createDataFrame([("2024-01-01 00:01:00", "x", 1.0), ("2024-01-01 00:04:00", "x", 3.0), ("2024-01-01 00:06:00", "x", 5.0)], "ts string, event_type string, value double")
    assert sorted((r.n, r["mean"]) for r in windowed_counts(rows).collect()) == [(1, 5.0), (2, 2.0)]


def test_whole_pages_decide_ocr(spark, tmp_path):
    """One page of much text carries the file; short pages alone don't."""
    pages = [("carried", "x" * 2000), ("carried", ""), ("carried", None), ("short", "y" * 24), ("short", "y" * 20), ("edge", "z" * 75), ("edge", ""), ("edge", ""), ("edge", "late" * 99), ("late", " "), ("late", ""), ("late", "z" * 74), ("late", "z" * 999)]
    spark.createDataFrame([(i, s, x) for i, (s, x) in enumerate(pages)], "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id: r.ocr for r in lifecycle.q_needs_ocr(spark, str(tmp_path)).collect()} == {"carried": False, "short": True, "edge": False, "late": True}
