"""Files to answers: ingestion, search, deletion and evaluation over stores."""

from __future__ import annotations


from lodestone.api import Library, call
from lodestone.operators.response import image_counts, result_images
from lodestone.plans.ingestion import Stores, ingest
from lodestone.sources.embeddings import hashing


def test_ingest_search_delete(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "nets.md").write_text("# Neural nets\n\nNeural nets learn features by gradient descent.")
    (folder / "cats.txt").write_text("Cats sleep all day. They like fish and warm places.")
    (folder / "bad.docx").write_bytes(b"nothing")
    stores, encode = Stores(spark, str(tmp_path / "lib")), hashing(32)
    done = {r.path.rsplit("/", 1)[1]: r for r in ingest(spark, stores, str(folder), encode).collect()}
    assert done["nets.md"].success and not done["bad.docx"].success and done["bad.docx"].error
    assert ingest(spark, stores, str(folder), encode).count() == 1  # only the failed one is due again
    assert stores.index_of("default").corpus_stats().first().n == stores.chunks.read().count() == 2

    (folder / "cats.txt").write_text("Dogs bark at night.")
    ingest(spark, stores, str(folder), encode)
    texts = {r.text for r in stores.chunks.read().collect()}
    assert len(texts) == 2 and not any("Cats" in x for x in texts)
    assert stores.postings.read().filter("term = 'cat'").count() == 0

    library = Library(stores, encode)
    blocks = call(library, "query_knowledge_hub", {"query": "gradient descent"})["result"]
    assert "nets.md" in blocks[0]["text"] and blocks[-1]["text"].startswith('{"citations"')
    assert call(library, "list_collections", {})["result"] == [{"collection": "default", "n_chunks": 2}]
    assert call(library, "query_knowledge_hub", {"query": " "})["error"] == "invalid params"
    assert call(library, "nope", {})["error"] == "method not found" and call(library, "list_collections", {"x": 1})["error"] == "invalid params"
    row = stores.chunks.read().filter("doc_type = 'md'").first()
    assert call(library, "get_document_summary", {"doc_id": row.doc_id})["result"]["title"] == "Neural nets"

    golden = spark.createDataFrame([("gradient descent nets", [row.chunk_id], ["x/nets.md"]), ("bark", [], ["cats.txt"])], "query string, expected_chunk_ids array<string>, expected_sources array<string>")
    values = {(r.query_id, r.metric): r.value for r in library.evaluate(golden).collect()}
    assert values["0", "hit_rate"] == 1.0 and values["0", "source_recall"] == 1.0 and values["1", "hit_rate"] == 0.0

    gone = library.delete_document(row.source_path)
    assert gone["chunks"] == 1 and gone["history"] == 1 and stores.chunks.read().count() == 1


def test_images_of_results(spark):
    results = spark.createDataFrame([("q", "c1", 1, "a [IMAGE: i] [IMAGE: j]"), ("q", "c2", 2, "[IMAGE: i] [IMAGE: gone]")], "query_id string, chunk_id string, rank int, text string")
    images = spark.createDataFrame([("i", "/i.png", "cap"), ("j", "/j.png", None)], "image_id string, file_path string, caption string")
    files = spark.createDataFrame([("/i.png", bytearray(b"\x89PNG1")), ("/j.png", bytearray(b"\x89PNG1"))], "path string, content binary")
    got = result_images(results, images, files).collect()
    assert [(r.chunk_id, r.image_id, r.mime) for r in got] == [("c1", "i", "image/png")]
    assert sorted((r.chunk_id, r.n_images) for r in image_counts(results).collect()) == [("c1", 2), ("c2", 2)]
