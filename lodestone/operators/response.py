"""Answers of a search: images of results, Markdown, and the reference block."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestone.functions.numeric import mime_type
from lodestone.functions.text import image_ids, snippet

#: Images of one result, and the part of an image by which it is told from others.
MOST_IMAGES, HEAD = 5, 100


def result_images(results: DataFrame, images: DataFrame, files: DataFrame) -> DataFrame:
    """query_id, chunk_id, place, image_id, mime, data (base64) and caption of results' placeholders.

    An image counts once a query, by the beginning of its data; one whose file is gone is left out.
    images has image_id, file_path and caption, files path and content.
    """
    asked = results.select("query_id", "chunk_id", "rank", F.posexplode(F.slice(image_ids(F.col("text")), 1, MOST_IMAGES)).alias("place", "image_id"))
    held = asked.join(images.select("image_id", "file_path", "caption"), "image_id").join(files.select(F.col("path").alias("file_path"), "content"), "file_path")
    rows = held.withColumns({"data": F.base64("content"), "mime": mime_type(F.col("file_path"), F.col("content"))})
    first = W.partitionBy("query_id", F.substring("data", 1, HEAD)).orderBy("rank", "place")
    return rows.withColumn("__n", F.row_number().over(first)).filter("__n = 1").select("query_id", "chunk_id", "place", "image_id", "mime", "data", "caption")


def image_counts(results: DataFrame) -> DataFrame:
    ids = F.slice(image_ids(F.col("text")), 1, MOST_IMAGES)
    return results.select("query_id", "chunk_id", F.size(ids).alias("n_images"), (F.size(ids) > 0).alias("has_images"))


def cited(results: DataFrame) -> DataFrame:
    """Results with what a citation shows; page is null unless it is a whole number."""
    page = F.expr("try_cast(coalesce(page, page_num) AS int)")
    return results.select("query_id", F.col("rank").alias("index"), "chunk_id", F.col("source_path").alias("source"), F.round("score", 4).alias("score"), snippet(F.col("text"), 200).alias("text_snippet"), page.alias("page"))


def markdown(question: str, rows: list[Row]) -> str:
    """The answer's text: a numbered entry for each cited result."""
    if not rows:
        return f"No results for: {question}"
    lines = [f"## Results for: {question}", ""]
    for r in sorted(rows, key=lambda x: x["index"]):
        page = f", page {r.page}" if getattr(r, "page", None) is not None else ""
        lines += [f"### [{r['index']}] {r.source or 'unknown'}{page} (score {r.score:.4f})", "", r.text_snippet, ""]
    return "\n".join(lines).rstrip()


def content_blocks(question: str, rows: list[Row], images: list[Row]) -> list[dict]:
    """Text, images (each with its caption) and the references as JSON."""
    blocks: list[dict] = [{"type": "text", "text": markdown(question, rows)}]
    for i in images:
        blocks.append({"type": "image", "data": i.data, "mimeType": i.mime})
        if i.caption:
            blocks.append({"type": "text", "text": f"[{i.image_id}] {i.caption}"})
    references = [r.asDict() for r in rows]
    return [*blocks, {"type": "text", "text": json.dumps({"citations": references}, ensure_ascii=False)}]
