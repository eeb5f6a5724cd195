"""Files: discovery, readers by provider, parsing, and replay of what was parsed before."""

from __future__ import annotations

import hashlib
import html
import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.numeric import document_id, image_id
from lodestone.functions.text import first_title


def discover(spark: SparkSession, path: str, extensions: tuple[str, ...] = (".pdf",)) -> DataFrame:
    """path, modificationTime, length and content of files below ``path`` with one of the extensions, in either case."""
    names = [x.lstrip(".") for x in extensions]
    pattern = "*.{" + ",".join(sorted({y for x in names for y in (x.lower(), x.upper())})) + "}"
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)


def hashed(files: DataFrame) -> DataFrame:
    return files.withColumn("file_hash", F.sha2("content", 256))


#: Styles of a word processor's headings, and XML names.
W_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _runs(element: ET.Element) -> str:
    return "".join(t.text or "" for t in element.iter(f"{W_NS}t")).strip()


def _paragraph(paragraph: ET.Element) -> str:
    text, style = _runs(paragraph), paragraph.find(f"{W_NS}pPr/{W_NS}pStyle")
    name = (style.get(f"{W_NS}val") or "").lower() if style is not None else ""
    level = 1 if name == "title" else int(re.sub(r"\D", "", name) or 0) if name.startswith("heading") else 0
    return f"{'#' * min(level, 6)} {text}" if text and level else text


def _grid(table: ET.Element) -> str:
    """Rows as a Markdown table, the first as its head; short rows are filled up."""
    rows = [[" ".join(filter(None, map(_runs, cell.iter(f"{W_NS}p")))).replace("|", "\\|") for cell in row.findall(f"{W_NS}tc")] for row in table.findall(f"{W_NS}tr")]
    width = max(map(len, rows), default=0)
    if not width:
        return ""
    shown = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([shown[0], "|" + " --- |" * width, *shown[1:]])


def docx_text(content: bytes) -> str:
    """Paragraphs and tables in page order as Markdown: Title and Heading n styles become # marks."""
    with zipfile.ZipFile(io.BytesIO(content)) as package:
        body = ET.fromstring(package.read("word/document.xml")).find(f"{W_NS}body")

    def blocks(element: ET.Element) -> Iterator[str]:
        for child in element:
            if child.tag == f"{W_NS}p":
                yield _paragraph(child)
            elif child.tag == f"{W_NS}tbl":
                yield _grid(child)
            else:
                yield from blocks(child)

    return "\n\n".join(filter(None, blocks(body))) if body is not None else ""


def docx_media(files: DataFrame) -> DataFrame:
    """image_id, doc_hash, page, seq, name and content of the media in word processor files, by name; all are on page 1.

    A file that can't be opened has none.
    """
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as package:
                        names = sorted(n for n in package.namelist() if n.startswith("word/media/") and not n.endswith("/"))
                        made = [(hashlib.sha256(content).hexdigest(), i, n.rsplit("/", 1)[1], package.read(n)) for i, n in enumerate(names, 1)]
                except (zipfile.BadZipFile, OSError, RuntimeError):
                    continue
                yield pd.DataFrame(made, columns=["doc_hash", "seq", "name", "content"])

    rows = files.filter(F.lower("path").endswith(".docx")).select("content").mapInPandas(read, "doc_hash string, seq int, name string, content binary")
    return rows.select(image_id(F.col("doc_hash"), F.lit(1), F.col("seq")).alias("image_id"), "doc_hash", F.lit(1).alias("page"), "seq", "name", "content")


def html_text(content: bytes) -> str:
    text = re.sub(r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ", content.decode("utf-8", "replace"))
    return re.sub(r"\s*\n\s*", "\n", html.unescape(re.sub(r"<[^>]+>", "\n", text))).strip()


def pdf_text(content: bytes) -> str:
    """Text of all pages under page headers, by pypdf where it is installed."""
    try:
        from pypdf import PdfReader
    except ImportError as missing:
        raise RuntimeError("reading PDF needs the pypdf package") from missing
    pages = PdfReader(io.BytesIO(content)).pages
    return "\n".join(f"--- PAGE {i} ---\n{page.extract_text()}" for i, page in enumerate(pages, 1))


def plain_text(content: bytes) -> str:
    return content.decode("utf-8", "replace")


#: Readers by provider, and providers by extension.  A layout model's reader is registered by its user.
PARSERS: dict[str, Callable[[bytes], str]] = {"pdf_text": pdf_text, "pdf": pdf_text, "docx": docx_text, "html": html_text, "text": plain_text}
EXTENSIONS = {"pdf": "pdf_text", "docx": "docx", "html": "html", "htm": "html", "txt": "text", "md": "text"}


def register(provider: str, parser: Callable[[bytes], str], *extensions: str) -> None:
    PARSERS[provider] = parser
    EXTENSIONS.update({x.lstrip(".").lower(): provider for x in extensions})


def parser(provider: str) -> Callable[[bytes], str]:
    if provider not in PARSERS:
        raise ValueError(f"no parser {provider!r}; there are {', '.join(sorted(PARSERS))}")
    return PARSERS[provider]


def parse(files: DataFrame, provider: str | None = None) -> DataFrame:
    """doc_id, source_path, doc_hash, text, title and error of files; by extension unless a provider is named.

    A file that can't be parsed gives its error and no text; it fails nothing else.
    """
    if provider is not None:
        parser(provider)
    parsers, extensions = dict(PARSERS), dict(EXTENSIONS)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    name = provider or extensions[path.rsplit(".", 1)[-1].lower()]
                    made.append((path, content, parsers[name](bytes(content)), None))
                except Exception as error:
                    made.append((path, content, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(made, columns=["path", "content", "text", "error"])

    rows = files.select("path", "content").mapInPandas(read, "path string, content binary, text string, error string")
    return rows.select(
        document_id(F.col("content")).alias("doc_id"), F.col("path").alias("source_path"), F.sha2("content", 256).alias("doc_hash"), "text",
        first_title(F.col("text")).alias("title"), "error",
    )


def batches(documents: DataFrame, size: int) -> DataFrame:
    """doc_id, first and last page of each batch; one open batch where pages aren't known or all fit."""
    n = F.col("n_pages")
    one = n.isNull() | (F.lit(size) <= 0) | (n <= size)
    starts = F.when(one, F.array(F.lit(1))).otherwise(F.sequence(F.lit(1), n, F.lit(max(1, size))))
    rows = documents.select("doc_id", "n_pages", F.explode(starts).alias("first_page"))
    return rows.select("doc_id", "first_page", F.when(~one, F.least(F.col("first_page") + size - 1, n)).alias("last_page"))


def needs_ocr(pages: DataFrame, mode: str = "auto", *, probe: int = 3, least: int = 25) -> DataFrame:
    """doc_id and ocr: with 'auto', whether the first pages hold fewer than ``least`` characters each."""
    if mode in ("always", "never"):
        return pages.select("doc_id").distinct().withColumn("ocr", F.lit(mode == "always"))
    seen = pages.filter(F.col("page") <= probe).groupBy("doc_id").agg(F.sum(F.length(F.trim("text"))).alias("chars"), F.count(F.lit(1)).alias("n"))
    return seen.select("doc_id", (F.coalesce("chars", F.lit(0)) < F.col("n") * least).alias("ocr"))


def replay(files: DataFrame, cache: DataFrame, stamp: Column) -> tuple[DataFrame, DataFrame]:
    """What the cache has for files under this stamp, and files that must be parsed.

    cache has file_hash, version_stamp, batch, n_batches and text; an entry counts if all its batches are there.
    """
    held = cache.filter(F.col("version_stamp") == stamp)
    whole = held.groupBy("file_hash").agg(F.count_distinct("batch").alias("n"), F.max("n_batches").alias("of")).filter("n = of").select("file_hash")
    hits = held.join(whole, "file_hash").join(files.select("file_hash", "path"), "file_hash")
    texts = hits.groupBy("file_hash", "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("batch", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return texts, files.join(whole, "file_hash", "left_anti")


def cached(cache: DataFrame, parsed: DataFrame) -> DataFrame:
    """The parse cache with new entries (file_hash, version_stamp, batch, n_batches, text) in place of those of the same files."""
    return cache.join(parsed.select("file_hash").distinct(), "file_hash", "left_anti").unionByName(parsed)
