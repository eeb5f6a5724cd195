"""Ids, hashes, scores, vectors and geometry on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; null if either norm is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def similarity_score(cos: Column) -> Column:
    """max(0, 1 - d / 2) of the cosine distance d = 1 - cos."""
    return F.greatest(F.lit(0.0), 0.5 + 0.5 * cos)


def idf(n: Column, df: Column) -> Column:
    """Without smoothing: negative for terms of more than half the chunks."""
    return F.ln((n - df + 0.5) / (df + 0.5))


def bm25_part(idf_: Column, tf: Column, dl: Column, avgdl: Column, k1: float = 1.5, b: float = 0.75) -> Column:
    mean = F.when(avgdl == 0, 1.0).otherwise(avgdl)
    return idf_ * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * dl / mean))


def rrf_score(rank: Column, k: int = 60) -> Column:
    if k <= 0:
        raise ValueError(f"k must be positive, got {k}")
    return F.lit(1.0) / (F.lit(k) + rank)


def hash8(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 8)


def document_id(content: Column) -> Column:
    return F.concat(F.lit("doc_"), F.substring(F.sha2(content, 256), 1, 16))


def draft_chunk_id(doc_id: Column, index: Column, text: Column) -> Column:
    return F.concat_ws("_", doc_id, F.format_string("%04d", index), hash8(text))


def chunk_id(source_path: Column, index: Column, text: Column) -> Column:
    """The stored id: hash of the path, index, hash of the final text."""
    return F.concat_ws("_", hash8(source_path), F.format_string("%04d", index), hash8(text))


def image_id(doc_hash: Column, page: Column, seq: Column) -> Column:
    return F.concat_ws("_", F.substring(doc_hash, 1, 8), page.cast("string"), seq.cast("string"))


def centre_distance(a: Column, b: Column) -> Column:
    """Squared distance of two boxes' centres."""
    mid = lambda box, lo, hi: (box[lo] + box[hi]) / 2
    return F.pow(mid(a, "x0", "x1") - mid(b, "x0", "x1"), F.lit(2)) + F.pow(mid(a, "top", "bottom") - mid(b, "top", "bottom"), F.lit(2))


def box_size_ok(box: Column, least: float = 50.0) -> Column:
    return (F.abs(box["x1"] - box["x0"]) >= least) & (F.abs(box["bottom"] - box["top"]) >= least)


def flip_box(box: Column, height: Column) -> Column:
    """A box measured from the bottom of the page, measured from its top."""
    return F.struct(box["x0"].alias("x0"), (height - box["top"]).alias("top"), box["x1"].alias("x1"), (height - box["bottom"]).alias("bottom"))


def scaled_size(width: Column, height: Column, most: int) -> Column:
    """Width and height shrunk to fit a square of ``most``, in whole pixels."""
    ratio = F.least(F.lit(1.0), F.try_divide(F.lit(float(most)), width), F.try_divide(F.lit(float(most)), height))
    return F.struct((width * ratio).cast("int").alias("width"), (height * ratio).cast("int").alias("height"))


#: Media types by file extension, and by first bytes.
BY_EXTENSION = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp"}
BY_BYTES = {"89504E47": "image/png", "FFD8FF": "image/jpeg", "47494638": "image/gif", "52494646": "image/webp", "424D": "image/bmp"}
#: Fixed value: what tells a WebP image from other RIFF files.
RIFF_KIND = "57454250"


def mime_type(path: Column, content: Column) -> Column:
    extension, head = F.lower(F.regexp_extract(path, r"\.([^.]+)$", 1)), F.hex(F.substring(content, 1, 8))
    found = F.lit(None).cast("string")
    for magic, kind in BY_BYTES.items():
        riff = F.hex(F.substring(content, 9, 4)) == RIFF_KIND if kind == "image/webp" else F.lit(True)
        found = F.coalesce(found, F.when(head.startswith(magic) & riff, kind))
    known = F.create_map(*[F.lit(x) for pair in BY_EXTENSION.items() for x in pair])
    return F.coalesce(F.try_element_at(known, extension), found, F.lit("image/png"))


def stored_metadata(metadata: Column) -> Column:
    """A metadata map as the store keeps it: null values dropped, an empty map marked."""
    kept = F.map_filter(metadata, lambda _, v: v.isNotNull())
    return F.when(F.size(kept) > 0, kept).otherwise(F.create_map(F.lit("_placeholder"), F.lit("true")))


def shown_metadata(metadata: Column, internal: tuple[str, ...] = ("text", "chunk_id", "source_ref", "chunk_index")) -> Column:
    return F.map_filter(metadata, lambda k, _: ~k.isin(*internal) & ~k.startswith("_"))


def version_stamp(*knobs: Column) -> Column:
    return F.substring(F.sha2(F.to_json(F.struct(*knobs)), 256), 1, 16)
