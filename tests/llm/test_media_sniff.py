"""Each format's validator, carving, and the exact round trip of stored payloads."""

from __future__ import annotations

import hashlib
import io
import struct
import time
import wave
import zipfile
import zlib

import pytest

from lodestone.llm.media_formats import media, read_wav, write_wav
from lodestone.llm.media_sniff import carve, sniff, store_audio
from lodestone.llm.queries.op7 import op7_media_sniff


def chunk(kind, data):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


PNG = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")
GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0" * 6 + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00\x3b"
JPEG = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"ab\xff\xda" + struct.pack(">H", 3) + b"x" + b"\x01\xff\x00\x02\xff\xd9"
BMP = b"BM" + struct.pack("<IIII", 58, 0, 54, 40) + b"\0" * 40
OGG = b"OggS\0\x06" + b"\0" * 20 + b"\x01\x03abc"
PDF = b"%PDF-1.4\nstartxref\n0\n%%EOF"
WEBP = b"RIFF" + struct.pack("<I", 16) + b"WEBPVP8 " + struct.pack("<I", 4) + b"abcd"


def archive():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a", "b" * 50)
    return out.getvalue()


SAMPLES = {"image/png": PNG, "image/gif": GIF, "image/jpeg": JPEG, "image/bmp": BMP, "audio/ogg": OGG, "application/pdf": PDF, "image/webp": WEBP, "audio/wav": write_wav(b"\x80" * 9), "application/zip": archive()}


@pytest.mark.parametrize("kind", SAMPLES)
def test_formats(kind):
    data = SAMPLES[kind]
    assert (kind, 0, len(data)) in media(data)
    assert (kind, 7, len(data)) in media(b"padding" + data + b"tail")
    assert not [x for x in media(data[:-1]) if x[0] == kind]


def test_wav_is_a_wav():
    with wave.open(io.BytesIO(write_wav(b"abcd"))) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.readframes(9)) == (1, 1, b"abcd")
    assert read_wav(write_wav(b"abc")) == b"abc" and read_wav(PNG) is None


def test_types_are_corrected_and_media_carved(spark):
    rows = [(1, bytearray(PNG), "image/jpeg", "x"), (2, bytearray(b"text " + GIF + b" BM " + PNG), "text/plain", "x"), (3, None, "a/b", None), (4, bytearray(b""), None, None), (1, bytearray(PNG), "image/png", "y")]
    out = sniff(spark.createDataFrame(rows, "id long, content binary, declared string, MEDIA string"), key="id", content="content", declared="declared")
    got = sorted((r.key, r.type or "", r.corrected) for r in out.collect())
    assert got == [(1, "image/png", False), (1, "image/png", True), (2, "text/plain", False), (3, "a/b", False), (4, "", False)]
    assert sorted((r.carved_type, bytes(r.carved)) for r in carve(out, content="media").collect()) == [("image/gif", GIF), ("image/png", PNG)]


def test_query_round_trip(spark, tmp_path):
    texts = [None, "", "a" * 576, "é" * 300, "RIFF" + "x" * 5000, "é" * 300]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in op7_media_sniff(spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        data = (text or "").encode()
        padded = data + b"\xff" * (-len(data) % 576 or (0 if data else 576))
        assert (rows[i].n_bytes, rows[i].payload_bytes, rows[i].payload_sha256) == (len(data), len(padded), hashlib.sha256(padded).hexdigest())
        assert rows[i].tail_crc32 == zlib.crc32(padded[-32:]) and rows[i].media_sha256 == hashlib.sha256(write_wav(padded)).hexdigest()
    assert rows[3].feature == rows[5].feature and rows[3].feature.startswith("type=audio/wav")
    assert store_audio(spark.createDataFrame([], "k long, p binary"), key="k", payload="p").count() == 0


def document(inner=b"", saved=1):
    """A PDF with a stream in it, saved so many times; each end mark says where its table lies."""
    out = b"%PDF-1.4\n1 0 obj\nstream\n" + inner + b"\nendstream\n"
    for _ in range(saved):
        place = len(out)
        out += b"xref\n0 1\ntrailer\nstartxref\n%d\n%%%%EOF\n" % place
    return out[:-1]


def test_pdfs_with_several_end_marks():
    pdfs = lambda data: [(at, n) for kind, at, n in media(data) if kind == "application/pdf"]
    for saved in (1, 2, 3):
        data = document(saved=saved)
        assert pdfs(b"padding" + data + b" tail") == [(7, len(data))]
        assert pdfs(data + document()) == [(0, len(data)), (len(data), len(document()))]
        outer = document(inner=document(saved=2), saved=saved)
        assert pdfs(outer)[0] == pdfs(outer + data)[0] == (0, len(outer))


def test_archives_in_an_archive():
    out, inner = io.BytesIO(), archive()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.zip", inner)
        z.writestr("b.zip", inner)
        z.comment = b"said"
    outer = out.getvalue()
    zips = [(at, n) for kind, at, n in media(b"padding" + outer + b"tail") if kind == "application/zip"]
    assert zips == [(7, len(outer)), (7 + outer.index(inner), len(inner)), (7 + outer.rindex(inner), len(inner))]


def page(flags, serial=0, body=b"abc"):
    return b"OggS\0" + bytes([flags]) + b"\0" * 8 + struct.pack("<I", serial) + b"\0" * 8 + bytes([1, len(body)]) + body


def oggs(data):
    return [(at, n) for kind, at, n in media(data) if kind == "audio/ogg"]


def test_an_ogg_stream_is_one_medium():
    stream = page(2) + page(0) * 5 + page(4)
    both = page(2, 1) + page(2, 2) + page(0, 1) + page(4, 2) + page(0, 1) + page(4, 1)
    assert oggs(b"padding" + stream + b"tail") == [(7, len(stream))]
    assert oggs(stream + both + stream) == [(0, len(stream)), (len(stream), len(both)), (len(stream + both), len(stream))]
    assert oggs(page(2) + page(0) + stream) == [(len(page(2) + page(0)), len(stream))]
    assert not oggs(stream[len(page(2)) :]) and not oggs(both[: -len(page(4))]) and not oggs(page(2) + b"gap" + page(4)) and not oggs(page(2) + page(4, 9))


@pytest.mark.parametrize("data", [
    page(2) + page(0) * 100_000 + page(4), page(2) * 100_000, (page(2) + page(4)) * 50_000, b"%PDF-1.4 " * 100_000, document(saved=2) * 20_000, b"PK\x03\x04" * 100_000, b"\xff\xd8\xff\xe0\0\4ab" * 100_000,
    document() + b"%PDF-1.4 " * 100_000,
])
def test_long_content_in_one_pass(data):
    began = time.perf_counter()
    media(data)
    assert time.perf_counter() - began < 20


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id long, content binary, declared string, media string, `a.b` int")
    out = sniff(none, key="id", content="content", declared="declared")
    assert out.count() == 0 and carve(out, content="media").count() == 0


def test_very_long_content(spark):
    content = bytearray(b"x" * 3_000_000 + PNG + b"y" * 3_000_000 + GIF)
    rows = sniff(spark.createDataFrame([(1, content, None)] * 2, "id long, content binary, declared string"), key="id", content="content", declared="declared").collect()
    assert all([(x["type"], x["offset"]) for x in r.embedded] == [("image/png", 3_000_000), ("image/gif", 6_000_000 + len(PNG))] for r in rows) and len(rows) == 2
