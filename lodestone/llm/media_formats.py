"""Media formats: magic bytes and validators that confirm structure and give the length in bytes.

A validator takes the content and the place of the magic bytes and returns the length of the medium
that starts there, or 0 if its structure or its lengths are not those of the format.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left, bisect_right
from functools import lru_cache

import ahocorasick

PDF_END = re.compile(rb"startxref\s+(\d{1,15})\s+%%EOF")
PDF_TABLE = re.compile(rb"xref\b|\d+\s+\d+\s+obj\b")


def png(data: bytes, at: int) -> int:
    here, seen = at + 8, 0
    while here + 12 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, here)
        end = here + 12 + n
        if end > len(data) or (not seen and (kind != b"IHDR" or n != 13)):
            return 0
        if zlib.crc32(data[here + 4 : end - 4]) != struct.unpack_from(">I", data, end - 4)[0]:
            return 0
        if kind == b"IEND":
            return end - at
        here, seen = end, seen + 1
    return 0


def _sub_blocks(data: bytes, here: int) -> int:
    """The place after a GIF's chain of sub-blocks, or 0."""
    while here < len(data):
        if data[here] == 0:
            return here + 1
        here += 1 + data[here]
    return 0


def gif(data: bytes, at: int) -> int:
    if at + 13 > len(data):
        return 0
    here = at + 13 + (3 << ((data[at + 10] & 7) + 1) if data[at + 10] & 0x80 else 0)
    while here and here < len(data):
        if data[here] == 0x3B:
            return here + 1 - at
        if data[here] == 0x21:
            here = _sub_blocks(data, here + 2)
        elif data[here] == 0x2C and here + 10 < len(data):
            flags = data[here + 9]
            here = _sub_blocks(data, here + 11 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0))
        else:
            return 0
    return 0


def jpeg(data: bytes, at: int) -> int:
    here, scanned = at + 2, False
    while here + 4 <= len(data) and data[here] == 0xFF:
        kind = data[here + 1]
        if kind == 0xFF:
            here += 1
            continue
        n = struct.unpack_from(">H", data, here + 2)[0]
        if n < 2 or kind < 0xC0 or kind == 0xD8:
            return 0
        here += 2 + n
        if kind == 0xDA:  # entropy-coded data, up to the next marker that isn't a restart
            scanned = True
            while 0 <= (here := data.find(b"\xff", here)) < len(data) - 1 and (data[here + 1] == 0 or 0xD0 <= data[here + 1] <= 0xD7):
                here += 2
            if here < 0 or here + 2 > len(data):
                return 0
        if data[here : here + 2] == b"\xff\xd9":
            return here + 2 - at if scanned else 0
    return 0


def bmp(data: bytes, at: int) -> int:
    if at + 26 > len(data):
        return 0
    size, reserved, pixels, header = struct.unpack_from("<IIII", data, at + 2)
    return size if reserved == 0 and header in (12, 40, 52, 56, 64, 108, 124) and 14 + header <= pixels <= size <= len(data) - at else 0


def riff_chunks(data: bytes, at: int) -> dict[bytes, tuple[int, int]] | None:
    """Place and length of the first chunk of each kind, or None if they don't fill the file's size."""
    if at + 12 > len(data):
        return None
    end, here, found = at + 8 + struct.unpack_from("<I", data, at + 4)[0], at + 12, {}
    if end > len(data):
        return None
    while here + 8 <= end:
        kind, n = struct.unpack_from("<4sI", data, here)
        found.setdefault(kind, (here + 8, n))
        here += 8 + n + n % 2
    return found if here == end else None


def wav(data: bytes, at: int) -> int:
    found = riff_chunks(data, at) if data[at + 8 : at + 12] == b"WAVE" else None
    return 8 + struct.unpack_from("<I", data, at + 4)[0] if found and found.get(b"fmt ", (0, 0))[1] >= 16 and b"data" in found else 0


def webp(data: bytes, at: int) -> int:
    found = riff_chunks(data, at) if data[at + 8 : at + 12] == b"WEBP" else None
    return 8 + struct.unpack_from("<I", data, at + 4)[0] if found and found.keys() & {b"VP8 ", b"VP8L", b"VP8X"} else 0


def _ogg_page(data: bytes, at: int) -> tuple[int, int, int]:
    """Flags, serial number and end of the page at ``at``; an end of 0 if there is no whole page."""
    if data[at : at + 4] != b"OggS" or at + 27 > len(data) or data[at + 4]:
        return 0, 0, 0
    table = data[at + 27 : at + 27 + data[at + 26]]
    end = at + 27 + len(table) + sum(table)
    return data[at + 5], struct.unpack_from("<I", data, at + 14)[0], end if len(table) == data[at + 26] and end <= len(data) else 0


@lru_cache(maxsize=1)
def ogg_media(data: bytes) -> dict[int, int]:
    """Place and length of every Ogg medium, in one pass.

    A medium begins with the first pages of all its streams, goes on without gaps, and ends with the last
    page of the last stream that is open.
    """
    found: dict[int, int] = {}
    begun, open_, heads = -1, set(), False
    here = data.find(b"OggS")
    while here >= 0:
        flags, serial, end = _ogg_page(data, here)
        first = bool(end and flags & 2)
        if first and not (begun >= 0 and heads):
            begun, open_, heads = here, set(), True
        elif not end or serial not in open_ and not first:
            begun = -1
        if end and begun >= 0:
            heads = first
            open_.add(serial)
            if flags & 4:
                open_.discard(serial)
            if not open_:
                found[begun], begun = end - begun, -1
        after = end or here + 4
        here = data.find(b"OggS", after)
        if here != after:
            begun = -1
    return found


def ogg(data: bytes, at: int) -> int:
    return ogg_media(data).get(at, 0)


@lru_cache(maxsize=1)
def pdf_marks(data: bytes) -> tuple[list[int], list[int], list[int], list[re.Match]]:
    """Places of headers, of startxref and of end marks, and the end marks that say where their table lies."""
    places = (lambda mark: [m.start() for m in re.finditer(mark, data)])
    return places(rb"%PDF-"), places(rb"startxref"), places(rb"%%EOF"), list(PDF_END.finditer(data))


def pdf(data: bytes, at: int) -> int:
    """Up to the last end mark before the next header, as a file that was saved again holds several.

    A header before any end mark is that of a PDF stored inside: then the end is the first mark whose
    cross-reference table lies where it says, counted from here, or a later one before a further header.
    """
    headers, starts, marks, tables = pdf_marks(data)
    after = lambda places, x: places[i] if (i := bisect_left(places, x)) < len(places) else -1
    start, stop = after(starts, at), after(headers, at + 5)
    if 0 <= stop < start:
        own = (m.end() for m in tables[bisect_left(tables, start, key=re.Match.start) :] if PDF_TABLE.match(data, at + int(m[1])) and at + int(m[1]) < m.start())
        if end := next(own, 0):
            start, stop = end - 5, after(headers, end)
    if start < 0:
        return 0
    last = bisect_right(marks, stop - 5 if stop >= 0 else len(data)) - 1
    end = marks[last] if last >= 0 and marks[last] >= start else after(marks, start)
    return end + 5 - at if end >= 0 else 0


@lru_cache(maxsize=1)
def archives(data: bytes) -> dict[int, int]:
    """Place and length of every archive: an end record tells where its archive begins."""
    found: dict[int, int] = {}
    end = data.find(b"PK\x05\x06")
    while 0 <= end <= len(data) - 22:
        size, offset, comment = struct.unpack_from("<IIH", data, end + 12)
        if end + 22 + comment <= len(data):
            found.setdefault(end - size - offset, end + 22 + comment - (end - size - offset))
        end = data.find(b"PK\x05\x06", end + 4)
    return found


def archive(data: bytes, at: int) -> int:
    return archives(data).get(at, 0)


#: Media type, magic bytes.
SIGNATURES = (
    ("image/png", b"\x89PNG\r\n\x1a\n", png),
    ("image/gif", b"GIF87a", gif),
    ("image/gif", b"GIF89a", gif),
    ("image/jpeg", b"\xff\xd8\xff", jpeg),
    ("image/bmp", b"BM", bmp),
    ("audio/wav", b"RIFF", wav),
    ("image/webp", b"RIFF", webp),
    ("audio/ogg", b"OggS", ogg),
    ("application/pdf", b"%PDF-", pdf),
    ("application/zip", b"PK\x03\x04", archive),
)


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """One automaton for all magic bytes; bytes are read as characters of the same number."""
    found = ahocorasick.Automaton()
    for magic in {m for _, m, _ in SIGNATURES}:
        found.add_word(magic.decode("latin-1"), (len(magic), [(t, check) for t, m, check in SIGNATURES if m == magic]))
    found.make_automaton()
    return found


def media(data: bytes) -> list[tuple[str, int, int]]:
    """(type, offset, length) of every medium whose structure holds, in order of offset."""
    found = []
    for last, (n, kinds) in automaton().iter(data.decode("latin-1")):
        at = last + 1 - n
        found += [(kind, at, length) for kind, check in kinds if (length := check(data, at))]
    return sorted(found, key=lambda x: (x[1], -x[2], x[0]))


def write_wav(samples: bytes, rate: int = 8000) -> bytes:
    """Unsigned 8-bit mono samples as a WAV file."""
    pad = b"\0" * (len(samples) % 2)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples + pad


def read_wav(data: bytes) -> bytes | None:
    """The samples of an 8-bit mono WAV file, else None."""
    found = riff_chunks(data, 0) if wav(data, 0) else None
    if not found:
        return None
    coding, channels, _, _, _, bits = struct.unpack_from("<HHIIHH", data, found[b"fmt "][0])
    at, n = found[b"data"]
    return data[at : at + n] if (coding, channels, bits) == (1, 1, 8) else None
