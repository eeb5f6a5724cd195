"""Byte-level BPE encoding and decoding by overlapping chunks.

A text longer than ``chunk`` plus ``overlap`` characters is cut into chunks that overlap; shorter ones are one
piece.  Every chunk is pre-tokenised by itself, in parallel threads; where the scans of two neighbours have a
boundary in common they have resynchronised, and the text is split there.  The pieces are encoded one by
one, and because no pre-token crosses a split, joining their ids gives the ids of the whole text.  A cut at
which the scans don't meet inside the overlap is dropped: the pieces beside it stay one.  Decoding
looks up each id's bytes and joins them.

A scan sees no further than its window, so only boundaries are certain from which to the window's end there
is more than one pre-token can hold (see ``SURE``).  A piece is matched again by itself, so it never ends in white
space, the one thing that patterns look beyond (``\\s+(?!\\S)``).

Edge cases: a null text is an empty one and has no ids; texts of any length are encoded whole; repeated
rows are encoded each; an empty table gives an empty result; all other columns are carried along, and an
output column takes the place of an input column of its name.  Null ids decode to no bytes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestone.llm.common import map_arrow, parts, texts

#: Fixed value: the characters that Unicode calls white space, for engines whose own class differs.
WHITE_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


@lru_cache(maxsize=4)
def load(path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file, kept per Python worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def token_bytes(path: str, pattern: str) -> list[bytes]:
    encoding = load(path, pattern)
    table = [b""] * (encoding.max_token_value + 1)
    for token in encoding.token_byte_values():
        table[encoding.encode_single_token(token)] = token
    return table


@lru_cache(maxsize=4)
def splitter(pattern: str) -> regex.Pattern:
    """The pre-token pattern for the scan of boundaries, with white space spelled out."""
    pattern = pattern.replace(r"[^\s", f"[^{WHITE_SPACE}").replace(r"\S", f"[^{WHITE_SPACE}]").replace(r"\s", f"[{WHITE_SPACE}]")
    return regex.compile(pattern)


#: No pre-token of the published patterns holds a letter or digit, then other characters than marks and apostrophes,
#: and then a letter or digit again.
SURE = regex.compile(r"[\p{L}\p{N}][^\p{L}\p{N}\p{M}'\u2019]+[\p{L}\p{N}]")


def sight(text: str, start: int, stop: int) -> int:
    """The last place from which to ``stop`` there is more than one pre-token holds; ``start`` if there is none."""
    if stop == len(text):
        return stop
    size = 64
    while True:
        low, last = max(start, stop - size), None
        for last in SURE.finditer(text, low, stop, concurrent=True):
            pass
        if last is not None or low == start:
            return last.start() if last else start
        size *= 8


def boundaries(text: str, start: int, stop: int, pattern: regex.Pattern) -> list[int]:
    """Certain pre-token boundaries of a scan from ``start``, whatever stands behind ``stop``."""
    found, end = [start], sight(text, start, stop)
    for match in pattern.finditer(text, start, stop, concurrent=True):
        if match.end() > end:
            break
        found.append(match.end())
    return found


def split(text: str, pattern: regex.Pattern, chunk: int, overlap: int) -> list[str]:
    """Pieces of ``text`` between positions where neighbouring scans agree."""
    if len(text) <= chunk + overlap:
        return [text] if text else []
    starts = list(range(0, len(text), chunk))
    with ThreadPoolExecutor() as pool:
        scans = list(pool.map(lambda s: boundaries(text, s, min(len(text), s + chunk + overlap), pattern), starts))
    cuts, certain, missed = [0], scans[0], 0
    for start, scan in zip(starts[1:], scans[1:], strict=True):
        met = sorted(p for p in set(certain).intersection(scan) if p >= start)
        if met:
            certain, missed = [p for p in scan if p >= met[0]], 0
            at = next((p for p in met if not text[p - 1].isspace()), len(text))
            if cuts[-1] < at < len(text):
                cuts.append(at)
        else:  # the left scan goes on from its last certain boundary; each time it is to see twice as far
            missed += 1
            if missed & (missed - 1) == 0:
                certain = boundaries(text, certain[-1], min(len(text), start + missed * chunk + overlap), pattern)
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)]


def encode_text(text: str, encoding: tiktoken.Encoding, pattern: regex.Pattern, chunk: int, overlap: int) -> list[int]:
    ids: list[int] = []
    for piece in encoding.encode_ordinary_batch(split(text, pattern, chunk, overlap), num_threads=1):
        ids += piece
    return ids


def _with(schema: T.StructType, **fields: T.DataType) -> T.StructType:
    """``schema`` with further fields, in place of those of the same name."""
    kept = [f for f in schema.fields if f.name.lower() not in {n.lower() for n in fields}]
    return T.StructType(kept + [T.StructField(n, t) for n, t in fields.items()])


def _replaced(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    names = {n.lower() for n in columns}
    kept = {n: batch.column(i) for i, n in enumerate(batch.schema.names) if n.lower() not in names}
    return pa.RecordBatch.from_pydict(kept | columns)


def encode(df: DataFrame, vocabulary: str, pattern: str, *, text: str = "text", chunk: int = 1 << 16, overlap: int = 1 << 12) -> DataFrame:
    """``df`` with ids (little-endian unsigned 32-bit integers, binary) and n_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, scan = load(vocabulary, pattern), splitter(pattern)
        for batch in parts(batches):
            packed = [np.array(encode_text(value, encoding, scan, chunk, overlap), dtype="<u4").tobytes() for value in texts(batch, text)]
            yield _replaced(batch, ids=pa.array(packed, pa.binary()), n_tokens=pa.array([len(x) // 4 for x in packed], pa.int64()))

    return map_arrow(df, run, _with(df.schema, ids=T.BinaryType(), n_tokens=T.LongType()))


def decode(df: DataFrame, vocabulary: str, pattern: str, *, ids: str = "ids") -> DataFrame:
    """``df`` with decoded (binary): the bytes of all ids, joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(vocabulary, pattern)
        for batch in parts(batches):
            rows = (np.frombuffer(x or b"", dtype="<u4").tolist() for x in batch.column(ids).to_pylist())
            yield _replaced(batch, decoded=pa.array([b"".join(map(table.__getitem__, x)) for x in rows], pa.binary()))

    return map_arrow(df, run, _with(df.schema, decoded=T.BinaryType()))
