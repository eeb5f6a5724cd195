"""Media columns by signature sniffing.

One Aho-Corasick pass over the bytes finds all magic bytes; a validator of the format follows each and
confirms structure and lengths.  A medium that starts at the first byte and is confirmed gives the
type, in place of a declared one that differs; confirmed media further inside are carved out by offset
and length.

Edge cases: null content is empty and has no type, so the declared one stays; a null declared type is
corrected like a wrong one; content of any length is read whole; repeated rows are read each; an empty
table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import map_arrow, parts
from lodestone.llm.media_formats import media, read_wav, write_wav

FOUND = "array<struct<type:string,offset:bigint,length:bigint>>"
_FOUND = pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))


def _each(df: DataFrame, schema: str, types: list[pa.DataType], one) -> DataFrame:
    """A row of ``schema`` for each row: its first column, then what ``one`` makes of the others."""
    names = T.StructType.fromDDL(schema).fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            made = list(zip(*map(one, *[c.to_pylist() for c in batch.columns[1:]])))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, made, types)], names=names)

    return map_arrow(df, run, schema)


def store_audio(df: DataFrame, *, key: str, payload: str) -> DataFrame:
    """key and media: each payload as the samples of an 8-bit WAV file."""
    return _each(df.select(F.col(key).alias("key"), F.col(payload).alias("payload")), f"key {df.schema[key].dataType.simpleString()}, media binary", [pa.binary()], lambda x: (write_wav(x or b""),))


def features(samples: bytes) -> str:
    """Mean, deviation, peaks and zero crossings of 8-bit samples, in whole numbers."""
    x = np.frombuffer(samples, np.uint8)
    total, square = int(x.sum(dtype=np.int64)), int((x.astype(np.int64) ** 2).sum())
    crossings = int(np.count_nonzero(np.diff(x >= 128)))
    mean = total / max(1, len(x))
    return f"mean={mean:.4f};sd={max(0.0, square / max(1, len(x)) - mean * mean) ** 0.5:.4f};min={x.min(initial=255)};max={x.max(initial=0)};crossings={crossings}"


def sniff(df: DataFrame, *, key: str, content: str, declared: str) -> DataFrame:
    """key, type, corrected, embedded, samples (of 8-bit audio, else null) and feature."""
    rows = df.select(F.col(key).alias("key"), F.col(content).alias("content"), F.col(declared).alias("declared"))

    def one(data: bytes | None, said: str | None) -> tuple:
        found = media(data or b"")
        kind = next((t for t, at, _ in found if at == 0), said)
        inside = [{"type": t, "offset": at, "length": n} for t, at, n in found if at]
        samples = read_wav(data or b"") if kind == "audio/wav" else None
        feature = f"type={kind};embedded={','.join(x['type'] for x in inside)}" + (f";{features(samples)}" if samples is not None else "")
        return kind, kind != said, inside, samples, feature

    schema = f"key {df.schema[key].dataType.simpleString()}, type string, corrected boolean, embedded {FOUND}, samples binary, feature string, media binary"
    return _each(rows, schema, [pa.string(), pa.bool_(), _FOUND, pa.binary(), pa.string(), pa.binary()], lambda data, said: (*one(data, said), data))


def carve(df: DataFrame, *, content: str, embedded: str = "embedded") -> DataFrame:
    """A row per embedded medium: the columns of ``df``, then type, offset and carved (its bytes)."""
    rows = df.select("*", F.explode(embedded).alias("__medium"))
    bytes_of = F.substring(F.col(content), (F.col("__medium.offset") + 1).cast("int"), F.col("__medium.length").cast("int"))
    return rows.withColumns({"carved_type": F.col("__medium.type"), "carved_offset": F.col("__medium.offset"), "carved": bytes_of}).drop("__medium")
