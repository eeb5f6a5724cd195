"""Embedding providers: a registry of functions of texts, run as Arrow batches."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Embed = Callable[[list[str]], list[list[float]]]


def hashing(dim: int = 256) -> Embed:
    """Signed hashing of words, of norm 1: needs no service and gives equal texts equal vectors."""
    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * dim
            for word in re.findall(r"\w+", text.lower()):
                h = zlib.crc32(word.encode())
                v[h % dim] += 1.0 if h >> 31 else -1.0
            norm = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / norm for x in v])
        return out

    return embed


def http(**options) -> Embed:
    """Vectors of a service; its options are those of ``models.http_embedding``."""
    from lodestone.sources.models import http_embedding

    return http_embedding(**options)


PROVIDERS: dict[str, Callable[..., Embed]] = {"hashing": hashing, "http": http}


def provider(name: str, **options) -> Embed:
    if name not in PROVIDERS:
        raise ValueError(f"no embedding provider {name!r}; there are {', '.join(sorted(PROVIDERS))}")
    return PROVIDERS[name](**options)


def embed(rows: DataFrame, encode: Embed, *, text: str = "text", batch: int = 64, dim: int | None = None) -> DataFrame:
    """``rows`` with embedding; blank texts, and vectors of another number or length than asked, fail the job."""
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in texts:
            values = some.tolist()
            if any(not (v or "").strip() for v in values):
                raise ValueError("texts to embed must not be blank")
            made: list[list[float]] = []
            for start in range(0, len(values), batch):
                made += encode(values[start : start + batch])
            if len(made) != len(values) or (dim and any(len(v) != dim for v in made)):
                raise ValueError("the embedding provider gave other vectors than asked")
            yield pd.Series(made, index=some.index)

    return rows.withColumn("embedding", run(F.col(text)))
