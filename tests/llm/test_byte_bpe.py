"""Chunked encoding against the library on whole texts, and exact round trips."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm.byte_bpe import decode, encode, encode_text, load, split, splitter
from lodestone.llm.queries.op10 import op10_byte_bpe

VOCABULARY = P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab'sré1234 \n\t  !?中́\x1c\u3000\u00a0\x85\u2028\u2019_-"), max_size=200), st.integers(1, 40), st.integers(1, 12))
def test_pieces_encode_like_the_whole(text, chunk, overlap):
    encoding, scan = load(*VOCABULARY), splitter(P.PATTERN)
    assert "".join(split(text, scan, chunk, overlap)) == text
    assert encode_text(text, encoding, scan, chunk, overlap) == encoding.encode_ordinary(text)


def test_long_texts_are_split_and_unbroken_runs_are_not():
    rng, scan = random.Random(1), splitter(P.PATTERN)
    text = " ".join("".join(rng.choices("abcé1'", k=rng.randint(1, 9))) for _ in range(50_000))
    encoding = load(*VOCABULARY)
    assert len(split(text, scan, 1 << 14, 1 << 10)) > 10
    assert encode_text(text, encoding, scan, 1 << 14, 1 << 10) == encoding.encode_ordinary(text)
    assert split("x" * 5_000, scan, 100, 10) == ["x" * 5_000]


@pytest.mark.parametrize("rows", [[], [(1, None, 5), (1, None, 5), (2, "", 6), (None, "héllo  wörld\n\n" * 9, None)]])
def test_rows(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, IDS int")
    out = decode(encode(df, *VOCABULARY), *VOCABULARY).collect()
    encoding = load(*VOCABULARY)
    got = sorted((r.doc_id or 0, np.frombuffer(r.ids, "<u4").tolist(), bytes(r.decoded), r.n_tokens) for r in out)
    want = sorted((i or 0, encoding.encode_ordinary(t or ""), (t or "").encode(), len(encoding.encode_ordinary(t or ""))) for i, t, _ in rows)
    assert got == want


def hard_text(chunk, chunks):
    """A blank and another white space before every multiple of ``chunk``, words around them."""
    space = [" ", " ", "　", "\x85"]
    return "".join(("word it's " * (chunk // 10 + 1))[: chunk - 2] + " " + space[i % 4] for i in range(chunks)) + "end"


def test_white_space_at_every_chunk_of_default_size():
    encoding, scan, text = load(*VOCABULARY), splitter(P.PATTERN), hard_text(1 << 16, 5)
    assert len(split(text, scan, 1 << 16, 1 << 12)) > 3
    assert encode_text(text, encoding, scan, 1 << 16, 1 << 12) == encoding.encode_ordinary(text)


def test_a_long_unbroken_run_is_scanned_a_bounded_number_of_times():
    scan, seen = splitter(P.PATTERN), []

    class Counted:
        def finditer(self, text, start, stop, **how):
            seen.append(stop - start)
            return scan.finditer(text, start, stop, **how)

    text = "ab " * 100 + "x" * 200_000 + " cd" * 100
    assert "".join(split(text, Counted(), 1000, 50)) == text
    assert sum(seen) < 6 * len(text)


def test_the_query_against_the_library(spark, tmp_path):
    texts = [None, "", "a  b\n\n c's 12345", hard_text(1 << 16, 3), "中文。" * 30_000, "   " * 30_000, "x" * 100_000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    encoding, rows = load(*VOCABULARY), {r.doc_id: r for r in op10_byte_bpe(spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        ids = encoding.encode_ordinary(text or "")
        assert rows[i].n_tokens == len(ids) and rows[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
