"""Every id in exactly one piece, sequences gapless, ids as the library gives them."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestone.llm.packing import capacities, pack, pack_documents, words

VOCABULARY = P.path("word_bpe_49k.json")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=60))
def test_pack_covers_all_without_padding(lengths):
    pieces = list(pack(lengths, 64, 1.0, 0.1))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for doc, start, n, seq, offset in pieces:
        by_doc[doc].append((start, n))
        by_seq[seq].append((offset, n))
    for doc, n in enumerate(lengths):
        at = 0
        for start, length in sorted(by_doc[doc]):
            assert start == at
            at += length
        assert at == n
    for seq, size in enumerate(capacities(sum(lengths), 64)):
        at = 0
        for offset, length in sorted(by_seq[seq]):
            assert offset == at
            at += length
        assert at == size


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet=st.sampled_from("abAÉéßÿªµ́1's \n\t　!?中Σ<|endoftext|>"), max_size=80))
def test_ids_are_the_library_s(text):
    assert np.frombuffer(words(VOCABULARY).ids(text), "<u4").tolist() == Tokenizer.from_file(VOCABULARY).encode(text, add_special_tokens=False).ids


def test_rows(spark):
    rows = [(1, "Hello world " * 3000, "x"), (2, None, None), (2, "", ""), (None, "a b", "y"), (5, "same", "z"), (5, "same", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, OFFSET string").repartition(2)
    tokenizer = Tokenizer.from_file(VOCABULARY)
    out = pack_documents(df, VOCABULARY, window=2000).collect()
    assert sum(r.length for r in out) == sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _ in rows)
    ids = b"".join(bytes(r.ids) for r in sorted((r for r in out if r.doc_id == 1), key=lambda r: r.start))
    assert np.frombuffer(ids, "<u4").tolist() == [*tokenizer.encode(rows[0][1], add_special_tokens=False).ids, 2]
    assert pack_documents(df.limit(0), VOCABULARY).count() == 0
