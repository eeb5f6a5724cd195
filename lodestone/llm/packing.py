"""Cost-balanced packing of token sequences.

Attention costs a sequence of n tokens of one document ``linear * n + quadratic * n**2``.  A task
collects its documents' ids up to ``window`` tokens and then packs them: documents in descending order
of length, each to the sequence of lowest cost so far that has room for it.  Where none has room for
the whole document it is cut, and fills the sequences of lowest cost that have room at all.  The
window's sequences have as much room as it has tokens: all of ``capacity``, and the rest in powers of
two, which need no padding.  No shuffle is needed, and a task never holds more than a window and one
document.

Edge cases: a null or empty text is the end id alone; texts of any length are cut into full sequences;
equal lengths go in input order; repeated rows are packed each; null ids are kept; an empty table gives
an empty result; further columns are not read.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from lodestone.llm.common import map_arrow, pick, texts

#: Sequences of one task are numbered from its partition's number times this.
PER_TASK = 1 << 40
#: Ids of so many distinct words are kept per Python worker, and of as many before them.
REMEMBERED = 200_000
#: Marks that the tokenizer parts from the letters before them.
MARKS = ".,!?;:%$#&*()-"
#: The characters by which byte-level vocabularies stand for bytes: printable ones for themselves, the others from 256 on.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: chr(b) for b in PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*PRINTABLE}))}


class Words(dict):
    """Packed ids of a word between blanks, by the tokenizer; white space separates and is dropped.

    Letters of one byte's code points are parted here from marks after them and written small, as the
    tokenizer would, so that a word with and without them is merged once; all else goes through the
    whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.before: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            ids = self.merged(word)
        if len(word) <= 64:
            if len(self) >= REMEMBERED:
                self.before = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def merged(self, word: str) -> bytes:
        stem = word.rstrip(MARKS)
        if not stem.isalpha() or max(stem) > "\xff":
            return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        small = stem.lower()
        if small != word:
            return self[small] + (self[word[len(stem) :]] if len(stem) < len(word) else b"")
        chars = small if small.isascii() else "".join(map(BYTE_CHARS.__getitem__, small.encode()))
        return array("I", [t.id for t in self.tokenizer.model.tokenize(chars)]).tobytes()

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(maxsize=2)
def words(path: str) -> Words:
    return Words(path)


def capacities(total: int, capacity: int) -> list[int]:
    """Rooms for ``total`` tokens: full sequences, then powers of two for the rest."""
    rest = total % capacity
    return [capacity] * (total // capacity) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(lengths: list[int], capacity: int, linear: float, quadratic: float) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece."""
    room = np.array(capacities(sum(lengths), capacity), dtype=np.int64)
    size, cost = room.copy(), np.zeros(len(room))

    def place(doc: int, start: int, n: int, seq: int) -> tuple[int, int, int, int, int]:
        offset = int(size[seq] - room[seq])
        room[seq] -= n
        cost[seq] += linear * n + quadratic * n * n
        return doc, start, n, seq, offset

    rest, full = [], 0
    for doc, n in enumerate(lengths):
        for start in range(0, n - capacity + 1, capacity):
            yield place(doc, start, capacity, full)
            full += 1
        if n % capacity:
            rest.append((n % capacity, doc))
    for n, doc in sorted(rest, key=lambda x: (-x[0], x[1])):
        start = lengths[doc] - n
        while n:
            fits = np.where(room >= n, cost, np.inf)
            seq = int(fits.argmin())
            if fits[seq] == np.inf:
                seq = int(np.where(room > 0, cost, np.inf).argmin())
            length = min(n, int(room[seq]))
            yield place(doc, start, length, seq)
            start, n = start + length, n - length


def pack_documents(
    docs: DataFrame, vocabulary: str, *, doc_id: str = "doc_id", text: str = "text", capacity: int = 4096, end_id: int = 2,
    window: int = 1 << 22, linear: float = 1.0, quadratic: float = 1 / 1024,
) -> DataFrame:
    """A row per piece: doc_id, start, length, ids (packed little-endian uint32), doc_tokens, sequence_id, offset."""
    end = np.array([end_id], dtype="<u4").tobytes()
    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    columns = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]

    def flushed(held: list[tuple[int, bytes]], first: int) -> Iterator[pa.RecordBatch]:
        lengths = [len(x) // 4 for _, x in held]
        rows = [
            (held[d][0], start, n, held[d][1][4 * start : 4 * (start + n)], lengths[d], first + seq, offset)
            for d, start, n, seq, offset in pack(lengths, capacity, linear, quadratic)
        ]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*rows), columns)], names=[n for n, _ in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, next_id = words(vocabulary), TaskContext.get().partitionId() * PER_TASK
        held, tokens = [], 0
        for batch in batches:
            for key, value in zip(batch.column("doc_id").to_pylist(), texts(batch)):
                ids = encode.ids(value) + end
                held.append((key, ids))
                tokens += len(ids) // 4
                if tokens >= window:
                    yield from flushed(held, next_id)
                    next_id += len(capacities(tokens, capacity))
                    held, tokens = [], 0
        if held:
            yield from flushed(held, next_id)

    return map_arrow(pick(docs, doc_id=doc_id, text=text), run, schema)
