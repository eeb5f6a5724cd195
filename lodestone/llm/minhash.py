"""Shingle sets and circulant MinHash signatures.

Two permutations make every coordinate: the first spreads a set's elements over ``UNIVERSE`` places, the
second is read at those places after a circular shift, one more for each coordinate, and the least value
is the coordinate.  Reading a window of the second permutation gives all shifts of one element at once.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash

UNIVERSE = 1 << 20
#: Elements whose windows are held at once.
AT_ONCE = 4096
#: Distinct words whose hashes are kept per Python worker.
REMEMBERED = 200_000
_ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that leaves no pattern."""
    x = (x ^ (x >> np.uint64(30))) * _ODD[1]
    x = (x ^ (x >> np.uint64(27))) * _ODD[2]
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_hashes = WordHashes()


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``width`` words; a shorter text is one run.

    A-Z count as a-z; words are parted by the ASCII blanks.
    """
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    n = len(words) - width + 1
    total = np.full(n, np.uint64(width), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            total = mix(total * _ODD[0] + h[i : i + n])
    return np.unique(total)


@lru_cache(maxsize=2)
def windows(length: int, seed: int) -> np.ndarray:
    """Row p holds the second permutation at p, p - 1, ... around the circle, ``length`` of them."""
    permuted = np.random.default_rng(seed).permutation(UNIVERSE).astype(np.int32)
    around = np.concatenate([permuted, permuted[: length - 1]])
    return np.lib.stride_tricks.sliding_window_view(around, length)


def signature(elements: np.ndarray, length: int, seed: int = 7) -> np.ndarray:
    """``length`` coordinates of a set that isn't empty."""
    places = (mix(elements + np.uint64(seed)) >> np.uint64(44)).astype(np.int64)
    table, least = windows(length, seed), np.full(length, UNIVERSE, np.int32)
    for start in range(0, len(places), AT_ONCE):
        np.minimum(least, table[places[start : start + AT_ONCE]].min(axis=0), out=least)
    return least


def band_keys(coordinates: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of ``rows`` coordinates; a band's number is part of its key."""
    bands = coordinates.reshape(-1, rows).astype(np.uint64)
    keys = mix(np.arange(1, len(bands) + 1, dtype=np.uint64) * _ODD[0])
    with np.errstate(over="ignore"):
        for i in range(rows):
            keys = mix(keys * _ODD[0] + bands[:, i])
    return keys.view(np.int64)


def odd_sketch(elements: np.ndarray) -> np.ndarray:
    """A bit for each of 2 to 4 places an element (64 at least): whether the elements that fall there are odd in number.

    Two sketches differ in a place only if the sets differ in an element that falls there, so that the number of places
    in which they differ is at most the number of elements that only one of the sets has.
    """
    places = max(64, 2 << max(0, len(elements) - 1).bit_length())
    odd = np.bincount((elements & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def fold(sketch: np.ndarray, length: int) -> np.ndarray:
    """The sketch of the same set, or of a set in each row, over ``length`` words, a power of two that isn't more than it has."""
    while sketch.shape[-1] > length:
        half = sketch.shape[-1] // 2
        sketch = sketch[..., :half] ^ sketch[..., half:]
    return sketch


def fingerprint(elements: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for the whole set."""
    digest = xxhash.xxh3_128_digest(elements.tobytes())
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)
