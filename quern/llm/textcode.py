"""Vectorised words, word hashes and n-gram hashes over Arrow text columns.

Everything works on UTF-8 bytes. The word patterns in use never split a
multi-byte character, so bytes give the same words as characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Texts are taken together up to this many bytes; a longer text is taken alone.
CHUNK_BYTES = 1 << 20
_U = np.uint64
_RADIX = 0x9E3779B97F4A7C15  # odd, so powers have inverses modulo 2**64
_rng = np.random.default_rng(20240229)
_BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_GRAM_CODE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)
_BYTE_CODE[65:91] = _BYTE_CODE[97:123]  # A-Z count as a-z

#: Bytes of words: all but white space, and letters, digits and non-ASCII only.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    ALNUM[_a:_b] = True


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_RADIX, -1, 1 << 64)
    return tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)])) for base in (_RADIX, inverse))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits of 64-bit values."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each text starts, with the end."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``limit`` bytes each."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield first, last
        first = last


def word_hashes(texts: pa.Array, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, A-Z lower-cased, and the place of each text's first word, with the end."""
    data, offsets = text_bytes(texts)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = word_bytes[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts_of_texts = offsets[:-1][offsets[:-1] < len(data)]
    first[starts_of_texts] = inside[starts_of_texts]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    ends = np.flatnonzero(last)
    n = 1 << max(10, (len(data) - 1).bit_length())
    up, down = _powers(n)
    total = np.cumsum(_BYTE_CODE[data] * up[: len(data)])
    before = np.where(starts > 0, total[starts - 1], _U(0))
    return mix((total[ends] - before) * down[starts]), np.searchsorted(starts, offsets)


def grams(words: np.ndarray, places: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of k words inside a text, and the place of each text's first run, with the end."""
    counts = np.maximum(np.diff(places) - k + 1, 0)
    out = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])
    if len(words) < k:
        return np.zeros(0, np.uint64), out
    n = len(words) - k + 1
    total = words[:n] * _GRAM_CODE[0]
    for j in range(1, k):
        total += words[j : j + n] * _GRAM_CODE[j]
    at = np.arange(out[-1]) + np.repeat(places[:-1] - out[:-1], counts)
    return mix(total[at]), out


def list_column(values: np.ndarray, places: np.ndarray) -> pa.Array:
    """One list of 64-bit integers for each text."""
    return pa.ListArray.from_arrays(pa.array(places.astype(np.int32)), pa.array(values.view(np.int64)))
