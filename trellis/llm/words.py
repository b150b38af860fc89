"""Words, hashes and k-grams of whole texts, computed by numpy over Arrow's UTF-8 buffers.

A word is a maximal run of bytes of one class, so every function here works on bytes: all bytes of a character
above U+007F are of the same class in both tables below.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: bytes of words `[^\x20\x09-\x0D]+`
NONSPACE = np.ones(256, bool)
NONSPACE[[0x20, *range(0x09, 0x0E)]] = False

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_BLOCK = 1 << 20
CHUNK = 2 << 20


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_VALUE = _odd(11, 256)
#: what a word at distance j within a k-gram is multiplied by; two independent sets
GRAM, GRAM2 = _odd(12, 64), _odd(13, 64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    if not _powers:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for base in (_BASE, inverse):
            p = np.full(_BLOCK, base, np.uint64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers


def release() -> None:
    """Gives memory that is free again back to the system. Workers live on between tasks and stages, and would keep the most
    they ever had."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (murmur's finaliser)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def lower(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def spans(buf: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words; offsets has where each document begins, and the end of the last."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = is_word[buf]
    first = np.zeros(len(buf) + 1, bool)
    first[offsets] = True
    before = np.empty(len(buf), bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (first[:-1] | ~before))
    after = np.empty(len(buf), bool)
    after[-1], after[:-1] = False, inside[1:]
    return starts, np.flatnonzero(inside & (first[1:] | ~after)) + 1


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, from prefix sums of a polynomial over blocks."""
    power, inverse = _tables()
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        at = int(starts[i])
        j = int(np.searchsorted(ends, at + _BLOCK, "right"))
        if j <= i:  # a word longer than a block
            out[i] = np.frombuffer(hashlib.blake2b(buf[at : ends[i]].tobytes(), digest_size=8).digest(), np.uint64)[0]
            i += 1
            continue
        part = buf[at : int(ends[j - 1])]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_VALUE[part] * power[: len(part)], out=sums[1:])
        s, e = starts[i:j] - at, ends[i:j] - at
        out[i:j] = (sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out)


def grams(words: np.ndarray, k: int, by: np.ndarray = GRAM) -> np.ndarray:
    """The hash of each k successive words; at the last k-1 places it has no meaning. Distances from 64 on reuse
    multipliers, mixed with the round, so that any k is served."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total += words[j : j + n] * (by[j % 64] + np.uint64(2 * (j // 64)))
    return mix(total + np.uint64(k))


def lowest(values: np.ndarray, w: int) -> np.ndarray:
    """The least of each w successive values."""
    n = len(values) - w + 1
    if n <= 0:
        return values[:0]
    out = values[:n].copy()
    for j in range(1, w):
        np.minimum(out, values[j : j + n], out=out)
    return out


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts of about `size` bytes; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def by_document(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which words each document has: bounds into the words, one more than documents."""
    return np.searchsorted(starts, offsets)
