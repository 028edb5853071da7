"""Word shingles of whole batches of texts, and their MinHash sketches, in numpy.

Words are runs of bytes outside ASCII white space; a shingle is `width` words in a row. A text
with fewer words, but at least one, has all its words as its only shingle. Shingles are named
by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

HASHES = 128
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _random(name: str, n: int, kind: type = np.uint64) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(hashlib.shake_128(name.encode()).digest(n * size), kind).copy()


_BYTE = _random("bytes", 256)
_PLACE = _random("places", 64) | np.uint64(1)
_FACTOR = _random("factors", HASHES, np.uint32) | np.uint32(1)
_SHIFT = _random("shifts", HASHES, np.uint32)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit words."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


KEPT_BITS = 18  # larger tables are made anew for each very long text, so that no worker keeps them


def _powers(bits: int, inverse: bool) -> np.ndarray:
    return _kept_powers(bits, inverse) if bits <= KEPT_BITS else _made_powers(bits, inverse)


@lru_cache(maxsize=2 * KEPT_BITS)
def _kept_powers(bits: int, inverse: bool) -> np.ndarray:
    return _made_powers(bits, inverse)


def _made_powers(bits: int, inverse: bool) -> np.ndarray:
    base = pow(_BASE, -1, 1 << 64) if inverse else _BASE
    out = np.full(1 << bits, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and begin of each word of a byte string."""
    space = _SPACE[data]
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    begins, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    bits = max(10, int(len(data)).bit_length())
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(bits, False)[: len(data)], out=sums[1:])
    words = (sums[ends] - sums[begins]) * _powers(bits, True)[begins]
    return mixed(words + (ends - begins).astype(np.uint64)), begins


def shingle_sets(texts: list[bytes | None], width: int, slice_bytes: int = 1 << 17) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; several texts are hashed at once."""
    at = 0
    while at < len(texts):
        parts, total = [], 0
        while at < len(texts) and (not parts or total + len(texts[at] or b"") <= slice_bytes):
            parts.append(texts[at] or b"")
            total += len(parts[-1]) + 1
            at += 1
        data = np.frombuffer(b" ".join(parts), np.uint8)
        words, begins = _word_hashes(data)
        starts = np.cumsum([0, *(len(p) + 1 for p in parts)])
        border = np.searchsorted(begins, starts)
        n = len(words) - width + 1
        grams = np.zeros(max(n, 0), np.uint64)
        for i in range(width):
            grams += words[i : i + max(n, 0)] * _PLACE[i]
        grams = mixed(grams)
        for a, b in zip(border[:-1].tolist(), border[1:].tolist(), strict=True):
            if b - a >= width:
                yield np.unique(grams[a : b - width + 1])
            elif b > a:
                few = mixed((words[a:b] * _PLACE[: b - a]).sum(keepdims=True) + np.uint64(b - a))
                yield few
            else:
                yield np.empty(0, np.uint64)


def minhash(shingles: np.ndarray, step: int = 2048) -> np.ndarray:
    """Least value of each of the hash functions over a set (not empty)."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), step):
        values = low[i : i + step, None] * _FACTOR[None, :]
        values += _SHIFT[None, :]
        np.minimum(least, values.min(axis=0), out=least)
    return least


def set_key(shingles: np.ndarray) -> bytes:
    """128-bit name of a set."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
