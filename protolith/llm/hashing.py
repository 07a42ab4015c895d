"""Vectorised 64-bit hashes of bytes, words and shingles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from .common import groups_of

#: An odd base of polynomial hashes and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of text that a kernel holds at once, beyond one document's.
CHUNK = 1 << 20


@lru_cache(4)
def powers(n: int, base: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    k = 1
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * np.uint64(pow(base, k, 1 << 64))
        k += m
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers; changes x."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of bytes, A-Z lower-cased, and the words' starts; words are runs without white space."""
    n = len(data)
    space = np.ones(n + 2, bool)
    space[1:-1] = _SPACE[data]
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[::2], edges[1::2]
    size = 1 << max(12, int(n).bit_length())
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * powers(size, BASE)[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * powers(size, INVERSE)[starts]), starts


def shingles(texts: list[str | None], width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the text, its sorted distinct shingle hashes) of each text; a shorter text's words are one shingle."""
    raw = [(t or "").encode() for t in texts]
    for i, j in groups_of([len(r) + 1 for r in raw], CHUNK):
        data = np.frombuffer(b"\n".join(raw[i:j]), np.uint8)
        w, at = words(data)
        bounds = np.searchsorted(at, np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw[i:j]])]))
        n = len(w) - width + 1
        s = np.zeros(max(0, n), np.uint64)
        for k in range(width):
            if n > 0:
                s = mix(s * np.uint64(BASE) + w[k : k + n])
        for k in range(j - i):
            a, b = bounds[k], bounds[k + 1]
            if b - a >= width:
                own = np.sort(s[a : b - width + 1])
                yield i + k, own[np.concatenate([[True], own[1:] != own[:-1]])]
            elif b > a:
                h = np.full(1, b - a, np.uint64)
                for x in w[a:b]:
                    h = mix(h * np.uint64(BASE) + x)
                yield i + k, h
            else:
                yield i + k, np.empty(0, np.uint64)
