"""Vectorised word streams: whole Arrow batches of texts become numpy arrays of word hashes.

A word is a maximal run of ASCII letters and digits and of non-ASCII characters, lower-cased.
Hashes depend on the bytes of a word alone, so they agree between executors and runs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_CHUNK = 400_000  # characters of text worked on at once

_WORD = np.zeros(256, bool)
_WORD[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8)] = True
_WORD[128:] = True
_SYMBOL = ~_WORD
_SYMBOL[:33] = False
_SYMBOL[127] = False
_powers: dict[str, np.ndarray] = {"up": np.ones(1, U), "down": np.ones(1, U)}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public splitmix64 constants)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def salted(x: np.ndarray, salt: int) -> np.ndarray:
    return mix(x + U((salt * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF))


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        step = np.full(max(n, _CHUNK * 2), U(_BASE if kind == "up" else _INV))
        step[0] = U(1)
        have = _powers[kind] = np.cumprod(step)
    return have[:n]


@dataclass
class Words:
    """Words of several documents: word i covers bytes [start, end) of buf; doc d has words bounds[d]:bounds[d + 1]."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray
    sums: np.ndarray

    def _span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        down = _power("down", len(self.sums))
        return mix((self.sums[end] - self.sums[start]) * down[start] + (end - start).astype(U))

    @property
    def hash(self) -> np.ndarray:
        return self._span(self.start, self.end)

    def prefix(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Which words are longer than n bytes, and the hashes of their first n bytes."""
        long = np.flatnonzero(self.end - self.start > n)
        return long, self._span(self.start[long], self.start[long] + n)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def chunks(texts: list, limit: int = _CHUNK):
    """Slices (lo, hi) of a batch with about limit characters each; a longer text stands alone, whole."""
    lo = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > lo and size + n > limit:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(mask[1:] != mask[:-1]) + 1
    return edge[::2], edge[1::2]


def words(texts: list, symbols: bool = False) -> Words:
    """The words of texts (null: empty); with symbols, the runs of other visible ASCII characters instead."""
    coded = [(t.lower().encode("utf-8", "replace") if t else b"") for t in texts]
    buf = np.frombuffer(b"\n" + b"\n".join(coded) + b"\n", np.uint8)
    sizes = np.fromiter(map(len, coded), np.int64, len(coded))
    offsets = np.concatenate(([0], np.cumsum(sizes + 1))) + 1
    start, end = _runs((_SYMBOL if symbols else _WORD)[buf])
    sums = np.zeros(len(buf) + 1, U)
    np.cumsum((buf.astype(U) + U(1)) * _power("up", len(buf)), out=sums[1:])
    return Words(buf, start, end, np.searchsorted(start, offsets), sums)


def shingles(w: Words, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of every run of n words; a shorter document with words has one shingle, all its words."""
    h, bounds = w.hash, w.bounds
    count = np.diff(bounds)
    doc = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(h)) - bounds[:-1][doc]
    keep = (place <= count[doc] - n) | ((place == 0) & (count[doc] < n))
    at, doc = np.flatnonzero(keep), doc[keep]
    size = np.minimum(n, count[doc])
    out = np.full(len(at), U(0x5851F42D4C957F2D))
    for k in range(n):
        has = size > k
        out[has] = mix(out[has] * U(3) + h[at[has] + k] + U(k))
    return out, doc
