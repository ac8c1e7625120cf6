"""Vectorised numpy primitives over UTF-8 bytes.

A word is a maximal run of bytes outside [\\x20\\x09-\\x0D]; bytes.split() uses the same set, and no byte of a
multi-byte UTF-8 character falls into it, so byte words are the code-point words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_MIX = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_pw = np.ones(1, np.uint64)
_ipw = np.ones(1, np.uint64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that a slice of documents may hold while a kernel works on it; a longer document is a slice of its own.
SLICE_BYTES = 1 << 18


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pw, _ipw
    if len(_pw) < n:
        size = max(n, 2 * SLICE_BYTES)
        for name, base in (("_pw", _BASE), ("_ipw", _INV)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            globals()[name] = np.cumprod(x)
    return _pw, _ipw


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] = B**i * hash of buf[i:j], modulo 2**64."""
    pw, _ = _powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_MIX[buf] * pw[: len(buf)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, ipw = _powers(len(prefix))
    return mix64((prefix[end] - prefix[start]) * ipw[start])


def window_hash(prefix: np.ndarray, width: int) -> np.ndarray:
    """Hash of each width-byte string, by start."""
    n = len(prefix) - width
    if n <= 0:
        return np.zeros(0, np.uint64)
    _, ipw = _powers(len(prefix))
    return mix64((prefix[width:] - prefix[:n]) * ipw[:n])


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    word = np.zeros(len(buf) + 2, np.int8)
    word[1:-1] = ~SPACE[buf]
    edge = np.diff(word)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def gram_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive entries."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for j in range(n):
        out = out * np.uint64(0x9FB21C651E98DF25) + (h[j : j + m] ^ (h[j : j + m] >> np.uint64(29)))
    return mix64(out)


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    lo = used = 0
    for k, x in enumerate(texts):
        if k > lo and used + len(x) > SLICE_BYTES:
            yield lo, k
            lo, used = k, 0
        used += len(x) + 1
    if lo < len(texts):
        yield lo, len(texts)


class Joined:
    """A slice of documents in one buffer, each followed by a blank."""

    def __init__(self, texts: list[bytes]):
        self.buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        self.size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.end = np.cumsum(self.size + 1)
        self.start = self.end - self.size - 1

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.end, at, "right")

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sum of flags (one for each byte) in each document."""
        total = np.zeros(len(self.buf) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.end - 1] - total[self.start]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, end, hash and document of each word."""
        s, e = word_spans(self.buf)
        return s, e, span_hash(prefix_hash(self.buf), s, e), self.doc_of(s)


def grams_in_docs(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first entry of each n-gram that stays inside a document."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[n - 1 :] == doc[: len(doc) - n + 1])
    return gram_hash(h, n)[at], at
