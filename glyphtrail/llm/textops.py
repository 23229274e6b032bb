"""Vectorised byte-level text primitives shared by the Python-side operators.

Words are maximal runs of bytes outside ``\\x20\\x09-\\x0D``; A-Z count as a-z.
Every hash is a fixed function of the bytes (no per-process seed), so a task that
is run again on another executor gives the same values.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SHINGLE = 5
#: Bytes of text handled at once; one longer text is handled alone.
BLOCK_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 2**64, 256, dtype=U64)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = int(_rng.integers(0, 2**63, dtype=U64)) * 2 + 1
_BASE_INV = pow(_BASE, -1, 2**64)
_PLACE = _rng.integers(0, 2**64, 64, dtype=U64) | U64(1)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective avalanche of 64-bit integers."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def _powers_of(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 4096)
        steps = np.full(size, U64(base), U64)
        steps[0] = U64(1)
        have = np.multiply.accumulate(steps)
        if n <= BLOCK_BYTES + 4096:
            _powers[base] = have
    return have[:n]


class Words:
    """The words of several texts, flat: ``start``/``end`` byte positions in
    ``buf``, 64-bit ``hash`` of each, and ``first[i]:first[i + 1]`` for text i."""

    def __init__(self, texts: list[bytes]):
        blob = b" ".join(texts) + b" "
        buf = np.frombuffer(blob, np.uint8)
        inside = ~_SPACE[buf]
        change = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            change = np.concatenate(([0], change))
        self.buf = buf
        self.start, self.end = change[0::2], change[1::2]
        pre = np.zeros(len(buf) + 1, U64)
        np.cumsum(_BYTE[buf] * _powers_of(_BASE, len(buf)), out=pre[1:])
        raw = (pre[self.end] - pre[self.start]) * _powers_of(_BASE_INV, len(buf))[self.start]
        self.hash = mix(raw + (self.end - self.start).astype(U64))
        lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts)) + 1
        self.text_start = np.concatenate(([0], np.cumsum(lengths)))
        self.first = np.searchsorted(self.start, self.text_start)

    def shingles(self, i: int, size: int = SHINGLE) -> np.ndarray:
        """Sorted distinct hashes of the word n-grams of text i; of its whole
        word sequence if that is shorter; empty if it has no word."""
        return np.unique(gram_hashes(self.hash[self.first[i] : self.first[i + 1]], size))


def gram_hashes(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    n = len(words)
    if not n:
        return np.zeros(0, U64)
    size = min(size, n)
    total = np.zeros(n - size + 1, U64)
    for t in range(size):
        total += words[t : n - size + 1 + t] * _PLACE[t]
    return mix(total + U64(size))


def blocks(texts: Iterable[bytes | None]) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts) in runs of about BLOCK_BYTES; null is empty."""
    run: list[bytes] = []
    size = at = 0
    for i, t in enumerate(texts):
        t = t or b""
        if run and size + len(t) > BLOCK_BYTES:
            yield at, run
            run, size, at = [], 0, i
        run.append(t)
        size += len(t)
    if run:
        yield at, run


def shingle_sets(texts: Iterable[bytes | None], size: int = SHINGLE) -> Iterator[np.ndarray]:
    for _, run in blocks(texts):
        words = Words(run)
        for i in range(len(run)):
            yield words.shingles(i, size)


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches in smaller ones, so that few texts are Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    return [t or b"" for t in batch.column(column).cast(pa.large_binary()).to_pylist()]


class Spans:
    """Hashes of any byte spans of several texts, bytes mapped by ``table`` first;
    ``runs`` gives the maximal runs of bytes for which ``inside`` holds."""

    def __init__(self, texts: list[bytes], table: np.ndarray, inside: np.ndarray):
        self.buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts)) + 1
        self.text_start = np.concatenate(([0], np.cumsum(lengths)))
        self._pre = np.zeros(len(self.buf) + 1, U64)
        np.cumsum(table[self.buf] * _powers_of(_BASE, len(self.buf)), out=self._pre[1:])
        self._inv = _powers_of(_BASE_INV, len(self.buf) + 1)
        ok = np.zeros(len(self.buf) + 2, bool)
        ok[1:-1] = inside[self.buf]
        change = np.flatnonzero(ok[1:] != ok[:-1])
        self.start, self.end = change[0::2], change[1::2]
        self.first = np.searchsorted(self.start, self.text_start)

    def hash(self, start: np.ndarray, end: np.ndarray | None = None, length: int = 0) -> np.ndarray:
        """Of the bytes start:end, or of ``length`` bytes from start."""
        stop = start + length if end is None else end
        return mix((self._pre[stop] - self._pre[start]) * self._inv[start] + (stop - start).astype(U64))

    def per_text(self, at: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        """Sum of the weights (or count) of byte positions by text."""
        text = np.searchsorted(self.text_start, at, "right") - 1
        return np.bincount(text, weights, len(self.text_start) - 1)


def byte_table(mapped: dict[bytes, bytes] | None = None) -> np.ndarray:
    """Fixed random values of the bytes; ``mapped`` makes a byte count as another."""
    out = np.random.Generator(np.random.PCG64(77)).integers(0, 2**64, 256, dtype=U64)
    for a, b in (mapped or {}).items():
        for x, y in zip(a, b, strict=True):
            out[x] = out[y]
    return out


def byte_class(members: bytes, letters: bool = True, high: bool = True) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    if letters:
        out[65:91] = out[97:123] = True
    if high:
        out[128:] = True
    return out
