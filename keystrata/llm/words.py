"""Vectorised word work on UTF-8 bytes: spans, 64-bit word fingerprints, window fingerprints.

A word is a maximal run without the bytes 0x20 and 0x09 to 0x0D. Fingerprints are prefix sums of a
polynomial over random byte values modulo 2**64, finished by a mixing step, so a whole slice of
documents costs a few numpy passes and no Python loop over words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from . import workers

U = np.uint64
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLOCK = 1 << 19

_BASE = U(0x9E3779B97F4A7C15 | 1)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_SECOND = np.random.default_rng(1109).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_STEPS = np.random.default_rng(77).integers(1, 1 << 63, 64, dtype=np.uint64) * U(2) + U(1)
_powers = np.ones((2, 1), np.uint64)


def _power_tables(n: int) -> np.ndarray:
    global _powers
    if _powers.shape[1] < n:
        full = np.empty((2, max(n, BLOCK + 1)), np.uint64)
        for row, base in zip(full, (_BASE, _INVERSE), strict=True):
            row[:] = base
            row[0] = 1
            np.multiply.accumulate(row, out=row)
        _powers = full
    return _powers


def _forget() -> None:
    global _powers
    _powers = np.ones((2, 1), np.uint64)


workers.keeps(_forget)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every input bit reaches every output bit."""
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h ^= h >> U(29)
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(32)
    return h


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = _BYTES) -> np.ndarray:
    """Fingerprints of buf[s:e] for each span. values: of the 256 bytes; others give independent fingerprints."""
    powers = _power_tables(len(buf) + 1)
    sums = np.empty(len(buf) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values[buf] * powers[0, : len(buf)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers[1][starts] + (ends - starts).astype(np.uint64) * _STEPS[63])


def _blocks(buf: np.ndarray):
    """Ranges of about BLOCK bytes that end after a space, or at the end."""
    at = 0
    while at < len(buf):
        end = min(at + BLOCK, len(buf))
        while end < len(buf) and not IS_SPACE[buf[end - 1]]:
            ahead = np.flatnonzero(IS_SPACE[buf[end : end + BLOCK]])
            end = end + int(ahead[0]) + 1 if len(ahead) else min(end + BLOCK, len(buf))
        yield at, end
        at = end


def _spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


@dataclass
class Words:
    """Words of some documents, document after document. Those of document d: first[d] to first[d + 1]."""

    hashes: np.ndarray
    first: np.ndarray
    buf: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    second: np.ndarray | None = None

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and fingerprints of all windows of n consecutive words of one document."""
        total = len(self.hashes)
        if total < n:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        left = np.repeat(self.first[1:], np.diff(self.first)) - np.arange(total)
        at = np.flatnonzero(left >= n)
        return at, window_hashes(self.hashes, n)[at]


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of all runs of n entries (also across documents; the caller selects)."""
    count = len(h) - n + 1
    out = np.zeros(max(count, 0), np.uint64)
    for k in range(n):
        out += h[k : k + len(out)] * _STEPS[k]
    return mix(out)


def split_words(docs: list[bytes], fold: bool = False, second: bool = False) -> Words:
    """Words of each document; fold: with A-Z lower-cased; second: with a second fingerprint of each."""
    lengths = np.fromiter(map(len, docs), np.int64, len(docs))
    offsets = np.concatenate(([0], np.cumsum(lengths + 1)))
    buf = np.frombuffer(b" ".join(docs) + b" ", np.uint8) if docs else np.empty(0, np.uint8)
    if fold:
        buf = LOWER[buf]
    hashes, others, starts, ends = [], [], [], []
    for a, b in _blocks(buf):
        part = buf[a:b]
        s, e = _spans(~IS_SPACE[part])
        hashes.append(span_hashes(part, s, e))
        if second:
            others.append(span_hashes(part, s, e, _SECOND))
        starts.append(s + a)
        ends.append(e + a)
    cat = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
    starts, ends = cat(starts, np.int64), cat(ends, np.int64)
    return Words(cat(hashes, np.uint64), np.searchsorted(starts, offsets), buf, offsets, starts, ends, cat(others, np.uint64) if second else None)


def unique_in_docs(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, fingerprint) pairs; fingerprints ascend within each document."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[keep], h[keep]
