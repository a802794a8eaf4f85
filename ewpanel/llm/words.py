"""Hashes of words and word shingles of whole texts, vectorised over Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ewpanel.llm.common import mix64, utf8_parts

_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: For each byte: a 64-bit value, equal for A-Z and a-z; and whether it is ASCII white space.
_VALUE = mix64(np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint64) + np.uint64(1))
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, up to n."""
    if len(_powers[0]) <= n:
        inverse = pow(_BASE, -1, 1 << 64)
        for k, base in enumerate((_BASE, inverse)):
            table = np.full(n + 1, np.uint64(base))
            table[0] = 1
            _powers[k] = np.cumprod(table, dtype=np.uint64)
    return _powers


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word ([^\\x20\\x09-\\x0D]+, A-Z lower-cased) and the n + 1 offsets of each text's words."""
    data, offsets = utf8_parts(texts)
    if len(data) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_WHITE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _power_tables(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * power[: len(data)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * inverse[starts]), np.searchsorted(starts, offsets)


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its ``width``-word shingles.

    A text with fewer words has its whole sequence as one shingle, one without
    words none.
    """
    words, offsets = word_hashes(texts)
    n = len(words)
    rolled = np.zeros(n, np.uint64)
    for j in range(width):
        moved = np.zeros(n, np.uint64)
        moved[: n - j] = words[j:] if j < n else 0
        rolled = mix64(rolled * np.uint64(31) + moved + np.uint64(j + 1))
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        m = b - a
        if m >= width:
            s = np.sort(rolled[a : b - width + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif m:
            h = np.full(1, m, np.uint64)
            for j in range(a, b):
                h = mix64(h * np.uint64(31) + words[j : j + 1])
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
