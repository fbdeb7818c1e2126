"""Sets of word n-grams of whole texts, their identity and minhash values."""

from __future__ import annotations

import numpy as np

from .common import mix64, text_buffer
from .spans import ngram_hashes, span_hashes, token_spans

_KEY = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def sets(column, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All rows' sorted distinct shingles end to end with their n+1 offsets, and two
    64-bit identities of each set.  A text of fewer than n words, but at
    least one, has the one shingle of all its words; other texts have none."""
    buf, off = text_buffer(column)
    starts, ends, row = token_spans(buf, off, "words")
    h = span_hashes(buf, starts, ends)
    grams = ngram_hashes(h, n)
    first = np.searchsorted(row, np.arange(len(off)))
    parts = []
    for a, b in zip(first, first[1:]):
        if b - a >= n:
            parts.append(np.unique(grams[a:b - n + 1]))
        else:
            parts.append(ngram_hashes(h[a:b], int(b - a)) if b > a else h[:0])
    cuts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=cuts[1:])
    values = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    sums = [np.zeros(len(values) + 1, np.uint64) for _ in _KEY]
    for s, k in zip(sums, _KEY):
        np.cumsum(mix64(values ^ k), out=s[1:])
    k1, k2 = ((s[cuts[1:]] - s[cuts[:-1]]) for s in sums)
    return values, cuts, k1.view(np.int64), k2.view(np.int64)


def minhashes(values: np.ndarray, cuts: np.ndarray, t: int, rows_at_once: int = 256) -> np.ndarray:
    """(rows, t) uint32 minhash values; rows with an empty set get 0."""
    odd = np.random.Generator(np.random.PCG64(31)).integers(0, 1 << 63, t, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros((len(cuts) - 1, t), np.uint32)
    full = np.flatnonzero(cuts[1:] > cuts[:-1])
    for i in range(0, len(full), rows_at_once):
        rows = full[i:i + rows_at_once]
        a, b = cuts[rows[0]], cuts[rows[-1] + 1]
        v, at = values[a:b], cuts[rows] - a
        for c in range(t):
            out[rows, c] = np.minimum.reduceat(v * odd[c], at) >> np.uint64(32)
    return out
