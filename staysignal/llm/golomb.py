"""Golomb-Rice coding of sorted unsigned integers as differences.

The quotients (unary) and the remainders (fixed width) are two bit streams,
so that encoding and decoding are array operations.  Layout: count u32,
remainder width u8, quotient bytes u32, first value u64, quotients, remainders.
"""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<IBIQ")


def encode(values: np.ndarray) -> bytes:
    """``values``: sorted uint64, repeats allowed."""
    n = len(values)
    if n == 0:
        return _HEAD.pack(0, 0, 0, 0)
    gaps = np.diff(values)
    k = 0
    if n > 1:
        mean = float(values[-1] - values[0]) / (n - 1)
        k = max(0, int(np.log2(mean * 0.6931 + 1e-9))) if mean > 1.5 else 0
    q = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(q + 1)  # a zero bit closes each quotient
    unary = np.ones(int(ends[-1]) if n > 1 else 0, np.uint8)
    unary[ends - 1] = 0
    packed = np.packbits(unary).tobytes()
    bits = np.empty((n - 1, k), np.uint8)
    for j in range(k):
        bits[:, j] = (gaps >> np.uint64(j)) & np.uint64(1)
    return _HEAD.pack(n, k, len(packed), int(values[0])) + packed + np.packbits(bits.ravel()).tobytes()


def size(blob: bytes, at: int = 0) -> int:
    """Bytes that the code at ``at`` takes."""
    n, k, m, _ = _HEAD.unpack_from(blob, at)
    return _HEAD.size + m + ((max(n, 1) - 1) * k + 7) // 8


def decode(blob: bytes, at: int = 0) -> np.ndarray:
    n, k, m, first = _HEAD.unpack_from(blob, at)
    if n == 0:
        return np.zeros(0, np.uint64)
    at += _HEAD.size
    unary = np.unpackbits(np.frombuffer(blob, np.uint8, m, at))
    closes = np.flatnonzero(unary == 0)[:n - 1]
    gaps = (np.diff(closes, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    at += m
    if k and n > 1:
        bits = np.unpackbits(np.frombuffer(blob, np.uint8, ((n - 1) * k + 7) // 8, at))[:(n - 1) * k].reshape(n - 1, k)
        for j in range(k):
            gaps += bits[:, j].astype(np.uint64) << np.uint64(j)
    out = np.empty(n, np.uint64)
    out[0] = first
    np.cumsum(gaps, out=out[1:])
    out[1:] += np.uint64(first)
    return out
