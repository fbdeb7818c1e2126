"""Tokens of whole texts as byte spans, and their hashes, without creating a
Python object per token.

A *word* is a maximal run of bytes outside ``\\x20 \\x09-\\x0D``; a *line* is
what lies between line feeds (an empty text is one empty line).  Hashes are
64-bit polynomial sums over a random byte table, finalised by a mixer; two
lanes with different tables give 96 or 128 bits.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np

from .common import mix64

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[32, 9, 10, 11, 12, 13]] = True
REGION = 1 << 20  # bytes hashed at once
_BASE = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def token_spans(buf: np.ndarray, off: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start byte, end byte, row) of every token of every row, in order."""
    n = len(off) - 1
    if kind == "lines":
        feeds = np.flatnonzero(buf == 10)
        starts = np.sort(np.concatenate([off[:-1], feeds + 1]), kind="stable")
        ends = np.sort(np.concatenate([feeds, off[1:]]), kind="stable")
        per_row = np.searchsorted(feeds, off[1:]) - np.searchsorted(feeds, off[:-1]) + 1
        return starts, ends, np.repeat(np.arange(n), per_row)
    if not len(buf):
        return (np.zeros(0, np.int64),) * 3
    inside = ~_SEPARATOR[buf]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    cuts = off[:-1][off[:-1] < len(buf)]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cuts[cuts > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(off[1:], starts, side="right")


def ink(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bytes of every token outside ``\\x20 \\x09-\\x0D``."""
    counts = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(~_SEPARATOR[buf], out=counts[1:])
    return counts[ends] - counts[starts]


@lru_cache(maxsize=4)
def _tables(lane: int):
    """Byte values, powers of the base and of its inverse modulo 2**64."""
    values = np.random.Generator(np.random.PCG64(977 + lane)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2)
    values += np.uint64(1)
    base, powers = _BASE[lane], []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.empty(REGION + 1, np.uint64)
        p[0] = 1
        done, step = 1, b
        while done < len(p):  # doubling
            take = min(done, len(p) - done)
            p[done:done + take] = p[:take] * np.uint64(pow(b, done, 1 << 64))
            done += take
        powers.append(p)
    return values, powers[0], powers[1]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    values, power, inverse = _tables(lane)
    out = np.zeros(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        first = int(starts[a])
        b = int(np.searchsorted(ends, first + REGION, side="right"))
        if b <= a:  # one token longer than a region
            d = hashlib.blake2b(buf[first:int(ends[a])].tobytes(), digest_size=16).digest()
            out[a] = int.from_bytes(d[8 * lane:8 * lane + 8], "little")
            a += 1
            continue
        size = int(ends[b - 1]) - first
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(values[buf[first:first + size]] * power[:size], out=sums[1:])
        s = starts[a:b] - first
        out[a:b] = (sums[ends[a:b] - first] - sums[s]) * inverse[s]
        a = b
    return mix64(out + (ends - starts).astype(np.uint64))


def ngram_hashes(h: np.ndarray, n: int, lane: int = 0) -> np.ndarray:
    """Hash of tokens p..p+n-1 for every p at which n tokens follow."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    base = _BASE[1 - lane]
    have, have_n, cur, cur_n, left = None, 0, h, 1, n
    while left:
        if left & 1:
            if have is None:
                have, have_n = cur, cur_n
            else:
                m = len(h) - have_n - cur_n + 1
                have = have[:m] + cur[have_n:have_n + m] * np.uint64(pow(base, have_n, 1 << 64))
                have_n += cur_n
        left >>= 1
        if left:
            m = len(h) - 2 * cur_n + 1
            cur = cur[:m] + cur[cur_n:cur_n + m] * np.uint64(pow(base, cur_n, 1 << 64))
            cur_n *= 2
    return mix64(have)


def within_row(row: np.ndarray, n: int) -> np.ndarray:
    """Whether the n tokens from p on belong to one row."""
    return row[:len(row) - n + 1] == row[n - 1:] if len(row) >= n else np.zeros(0, bool)


def first_of_row(row: np.ndarray, n_rows: int) -> np.ndarray:
    return np.searchsorted(row, np.arange(n_rows + 1))


def join_kept(buf: np.ndarray, off: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray,
              keep: np.ndarray, glue: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of each row's kept tokens joined by one ``glue`` byte."""
    size, n = len(buf), len(off) - 1
    s, e, r = starts[keep], ends[keep], row[keep]
    full = e > s
    edge = np.zeros(size + 1, np.int8)
    edge[s[full]] += 1
    edge[e[full]] -= 1
    take = np.cumsum(edge[:-1], dtype=np.int8) > 0
    later = np.ones(len(s), bool)
    if len(s):
        later[0] = False
        later[1:] = r[1:] == r[:-1]
    joints = s[later] - 1  # the byte before a later token is always a separator of the same row
    out = buf.copy()
    out[joints] = glue
    take[joints] = True
    counts = np.zeros(size + 1, np.int64)
    np.cumsum(take, out=counts[1:])
    return out[take], counts[off]
