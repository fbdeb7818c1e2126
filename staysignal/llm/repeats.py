"""Removal of repeated token runs (words or lines) across a corpus.

A run of ``window`` tokens is a repeat if the same token sequence also starts
earlier: in a smaller id, or earlier in the same document.  Every token that
a repeat covers goes; runs are judged on the input, not on what is left.

1. Anchors.  Each chunk of documents sends hashes of its anchors to their
   owners, Golomb coded, and gets back those that match elsewhere.
   ``blocks``: non-overlapping reference blocks of ``window // 2`` tokens,
   probed with every rolling block of that length (each run of ``window``
   tokens holds a whole reference block).  ``winnow``: the smallest token
   hash of every ``window`` consecutive tokens (equal runs choose equally).
2. Extension.  A matched anchor is extended to both sides to all runs of
   ``window`` tokens that hold it; the runs' 96-bit keys go to their owners,
   which tell each chunk what an earlier chunk has already.  Overlapping
   repeats join to maximal repeated passages.  With ``single``, every token
   of that many bytes is an anchor and also a run by itself.
3. Each chunk deletes its repeats.

Chunks hold consecutive ids, so "earlier" between chunks is the smaller
chunk.  A token sequence that a third of all documents share travels once
per chunk; no list of its places is ever built.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import golomb
from .chunks import CHUNK_BYTES, in_chunks
from .common import bits_for, string_array, text_buffer
from .exchange import MESSAGE, asked, messages, owners_of
from .spans import ink, join_kept, ngram_hashes, span_hashes, token_spans, within_row

NOTE = -1  # answers from here on are notes of a chunk to itself
GLUE = {"words": 32, "lines": 10}


class _Chunk:
    """Tokens of the rows of one chunk."""

    def __init__(self, group: pa.Table, key: str, kind: str):
        nulls = group.column(key).is_null()
        if group.num_rows > 1:  # id order, null ids first, equal ids by text: a task run again sees the same
            order = pc.sort_indices(pa.table({"n": pc.invert(nulls).cast(pa.int8()), "k": group.column(key),
                                              "t": group.column("__text")}),
                                    sort_keys=[("n", "ascending"), ("k", "ascending"), ("t", "ascending")])
            group = group.take(order)
        self.group = group
        ids = group.column(key)
        self.ids = ids.fill_null(np.iinfo(np.int64).min).to_numpy().astype(np.int64)
        self.buf, self.off = text_buffer(group.column("__text"))
        self.starts, self.ends, self.row = token_spans(self.buf, self.off, kind)
        if kind == "lines":  # a null text has no line
            none = ids_of_null(group)
            if none.any():
                keep = ~none[self.row]
                self.starts, self.ends, self.row = self.starts[keep], self.ends[keep], self.row[keep]

    def hashes(self, lane: int) -> np.ndarray:
        return span_hashes(self.buf, self.starts, self.ends, lane)


def ids_of_null(group: pa.Table) -> np.ndarray:
    return group.column("__text").is_null().to_numpy(zero_copy_only=False) if group.num_rows else np.zeros(0, bool)


def _alone(c: _Chunk, single: int | None) -> np.ndarray:
    """Whether a token may go by itself: it has at least ``single`` bytes outside white space."""
    return ink(c.buf, c.starts, c.ends) >= single if single is not None else np.zeros(len(c.row), bool)


def _anchors(c: _Chunk, window: int, mode: str, width: int, h0: np.ndarray | None = None, single: int | None = None):
    """(value, token position, is a reference) of every probe of a chunk."""
    h = c.hashes(0) if h0 is None else h0
    if mode == "blocks":
        n = window // 2
        v = ngram_hashes(h, n)
        ok = within_row(c.row, n)
        first = np.searchsorted(c.row, c.row[:len(v)])
        at = np.arange(len(v))
        reference = (at - first) % n == 0
        at, v, reference = at[ok], v[ok], reference[ok]
    else:
        ok = within_row(c.row, window)
        at = np.flatnonzero(_alone(c, single))
        if len(ok):
            views = np.lib.stride_tricks.sliding_window_view(h, window)[ok]
            least = np.flatnonzero(ok) + window - 1 - views[:, ::-1].argmin(axis=1)  # the last of equal minima
            at = np.union1d(at, least)
        v, reference = h[at], np.ones(len(at), bool)
    return v >> np.uint64(64 - width), at, reference


def _runs(c: _Chunk, candidates: list[np.ndarray], windows: list[int]):
    """Sorted 96-bit keys of the candidate runs of each length, their order, and the starts of equal keys."""
    lanes = [c.hashes(0), c.hashes(1)]
    h, lo = (np.concatenate([ngram_hashes(x, n, lane)[at] for at, n in zip(candidates, windows)])
             for lane, x in enumerate(lanes))
    lo = (lo >> np.uint64(32)).astype(np.uint32)
    order = np.argsort(h, kind="stable")
    hs, ls = h[order], lo[order]
    if ((hs[1:] == hs[:-1]) & (ls[1:] != ls[:-1])).any():
        order = np.lexsort((lo, h))
        hs, ls = h[order], lo[order]
    new = np.ones(len(hs), bool)
    if len(hs):
        new[1:] = (hs[1:] != hs[:-1]) | (ls[1:] != ls[:-1])
    return hs, ls, order, np.flatnonzero(new)


def _spread(flags: np.ndarray, n: int) -> np.ndarray:
    """Tokens covered by the flagged runs of n tokens."""
    edge = np.zeros(len(flags) + n + 1, np.int32)
    at = np.flatnonzero(flags)
    edge[at] += 1
    edge[at + n] -= 1
    return np.cumsum(edge)[:len(flags) + n - 1] > 0


def remove_repeats(docs: DataFrame, window: int, kind: str = "words", anchors: str = "blocks", key: str = "doc_id",
                   text: str = "text", carry: list[str] | None = None, with_text: bool = True,
                   chunk_bytes: int = CHUNK_BYTES, single: int | None = None) -> DataFrame:
    """One row per input row: the columns ``carry`` (default: ``key``), then
    ``n_tokens``, ``n_removed``, ``kept_sha256``, ``spans`` (removed passages,
    as (first token, tokens)) and, if asked, ``kept_text``.

    A null text has no token; an empty one has no word and one empty line.
    Rows with the same id and the same text stand at the same place, so
    neither is earlier.  Carried columns may have any name.  With ``single``
    (for ``winnow``), a token of at least so many bytes outside white space
    also goes if it alone starts earlier.
    """
    if single is not None and anchors != "winnow":
        raise ValueError("single needs winnow anchors")
    windows = [window] if single is None else [window, 1]
    carry = carry or [key]
    width_names = [f"__c{i}" for i in range(len(carry))]
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("__key"), F.col(f"`{text}`").alias("__text"),
                       *[F.col(f"`{c}`").alias(w) for c, w in zip(carry, width_names) if c != text])
    rows, _, total = in_chunks(rows, "__key", F.octet_length("__text"), chunk_bytes)
    n_chunks = max(1, total // chunk_bytes, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    owner_bits = bits_for(n_chunks)
    width = min(62, max(owner_bits + 8, bits_for(total / 4 + 1) + 14))

    def probe(group: pa.Table) -> pa.Table:
        c = _Chunk(group, "__key", kind)
        v, _, reference = _anchors(c, window, anchors, width, single=single)
        order = np.argsort(v)
        v, reference = v[order], reference[order]
        first = np.flatnonzero(np.diff(v, prepend=np.uint64(1 << 63)))
        count = np.diff(np.append(first, len(v)))
        values = v[first]
        flag = np.logical_or.reduceat(reference, first) if len(first) else np.zeros(0, bool)
        number = group.column("chunk")[0].as_py()
        owners, cuts = owners_of(values, width, owner_bits)
        return messages([(int(o), number, golomb.encode(values[a:b]) + np.packbits(flag[a:b]).tobytes()
                          + np.packbits(count[a:b] > 1).tobytes())
                         for o, a, b in zip(owners, cuts, cuts[1:])])

    def match(chunks: list[int], texts: list[bytes]) -> dict[int, bytes]:
        values, reference, often = [], [], []
        for m in texts:
            v = golomb.decode(m)
            at, n = golomb.size(m), len(v)
            bits = (n + 7) // 8
            values.append(v)
            reference.append(np.unpackbits(np.frombuffer(m, np.uint8, bits, at), count=n))
            often.append(np.unpackbits(np.frombuffer(m, np.uint8, bits, at + bits), count=n))
        every = np.concatenate(values)
        order = np.argsort(every, kind="stable")
        s = every[order]
        first = np.flatnonzero(np.diff(s, prepend=np.uint64(1 << 63)))
        if not len(first):
            return {}
        many = (np.diff(np.append(first, len(s))) > 1) | (np.maximum.reduceat(np.concatenate(often)[order], first) > 0)
        hits = s[first][many & (np.maximum.reduceat(np.concatenate(reference)[order], first) > 0)]
        out = {}
        for number, v in zip(chunks, values):
            got = v[np.isin(v, hits, assume_unique=True)]
            if len(got):
                out[number] = golomb.encode(got)
        return out

    def extend(group: pa.Table, answers: pa.Table) -> pa.Table:
        if not group.num_rows or not answers.num_rows:
            return messages([])
        c = _Chunk(group, "__key", kind)
        number = group.column("chunk")[0].as_py()
        hits = np.sort(np.concatenate([golomb.decode(m) for m in answers.column("message").to_pylist()]))
        v, at, _ = _anchors(c, window, anchors, width, single=single)
        place = np.minimum(np.searchsorted(hits, v), len(hits) - 1)
        matched = np.zeros(len(c.row) + 1, np.int64)
        matched[at[hits[place] == v] + 1] = 1
        matched = np.cumsum(matched)
        inner = window // 2 if anchors == "blocks" else 1
        ok = within_row(c.row, window)
        n = len(ok)
        candidates = [np.flatnonzero(ok & (matched[window - inner + 1:window - inner + 1 + n] > matched[:n]))]
        if single is not None:
            candidates.append(np.flatnonzero(_alone(c, single) & (np.diff(matched) > 0)))
        if not any(map(len, candidates)):
            return messages([])
        hs, ls, _, first = _runs(c, candidates, windows)
        hs, ls = hs[first], ls[first]
        owners, cuts = owners_of(hs, 64, owner_bits)
        note = b"".join(golomb.encode(x.astype(np.uint64)) for x in candidates)
        return messages([(int(o), number, golomb.encode(hs[a:b]) + ls[a:b].tobytes())
                         for o, a, b in zip(owners, cuts, cuts[1:])] + [(NOTE - number, number, note)])

    def earlier(chunks: list[int], texts: list[bytes]) -> dict[int, bytes]:
        hs = [golomb.decode(m) for m in texts]
        ls = [np.frombuffer(m, np.uint32, len(h), golomb.size(m)) for m, h in zip(texts, hs)]
        sizes = [len(h) for h in hs]
        h, lo = np.concatenate(hs), np.concatenate(ls)
        order = np.lexsort((lo, h))  # stable: equal keys stay in chunk order
        s, t = h[order], lo[order]
        again = np.zeros(len(h), bool)
        again[order[1:]] = (s[1:] == s[:-1]) & (t[1:] == t[:-1])
        cuts = np.cumsum([0, *sizes])
        return {number: np.packbits(again[a:b]).tobytes() for number, a, b in zip(chunks, cuts, cuts[1:])
                if again[a:b].any()}

    carried = [docs.schema[c] for c in carry]
    result = T.StructType(
        [T.StructField(w, f.dataType) for w, f in zip(width_names, carried)] + [
            T.StructField("n_tokens", T.LongType()), T.StructField("n_removed", T.LongType()),
            T.StructField("kept_sha256", T.StringType()),
            T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()),
                                                             T.StructField("length", T.LongType())])))]
        + ([T.StructField("kept_text", T.StringType())] if with_text else []))

    def delete(group: pa.Table, answers: pa.Table) -> pa.Table:
        if not group.num_rows:
            return None
        c = _Chunk(group, "__key", kind)
        n_rows = group.num_rows
        removed = np.zeros(len(c.row), bool)
        notes = {d: m for d, m in zip(answers.column("dest").to_pylist(), answers.column("message").to_pylist())}
        mine = [d for d in notes if d < 0]
        if mine:
            candidates, at = [], 0
            for _ in windows:
                candidates.append(golomb.decode(notes[mine[0]], at).astype(np.int64))
                at += golomb.size(notes[mine[0]], at)
            hs, ls, order, first = _runs(c, candidates, windows)
            where = np.concatenate(candidates)[order]
            length = np.repeat(windows, [len(x) for x in candidates])[order]
            group_of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(hs))))
            seen = np.zeros(len(first), bool)
            owners, cuts = owners_of(hs[first], 64, owner_bits)
            for o, a, b in zip(owners, cuts, cuts[1:]):
                if int(o) in notes:
                    seen[a:b] = np.unpackbits(np.frombuffer(notes[int(o)], np.uint8), count=b - a)
            # a chunk's tokens are in (id, place) order, so the first of equal keys is the earliest
            lead = where[first][group_of]
            place = where - np.searchsorted(c.row, c.row[where])
            lead_place = lead - np.searchsorted(c.row, c.row[lead])
            same = (c.ids[c.row[where]] == c.ids[c.row[lead]]) & (place == lead_place)
            if (np.diff(c.ids) == 0).any():
                lead_place, same = _least_place(c, where, place, group_of, len(first))
            repeat = seen[group_of] | ~same
            for w in windows:
                bad = np.zeros(max(0, len(c.row) - w + 1), bool)
                bad[where[repeat & (length == w)]] = True
                removed |= _spread(bad, w)[:len(c.row)]
        out, cuts = join_kept(c.buf, c.off, c.starts, c.ends, c.row, ~removed, GLUE[kind])
        data = out.tobytes()
        shas = [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(cuts, cuts[1:])]
        n_tokens = np.bincount(c.row, minlength=n_rows)
        n_removed = np.bincount(c.row, weights=removed, minlength=n_rows).astype(np.int64)
        lead = np.searchsorted(c.row, np.arange(n_rows + 1))
        gone = np.flatnonzero(removed)
        cut = np.ones(len(gone), bool)
        if len(gone):
            cut[1:] = (gone[1:] != gone[:-1] + 1) | (c.row[gone[1:]] != c.row[gone[:-1]])
        begin = gone[cut]
        length = np.diff(np.append(np.flatnonzero(cut), len(gone)))
        lists = pa.ListArray.from_arrays(
            pa.array(np.searchsorted(c.row[begin], np.arange(n_rows + 1)), pa.int32()),
            pa.StructArray.from_arrays([pa.array(begin - lead[c.row[begin]], pa.int64()),
                                        pa.array(length, pa.int64())], ["start", "length"]))
        texts = string_array(out, cuts)
        none = ids_of_null(c.group)
        if none.any():
            texts = pa.array([None if x else t for x, t in zip(none, texts.to_pylist())], pa.string())
        cols = [c.group.column("__text" if name == text else w) for name, w in zip(carry, width_names)]
        return pa.table(cols + [pa.array(n_tokens, pa.int64()), pa.array(n_removed, pa.int64()),
                                pa.array(shas, pa.string()), lists] + ([texts] if with_text else []),
                        names=result.names)

    def _or_empty(f, schema):
        def call(group: pa.Table, answers: pa.Table) -> pa.Table:
            got = f(group, answers)
            return got if got is not None else schema.empty_table()
        return call

    empty = to_arrow_schema(result)
    by_chunk = rows.groupBy("chunk")
    matches = asked(by_chunk.applyInArrow(probe, MESSAGE), match)
    runs = by_chunk.cogroup(matches.groupBy("chunk")).applyInArrow(extend, MESSAGE)
    verdicts = asked(runs, earlier)
    out = by_chunk.cogroup(verdicts.groupBy("chunk")).applyInArrow(_or_empty(delete, empty), result)
    names = [*carry, *result.names[len(carry):]]
    return out.toDF(*names)


def _least_place(c: _Chunk, where, place, group_of, n_groups):
    """As the comparison with the first of equal keys, where ids repeat: the
    least (id, place) of each key."""
    ids = c.ids[c.row[where]]
    order = np.lexsort((place, ids, group_of))
    lead = order[np.searchsorted(group_of[order], np.arange(n_groups))]
    return place[lead][group_of], (ids == ids[lead][group_of]) & (place == place[lead][group_of])
