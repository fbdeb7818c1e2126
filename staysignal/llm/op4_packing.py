"""Best-fit packing of token sequences with Martello-Toth dominance reduction.

Every document becomes pieces of at most ``capacity`` tokens.  How many pieces
there are of each length is a table of at most ``capacity`` rows, and the
packing is planned on it: sets that provably dominate all alternatives are
fixed first, the rest is packed best-fit, longest first.  The plan, a list of
patterns with multiplicities, says where the r-th piece of each length goes;
ranks within a length come from a two-level count, so a length that a third
of all pieces have is never in one task.
"""

from __future__ import annotations

import bisect
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_slices, partitions, written

CAPACITY = 2048
END = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


# ---- tokens -------------------------------------------------------------------------------------------------------
def vocabulary_path(name: str = "byte_bpe_50k") -> str:
    import public_tokenizers
    return public_tokenizers.path(f"{name}.json")


@lru_cache(maxsize=2)
def encoder(path: str):
    """ids of one text by the byte-level BPE file ``path`` as ``tokenizers`` gives them, special tokens in the text
    included.  Where the same vocabulary lies beside it as ranks, texts in Latin letters that hold no special token
    go through ``tiktoken``: the same ids, four times as fast."""
    import base64
    import os

    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(path)
    slow = lambda text: whole.encode(text, add_special_tokens=False).ids
    ranks = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks):
        return slow
    import public_tokenizers
    import tiktoken
    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    special = [t.content for t in whole.get_added_tokens_decoder().values()]
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def ids(text: str) -> list[int]:
        raw = np.frombuffer(text.encode(), np.uint8)
        # lead bytes below 0xCA: up to U+027F, where letter classes have long been settled
        plain = (not len(raw) or raw.max() < 0xCA) and not any(t in text for t in special)
        return fast.encode_ordinary(text) if plain else slow(text)
    return ids


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, key: str = "doc_id",
           text: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of every document: its ids and a closing 0; only documents longer than ``capacity`` are cut,
    and then only the first piece may be shorter.  Null text is empty: one piece, the 0."""
    path = path or vocabulary_path()

    def f(batches):
        encode = encoder(path)
        for b in batches:
            for part in byte_slices(b, 1, rows=500):
                rows: list[tuple] = []
                for key_, text_ in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = np.array([*encode(text_ or ""), END], "<u4")
                    first = len(ids) % capacity or min(len(ids), capacity)
                    cuts = [0, *range(first, len(ids) + 1, capacity)]
                    for i, (a, z) in enumerate(zip(cuts, cuts[1:])):
                        own = ids[a:z]
                        rows.append((key_, i, a, z - a, zlib.crc32(own.tobytes()), own))
                cols = list(zip(*rows))
                arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), *[pa.int64()] * 3))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array([x.astype(np.int32) for x in cols[5]], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select(F.col(f"`{key}`").cast("long"), F.col(f"`{text}`")).mapInArrow(
        f, PIECES + ", ids array<int>" * with_ids)


# ---- plan ---------------------------------------------------------------------------------------------------------
class _Lengths:
    """A multiset of lengths with its distinct values in order."""

    def __init__(self, counts: dict[int, int]):
        self.n = {k: v for k, v in counts.items() if v > 0}
        self.sorted = sorted(self.n)

    def take(self, items: list[int], times: int) -> None:
        for x in items:
            self.n[x] -= times
            if not self.n[x]:
                del self.n[x]
                self.sorted.pop(bisect.bisect_left(self.sorted, x))

    def without(self, x: int, value: int) -> int:
        """How many of ``value`` are left beside one ``x``."""
        return self.n.get(value, 0) - (value == x)

    def largest(self, x: int, most: int) -> int | None:
        """The largest length of at most ``most``, beside one ``x``."""
        i = bisect.bisect_right(self.sorted, most) - 1
        while i >= 0 and not self.without(x, self.sorted[i]):
            i -= 1
        return self.sorted[i] if i >= 0 else None

    def smallest(self, x: int, k: int) -> list[int]:
        out: list[int] = []
        for v in self.sorted:
            out += [v] * min(k - len(out), self.without(x, v))
            if len(out) == k:
                break
        return out


def _best_pair(left: _Lengths, x: int, room: int) -> tuple[int, int]:
    """(greatest sum of two lengths that fit, greatest smaller member of such a pair), 0 if none."""
    best = small = 0
    values = [v for v in left.sorted if v <= room and left.without(x, v) > 0]
    j = len(values) - 1
    for i, v in enumerate(values):
        while j >= 0 and values[j] + v > room:
            j -= 1
        if j < i or (j == i and left.without(x, v) < 2):
            break
        best, small = max(best, values[j] + v), v
    return best, small


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, list[int]]], dict[int, int]]:
    """Fix sets that hold one length x and dominate every set with x; returns
    (times, lengths) patterns and what is left.

    With room r beside x, k the greatest other length that fits: nothing fits
    -> {x}; k = r, or no two fit, or at most two fit and no two exceed k ->
    {x, k}; at most two fit and k fits beside y, the greatest smaller member of
    any fitting pair -> {x, k, y}.  In each case any other set's members can
    change places with the fixed ones and still fit where those were.
    """
    left, fixed, changed = _Lengths(counts), [], True
    while changed:
        changed = False
        for x in reversed(list(left.sorted)):
            while left.n.get(x):
                room = capacity - x
                k = left.largest(x, room)
                if k is None:
                    chosen, times = [x], left.n[x]
                else:
                    low = left.smallest(x, 3)
                    if k == room or len(low) < 2 or low[0] + low[1] > room:
                        chosen = [x, k]
                    elif len(low) < 3 or sum(low) > room:
                        best, small = _best_pair(left, x, room)
                        if best <= k:
                            chosen = [x, k]
                        elif k + small <= room and left.without(x, small) - (small == k) > 0:
                            chosen = [x, k, small]
                        else:
                            break
                    else:
                        break
                    times = min(left.n[v] // chosen.count(v) for v in chosen)
                left.take(chosen, times)
                fixed.append((times, chosen))
                changed = True
    return fixed, dict(left.n)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Best-fit decreasing on counted lengths: equal bins stay one entry."""
    rooms: list[int] = []
    open_: dict[int, list[tuple[int, list[int]]]] = {}

    def put(room: int, times: int, pattern: list[int]) -> None:
        if room not in open_:
            open_[room] = []
            bisect.insort(rooms, room)
        open_[room].append((times, pattern))

    for x in sorted(counts, reverse=True):
        n = counts[x]
        while n:
            i = bisect.bisect_left(rooms, x)
            if i == len(rooms):
                per = capacity // x
                full, rest = divmod(n, per)
                if full:
                    put(capacity - per * x, full, [x] * per)
                if rest:
                    put(capacity - rest * x, 1, [x] * rest)
                break
            room = rooms[i]
            times, pattern = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(i)
            m = min(times, n)
            if m < times:
                put(room, times - m, pattern)
            put(room - x, m, [*pattern, x])
            n -= m
    return [entry for entries in open_.values() for entry in entries]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    fixed, rest = reduce_dominated(counts, capacity)
    return fixed + best_fit(rest, capacity)


# ---- placement ----------------------------------------------------------------------------------------------------
def _slots(patterns: list[tuple[int, list[int]]]) -> tuple[np.ndarray, ...]:
    """For each (length, first rank): first sequence and offset, sorted."""
    given: dict[int, int] = {}
    rows, sequence = [], 0
    for times, lengths in patterns:
        offset = 0
        for x in lengths:
            rows.append((x, given.get(x, 0), sequence, offset))
            given[x] = given.get(x, 0) + times
            offset += x
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return (table[:, 0] << 48) + table[:, 1], table[:, 1], table[:, 2], table[:, 3]


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` (with doc_id, piece and length) plus sequence_id and offset."""
    spark = parts.sparkSession
    counts = {int(r["length"]): r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    keys, ranks, sequences, offsets = _slots(plan(counts, capacity))
    share = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(4 * partitions(spark))).cast("int")
    parts = parts.withColumn("__share", share)
    sums = parts.groupBy("length", "__share").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("length").orderBy("__share").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    own = Window.partitionBy("length", "__share").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (parts.withColumn("__own", F.row_number().over(own) - 1).join(sums, ["length", "__share"])
              .withColumn("__rank", F.col("__own") + F.col("__before")).drop("__own", "__before", "__share"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema if f.name != "__share")

    def place(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("__rank").to_numpy()
            at = np.searchsorted(keys, (length << 48) + rank, side="right") - 1
            t = pa.Table.from_batches([b]).drop_columns(["__rank"])
            t = t.append_column("sequence_id", pa.array(sequences[at] + rank - ranks[at]))
            t = t.append_column("offset", pa.array(offsets[at])).select(names)
            yield from t.to_batches()

    names = [f.name for f in parts.schema if f.name != "__share"] + ["sequence_id", "offset"]
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, **columns) -> DataFrame:
    """Pieces of every document and their places.  The pieces are written once: texts are tokenized once.
    Repeated rows are packed each; an empty table gives an empty result."""
    return pack(written(pieces(docs, path, capacity, **columns), "pieces"), capacity)


def digest(docs: DataFrame) -> DataFrame:
    return pack_documents(docs.select("doc_id", "text"))
