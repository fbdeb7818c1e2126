"""SentencePiece encoding and decoding.

Encoding is the best segmentation by unigram log scores (Viterbi) over a
double-array trie of the pieces' UTF-8 bytes.  A space becomes the marker
U+2581 and one is put before a text; a character that no piece covers falls
back to the pieces of its bytes.  Decoding joins pieces and bytes, turns
markers into spaces and takes the first one away.

No piece has a marker behind another character, so the best segmentation of a
text is that of its words one by one, and words are remembered (a bounded number).
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
_MARK = MARK.encode()
UNKNOWN_PENALTY = 10.0
REMEMBERED = 150_000  # words in each of two generations


def model_path(name: str = "piece_bpe_32k") -> str:
    import public_tokenizers
    return public_tokenizers.path(f"{name}.model")


class DoubleArray:
    """Trie over bytes: the child of node s by byte c is t = base[s] + c + 1 if check[t] = s."""

    def __init__(self, words: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        values = [-1]
        for word, value in words.items():
            node = 0
            for c in word:
                nxt = children[node].get(c)
                if nxt is None:
                    nxt = children[node][c] = len(children)
                    children.append({})
                    values.append(-1)
                node = nxt
            values[node] = value
        self._free = np.ones(1 << 12, bool)
        self._base = np.zeros(1 << 12, np.int64)
        self._free[0] = False
        taken: list[tuple[int, int, int]] = []
        place, start, queue = {0: 0}, 1, [0]
        for node in queue:
            codes = sorted(children[node])
            if not codes:
                continue
            base, start = self._fit(np.array(codes) + 1, start)
            self._base[place[node]] = base
            for c in codes:
                t, child = base + c + 1, children[node][c]
                self._free[t] = False
                taken.append((t, place[node], values[child]))
                place[child] = t
                queue.append(child)
        size = len(self._free)
        self.base, self.check, self.value = self._base.tolist(), [-1] * size, [-1] * size
        for t, parent, v in taken:
            self.check[t], self.value[t] = parent, v
        del self._free, self._base

    def _fit(self, codes: np.ndarray, start: int, window: int = 4096) -> tuple[int, int]:
        """The first base whose places for all ``codes`` are free, and where to look
        next time: past a window that is nearly full."""
        at = start
        while True:
            more = at + window + 600 - len(self._free)
            if more > 0:
                more = max(more, len(self._free))
                self._free = np.append(self._free, np.ones(more, bool))
                self._base = np.append(self._base, np.zeros(more, np.int64))
            first = np.flatnonzero(self._free[at:at + window]) + at
            if at == start and len(first) < window // 20:
                start += window
            bases = first - codes[0]
            bases = bases[bases >= 0]
            for c in codes[1:]:
                bases = bases[self._free[bases + c]]
            if len(bases):
                return int(bases[0]), start
            at += window


class Unigram:
    """Pieces with log scores.  ``kinds``: one letter per piece, n normal, b byte, others are never produced."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: str):
        normal = {p.encode(): i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == "n" and p}
        self.trie, self.scores = DoubleArray(normal), scores
        self.byte = {int(pieces[i][3:5], 16): i for i, k in enumerate(kinds) if k == "b"}
        self.unknown = next((i for i, k in enumerate(kinds) if k == "u"), 0)
        self.unknown_score = min([scores[i] for i in normal.values()], default=0.0) - UNKNOWN_PENALTY
        self.bytes = [bytes([int(p[3:5], 16)]) if k == "b" else p.encode() if k == "n" else b"" for p, k in
                      zip(pieces, kinds)]
        self._table = None
        self.by_words = not any(MARK in p.lstrip(MARK) for p, k in zip(pieces, kinds) if k == "n")

    def viterbi(self, raw: bytes) -> list[int]:
        """Piece ids of the best segmentation; of equal ones that with the earlier last start."""
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        n, never = len(raw), float("-inf")
        best, back, piece = [never] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            here = best[i]
            if here == never:
                continue
            node, j, first = 0, i, 0
            while j < n:
                t = base[node] + raw[j] + 1
                if check[t] != node:
                    break
                node = t
                j += 1
                v = value[t]
                if v >= 0:
                    first = first or j
                    s = here + scores[v]
                    if s > best[j]:
                        best[j], back[j], piece[j] = s, i, v
            c = raw[i]
            to = i + (1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4)
            if first != to and here + self.unknown_score > best[to]:  # no piece is this character alone
                best[to], back[to], piece[to] = here + self.unknown_score, i, -1
        ids, at = [], n
        while at:
            start, v = back[at], piece[at]
            if v >= 0:
                ids.append(v)
            elif self.byte:
                ids += [self.byte[c] for c in reversed(raw[start:at])]
            else:
                ids.append(self.unknown)
            at = start
        return ids[::-1]

    def words(self, text: str) -> list[str]:
        """Parts of a text that are segmented one by one, each without the marker before it."""
        if not text:
            return []
        if not self.by_words:
            return [text.replace(" ", MARK)]
        if "  " not in text and MARK not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [w[1:] for w in re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK))]

    def decode_all(self, ids: np.ndarray, cuts: np.ndarray) -> list[str]:
        """Texts of the id lists ids[cuts[i]:cuts[i + 1]]."""
        if self._table is None:
            size = np.array([len(b) for b in self.bytes])
            self._table = np.frombuffer(b"".join(self.bytes), np.uint8), size, np.cumsum(size) - size
        table, size, start = self._table
        n = size[ids]
        ends = np.concatenate([[0], np.cumsum(n)])
        raw = table[np.repeat(start[ids] - ends[:-1], n) + np.arange(ends[-1])].tobytes()
        texts = [raw[a:b].replace(_MARK, b" ").decode("utf-8", "replace") for a, b in zip(ends[cuts], ends[cuts[1:]])]
        return [t[1:] if t.startswith(" ") else t for t in texts]

    def decode(self, ids) -> str:
        return self.decode_all(np.array(ids, np.int64), np.array([0, len(ids)]))[0]


@lru_cache(maxsize=2)
def load(path: str) -> Unigram:
    """The pieces of a SentencePiece file.  The scores of a file made by merges are
    ranks, not log scores: there the r-th piece gets the log of a Zipf share."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    pieces, scores = [sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)]
    kinds = "".join("b" if sp.is_byte(i) else "u" if sp.is_unknown(i) else "c" if sp.is_control(i) or sp.is_unused(i)
                    else "n" for i in range(n))
    ranks = [-s for s, k in zip(scores, kinds) if k == "n"]
    if ranks == list(range(len(ranks))):
        total = sum(1 / (r + 1) for r in ranks)
        scores = [-float(np.log((1 - s) * total)) if k == "n" else s for s, k in zip(scores, kinds)]
    return Unigram(pieces, scores, kinds)


class _Words(dict):
    """ids of words, with a bounded memory: of two generations the older goes when the newer is full."""

    def __init__(self, model: Unigram):
        super().__init__()
        self.model, self.old = model, {}

    def __missing__(self, word: str) -> bytes:
        got = self.old.get(word)
        if got is None:
            got = np.array(self.model.viterbi(_MARK + word.encode()), "<u4").tobytes()
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        if len(word) <= 64:
            self[word] = got
        return got


class Encoder:
    def __init__(self, model: Unigram):
        self.model, self.known = model, _Words(model)

    def encode(self, text: str) -> bytes:
        """ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.known.__getitem__, self.model.words(text)))


def encode(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text",
           carry: list[str] | None = None) -> DataFrame:
    """doc_id, the columns ``carry``, ids and their crc32 (as little-endian unsigned 32-bit integers).  A null text has null ids, an empty one none.  U+2581 in a
    text is a space afterwards, as with every SentencePiece model."""
    path, carry = path or model_path(), carry or []

    shared = docs.sparkSession.sparkContext.broadcast(load(path))  # as large as the vocabulary

    def f(batches):
        coder = Encoder(shared.value)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                raw = [None if t is None else coder.encode(t) for t in part.column(1).to_pylist()]
                cuts = np.cumsum([0, *[len(r or b"") // 4 for r in raw]])
                lists = pa.ListArray.from_arrays(
                    pa.array(cuts, pa.int32(), mask=np.array([*[r is None for r in raw], False])),
                    pa.array(np.frombuffer(b"".join(r or b"" for r in raw), "<i4"), pa.int32()))
                crc = pa.array([None if r is None else zlib.crc32(r) for r in raw], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *[part.column(2 + i) for i in range(len(carry))], lists, crc],
                    names=["doc_id", *carry, "ids", "ids_crc32"])

    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.select(F.col(f"`{key}`").cast("long"), F.col(f"`{text}`"), *[F.col(f"`{c}`") for c in carry]).mapInArrow(
        f, f"doc_id long, {kept + ', ' if kept else ''}ids array<int>, ids_crc32 long")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` (with ids) plus ``decoded``; null ids have null text."""
    shared = encoded.sparkSession.sparkContext.broadcast(load(path or model_path()))

    def f(batches):
        model = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                lists = part.column("ids")
                cuts = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())])
                texts = model.decode_all(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), cuts)
                texts = pa.array(texts, pa.string(), mask=lists.is_null().to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*b.schema.names, "decoded"])

    return encoded.mapInArrow(f, T.StructType([*encoded.schema, T.StructField("decoded", T.StringType())]))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (little-endian unsigned 32-bit ids), decoded_sha256 and whether the round trip is exact."""
    rows = docs.select("doc_id", "text", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
    done = decode(encode(rows, carry=["text_sha256"]))
    done = done.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_ids"), "ids_crc32",
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "text_sha256")
    return done.withColumn("round_trip", F.col("decoded_sha256") == F.col("text_sha256")).drop("text_sha256")
