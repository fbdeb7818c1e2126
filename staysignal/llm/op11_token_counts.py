"""Token counts by a map-side two-tier look-up.

The tokenizer cuts a text into pre-tokens that are encoded one by one, so a
text's count is the sum of its pre-tokens' lengths.  Tier one is a compact
hash table of the most frequent pre-tokens' lengths, learned on a bounded
sample and broadcast; tier two is each Python worker's own cache, which
encodes a miss with the library once.  No pre-token is ever shuffled, and what
the table holds changes no result, only the number of misses.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices

LIMIT = 2048
TABLE_WORDS = 1 << 16  # entries of the broadcast table, of at most WORD_CHARS characters each
WORD_CHARS = 64
SAMPLE_BYTES = 16 << 20  # about so much text is sampled, whole texts by id hash, to learn the table
SAMPLE_TASKS = 8
CACHE_WORDS = 1 << 18
SEGMENT = 1 << 20  # characters of a text whose pre-tokens are held at once

# Characters below U+0280 (and some punctuation) whose classes and lower case every Unicode version agrees on; such
# characters never compose with each other.  A word that holds any other goes to the library as it is.
_UNSETTLED = re.compile("[^\x00-įı-ȹȻ-Ƚȿ-ɿ–—‘-„•…€]")
_SPACE = "\t-\r \x85\xa0"
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ʯ"
_NUMBER = "0-9²³¹¼½¾"
_PRE_TOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")
_BREAK = re.compile("[\t-\r ]+")


def vocabulary_path(name: str = "word_bpe_49k") -> str:
    import public_tokenizers
    return public_tokenizers.path(f"{name}.json")


def segments(text: str):
    """``text`` in parts of about SEGMENT characters, cut after white space (which no pre-token crosses)."""
    at = 0
    while len(text) - at > SEGMENT:
        cut = _BREAK.search(text, at + SEGMENT)
        if cut is None:
            break
        yield text[at:cut.end()]
        at = cut.end()
    yield text[at:] if at else text


def units(text: str) -> list[str]:
    """Strings whose own token counts add up to the text's: lower-case pre-tokens, and whole words between white
    space where a character or a special token needs the library's own normalisation."""
    if "<|" not in text and (text.isascii() or not _UNSETTLED.search(text)):
        return _PRE_TOKEN.findall(text.lower())
    out: list[str] = []
    for word in _BREAK.split(text):
        if "<|" in word or _UNSETTLED.search(word):
            out.append(word)
        else:
            out += _PRE_TOKEN.findall(word.lower())
    return out


class LengthTable:
    """Open-addressing hash table word -> number of tokens in flat arrays (a power of two of slots, at most half
    full).  A found slot's word is compared itself, so equal hashes do no harm."""

    def __init__(self, words: list[str], lengths: list[int]):
        self.words = pa.array(words, pa.string())
        self.lengths = np.array(lengths, np.int32)
        size = 4
        while size < 2 * len(words):
            size *= 2
        self.slots = np.full(size, -1, np.int32)
        todo, at = np.arange(len(words)), self._hashes(self.words) & np.uint64(size - 1)
        while len(todo):
            free = self.slots[at] < 0
            own, first = np.unique(at[free], return_index=True)
            self.slots[own] = todo[free][first]
            left = np.ones(len(todo), bool)
            left[np.flatnonzero(free)[first]] = False
            todo, at = todo[left], (at[left] + np.uint64(1)) & np.uint64(size - 1)

    @staticmethod
    def _hashes(words: pa.Array) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, words.to_pylist()), np.uint64, len(words))

    def look_up(self, words: pa.Array) -> np.ndarray:
        """Token count of each word, -1 where the table lacks it."""
        out = np.full(len(words), -1, np.int64)
        todo, last = np.arange(len(words)), np.uint64(len(self.slots) - 1)
        at = self._hashes(words) & last
        while len(todo):
            row = self.slots[at]
            todo, at, row = todo[row >= 0], at[row >= 0], row[row >= 0]
            if not len(todo):
                break
            same = pc.equal(self.words.take(pa.array(row)), words.take(pa.array(todo))).to_numpy(zero_copy_only=False)
            out[todo[same]] = self.lengths[row[same]]
            todo, at = todo[~same], (at[~same] + np.uint64(1)) & last
        return out


class Coder:
    """The library's counts of single units, remembered in a bounded cache."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.library, self.known = Tokenizer.from_file(path), {}

    def lengths(self, words: list[str]) -> list[int]:
        new = [w for w in words if w not in self.known]
        found = dict(zip(new, (len(e.ids) for e in self.library.encode_batch_fast(new, add_special_tokens=False))))
        out = [found[w] if w in found else self.known[w] for w in words]
        if len(self.known) + len(found) > CACHE_WORDS:
            self.known.clear()
        self.known.update((w, n) for w, n in found.items() if len(w) <= WORD_CHARS)
        return out


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    """One cache for a Python worker, kept from task to task."""
    return Coder(path)


def count_texts(texts: list[str | None], table: LengthTable, own: Coder) -> np.ndarray:
    """Number of tokens of each text."""
    total = np.zeros(len(texts), np.int64)
    held: list[str] = []
    doc: list[int] = []
    sizes: list[int] = []

    def flush() -> None:
        if not held:
            return
        coded = pa.array(held, pa.string()).dictionary_encode()
        words = coded.dictionary
        lengths = table.look_up(words)
        miss = np.flatnonzero(lengths < 0)
        if len(miss):
            lengths[miss] = own.lengths(words.take(pa.array(miss)).to_pylist())
        of = np.repeat(np.array(doc), np.array(sizes))
        total[:] += np.bincount(of, lengths[coded.indices.to_numpy()], len(texts)).astype(np.int64)
        held.clear(), doc.clear(), sizes.clear()

    room = SEGMENT
    for i, text in enumerate(texts):
        for part in segments(text or ""):
            found = units(part)
            held.extend(found)
            doc.append(i)
            sizes.append(len(found))
            room -= len(part)
            if room < 0:
                flush()
                room = SEGMENT
    flush()
    return total


def learn_table(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", words: int = TABLE_WORDS,
                sample_bytes: int = SAMPLE_BYTES) -> LengthTable:
    """The most frequent units of a sample of whole texts.  At most SAMPLE_TASKS x ``words`` rows reach the driver."""
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).filter("t is not null")
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    scale = 1 << 30
    part = min(scale, int(sample_bytes / max(1, total) * scale))
    chosen = rows.filter(F.pmod(F.xxhash64("k"), F.lit(scale)) < part).select("t").repartition(SAMPLE_TASKS)

    def frequent(batches):
        seen: Counter = Counter()
        for b in batches:
            for piece in byte_slices(b, 0):
                for t in piece.column(0).to_pylist():
                    for s in segments(t):
                        seen.update(w for w in units(s) if len(w) <= WORD_CHARS)
                        if len(seen) > 8 * words:
                            seen = Counter(dict(seen.most_common(4 * words)))
        best = seen.most_common(words)
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in best], pa.string()),
                                          pa.array([n for _, n in best], pa.int64())], names=["word", "n"])

    found = chosen.mapInArrow(frequent, "word string, n long").toArrow().group_by("word").aggregate([("n", "sum")])
    best = found.sort_by([("n_sum", "descending"), ("word", "ascending")]).slice(0, words).column("word").to_pylist()
    return LengthTable(best, Coder(path).lengths(best))


def token_counts(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text",
                 limit: int = LIMIT, **learning) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row and whole text.

    A null text counts as empty (0 bytes, 0 tokens), and so do texts of white space alone (0 tokens); rows that
    repeat are counted each; a null id stays null; an empty table gives an empty result.  Other columns aren't read.
    """
    path = path or vocabulary_path()
    table = docs.sparkSession.sparkContext.broadcast(learn_table(docs, path, key, text, **learning))

    def f(batches):
        own = coder(path)
        for b in batches:
            for part in byte_slices(b, 1):
                size = pc.fill_null(pc.cast(pc.binary_length(part.column(1)), pa.int64()), 0)
                n = pa.array(count_texts(part.column(1).to_pylist(), table.value, own))
                yield pa.RecordBatch.from_arrays([part.column(0), size, n], names=["doc_id", "n_bytes", "n_tokens"])

    out = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("t")).mapInArrow(
        f, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def digest(docs: DataFrame) -> DataFrame:
    return token_counts(docs)
