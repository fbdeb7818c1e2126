"""Language ID by rank-order n-gram profiles.

A profile is the list of the most frequent character n-grams (1 to ``N`` letters,
words padded by a blank) in order of frequency.  A document's own profile is
compared to each language's by the out-of-place distance: the sum of the rank
differences, with the profile's length for an n-gram that a language lacks.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_hash

N = 3
PROFILE = 300
TRAIN_DOCS = 4000  # about so many training documents of each language
UNKNOWN = "und"
BLANK = 1
_BITS = 21  # of a code point


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def letters_of(text: str) -> np.ndarray:
    """Code points in lower case, every run of other characters one BLANK, one at either end."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = _letters()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first other character after a letter stands for its run
    body = np.where(letter, points, BLANK)[keep]
    if not letter.any():
        return body[:0]
    return np.concatenate([[BLANK], body, np.full(int(letter[-1]), BLANK)])


def ngram_counts(text: str, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram keys, counts), keys ascending; an n-gram of blanks alone doesn't count."""
    c = letters_of(text)
    grams, key = [], c
    for size in range(1, n + 1):
        if size > 1:
            key = (key[:-1] << _BITS) | c[size - 1:]
        grams.append(key[key != BLANK] if size == 1 else key)
    return np.unique(np.concatenate(grams), return_counts=True) if len(c) else (c, c)


def top(keys: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent keys; ties by key."""
    return keys[np.argsort(-counts, kind="stable")[:size]]


def learn(docs: DataFrame, usable: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", n: int = N,
          size: int = PROFILE, train_docs: int = TRAIN_DOCS) -> dict[str, np.ndarray]:
    """Profiles of all languages of the rows where ``usable``, from a sample by id
    hash of about ``train_docs`` documents of each language."""
    rows = docs.filter(usable & F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = rows.groupBy(lang).count().collect()  # one row for each language
    scale = 1 << 30
    limit = F.create_map(*[x for r in counts for x in (F.lit(r[0]), F.lit(min(scale, train_docs * scale // r[1])))]) \
        if counts else F.lit(None)
    rows = rows.filter(F.pmod(F.xxhash64(key), F.lit(scale)) < limit[F.col(lang)]) if counts else rows

    def count(batches):
        for b in batches:
            for lang_ in set(b.column(0).to_pylist()):
                own = b.column(1).filter(pa.array([x == lang_ for x in b.column(0).to_pylist()])).to_pylist()
                parts = [ngram_counts(t, n) for t in own]
                keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                sums = np.bincount(at, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang_] * len(keys), pa.string()), pa.array(keys, pa.int64()),
                                                  pa.array(sums)], names=["lang", "gram", "n"])

    grams = rows.select(lang, text).mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(
        F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = grams.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size).collect()
    profiles: dict[str, list] = {}
    for r in sorted(best, key=lambda r: (r["lang"], r["rank"])):
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return {k: np.array(v, np.int64) for k, v in profiles.items()}


class Profiles:
    """Rank tables of all languages over the union of their n-grams."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int = PROFILE):
        self.langs, self.size = sorted(profiles), size
        self.grams = np.unique(np.concatenate([profiles[k] for k in self.langs])) if profiles else np.zeros(0, np.int64)
        self.ranks = np.full((len(self.langs), len(self.grams)), -1, np.int64)
        for i, k in enumerate(self.langs):
            self.ranks[i, np.searchsorted(self.grams, profiles[k])] = np.arange(len(profiles[k]))

    def distances(self, own: np.ndarray) -> np.ndarray:
        """Out-of-place distance of the profile ``own`` to each language."""
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        known = self.grams[at] == own
        ranks = self.ranks[:, at]
        moved = np.abs(ranks - np.arange(len(own)))
        return np.where(known & (ranks >= 0), moved, self.size).sum(axis=1)

    def predict(self, text: str | None, n: int = N) -> tuple[str, float]:
        keys, counts = ngram_counts(text, n) if text else ((), ())
        if not len(keys) or not self.langs:
            return UNKNOWN, 0.0
        own = top(keys, counts, self.size)
        d = self.distances(own)
        best = int(d.argmin())  # the first of equal ones by name
        return self.langs[best], float(1 - d[best] / (self.size * len(own)))


def predict(docs: DataFrame, profiles: Profiles, key: str = "doc_id", text: str = "text", n: int = N) -> DataFrame:
    """doc_id, lang_pred and score (1 less the distance to the language as a share of
    the greatest possible); ``und`` and 0 where the text is null or has no letter."""
    def f(batches):
        for b in batches:
            got = [profiles.predict(t, n) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()),
                                              pa.array([g[1] for g in got], pa.float64())],
                                             names=["doc_id", "lang_pred", "score"])
    return docs.select(F.col(f"`{key}`").cast("long"), F.col(f"`{text}`")).mapInArrow(
        f, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score.  A null id is in no fold and is
    not learned from; rows that repeat are predicted alike."""
    fold = id_hash("doc_id") % 4
    out = predict(docs, Profiles(learn(docs, fold != 2)))
    return out.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def digest(docs: DataFrame) -> DataFrame:
    return identify(docs.select("doc_id", "text", "lang"))
