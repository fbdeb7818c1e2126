"""Toxic spans by a linear-chain conditional random field.

Two labels per word (0 clean, 1 toxic).  Words are labelled from document labels:
a word is toxic in a toxic document if it, or a beginning of it, is much more
common in toxic than in clean documents.  The field (word and prefix weights,
transition weights) is trained on those labelled words by maximum conditional
likelihood; at scoring time forward-backward gives each word's marginal of being
toxic, over the whole text, a chain per line.  A logistic step turns a
document's marginals into its score; words of marginal 0.5 or more are
reported with their offsets.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, id_hash, table, written

TRAIN_DOCS = 1500  # about so many labelled documents of either class,
TRAIN_BYTES = 24 << 20  # and about so many bytes of text: fewer documents if they are long
PREFIXES = (4, 5, 6, 7, 8)
LEAST_DOCS = 4  # documents that must hold a feature
LEAST_SHARE = 0.02  # of the toxic documents must hold a toxic feature; rarer ones come from copied texts
LIFT = 12.0  # times as common in toxic documents
ROUNDS = 40
CACHE_WORDS = 400_000
_EDGE = ".,;:!?\"'()[]{}<>*#$%&|-_/\\=+~`"


def features(word: str) -> list[str]:
    """A word's own feature and those of its beginnings."""
    w = word.strip(_EDGE)
    return [w] + [w[:k] + "*" for k in PREFIXES if len(w) > k]


def lines_of(text: str | None) -> list[list[str]]:
    return [line.split() for line in (text or "").lower().split("\n")]


class Chains:
    """Chains laid out by time: position t of all chains that reach it, longest first."""

    def __init__(self, lengths: np.ndarray):
        lengths = lengths.astype(np.int64)
        order = np.argsort(-lengths, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        longest = int(lengths.max()) if len(lengths) else 0
        alive = np.searchsorted(-lengths[order], -np.arange(1, longest + 1), side="right")
        self.cuts = np.concatenate([[0], np.cumsum(alive)])
        chain = np.repeat(np.arange(len(lengths)), lengths)
        t = np.arange(len(chain)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.place = self.cuts[t] + rank[chain] if len(chain) else np.zeros(0, np.int64)

    def steps(self):
        return list(zip(self.cuts[:-1], self.cuts[1:]))


def marginals(emission: np.ndarray, lengths: np.ndarray, trans: np.ndarray, pairs: bool = False):
    """P(toxic) of every word; with ``pairs`` also the expected transition counts.

    With two labels forward and backward messages are ratios label 1 : label 0.
    """
    c = Chains(lengths)
    x = np.empty(len(emission))
    x[c.place] = np.exp(np.clip(emission, -30, 30))
    (a, b), (d, e) = np.exp(trans)  # a: 0->0, b: 0->1, d: 1->0, e: 1->1
    fwd, bwd = np.empty(len(x)), np.empty(len(x))
    steps = c.steps()
    for k, (lo, hi) in enumerate(steps):
        if k == 0:
            fwd[lo:hi] = x[lo:hi]
        else:
            r = fwd[steps[k - 1][0]:steps[k - 1][0] + hi - lo]
            fwd[lo:hi] = x[lo:hi] * (b + r * e) / (a + r * d)
    for k in range(len(steps) - 1, -1, -1):
        lo, hi = steps[k]
        bwd[lo:hi] = 1.0
        if k + 1 < len(steps):
            nlo, nhi = steps[k + 1]
            s = x[nlo:nhi] * bwd[nlo:nhi]
            bwd[lo:lo + nhi - nlo] = (d + e * s) / (a + b * s)
    odds = fwd * bwd
    p = (odds / (1 + odds))[c.place]
    if not pairs:
        return p
    counts = np.zeros((2, 2))
    for (lo, hi), (nlo, nhi) in zip(steps, steps[1:]):
        r = fwd[lo:lo + nhi - nlo]
        s = x[nlo:nhi] * bwd[nlo:nhi]
        cells = np.stack([np.full(len(r), a), b * s, r * d, r * e * s])
        counts += (cells / cells.sum(axis=0)).sum(axis=1).reshape(2, 2)
    return p, counts


class Model:
    """Feature weights (of label 1 against 0), transitions, and the document step."""

    def __init__(self, weights: dict[str, float], bias: float, trans: np.ndarray, document: np.ndarray):
        self.weights, self.bias, self.trans, self.document = weights, bias, trans, document

    def emission(self, word: str) -> float:
        return self.bias + sum(self.weights.get(f, 0.0) for f in features(word))

    def score(self, p: np.ndarray, words: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-(summary(p, doc, n) @ self.document)))


def summary(p: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Of each document: 1, its greatest marginal, the logs of its expected toxic words and of their
    share in 100 words (a long clean text holds a suspect word by chance)."""
    most = np.zeros(n)
    np.maximum.at(most, doc, p)
    expected, words = np.bincount(doc, p, n), np.maximum(1, np.bincount(doc, minlength=n))
    return np.stack([np.ones(n), most, np.log1p(expected), np.log1p(100 * expected / words)], axis=1)


def _labelled(docs: DataFrame, labels: DataFrame, usable: Column, train_docs: int, train_bytes: int) -> DataFrame:
    """(text, toxic): a sample by id hash of about ``train_docs`` labelled documents of either class, whole texts,
    equal ones once; of more than ``train_bytes`` in all fewer documents are taken.  A written table."""
    rows = labels.filter(usable & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    scale = 1 << 30
    share = lambda part: F.lit(min(scale, int(part * scale)))
    limit = F.when(F.col("toxic") == 1, share(train_docs / max(1, counts.get(1, 0)))).otherwise(
        share(train_docs / max(1, counts.get(0, 0))))
    chosen = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < limit)  # bounded by train_docs
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = written(texts.select("text", F.col("toxic").cast("int").alias("toxic")).distinct(), "toxicity-sample")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return texts.filter(F.pmod(F.xxhash64("text"), F.lit(scale)) < share(train_bytes / max(1, size)))


def _counted(sample: DataFrame) -> pa.Table:
    """The sample's words (kind w) and the features (kind f) that LEAST_DOCS of its documents hold, with the number of
    clean and of toxic documents.  Counted in tasks."""
    def count(batches):
        words: set[str] = set()
        held: tuple[Counter, Counter] = Counter(), Counter()
        for b in batches:
            for part in byte_slices(b, 0):
                for text, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    own = {w for line in lines_of(text) for w in line}
                    words |= own
                    held[y].update({f for w in own for f in features(w)})
        found = held[0].keys() | held[1].keys()
        yield pa.RecordBatch.from_arrays(
            [pa.array(["w"] * len(words) + ["f"] * len(found)), pa.array([*words, *found], pa.string()),
             *(pa.array([0] * len(words) + [held[y][f] for f in found], pa.int64()) for y in (0, 1))],
            names=["kind", "name", "clean", "toxic"])

    rows = sample.mapInArrow(count, "kind string, name string, clean long, toxic long")
    rows = rows.groupBy("kind", "name").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    return rows.filter((F.col("kind") == "w") | (F.col("clean") + F.col("toxic") >= LEAST_DOCS)).orderBy(
        "kind", "name").toArrow()


def _encoded(sample: DataFrame, words: list[str]) -> pa.Table:
    """toxic, word numbers and line lengths of the sample's documents; texts stay in the tasks."""
    known = sample.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(words)})

    def encode(batches):
        number = known.value
        for b in batches:
            for part in byte_slices(b, 0):
                lines = [[x for x in lines_of(t) if x] for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(1), pa.array([[number[w] for x in doc for w in x] for doc in lines], pa.list_(pa.int32())),
                     pa.array([[len(x) for x in doc] for doc in lines], pa.list_(pa.int32()))],
                    names=["toxic", "words", "lengths"])

    rows = sample.orderBy("toxic", F.xxhash64("text"), "text").mapInArrow(
        encode, "toxic int, words array<int>, lengths array<int>")
    return rows.toArrow()


def train(sample: DataFrame, rounds: int = ROUNDS) -> Model:
    """Fit on ``sample`` (text, toxic).  Tasks count features and turn words into numbers; the driver holds the
    sample's distinct words and arrays of numbers, at most some bytes for each byte of the sample."""
    found = _counted(sample)
    is_word = np.array(found["kind"].to_pylist()) == "w"
    names = found["name"].to_pylist()
    words = [x for x, w in zip(names, is_word) if w]
    clean, toxic = found["clean"].to_numpy()[~is_word], found["toxic"].to_numpy()[~is_word]
    index = {x: i for i, x in enumerate(x for x, w in zip(names, is_word) if not w)}
    del found, names
    rows = _encoded(sample, words)
    labels = rows["toxic"].to_numpy().astype(np.int64)
    n = np.maximum(1, np.bincount(labels, minlength=2))
    listed = (toxic >= max(LEAST_DOCS, LEAST_SHARE * n[1])) & (toxic / n[1] >= LIFT * (clean + 0.5) / n[0])
    listed[[index[f] for f in [""] if f in index]] = False
    at, owner, flagged = [], [], np.zeros(len(words), bool)
    for i, word in enumerate(words):
        ids = [index[f] for f in features(word) if f in index]
        at += ids
        owner += [i] * len(ids)
        flagged[i] = listed[ids].any() if ids else False
    at, owner = np.array(at, np.int64), np.array(owner, np.int64)
    lists = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (rows["words"], rows["lengths"])]
    of, lengths = (x.flatten().to_numpy().astype(np.int64) for x in lists)
    doc = np.repeat(np.arange(len(labels)), pa.compute.list_value_length(lists[0]).to_numpy().astype(np.int64))
    del rows, lists
    tags = (flagged[of] & (labels[doc] == 1)).astype(float)
    token, features_ = len(of), len(index)
    inner = np.ones(token, bool)
    inner[np.cumsum(lengths) - lengths] = False
    prev, cur = tags[np.flatnonzero(inner) - 1].astype(int), tags[inner].astype(int)
    seen = np.bincount(prev * 2 + cur, minlength=4).reshape(2, 2).astype(float)
    w, bias, trans = np.zeros(features_), -2.0, np.zeros((2, 2))
    mean, square = np.zeros(features_ + 5), np.zeros(features_ + 5)
    emission = lambda: bias + np.bincount(owner, w[at], len(words))[of]
    for k in range(1, rounds + 1):  # Adam on the log likelihood
        p, pairs = marginals(emission(), lengths, trans, True)
        miss = np.bincount(of, tags - p, len(words))
        grad = np.concatenate([np.bincount(at, miss[owner], features_) - 0.5 * w, [miss.sum()],
                               (seen - pairs).ravel() - 0.1 * trans.ravel()])
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad * grad
        step = 0.2 * (mean / (1 - 0.9 ** k)) / (np.sqrt(square / (1 - 0.99 ** k)) + 1e-8)
        w, bias, trans = w + step[:len(w)], bias + step[len(w)], trans + step[len(w) + 1:].reshape(2, 2)
    x = summary(marginals(emission(), lengths, trans), doc, len(labels))
    beta = np.zeros(x.shape[1])
    for _ in range(25):  # Newton with a small ridge
        q = 1 / (1 + np.exp(-(x @ beta)))
        grad = x.T @ (labels - q) - 0.05 * beta
        beta = beta + np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + 0.05 * np.eye(len(beta)), grad)
    return Model({f: float(w[i]) for f, i in index.items() if w[i]}, float(bias), trans, beta)


def fit(docs: DataFrame, labels: DataFrame, usable: Column, train_docs: int = TRAIN_DOCS,
        train_bytes: int = TRAIN_BYTES) -> Model:
    """The model of a bounded sample of labelled documents."""
    sample = _labelled(docs, labels, usable, train_docs, train_bytes)
    n = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    if len(n) < 2:  # nothing to tell apart
        rate = 1.0 if n.get(1) else 0.0
        return Model({}, -30.0, np.zeros((2, 2)), np.array([np.log((rate + 0.01) / (1.01 - rate)), 0, 0, 0]))
    return train(sample)


class _Emissions(dict):
    """Emission of each word, remembered for a bounded number of words."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE_WORDS:
            self.clear()
        e = self[word] = self.model.emission(word)
        return e


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", spans: bool = True) -> DataFrame:
    """doc_id, score and, if asked, the toxic words as (start, end) character offsets."""
    def f(batches):
        known = _Emissions(model)
        for b in batches:
            for part in byte_slices(b, 1, rows=1000):
                yield block(part.column(0), part.column(1).to_pylist(), known)

    def block(ids, texts, known) -> pa.RecordBatch:
        emission: list[float] = []
        lengths, doc = [], []
        for d, t in enumerate(texts):
            for line in lines_of(t):
                if line:
                    emission += map(known.__getitem__, line)
                    lengths.append(len(line))
                    doc.append(d)
        lengths = np.array(lengths, np.int64)
        doc = np.repeat(np.array(doc, np.int64), lengths)
        p = marginals(np.array(emission, float), lengths, model.trans)
        columns = [ids, pa.array(model.score(p, doc, doc, len(texts)))]
        if spans:
            found: list[list] = [[] for _ in texts]
            bad = np.flatnonzero(p >= 0.5)
            first = np.searchsorted(doc, np.arange(len(texts)))
            for d in np.unique(doc[bad]):
                places = [m.span() for m in re.finditer(r"\S+", texts[d])]
                found[d] = [dict(zip(("start", "end"), places[k - first[d]])) for k in bad[doc[bad] == d]
                            if k - first[d] < len(places)]
            columns.append(pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "score", "spans"][:len(columns)])

    schema = "doc_id long, score double" + ", spans array<struct<start: long, end: long>>" * spans
    return docs.select(F.col(f"`{key}`").cast("long"), F.col(f"`{text}`")).mapInArrow(f, schema)


def toxicity(docs: DataFrame, labels: DataFrame, spans: bool = True) -> DataFrame:
    """doc_id, held_out, score, predicted and the spans.  Null, empty and blank
    texts get the score of a text without toxic words.  A null id is in no
    fold and is not learned from."""
    fold = id_hash("doc_id") % 5
    out = score(docs, fit(docs, labels, fold != 0), spans=spans)
    return out.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"), *["spans"] * spans)


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the toxic ones: of rows that share an id (or a null one) all go if one of them is toxic."""
    bad = toxicity(docs, labels, spans=False).filter("predicted = 1").select(F.col("doc_id").alias("__id"))
    return docs.join(bad.distinct(), docs["doc_id"].eqNullSafe(F.col("__id")), "left_anti")


def digest(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    return toxicity(docs, labels)


def query(spark, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
