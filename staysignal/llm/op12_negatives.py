"""Hard-negative mining by matrix products in a residue number system.

Vectors become integers; their inner products are wanted exactly.  Components
are reduced modulo several small primes, each residue matrix is multiplied in
float32 (every partial sum stays below 2^24, so it is exact), and the signed
score is rebuilt from its residues by Chinese remaindering.  The number of
primes follows from the longest vector, since no score exceeds its squared length.

Anchors and rows are dealt to a grid of bounded cells.  A first pass finds each
anchor's positives; a second one, knowing their scores, keeps per cell the best
negatives inside each positive's score window; Spark windows merge the cells.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, table, written

SCALE = 256
ANCHOR_STEP = 100
POSITIVES = 5
NEGATIVES = 10
LOW, HIGH, WHOLE = 30, 90, 100  # LOW x positive <= WHOLE x negative <= HIGH x positive
DEPTH = 256  # columns multiplied before the residues are reduced again
CELL_ROWS = 16384
CELL_ANCHORS = 2048
TILE = 256  # anchors multiplied at once inside a cell
SCORES = "anchor_id long, bound long, vec_id long, score long"


# ---- the residue number system ------------------------------------------------------------------------------------
@lru_cache(maxsize=8)
def moduli(bound: int) -> tuple[int, ...]:
    """The largest primes whose DEPTH-fold residue products stay below 2^24, as many as tell -bound..bound apart."""
    most = 2 * math.isqrt((1 << 24) // DEPTH) + 1
    chosen, product = [], 1
    for p in range(most, 2, -1):
        if product > 2 * bound + 1:
            break
        small = (p - 1) // 2  # the largest residue in absolute value
        if DEPTH * small * small < 1 << 24 and all(p % q for q in range(2, math.isqrt(p) + 1)):
            chosen.append(p)
            product *= p
    if product >= 1 << 63:
        raise OverflowError(f"scores up to {bound} don't fit in 64 bits")
    return tuple(chosen)


def residues(x: np.ndarray, p: int) -> np.ndarray:
    """x mod p in -(p-1)/2..(p-1)/2 as float32."""
    r = np.mod(x, p)
    return np.where(r > p // 2, r - p, r).astype(np.float32)


def products(a: np.ndarray, b: np.ndarray, primes: tuple[int, ...]) -> np.ndarray:
    """a @ b.T of integer matrices, exact where the result lies within the primes' range."""
    value, weight = np.zeros((len(a), len(b)), np.int64), 1
    for p in primes:
        r = np.zeros(value.shape, np.int64)
        for at in range(0, a.shape[1], DEPTH):
            part = residues(a[:, at:at + DEPTH], p) @ residues(b[:, at:at + DEPTH], p).T
            r += part.astype(np.int64)
        # the next mixed-radix digit: what the value found so far lacks modulo p
        digit = np.mod((r - value) % p * pow(weight, -1, p), p)
        value += digit * weight
        weight *= p
    return np.where(value > weight // 2, value - weight, value)


# ---- selection in a cell ------------------------------------------------------------------------------------------
def first_k(scores: np.ndarray, usable: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` greatest usable scores of each row; of equal ones the first columns."""
    worst = np.iinfo(np.int64).min
    s = np.where(usable, scores, worst)
    if s.shape[1] > k:
        cut = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        above, level = s > cut[:, None], s == cut[:, None]
        room = k - above.sum(axis=1)
        keep = (above | (level & (np.cumsum(level, axis=1) <= room[:, None]))) & (s > worst)
    else:
        keep = s > worst
    return np.nonzero(keep)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    column = column.combine_chunks()
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    at = np.arange(len(column)).repeat(size)
    out[at, np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)] = column.flatten().to_numpy()
    return out


def _cells(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, select, primes, width: int) -> DataFrame:
    """``select`` over every cell of anchors x rows: each anchor block meets each row block in one cell."""
    spark = rows.sparkSession
    across = max(partitions(spark), math.ceil(n_rows / CELL_ROWS))
    down = max(1, math.ceil(n_anchors / CELL_ANCHORS))
    own = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    fresh = lambda df: [F.col(c).alias(c, metadata={}) for c in df.columns]  # noqa: E731  (both sides stem from one table)
    left = anchors.select(*fresh(anchors), own(down, 1).alias("gy")).withColumn("gx", every(across))
    right = rows.select(*fresh(rows), own(across, 2).alias("gx")).withColumn("gy", every(down))

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table([pa.array([], pa.int64())] * 4, names=["anchor_id", "bound", "vec_id", "score"])
        b = b.sort_by("vec_id")
        ids, labels, x = b["vec_id"].to_numpy(), b["label"].to_numpy(), _matrix(b["c"], width)
        found: list[tuple[np.ndarray, ...]] = []
        for at in range(0, a.num_rows, TILE):
            part = a.slice(at, TILE)
            scores = products(_matrix(part["c"], width), x, primes)
            found += select(part, part["vec_id"].to_numpy(), part["label"].to_numpy()[:, None], ids, labels[None, :], scores)
        columns = [np.concatenate(c) for c in zip(*found)]
        return pa.table([pa.array(c) for c in columns], names=["anchor_id", "bound", "vec_id", "score"])

    return left.groupBy("gy", "gx").cogroup(right.groupBy("gy", "gx")).applyInArrow(cell, SCORES)


def _best(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def integer_vectors(vectors: DataFrame, label: Column, key: str = "vec_id", vector: str = "embedding",
                    scale: int = SCALE) -> DataFrame:
    """vec_id, label and components floor(scale * x) of the rows that take part."""
    x = F.col(f"`{vector}`")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    c = F.transform(x, lambda v: F.floor(F.lit(scale) * v.cast("double")))
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("vec_id"), label.cast("long").alias("label"),
                          F.when(finite, c).alias("c"))
    rows = rows.filter("vec_id is not null and label is not null and c is not null")
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "c")).alias("v")).select("vec_id", "v.label", "v.c")


def mine(rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """Negatives of every (anchor, positive) of ``rows`` (vec_id, label, c); ``rows`` should be a written table."""
    squares = F.aggregate("c", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    stats = rows.agg(F.count("*").alias("n"), F.count_if(anchor).alias("anchors"), F.max(squares).alias("longest"),
                     F.max(F.size("c")).alias("width")).first()
    primes = moduli(math.ceil((stats["longest"] or 0.0) * (1 + 1e-9)) + 1)
    width = stats["width"] or 0
    sizes = (stats["anchors"], stats["n"])

    def same(part, aid, alab, ids, labels, scores):
        i, j = first_k(scores, (alab == labels) & (aid[:, None] != ids[None, :]), positives)
        return [(aid[i], np.zeros(len(i), np.int64), ids[j], scores[i, j])]

    def windows(part, aid, alab, ids, labels, scores):
        other, out = alab != labels, []
        bounds = part["bounds"].to_pylist()
        for k in range(max(map(len, bounds))):
            held = np.array([i for i, b in enumerate(bounds) if len(b) > k])
            bound = np.array([bounds[i][k] for i in held])[:, None]
            s = scores[held]
            # integers s with LOW * bound <= WHOLE * s <= HIGH * bound, without products that could overflow
            low, high = _ceil_share(bound, LOW), -_ceil_share(-bound, HIGH)
            i, j = first_k(s, other[held] & (s >= low) & (s <= high), negatives)
            out.append((aid[held[i]], bound[i, 0], ids[j], s[i, j]))
        return out

    anchors = rows.filter(anchor)
    own = _best(_cells(anchors, rows, *sizes, same, primes, width), ["anchor_id"], positives)
    own = written(own.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("bound")), "positives")
    bounds = own.groupBy("anchor_id").agg(F.collect_set("bound").alias("bounds"))  # at most ``positives`` of each
    armed = anchors.join(bounds.withColumnRenamed("anchor_id", "vec_id"), "vec_id")
    best = _best(_cells(armed, rows, *sizes, windows, primes, width), ["anchor_id", "bound"], negatives)
    return own.join(best, ["anchor_id", "bound"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), F.col("bound").alias("positive_score"),
        F.col("score").alias("negative_score"))


def _ceil_share(x: np.ndarray, share: int) -> np.ndarray:
    """The least integer of at least x * share / WHOLE."""
    q, r = np.divmod(x, WHOLE)
    return q * share - (-r * share) // WHOLE


def hard_negatives(vectors: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores.

    Rows with a null id, label or vector, or a null or non-finite component,
    take no part.  Rows that repeat an id count once (the least label, then
    vector).  A vector that is shorter than others has zeros at its end.  A
    positive whose window is empty (or whose score is negative) has no row,
    nor has an anchor alone in its class; an empty table gives an empty result.
    Other columns aren't read.  Scores beyond 64 bits raise an error.
    """
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = written(integer_vectors(vectors, label), "vectors")
    return mine(rows, F.col("vec_id") % ANCHOR_STEP == 0)


def digest(vectors: DataFrame) -> DataFrame:
    return hard_negatives(vectors)


def query(spark, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "embeddings"))


ORACLE = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS c
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same,
         CAST(list_inner_product(a.c, b.c) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % {ANCHOR_STEP} = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY ROW_NUMBER() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}),
n AS (
  SELECT anchor_id, positive_id, s.vec_id AS negative_id, positive_score, s.score AS negative_score,
         ROW_NUMBER() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same
    AND {LOW} * positive_score <= {WHOLE} * s.score AND {WHOLE} * s.score <= {HIGH} * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM n WHERE rank <= {NEGATIVES}
"""
