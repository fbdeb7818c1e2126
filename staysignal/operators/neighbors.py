"""Exact k-nearest neighbours without pairing any group with itself.

Neighbours are *distinct* feature vectors: rows are first grouped by their
vector (a partial aggregate, so a vector carried by a third of all rows
costs one row per task), each vector is named by the smallest id carrying
it, and a row's neighbours are the k nearest other vectors, ties broken by
that id.  The search then runs in two passes over the distinct vectors:

1. **Bound.**  Vectors are ordered along seeded random projections and each
   ordering is cut into consecutive blocks of ``block_size`` rows (twice,
   the second cut shifted by half a block).  Distances inside the blocks
   give every vector an upper bound ``r`` on its k-th neighbour distance.
   The position of a vector in an ordering is its exact rank, a running
   count over range partitions (no global window over raw rows).
2. **Exact pass.**  A projection onto a unit vector never lengthens a
   distance, so every true neighbour lies inside the box ``+-r`` around the
   vector on the first two projections.  Vectors are stored in 2-D grids of
   those projections at a few resolutions (cell side = the median bound
   times a power of two) and each vector probes, at the level whose cell
   side is between half its radius and its radius, the at most 5 x 5 cells
   its box touches: an equi-join on (level, cell), filtered by the box and
   by ``dist2 <= r^2``, then ranked.  Only levels some probe uses are stored.  The candidate set
   is not capped: it is every vector inside the box, so the result equals
   brute force, and dense regions get small radii, hence small cells.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import running_sums

# Finest grid level: cells no smaller than 2^-40 of the median bound.
MIN_LEVEL = -40


def dot(vec: Column, weights: list[float]) -> Column:
    """Unrolled over the known length: plain arithmetic stays in whole-stage
    codegen (array lambdas would be interpreted per row)."""
    out = vec[0] * F.lit(float(weights[0]))
    for i, w in enumerate(weights[1:], start=1):
        out = out + vec[i] * F.lit(float(w))
    return out


def sq_dist(a: Column, b: Column, dim: int | None = None) -> Column:
    """Squared Euclidean distance; unrolled when the length is known."""
    if dim:
        out = (a[0] - b[0]) * (a[0] - b[0])
        for i in range(1, dim):
            out = out + (a[i] - b[i]) * (a[i] - b[i])
        return out
    diffs = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.aggregate(diffs, F.lit(0.0), lambda acc, x: acc + x)


def value_rank(df: DataFrame, value: str, key: str) -> DataFrame:
    """Exact 0-based rank of each row by (value, key) without a global
    window: a distributed running count over range partitions
    (``common.running_sums``), balanced however the values cluster."""
    ones = df.withColumn("__one", F.lit(1).cast("bigint"))
    out = running_sums(ones, [F.col(value), F.col(key)], ["__one"], prefix="__cum")
    return out.withColumn("__rank", F.col("__cum__one") - 1).drop("__one", "__cum__one")


def vector_groups(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, node): the smallest id carrying each row's vector."""
    reps = df.groupBy(vec_col).agg(F.min(id_col).alias("node"))
    return df.select(id_col, vec_col).join(reps, vec_col).select(id_col, "node")


def _directions(dim: int, count: int, seed: int) -> list[list[float]]:
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(count):
        r = rng.normal(size=dim)
        out.append(list(r / np.linalg.norm(r)))
    return out


def _block_bound(base: DataFrame, id_col: str, vec_col: str, dirs: list[list[float]], k: int,
                 block_size: int, dim: int) -> DataFrame:
    """(id, r2): k-th smallest squared distance among block candidates (NULL
    when a vector met fewer than k candidates)."""
    cands = None
    for p in range(len(dirs)):
        ranked = value_rank(base.select(id_col, vec_col, F.col(f"__p{p}").alias("__v")), "__v", id_col)
        for shift in (0, block_size // 2):
            blk = ranked.withColumn("__blk", F.floor((F.col("__rank") + shift) / block_size))
            a = blk.select(F.col(id_col).alias("a"), F.col(vec_col).alias("va"), "__blk")
            b = blk.select(F.col(id_col).alias("b"), F.col(vec_col).alias("vb"), "__blk")
            # distances inside the block join: only (a, b, d2) is shuffled below
            pairs = a.join(b, "__blk").filter(F.col("a") != F.col("b")) \
                     .select("a", "b", sq_dist(F.col("va"), F.col("vb"), dim).alias("d2"))
            cands = pairs if cands is None else cands.unionByName(pairs)
    # a pair met in several blocks has the same d2; keep it once
    cands = cands.dropDuplicates(["a", "b"])
    # <= 2 * projections * block_size candidates per vector
    kth = F.try_element_at(F.array_sort(F.collect_list("d2")), F.lit(k))
    return cands.groupBy("a").agg(kth.alias("r2")).select(F.col("a").alias(id_col), "r2")


def knn(df: DataFrame, id_col: str, vec_col: str, k: int = 5, dim: int | None = None, block_size: int = 64,
        projections: int = 2, seed: int = 42) -> DataFrame:
    """(id, nbr_id, dist2, nbr_rank) for every row of ``df``: its k nearest
    distinct other vectors (``nbr_id`` = the smallest id carrying the vector),
    exact, ordered by (dist2, nbr_id)."""
    if dim is None:
        dim = int(df.select(F.size(vec_col)).first()[0])
    groups = df.groupBy(vec_col).agg(F.min(id_col).alias(id_col))
    dirs = _directions(dim, max(projections, 2), seed)
    # the distinct vectors and their bounds feed several jobs: written once
    # to spark.checkpoint.dir (lineage cut, no executor memory held)
    base = groups.select(id_col, vec_col, *[dot(F.col(vec_col), u).alias(f"__p{i}")
                                            for i, u in enumerate(dirs)]).checkpoint()

    bound = _block_bound(base, id_col, vec_col, dirs, k, block_size, dim)
    q = base.join(bound, id_col, "left").withColumn("__r", F.sqrt("r2")).checkpoint()
    st = q.agg(F.min("__p0").alias("lo0"), F.max("__p0").alias("hi0"), F.min("__p1").alias("lo1"),
               F.max("__p1").alias("hi1"), F.percentile_approx("__r", 0.5).alias("med")).first()
    lo0, hi0, lo1, hi1 = (float(st[c]) for c in ("lo0", "hi0", "lo1", "hi1"))
    span = max(hi0 - lo0, hi1 - lo1)
    side0 = float(st["med"]) if st["med"] else span + 1.0
    side0 = max(side0, 1e-12)
    top = max(0, int(np.ceil(np.log2((span + 1.0) / side0))) + 1)  # whole range in <= 2 cells per axis
    # slack for rounding in the projected coordinates
    eps = 1e-9 * (1.0 + max(abs(lo0), abs(hi0), abs(lo1), abs(hi1)))

    # no bound (fewer than k candidates): the box covers the whole range
    rad = F.coalesce(F.col("__r") * F.lit(1.0 + 1e-9), F.lit(span + 1.0)) + F.lit(eps)
    # grid level of a probe: cell side in [radius / 2, radius), so every probe
    # touches at most 5 x 5 cells whatever its radius and scans at most
    # (2.5 .. 3)^2 / 4 of its box area
    level = F.least(F.greatest(F.ceil(F.log2(F.col("rad") / F.lit(side0))) - 1, F.lit(MIN_LEVEL)),
                    F.lit(top)).cast("int")
    probe = q.select(F.col(id_col).alias("a"), F.col(vec_col).alias("va"), F.col("__p0").alias("q0"),
                     F.col("__p1").alias("q1"), F.col("r2"), rad.alias("rad")).withColumn("__L", level)
    levels = sorted(r[0] for r in probe.select("__L").distinct().collect())  # <= top - MIN_LEVEL + 1 values

    def side(lv: Column) -> Column:
        return F.lit(side0) * F.pow(F.lit(2.0), lv)

    def cell(p: Column, lo: float, lv: Column) -> Column:
        return F.floor((p - F.lit(lo)) / side(lv)).cast("bigint")

    stored = base.select(F.col(id_col).alias("b"), F.col(vec_col).alias("vb"), F.col("__p0").alias("s0"),
                         F.col("__p1").alias("s1"), F.explode(F.array(*[F.lit(v) for v in levels])).alias("__L"))
    stored = stored.withColumns({"__c0": cell(F.col("s0"), lo0, F.col("__L")),
                                 "__c1": cell(F.col("s1"), lo1, F.col("__L"))})
    probe = probe.select("*", F.explode(F.sequence(cell(F.col("q0") - F.col("rad"), lo0, F.col("__L")),
                                                   cell(F.col("q0") + F.col("rad"), lo0, F.col("__L")))).alias("__c0"))
    probe = probe.select("*", F.explode(F.sequence(cell(F.col("q1") - F.col("rad"), lo1, F.col("__L")),
                                                   cell(F.col("q1") + F.col("rad"), lo1, F.col("__L")))).alias("__c1"))
    hits = (probe.join(stored, ["__L", "__c0", "__c1"])
            .filter((F.col("a") != F.col("b")) & (F.abs(F.col("q0") - F.col("s0")) <= F.col("rad"))
                    & (F.abs(F.col("q1") - F.col("s1")) <= F.col("rad")))
            .select("a", "b", "r2", sq_dist(F.col("va"), F.col("vb"), dim).alias("dist2"))
            .filter(F.col("r2").isNull() | (F.col("dist2") <= F.col("r2"))))
    w = Window.partitionBy("a").orderBy("dist2", "b")
    top = hits.withColumn("nbr_rank", F.row_number().over(w)).filter(F.col("nbr_rank") <= k) \
              .select(F.col("a").alias("node"), F.col("b").alias("nbr_id"), "dist2", "nbr_rank")
    # every row inherits the neighbours of its vector
    return vector_groups(df, id_col, vec_col).join(top, "node").drop("node")
