"""Embedding near-dedup: iterative quantisation codes, multi-index Hamming
tables, rerank with the original vectors.

A rotation of the principal axes is learned on a bounded sample so that the
signs are balanced, nearly uncorrelated bits.  The code is cut into tables of
``KEY_BITS`` bits; vectors whose keys differ by at most one bit in any table
meet there, which finds every pair of codes within 7 bits of 64 and most
beyond.  Pairs that meet are compared by the cosine of their vectors in double
precision, in blocks, so that no bucket is capped; a pair that meets in several
tables counts in the first only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .graph import components, grouped, in_blocks, local_roots

THRESHOLD = 0.95
CODE_BITS = 64
KEY_BITS = 16
SAMPLE_VALUES = 2_000_000  # components of the sample that the rotation is learned on
ROUNDS = 50
BLOCK = 1000
TABLE = "embeddings"


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit_itq(sample: np.ndarray, bits: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) such that the signs of (x - mean) @ projection are the code."""
    mean = sample.mean(axis=0)
    centred = sample - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, :bits]
    v = centred @ axes
    turn = np.linalg.qr(np.random.Generator(np.random.PCG64(7)).standard_normal((axes.shape[1],) * 2))[0]
    for _ in range(rounds):
        signs = np.where(v @ turn >= 0, 1.0, -1.0)
        u, _, w = np.linalg.svd(signs.T @ v)
        turn = w.T @ u.T
    return mean, axes @ turn


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _probes(vectors: DataFrame, dim: int, model) -> DataFrame:
    """(bucket, rid, home, code): a vector is at home in its key of each table
    and visits the keys that lack one of its one-bits, so keys one bit apart
    meet in exactly one bucket.  Vectors of another length than ``dim`` share
    one bucket for each length."""
    def f(batches):
        mean, projection = model
        bits = projection.shape[1]
        for b in batches:
            length, rid = b.column("dim").to_numpy(), b.column("rid").to_numpy()
            other = np.flatnonzero(length != dim)
            usual = np.flatnonzero(length == dim)
            if len(other):
                yield _rows(-length[other].astype(np.int64), rid[other], True, np.zeros(len(other), np.uint64))
            if not len(usual):
                continue
            x = unit(_matrix(b.column("embedding").take(pa.array(usual))))
            on = (x - mean) @ projection >= 0
            code = (on.astype(np.uint64) << np.arange(bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
            for t in range(-(-bits // KEY_BITS)):
                key = (code >> np.uint64(KEY_BITS * t)) & np.uint64((1 << KEY_BITS) - 1)
                bucket = (key | np.uint64(t << 32)).astype(np.int64)
                yield _rows(bucket, rid[usual], True, code)
                for j in range(min(KEY_BITS, bits - KEY_BITS * t)):
                    visits = np.flatnonzero((key >> np.uint64(j)) & np.uint64(1))
                    if len(visits):
                        yield _rows(bucket[visits] & ~(1 << j), rid[usual][visits], False, code[visits])
    return vectors.select("rid", "dim", "embedding").mapInArrow(f, "bucket long, rid long, home boolean, code long")


def _rows(bucket, rid, home, code) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(rid), pa.array(np.full(len(rid), home)),
                                       pa.array(code.view(np.int64))], names=["bucket", "rid", "home", "code"])


def _compare(threshold: float):
    def f(group: pa.Table) -> pa.Table | None:
        home, blk = group.column("home").to_numpy(zero_copy_only=False), group.column("blk").to_numpy()
        bi, bj = group.column("bi")[0].as_py(), group.column("bj")[0].as_py()
        left, right = np.flatnonzero(blk == bi), np.flatnonzero(blk == bj)
        if not home.any() or group.num_rows < 2 or not len(left) or not len(right):
            return None
        x = unit(_matrix(group.column("embedding")))
        i, j = np.nonzero(x[left] @ x[right].T >= threshold)
        a, b = left[i], right[j]
        ok = home[a] | home[b]
        if bi == bj:
            ok &= a < b
        bucket = group.column("bucket")[0].as_py()
        if bucket >= 0:
            code = group.column("code").to_numpy().view(np.uint64)
            differ = code[a] ^ code[b]
            for t in range(bucket >> 32):  # met in an earlier table: counted there
                ok &= np.bitwise_count((differ >> np.uint64(KEY_BITS * t)) & np.uint64((1 << KEY_BITS) - 1)) > 1
        a, b = a[ok], b[ok]
        if not len(a):
            return None
        rid, copies = group.column("rid").to_numpy(), group.column("copies").to_numpy()
        links = np.zeros(len(rid), np.int64)
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        root = local_roots(len(rid), a, b)
        rows = np.unique(np.concatenate([a, b]))
        return pa.table([pa.array(rid[rows]), pa.array(rid[root[rows]]), pa.array(links[rows])],
                        names=["a", "b", "links"])
    return f


def near_vectors(table: DataFrame, key: str = "vec_id", vector: str = "embedding",
                 threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing; vectors of different lengths don't link.  Equal
    vectors are linked copies of each other, compared once.  A null id
    counts as the least.  An empty table gives an empty result.
    """
    low = F.lit(-(1 << 63))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    usable = F.coalesce((F.size("v") > 0) & F.forall("v", finite) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = table.select(F.coalesce(F.col(f"`{key}`").cast("long"), low).alias("id"), F.col(f"`{vector}`").alias("v"))
    rows = rows.withColumn("ok", usable)
    distinct = written(rows.filter("ok").groupBy(F.col("v").alias("embedding"))
                       .agg(F.min("id").alias("least"), F.count("*").alias("copies"))
                       .withColumns({"rid": F.monotonically_increasing_id(), "dim": F.size("embedding")}), "vectors")
    usual = distinct.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    if usual is None:
        return rows.select(F.nullif("id", low).alias("vec_id"), F.lit(0).cast("long").alias("n_links"),
                           F.nullif("id", low).alias("component_id"), F.lit(True).alias("kept"))
    dim, n = usual["dim"], usual["count"]
    share = min(1.0, SAMPLE_VALUES / dim / n)
    sample = distinct.filter((F.col("dim") == dim) & (F.pmod(F.xxhash64("embedding"), F.lit(1 << 30)) <= share * (1 << 30)))
    sample = np.array([r[0] for r in sample.select("embedding").collect()], np.float64).reshape(-1, dim)
    model = fit_itq(unit(sample), min(CODE_BITS, dim)) if len(sample) else (np.zeros(dim), np.eye(dim)[:, :CODE_BITS])
    probes = _probes(distinct, dim, model)
    met = written(probes.groupBy("bucket").agg(F.count("*").alias("size"), F.max("home").alias("any"))
                  .filter("size > 1 and any").drop("any"), "buckets")
    placed = probes.join(met, "bucket").join(distinct.select("rid", "embedding", "copies"), "rid")
    dealt = in_blocks(placed, "bucket", "size", "rid", block)
    links = written(grouped(dealt.select("bucket", "bi", "bj", "blk", "rid", "home", "code", "copies", "embedding"),
                            ["bucket", "bi", "bj"], _compare(threshold), "a long, b long, links long"), "vector-links")
    root = components(links.select("a", "b"), "vectors").withColumnRenamed("id", "rid")
    counted = links.groupBy(F.col("a").alias("rid")).agg(F.sum("links").alias("links"))
    known = written(distinct.join(counted, "rid", "left").join(root, "rid", "left")
                    .withColumn("root", F.coalesce("root", "rid")), "vector-groups")
    named = written(known.groupBy("root").agg(F.min("least").alias("component_id")), "vector-classes")
    known = written(known.join(named, "root").select(
        "embedding", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "vector-result")
    linked = rows.filter("ok").join(known, F.col("v") == F.col("embedding")).select("id", "n_links", "component_id")
    out = linked.unionByName(rows.filter(~F.col("ok")).select("id", F.lit(0).cast("long").alias("n_links"),
                                                             F.col("id").alias("component_id")))
    return out.select(F.nullif("id", low).alias("vec_id"), "n_links", F.nullif("component_id", low).alias("component_id"),
                      (F.col("id") == F.col("component_id")).alias("kept"))


def digest(table: DataFrame) -> DataFrame:
    return near_vectors(table)


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
r(id, low) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT l.b, r.low FROM r JOIN l ON l.a = r.id WHERE r.low < l.b),
c AS (SELECT id, min(low) AS low FROM r GROUP BY id)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, c.low AS component_id,
  e.vec_id = c.low AS kept
FROM embeddings e JOIN c ON c.id = e.vec_id
"""
