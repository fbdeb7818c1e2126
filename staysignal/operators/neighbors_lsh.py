"""k-nearest neighbours by random-projection hashing with measured recall, beside the exact search of ``neighbors``.

For many dimensions, where the exact search's boxes hold too much.  Neighbours are distinct vectors, as there.

1. **Tables.**  In every table a vector gets a code, one bit for each of a few random directions (is its projection
   above the sample median?), and one more projection.  Rows are range-partitioned and sorted by (table, code,
   projection) and compared inside consecutive blocks of ``block`` rows and inside those shifted by half a block, as
   one matrix product per block.  A row meets at most 1.5 x ``block`` others in a table, whatever the data look like.
2. **Recall.**  A bounded sample of rows is compared with all vectors by brute force (the sample is broadcast).
3. **Refinement.**  While the share of true neighbours found is below ``recall``, a row's candidates are its
   neighbours' neighbours (k x k rows), twice, and then more tables are added.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .neighbors import sq_dist, vector_groups

SAMPLE = 10_000  # vectors the medians are taken from
BLOCK_PER_NEIGHBOUR = 100  # rows of a block for each neighbour asked for: what bounds a row's candidates
QUERIES = 200  # rows whose neighbours are searched by brute force
PAIRS = "a {id}, b {id}, d2 double"


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _lowest(base: DataFrame, n: int, want: int, seed: int) -> list:
    """The ``want`` rows of the lowest hashes of ``base``, which has ``n`` rows.

    Every task answers a limit with ``want`` rows of its own, all of them held by the driver; so rows far above the
    bound expected are left out first, unless those below it turn out too few."""
    place = F.xxhash64("id", F.lit(seed))
    rows: list = []
    if n > 4 * want:
        rows = base.filter(place <= F.lit(2 ** 64 * 2 * want // n - 2 ** 63)).orderBy(place).limit(want).collect()
    return rows if len(rows) == want else base.orderBy(place).limit(want).collect()


def _hashed(base: DataFrame, first: int, tables: int, directions: np.ndarray, medians: np.ndarray, id_type: str) -> DataFrame:
    """(t, code, proj, id, vec): every vector once for each of the ``tables`` tables from number ``first`` on."""
    bits = directions.shape[1] - 1

    def f(batches):
        for batch in batches:
            x = _matrix(batch.column(1))
            for t in range(first, first + tables):
                p = x @ directions[t].T
                code = ((p[:, :bits] > medians[t, :bits]) << np.arange(bits)).sum(axis=1) if bits else np.zeros(len(x), np.int64)
                # the code's Gray rank: neighbours in the order differ in one bit
                rank = code.astype(np.int64)
                for s in (1, 2, 4, 8, 16, 32):
                    rank ^= rank >> s
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(rank), pa.array(p[:, bits]),
                                                  *batch.columns], names=["t", "code", "proj", "id", "vec"])
    return base.mapInArrow(f, f"t int, code long, proj double, id {id_type}, vec array<double>")


def _block_pairs(hashed: DataFrame, k: int, block: int, id_type: str) -> DataFrame:
    """The ``k`` nearest of each row's block mates, a table's partition after the other."""
    half = block // 2

    def nearest(ids: pa.ChunkedArray, x: np.ndarray):
        sq = (x * x).sum(axis=1)
        d2 = np.maximum(sq[:, None] + sq[None, :] - 2 * (x @ x.T), 0)
        np.fill_diagonal(d2, np.inf)
        near = min(k, len(x) - 1)
        at = np.argpartition(d2, near - 1, axis=1)[:, :near]
        own = np.repeat(np.arange(len(x)), near)
        exact = ((x[own] - x[at.ravel()]) ** 2).sum(axis=1)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(own)), ids.take(pa.array(at.ravel())), pa.array(exact)],
                                          names=["a", "b", "d2"])

    def f(batches):
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 8 * block:
                table = pa.Table.from_batches(held).combine_chunks()
                done = (table.num_rows - half) // half * half - half
                yield from blocks(table, done)
                table = table.slice(done).combine_chunks()
                held, rows = table.to_batches(), table.num_rows
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from blocks(table, table.num_rows)

    def blocks(table: pa.Table, done: int):
        t = table.column("t").to_numpy()
        x, ids = _matrix(table.column("vec")), table.column("id").combine_chunks()
        ids = pa.concat_arrays(ids.chunks) if isinstance(ids, pa.ChunkedArray) else ids
        for start in range(0, done, half):
            end = min(start + block, len(t))
            cuts = [start, *(start + 1 + np.flatnonzero(np.diff(t[start:end]))), end]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi - lo > 1:
                    yield nearest(ids.slice(lo, hi - lo), x[lo:hi])

    ordered = hashed.repartitionByRange("t", "code", "proj").sortWithinPartitions("t", "code", "proj")
    return ordered.mapInArrow(f, PAIRS.format(id=id_type))


def _top(pairs: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("a").orderBy("d2", "b")
    pairs = pairs.groupBy("a", "b").agg(F.min("d2").alias("d2"))
    return pairs.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).drop("r")


def _refined(best: DataFrame, base: DataFrame, k: int, dim: int) -> DataFrame:
    """``best`` after looking at the neighbours' neighbours (k x k candidates a row)."""
    step = best.select("a", F.col("b").alias("via")).join(best.select(F.col("a").alias("via"), "b"), "via")
    fresh = step.select("a", "b").filter(F.col("a") != F.col("b")).distinct()
    vectors = lambda c: base.select(F.col("id").alias(c), F.col("vec").alias(f"v{c}"))
    fresh = fresh.join(vectors("a"), "a").join(vectors("b"), "b").select("a", "b", sq_dist(F.col("va"), F.col("vb"), dim).alias("d2"))
    return _top(best.unionByName(fresh), k)


def measured_recall(best: DataFrame, base: DataFrame, k: int, dim: int, queries: int = QUERIES, seed: int = 42) -> float:
    """Share of the true neighbours of a sample of rows that ``best`` (a, b, d2) holds, equal distances counting."""
    rows = base.orderBy(F.xxhash64("id", F.lit(seed))).limit(queries).collect()  # ``queries`` rows
    rows = [r for r in rows if r["id"] is not None]
    if not rows:
        return 1.0
    asked, q = [r["id"] for r in rows], np.array([r["vec"] for r in rows], dtype=float)
    id_type = base.schema["id"].dataType.simpleString()

    def f(batches):  # a task's k nearest of every query: what leaves it doesn't grow with its rows
        names = pa.array(asked)
        ids, d2 = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                new, own = _matrix(part.column(1)), part.column(0)
                near = np.maximum((q * q).sum(axis=1)[:, None] + (new * new).sum(axis=1)[None, :] - 2 * (q @ new.T), 0)
                # a query is no neighbour of itself
                names = names.cast(own.type)
                place = pc.index_in(own, names).to_numpy(zero_copy_only=False)
                hit = np.flatnonzero(~np.isnan(place.astype(float)))
                near[place[hit].astype(int), hit] = np.inf
                top = min(k, near.shape[1])
                best_of = np.argpartition(near, top - 1, axis=1)[:, :top]
                found = own.take(pa.array(best_of.ravel())).to_numpy(zero_copy_only=False).reshape(best_of.shape)
                exact = ((q[:, None, :] - new[best_of]) ** 2).sum(axis=2)
                exact[np.isinf(np.take_along_axis(near, best_of, axis=1))] = np.inf
                ids, d2 = (found, exact) if ids is None else (np.hstack([ids, found]), np.hstack([d2, exact]))
                keep = np.argsort(d2, axis=1, kind="stable")[:, :k]
                ids, d2 = np.take_along_axis(ids, keep, axis=1), np.take_along_axis(d2, keep, axis=1)
        if ids is not None:
            real = np.isfinite(d2).ravel()
            a = names.take(pa.array(np.repeat(np.arange(len(asked)), ids.shape[1])[real]))
            yield pa.RecordBatch.from_arrays([a, pa.array(ids.ravel()[real], a.type), pa.array(d2.ravel()[real])], names=["a", "b", "d2"])
    every = base.filter(F.col("id").isNotNull()).select("id", "vec").mapInArrow(f, PAIRS.format(id=id_type))
    w = Window.partitionBy("a").orderBy("d2", "b")
    true = every.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k)
    far = true.groupBy("a").agg(F.max("d2").alias("far"), F.count("*").alias("n"))
    found = best.join(far, "a").filter(F.col("d2") <= F.col("far") * (1 + 1e-9) + 1e-12).groupBy("a").agg(F.count("*").alias("hit"))
    got = far.join(found, "a", "left").agg(F.sum(F.least("n", F.coalesce("hit", F.lit(0)))), F.sum("n")).first()
    return float(got[0] / got[1]) if got[1] else 1.0


def knn_lsh(df: DataFrame, id_col: str, vec_col: str, k: int = 5, dim: int | None = None, recall: float = 0.9,
            tables: int = 4, block: int | None = None, most_tables: int = 64, seed: int = 42) -> tuple[DataFrame, float]:
    """((id, nbr_id, dist2, nbr_rank), recall measured): up to ``k`` near distinct other vectors of every row.

    An empty table gives an empty result and recall 1.  ``ValueError`` if ``most_tables`` tables don't reach ``recall``.
    """
    dim = dim or int((df.select(F.size(vec_col)).first() or [1])[0])
    block = block or BLOCK_PER_NEIGHBOUR * k
    id_type = df.schema[id_col].dataType.simpleString()
    groups = df.groupBy(vec_col).agg(F.min(id_col).alias("id")).select("id", F.col(vec_col).cast("array<double>").alias("vec"))
    base = written(groups, "knn-base")
    n = base.count()
    bits = max(0, math.ceil(math.log2(max(1, n) / block)))
    rng = np.random.default_rng(seed)
    directions = rng.normal(size=(most_tables, bits + 1, dim))
    sample = np.array([r["vec"] for r in _lowest(base, n, SAMPLE, seed + 1)]).reshape(-1, dim)
    medians = np.median(sample @ directions.transpose(0, 2, 1), axis=1) if len(sample) else np.zeros((most_tables, bits + 1))
    best, used, got = None, 0, 0.0
    while n and got < recall:
        add = min(max(used, tables), most_tables - used)
        if not add:
            raise ValueError(f"recall {got:.3f} after {used} tables")
        pairs = _block_pairs(_hashed(base, used, add, directions, medians, id_type), k, block, id_type)
        best = written(_top(pairs if best is None else pairs.unionByName(best), k), "knn-best")
        used, got = used + add, measured_recall(best, base, k, dim, seed=seed)
        for _ in range(2):
            if got < recall:
                best = written(_refined(best, base, k, dim), "knn-best")
                got = measured_recall(best, base, k, dim, seed=seed)
    if best is None:
        best, got = base.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("d2")).limit(0), 1.0
    w = Window.partitionBy("a").orderBy("d2", "b")
    top = best.select(F.col("a").alias("node"), F.col("b").alias("nbr_id"), F.col("d2").alias("dist2"),
                      F.row_number().over(w).alias("nbr_rank"))
    return vector_groups(df, id_col, vec_col).join(top, "node").drop("node"), got
