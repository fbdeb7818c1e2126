"""Pairs within buckets, and connected components, without ever holding a
whole bucket or component in one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def in_blocks(rows: DataFrame, bucket: str, size: str, ident: str, block: int) -> DataFrame:
    """Rows of bucket with ``size`` rows dealt to groups (bucket, bi, bj) such
    that any two rows of a bucket meet in exactly one group that has both
    their blocks, and no group holds much more than two blocks of rows.
    ``blk`` is the row's own block."""
    n = F.ceil(F.col(size) / F.lit(float(block))).cast("int")
    rows = rows.withColumn("__n", n).withColumn("blk", F.pmod(F.xxhash64(ident, bucket), F.col("__n")).cast("int"))
    rows = rows.withColumn("__j", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    return rows.withColumns({"bi": F.least("blk", "__j"), "bj": F.greatest("blk", "__j")}).drop("__n", "__j")


def grouped(rows: DataFrame, keys: list[str], f: Callable[[pa.Table], pa.Table], schema) -> DataFrame:
    """``f`` over every group of ``keys``, many small groups to an Arrow batch
    (a group never waits for more than the batches it spans)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(table: pa.Table, upto: int):
            cuts = _cuts(table.slice(0, upto), keys)
            out = [f(table.slice(a, b - a)) for a, b in zip(cuts, cuts[1:])]
            out = [x for x in out if x is not None and x.num_rows]
            if out:
                yield from pa.concat_tables(out).combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            if held and all(held[-1].column(k)[-1] == batch.column(k)[-1] for k in keys) \
                    and all(held[0].column(k)[0] == batch.column(k)[-1] for k in keys):
                held.append(batch)
                continue
            table = pa.Table.from_batches([*held, batch])
            last = _cuts(table, keys)[-2]
            yield from flush(table, last)
            held = table.slice(last).combine_chunks().to_batches()
        if held:
            table = pa.Table.from_batches(held)
            yield from flush(table, table.num_rows)

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _cuts(table: pa.Table, keys: list[str]) -> np.ndarray:
    n = table.num_rows
    new = np.zeros(n, bool)
    if n:
        new[0] = True
    for k in keys:
        v = table.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(new), n)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least node of each node's component in the graph with edges (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
        while (root[root] != root).any():
            root = root[root]
    return root


def components(edges: DataFrame, name: str) -> DataFrame:
    """(id, root) of every node of ``edges`` (a, b): root is the least id of its
    component.  Alternates large-star and small-star steps; every step is
    written to the shared folder, and hub nodes meet their minimum in a join
    that Spark can split, never in one group."""
    e = written(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("v > u").distinct(),
                f"{name}-edges")
    state = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if state == now:
            return e.select(F.col("v").alias("id"), F.col("u").alias("root")).unionByName(
                e.select(F.col("u").alias("id"), F.col("u").alias("root")).distinct())
        state = now
        both = e.select(F.col("v").alias("x"), F.col("u").alias("y")).unionByName(
            e.select(F.col("u").alias("x"), F.col("v").alias("y")))
        least = written(both.groupBy("x").agg(F.min("y").alias("m")).withColumn("m", F.least("x", "m")), f"{name}-large")
        large = written(both.join(least, "x").filter("y > x").select(F.col("y").alias("v"), F.col("m").alias("u"))
                        .distinct(), f"{name}-large-star")
        low = written(large.groupBy("v").agg(F.min("u").alias("m")), f"{name}-small")
        moved = large.join(low, "v").filter("u > m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        e = written(moved.unionByName(low.select("v", F.col("m").alias("u"))).distinct(), f"{name}-small-star")
