"""Helpers shared by operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StructType

from ..session import written


def scalar_stats(df: DataFrame, **aggs: Column) -> dict[str, Column]:
    """Several aggregates of ``df`` as ONE scalar subquery (one extra scan,
    reused wherever the fields appear), returned as field Columns."""
    sub = df.agg(F.struct(*[a.alias(k) for k, a in aggs.items()]).alias("s")).scalar()
    return {k: sub.getField(k) for k in aggs}


def in_ranges(df: DataFrame, order: list[Column], step, schema: str | StructType, name: str) -> DataFrame:
    """``df`` range-partitioned and sorted by ``order`` and run through ``step(batches)``, partition by partition; a
    written table with the partition's number in ``__pid``.

    One exchange, on sampled bounds, so partitions hold similar row counts however the values cluster.  The table is
    written because what follows (totals and rows) must see the very same partition of every row.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__pid", F.spark_partition_id())
    return written(ordered.mapInArrow(step, schema), name)


def running_sums(df: DataFrame, order: Column | list[Column], cols: list[str], prefix: str = "cum_") -> DataFrame:
    """Inclusive running sums of the non-negative ``cols`` (numbers without nulls) in ``order`` (one or more Columns
    whose combined values must be distinct), without a window.

    Each range partition sums locally; the totals of the partitions before it, a table with one row per partition,
    are added as an offset where the rows lie.
    """
    order = order if isinstance(order, list) else [order]
    kinds = {c: T.DoubleType() if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)) else T.LongType() for c in cols}
    fields = [*df.schema.fields, T.StructField("__pid", T.IntegerType()), *[T.StructField(f"__run_{c}", k) for c, k in kinds.items()]]

    def step(batches):
        total = {c: 0 for c in cols}
        for batch in batches:
            added = []
            for c in cols:
                v = batch.column(c).to_numpy(zero_copy_only=False)
                run = np.cumsum(v, dtype=np.float64 if v.dtype.kind == "f" else np.int64) + total[c]
                total[c] = run[-1] if len(run) else total[c]
                added.append(pa.array(run))
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *(f"__run_{c}" for c in cols)])

    local = in_ranges(df, order, step, T.StructType(fields), "running")
    tot = local.groupBy("__pid").agg(*[F.max(f"__run_{c}").alias(f"__tot_{c}") for c in cols])
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offs = tot.select("__pid", *[F.coalesce(F.sum(f"__tot_{c}").over(before), F.lit(0)).alias(f"__off_{c}")
                                 for c in cols])
    out = local.join(F.broadcast(offs), "__pid")
    return out.select(*df.columns, *[(F.col(f"__run_{c}") + F.col(f"__off_{c}")).alias(f"{prefix}{c}")
                                     for c in cols])


# A joined-back table of at most this many rows may be broadcast after a count.
BROADCAST_ROWS = 10_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it is counted to hold at most ``rows``
    rows; left to the planner otherwise."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def quantiles(counts: DataFrame, qs: dict[str, float], groups: tuple[str, ...] = (), value: str = "value",
              n: str = "n") -> DataFrame:
    """Exact interpolated quantiles from (groups, value, n) counts: one row
    per group with a column per entry of ``qs``.

    The ranks are a distributed prefix sum over the counted values in (group,
    value) order, so no task holds the values of a column or group.
    """
    c = counts.filter(F.col(value).isNotNull()).select(*groups, value, F.col(n).cast("bigint").alias("__n"))
    run = running_sums(c, [F.col(g) for g in groups] + [F.col(value)], ["__n"])
    ends = run.groupBy(*groups).agg(F.min(F.col("cum___n") - F.col("__n")).alias("__start"),
                                    F.sum("__n").alias("__total"))
    if groups:
        ends = ends.withColumnsRenamed({g: f"__g{i}" for i, g in enumerate(groups)})
        cond = [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(groups)]
        run = run.join(broadcast_if_small(ends), cond)
        start, total = F.col("__start"), F.col("__total")
    else:
        s = ends.select(F.struct("__start", "__total").alias("s")).scalar()
        start, total = s["__start"], s["__total"]
    aggs = []
    for name, q in qs.items():
        pos = F.lit(float(q)) * (total - 1)
        lo = F.min(F.when(F.col("cum___n") - start > F.floor(pos), F.col(value)))
        hi = F.min(F.when(F.col("cum___n") - start > F.ceil(pos), F.col(value)))
        frac = F.max(pos - F.floor(pos))
        aggs.append((lo + (hi - lo) * frac).alias(name))
    return run.groupBy(*groups).agg(*aggs)


# Quantile sketches: a rank read from one is off by at most about RANK_ERROR of the rows (tested).
SKETCH_K, RANK_ERROR = 1600, 0.005


def sketched_quantiles(df: DataFrame, cols: list[str], qs: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Approximate quantiles of numeric columns (column_name and a column per entry of ``qs``) from mergeable KLL
    sketches: one scan, one partial aggregate, a few kilobytes a task for each column and group.  Nulls are left out;
    a column without values has null quantiles."""
    by = by or []
    value = lambda c: F.col(c).cast("double")
    sk = df.groupBy(*by).agg(*[F.kll_sketch_agg_double(F.when(~F.isnan(value(c)), value(c)), SKETCH_K).alias(f"__k{i}")
                               for i, c in enumerate(cols)])
    read = lambda i, q: F.when(F.kll_sketch_get_n_double(F.col(f"__k{i}")) > 0,
                               F.kll_sketch_get_quantile_double(F.col(f"__k{i}"), F.lit(float(q))))
    each = F.array(*[F.struct(F.lit(c).alias("column_name"), *[read(i, q).alias(n) for n, q in qs.items()])
                     for i, c in enumerate(cols)])
    return sk.select(*by, F.explode(each).alias("e")).select(*by, "e.*")
