"""Cleaning, imputation and encoding operators (DataFrame -> DataFrame).

All of them are narrow (per-row) transformations except where a statistic
must be learnt (imputation, scaling, level lists); those learn it with one
partial aggregate and apply it as a scalar subquery, never a cross join.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import (BINARY_COLS, CATEGORICAL_FEATURES, ID_COL, INTERNET_SERVICE_COLS,
                         NO_INTERNET, TARGET)
from ..functions import cleaning as C
from .common import broadcast_if_small, in_ranges, quantiles, running_sums, scalar_stats, sketched_quantiles

CLEAN_ORDER = ["gender", "SeniorCitizen", "Partner", "Dependents", "tenure", "PhoneService",
               "MultipleLines", "InternetService", "OnlineSecurity", "OnlineBackup",
               "DeviceProtection", "TechSupport", "StreamingTV", "StreamingMovies", "Contract",
               "PaperlessBilling", "PaymentMethod", "MonthlyCharges", "TotalCharges", "Churn"]


def drop_columns(df: DataFrame, cols=(ID_COL, "Unnamed: 0", "_c0")) -> DataFrame:
    """Drop id / index columns when present (missing names are ignored)."""
    return df.drop(*[c for c in cols if c in df.columns])


def clean_yes_no(df: DataFrame, cols=BINARY_COLS, strict: bool = True) -> DataFrame:
    present = [c for c in cols if c in df.columns]
    return df.withColumns({c: C.binary_flag(c, strict) for c in present})


def clean_label(df: DataFrame, target: str = TARGET, strict: bool = True) -> DataFrame:
    """Map the target to 1/0 and drop rows whose label is not recognised."""
    if target not in df.columns:
        return df
    return (df.withColumn(target, C.yes_no_code(target, strict).cast("int"))
              .filter(F.col(target).isNotNull()))


def clean_label_text(df: DataFrame, target: str = TARGET) -> DataFrame:
    return df.withColumn(target, C.label_text(target))


def clean_senior(df: DataFrame, col: str = "SeniorCitizen") -> DataFrame:
    return df.withColumn(col, C.senior_flag(col)) if col in df.columns else df


def fill_services(df: DataFrame) -> DataFrame:
    fills = {c: NO_INTERNET for c in INTERNET_SERVICE_COLS if c in df.columns}
    if "MultipleLines" in df.columns:
        fills["MultipleLines"] = "No"
    return df.fillna(fills)


def collapse_services(df: DataFrame) -> DataFrame:
    """'No internet service' -> 'No' on the six internet add-ons."""
    present = [c for c in INTERNET_SERVICE_COLS if c in df.columns]
    return df.replace(NO_INTERNET, "No", subset=present)


def clean_total_charges(df: DataFrame, impute: bool = True) -> DataFrame:
    if "TotalCharges" not in df.columns:
        return df
    return df.withColumn("TotalCharges", C.total_charges("TotalCharges", impute=impute))


def blank_to_null(df: DataFrame, col: str = "TotalCharges") -> DataFrame:
    """' ' -> NULL, then numeric."""
    return df.withColumn(col, C.blank_to_null(col).try_cast("double"))


def drop_nulls(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    return df.dropna(how="any", subset=subset)


def dedup(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    return df.dropDuplicates(subset) if subset else df.dropDuplicates()


def ffill(df: DataFrame, cols: list[str], order_by: str, partition_by: list[str] | None = None) -> DataFrame:
    """Forward fill NULLs in ``order_by`` order (optionally per partition key): the last non-null value before a row.

    Rows are range-partitioned by (keys, order column of any type) and filled inside their partition, so neither a
    hot key nor a table without a key is one task.  What a partition's first key has seen before it follows from
    one row per partition: the keys at its ends and the values it ends with.  Ties in ``order_by`` follow no order.
    """
    keys = list(partition_by or [])
    fields = [T.StructField(f.name, f.dataType) for f in df.schema] + [T.StructField("__pid", T.IntegerType())]

    def step(batches):
        last = None  # the last row, filled
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*([last] if last else []), batch]).combine_chunks()
            n = table.num_rows
            new = np.zeros(n, bool)
            new[0] = True
            for k in keys:
                c = table.column(k).combine_chunks()
                c = c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
                same = pc.fill_null(pc.equal(c[1:], c[:-1]), False)
                both = pc.and_(pc.is_null(c[1:]), pc.is_null(c[:-1]))
                new[1:] |= ~pc.or_(same, both).to_numpy(zero_copy_only=False)
            start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            for name in cols:
                c = table.column(name)
                seen = np.maximum.accumulate(np.where(c.is_valid().to_numpy(), np.arange(n), -1))
                at = pa.array(seen, mask=seen < start)
                table = table.set_column(table.schema.get_field_index(name), name, c.take(at))
            filled = table.slice(1 if last else 0).combine_chunks().to_batches()
            last = table.slice(n - 1).combine_chunks().to_batches()[0]
            yield from filled

    order = [F.col(c) for c in (*keys, order_by)]
    local = in_ranges(df, order, step, T.StructType(fields), "ffill")
    key, end = F.struct(*[F.col(k) for k in keys], F.lit(0).alias("__one")), F.struct(*order)
    ends = local.groupBy("__pid").agg(F.min(key).alias("first"), F.max(key).alias("last"),
                                      F.max_by(F.struct(*cols), end).alias("values")).orderBy("__pid").collect()
    carried, before = [], None  # one row per partition
    for r in ends:
        into = before[1] if before and before[0] == r["first"] else [None] * len(cols)
        carried.append((r["__pid"], *into))
        own = [v if v is not None else w for v, w in zip(r["values"], into)] if r["first"] == r["last"] else list(r["values"])
        before = (r["last"], own)
    kinds = [T.StructField("__p", T.IntegerType()), *[T.StructField(f"__in_{i}", df.schema[c].dataType) for i, c in enumerate(cols)]]
    spark = df.sparkSession
    carry = F.broadcast(spark.createDataFrame(carried, T.StructType(kinds)))
    firsts = [T.StructField("__q", T.IntegerType()), T.StructField("__first", local.select(key.alias("k")).schema["k"].dataType)]
    first = F.broadcast(spark.createDataFrame([(r["__pid"], r["first"]) for r in ends], T.StructType(firsts)))
    out = local.join(carry, F.col("__pid") == F.col("__p"), "left").join(first, F.col("__pid") == F.col("__q"), "left")
    at_start = key.eqNullSafe(F.col("__first"))
    return out.withColumns({c: F.coalesce(F.col(c), F.when(at_start, F.col(f"__in_{i}"))) for i, c in enumerate(cols)}) \
              .select(*df.columns)


def clean(df: DataFrame, keep_id: bool = False, strict: bool = True) -> DataFrame:
    """The full batch cleaning chain (reference ``clean_data``)."""
    out = df if keep_id else drop_columns(df)
    out = (out.transform(clean_yes_no, strict=strict)
              .transform(clean_label, strict=strict)
              .transform(clean_senior)
              .transform(fill_services)
              .transform(clean_total_charges, impute=True))
    ordered = ([ID_COL] if keep_id and ID_COL in out.columns else []) + \
              [c for c in CLEAN_ORDER if c in out.columns] + \
              [c for c in out.columns if c not in CLEAN_ORDER and c != ID_COL]
    out = out.select(*ordered)
    # Only columns Spark still marks nullable can hold NULL here (filled flags
    # and services are coalesced); checking just those is the same filter but
    # lets column pruning drop unused raw columns from the scan.
    nullable = [f.name for f in out.schema.fields if f.nullable]
    return out.dropna(how="any", subset=nullable) if nullable else out


def learnable(df: DataFrame) -> DataFrame:
    """The raw rows ``clean`` would keep, attributes as they are, the label as 1/0."""
    known = [F.col(c).isNotNull() for c in ("gender", "tenure", "InternetService", "Contract", "PaymentMethod",
                                            "MonthlyCharges")]
    return clean_label(df).filter(reduce(lambda a, b: a & b, known) & C.total_charges("TotalCharges").isNotNull())


def preprocess_score_input(df: DataFrame, flags=BINARY_COLS) -> DataFrame:
    """Cleaning for scoring: no row is dropped and TotalCharges stays NULL
    when it does not parse.  ``flags`` are the Yes/No columns still to be read."""
    return (df.transform(clean_yes_no, cols=flags)
              .transform(clean_senior)
              .transform(clean_total_charges, impute=False)
              .transform(fill_services))


# --------------------------------------------------------------------------
# Imputation: statistics learnt on one frame (train), applied to another.
# --------------------------------------------------------------------------

def impute(train: DataFrame, target: DataFrame, cols: list[str], strategy: str, exact: bool = True) -> DataFrame:
    """Fill NULLs of ``cols`` in ``target`` using ``train`` statistics (all
    columns' statistics in one scalar subquery).

    strategy: mean | median | mode | zero.  Median is the exact (interpolated)
    percentile (``exact=False``: from a quantile sketch, in one scan); mode
    breaks ties by the smallest value.
    """
    if strategy == "zero":
        return target.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(target.schema[c].dataType))
                                   for c in cols})
    if strategy == "mean":
        st = scalar_stats(train, **{f"v{i}": F.avg(c) for i, c in enumerate(cols)})
        return target.withColumns({c: F.coalesce(F.col(c).cast("double"), st[f"v{i}"]) for i, c in enumerate(cols)})
    if strategy == "median" and not exact:
        med = sketched_quantiles(train, cols, {"q": 0.5})
        st = scalar_stats(med, **{c: F.max(F.when(F.col("column_name") == c, F.col("q"))) for c in cols})
    elif strategy == "median":
        long = train.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value"))
                                                for c in cols])).alias("s")).select("s.*")
        med = quantiles(long.groupBy("name", "value").agg(F.count(F.lit(1)).alias("n")), {"q": 0.5}, ("name",))
        st = scalar_stats(med, **{c: F.max(F.when(F.col("name") == c, F.col("q"))) for c in cols})
    elif strategy == "mode":  # a grouped count per column: no value -> count map in one buffer
        st = {}
        for c in cols:
            n = train.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("v")).agg(F.count(F.lit(1)).alias("n"))
            st[c] = n.agg(F.min_by("v", F.struct((-F.col("n")).alias("k"), "v"))).scalar()
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    return target.withColumns({c: F.coalesce(F.col(c), st[c].cast(target.schema[c].dataType)) for c in cols})


# --------------------------------------------------------------------------
# Encodings
# --------------------------------------------------------------------------

def label_encode(train: DataFrame, target: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Alphabetical code 0..n-1 learnt on ``train``; unseen values fail
    loudly (as the reference does) through ANSI ``assert_true``."""
    out = out or f"{col}_code"
    # code = position among the distinct levels: a distributed running count
    # (range partitions), so a high-cardinality column is not one task
    levels = running_sums(train.select(col).distinct().withColumn("_one", F.lit(1).cast("bigint")),
                          [F.col(col)], ["_one"], prefix="_cum") \
        .select(col, (F.col("_cum_one") - 1).alias("_code"))
    # one row per distinct level: broadcast after a count, so that a column
    # of few levels does not shuffle the whole table on them
    joined = target.join(broadcast_if_small(levels.withColumnRenamed(col, "_lvl")),
                         F.col(col) == F.col("_lvl"), "left")
    return (joined.withColumn(out, F.when(F.col("_code").isNotNull(), F.col("_code").cast("int"))
                              .otherwise(F.raise_error(F.concat(F.lit("unseen label: "), F.col(col)))))
                  .drop("_lvl", "_code"))


def ordinal_encode(df: DataFrame, mapping: dict[str, dict[str, int]], suffix: str = "_enc") -> DataFrame:
    """Fixed dictionaries; unmapped -> 0."""
    cols = {}
    for c, m in mapping.items():
        pairs = []
        for k, v in m.items():
            pairs += [F.lit(k), F.lit(v)]
        cols[c + suffix] = F.coalesce(F.element_at(F.create_map(*pairs), F.col(c)), F.lit(0))
    return df.withColumns(cols)


def one_hot(df: DataFrame, levels: dict[str, list[str]], drop_first: bool = True) -> DataFrame:
    """Indicator columns ``{col}_{level}`` from a known level list; the first
    (alphabetical) level is dropped and unknown values encode as all zeros."""
    cols = {}
    for c, lv in levels.items():
        keep = sorted(lv)[1:] if drop_first else sorted(lv)
        for level in keep:
            cols[f"{c}_{level}"] = F.when(F.col(c) == level, 1).otherwise(0)
    return df.withColumns(cols)


def category_levels(df: DataFrame, cols=CATEGORICAL_FEATURES) -> dict[str, list[str]]:
    """Distinct levels per categorical column, one small aggregate (the
    result is bounded by the domains, not the row count)."""
    row = df.agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in cols]).first()
    return {c: list(row[c]) for c in cols}


def align_columns(df: DataFrame, columns: list[str], fill=0) -> DataFrame:
    """Reindex to ``columns``: missing ones become ``fill``, extra ones drop."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(fill).alias(c) for c in columns])


def standardize(train: DataFrame, target: DataFrame, cols: list[str], suffix: str = "_z") -> DataFrame:
    """z-score with population std (matches sklearn), statistics from
    ``train`` in ONE scalar subquery; zero std leaves the centred value."""
    st = scalar_stats(train, **{f"m{i}": F.avg(c) for i, c in enumerate(cols)},
                      **{f"s{i}": F.stddev_pop(c) for i, c in enumerate(cols)})
    out = {}
    for i, c in enumerate(cols):
        sd = st[f"s{i}"]
        out[c + suffix] = (F.col(c) - st[f"m{i}"]) / F.when(sd > 0, sd).otherwise(F.lit(1.0))
    return target.withColumns(out)


def minmax_scale(df: DataFrame, cols: list[str], suffix: str = "_mm", stats_from: DataFrame | None = None) -> DataFrame:
    """(x - min) / range clipped to [0, 1]; a zero range divides by 1.
    Min/max of every column come from ``stats_from`` (default ``df``) in one
    scalar subquery."""
    src = stats_from if stats_from is not None else df
    st = scalar_stats(src, **{f"lo{i}": F.min(F.col(c).cast("double")) for i, c in enumerate(cols)},
                      **{f"hi{i}": F.max(F.col(c).cast("double")) for i, c in enumerate(cols)})
    out = {}
    for i, c in enumerate(cols):
        lo, hi = st[f"lo{i}"], st[f"hi{i}"]
        rng = F.when(hi - lo == 0, F.lit(1.0)).otherwise(hi - lo)
        out[c + suffix] = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(c) - lo) / rng))
    return df.withColumns(out)


def segment_filter(df: DataFrame, **values) -> DataFrame:
    """AND of ``isin`` filters; an empty or missing list means no filter.
    Stays a plain predicate, so it is pushed to the parquet scan."""
    preds = [F.col(c).isin(list(v)) for c, v in values.items() if v]
    return df.filter(reduce(lambda a, b: a & b, preds)) if preds else df
