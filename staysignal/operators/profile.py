"""Profiling and aggregation operators.

Design rules applied throughout:
* every figure is a ``groupBy``/``agg`` with map-side partial aggregation,
  so a hot key costs one partial row per task, never a skewed partition;
* wide column sets are ``unpivot``-ed into (column, value) rows and grouped,
  instead of one job per column;
* global windows only ever run over already-aggregated, domain-bounded rows
  (a handful of classes / bins), never over raw customers;
* per-row statistics learnt from the table are scalar subqueries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import (CATEGORICAL_FEATURES, HIST_BINS, NUMERIC_FEATURES, SERVICE_COLS, TARGET)
from ..functions.bands import cohort_tenure_band, eda_tenure_band
from .common import broadcast_if_small, quantiles, sketched_quantiles, scalar_stats


def rate_pct(col: str = TARGET) -> Column:
    return F.round(F.avg(F.col(col)) * F.lit(100.0), 4)


def churn_overview(df: DataFrame, target: str = TARGET) -> DataFrame:
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy()  # over <= 2 aggregated rows
    stay, churned = (F.coalesce(F.sum(F.when(F.col(target) == y, F.col("n"))).over(every), F.lit(0)) for y in (0, 1))
    return counts.select(target, "n", F.round(F.col("n") * F.lit(100.0) / F.sum("n").over(every), 4).alias("share_pct"),
                         F.round(stay / F.greatest(churned, F.lit(1)), 4).alias("imbalance_ratio"))


def kpi_summary(df: DataFrame) -> DataFrame:
    churned = F.col(TARGET) == 1
    return df.agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum(F.col(TARGET)).cast("bigint").alias("churners"),
        rate_pct().alias("churn_rate_pct"),
        F.round(F.avg("MonthlyCharges"), 4).alias("avg_monthly"),
        F.round(F.avg("tenure"), 4).alias("avg_tenure"),
        F.round(F.sum(F.when(churned, F.col("MonthlyCharges"))), 2).alias("revenue_at_risk"),
        F.round(F.sum("MonthlyCharges"), 2).alias("total_revenue"),
    )


def churn_by_dim(df: DataFrame, dim: str) -> DataFrame:
    return df.groupBy(dim).agg(rate_pct().alias("churn_rate_pct"), F.count(F.lit(1)).alias("n"))


def churn_by_tenure_band(df: DataFrame) -> DataFrame:
    return (df.withColumn("tenure_group", eda_tenure_band("tenure"))
              .filter(F.col("tenure_group").isNotNull())
              .groupBy("tenure_group")
              .agg(rate_pct().alias("churn_rate_pct"), F.count(F.lit(1)).alias("n")))


def cohort_table(df: DataFrame) -> DataFrame:
    return (df.withColumn("tenure_band", cohort_tenure_band("tenure"))
              .filter(F.col("tenure_band").isNotNull())
              .groupBy("tenure_band")
              .agg(F.count(F.lit(1)).alias("n"), rate_pct().alias("churn_rate_pct"),
                   F.round(F.avg("MonthlyCharges"), 4).alias("avg_monthly")))


def segment_kpis(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"), rate_pct().alias("churn_rate_pct"),
                  F.round(F.avg("MonthlyCharges"), 4).alias("avg_monthly"),
                  F.round(F.avg("tenure"), 4).alias("avg_tenure"))


def segment_share(df: DataFrame, predicate: Column) -> DataFrame:
    """Segment size and share of the whole table in one scan."""
    seg = F.sum(F.when(predicate, 1).otherwise(0)).cast("bigint")
    return df.agg(seg.alias("segment_n"), F.count(F.lit(1)).alias("total_n"),
                  F.round(seg * F.lit(100.0) / F.count(F.lit(1)), 4).alias("share_pct"))


def bool_split(df: DataFrame, value: str = "MonthlyCharges") -> DataFrame:
    """Churned vs stayed sizes and sums in one pass (no second scan)."""
    return df.groupBy(TARGET).agg(F.count(F.lit(1)).alias("n"),
                                  F.round(F.sum(value), 2).alias(f"sum_{value}"),
                                  F.round(F.avg(value), 4).alias(f"avg_{value}"))


def long_format(df: DataFrame, cols: list[str], name: str = "column_name", value: str = "value",
                ids: list[str] | None = None, cast: str | None = None) -> DataFrame:
    src = df.select(*(ids or []), *[(F.col(c).cast(cast) if cast else F.col(c)).alias(c) for c in cols])
    return src.unpivot(ids or [], cols, name, value)


def services_matrix(df: DataFrame, services=SERVICE_COLS) -> DataFrame:
    """Churn rate (%) by service x status, N/A statuses skipped, pivoted."""
    long = (long_format(df, list(services), "Service", "Status", ids=[TARGET])
            .filter(~F.lower(F.col("Status")).isin("no internet service", "no phone service")))
    # pivot on a known value list as conditional aggregates: one aggregation
    # (one shuffle) instead of pivot's group-then-pivot pair
    return long.groupBy("Service").agg(*[
        F.round(F.avg(F.when(F.col("Status") == v, F.col(TARGET))) * F.lit(100.0), 4).alias(v)
        for v in ["No", "Yes"]])


def revenue_at_risk(df: DataFrame) -> DataFrame:
    churned = F.sum(F.when(F.col(TARGET) == 1, F.col("MonthlyCharges")))
    retained = F.sum(F.when(F.col(TARGET) == 0, F.col("MonthlyCharges")))
    return df.agg(F.round(churned, 2).alias("at_risk_revenue"),
                  F.round(retained, 2).alias("retained_revenue"),
                  F.round(churned * F.lit(100.0) / (churned + retained), 4).alias("at_risk_pct"))


def churn_hierarchy(df: DataFrame) -> DataFrame:
    label = F.when(F.col(TARGET) == 1, "Churn").otherwise("No Churn").alias("Churn_Label")
    return (df.select("Contract", "InternetService", label)
              .rollup("Contract", "InternetService", "Churn_Label")
              .agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("bigint").alias("level")))


def correlation_matrix(df: DataFrame, cols=NUMERIC_FEATURES) -> DataFrame:
    """Pearson correlation of every column pair (i < j) in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    wide = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}")
                    for a, b in pairs])
    long = wide.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "corr")
    parts = F.split(F.col("pair"), r"\|")
    return long.select(parts.getItem(0).alias("col_a"), parts.getItem(1).alias("col_b"),
                       F.round("corr", 6).alias("corr"))


def null_report(df: DataFrame) -> DataFrame:
    """Null count and % per column, only columns that have nulls."""
    n = F.count(F.lit(1))
    wide = df.agg(n.alias("__rows"), *[F.sum(F.col(c).isNull().cast("int")).cast("bigint").alias(c)
                                      for c in df.columns])
    long = wide.unpivot(["__rows"], df.columns, "column_name", "nulls")
    return (long.filter(F.col("nulls") > 0)
                .select("column_name", "nulls",
                        F.round(F.col("nulls") * F.lit(100.0) / F.col("__rows"), 4).alias("null_pct")))


def _shape(df: DataFrame, stage: str) -> DataFrame:
    nulls = sum((F.col(c).isNull().cast("bigint") for c in df.columns), F.lit(0).cast("bigint"))
    return df.agg(F.lit(stage).alias("stage"), F.count(F.lit(1)).alias("rows"),
                  F.lit(len(df.columns)).cast("bigint").alias("cols"),
                  F.coalesce(F.sum(nulls), F.lit(0)).cast("bigint").alias("nulls"))


def clean_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    return _shape(before, "before").unionByName(_shape(after, "after"))


HLL_BITS = 14  # distinct counts are off by about 0.8 % (one standard error), few values are counted exactly


def column_profile_sketched(df: DataFrame) -> DataFrame:
    """As ``column_profile``, distinct counts from HLL sketches: one scan, one
    partial aggregate of some 16 kB a column and task; nothing else is shuffled."""
    dtypes = dict(df.dtypes)
    each = [F.struct(F.lit(c).alias("column_name"), F.lit(dtypes[c]).alias("dtype"),
                     F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(F.col(c).cast("string"), HLL_BITS)), F.lit(0))
                     .cast("bigint").alias("n_distinct"), F.min(c).cast("string").alias("sample_value")) for c in df.columns]
    return df.agg(F.array(*each).alias("a")).select(F.explode("a").alias("e")).select("e.*")


def column_profile(df: DataFrame) -> DataFrame:
    """dtype, exact distinct count and a deterministic sample (the minimum)
    per column.  Distinct values are grouped as narrow (column, value) rows
    first, then counted, so no aggregate expands the wide rows."""
    dtypes = dict(df.dtypes)
    wide = df.agg(*[F.min(c).cast("string").alias(c) for c in df.columns])
    long = wide.unpivot([], df.columns, "column_name", "sample_value")
    texts = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    values = texts.unpivot([], df.columns, "column_name", "value").filter(F.col("value").isNotNull())
    n = values.groupBy("column_name", "value").agg(F.lit(1).alias("one")) \
              .groupBy("column_name").agg(F.count(F.lit(1)).alias("n_distinct"))
    dtype = F.element_at(F.create_map(*[x for c in df.columns for x in (F.lit(c), F.lit(dtypes[c]))]),
                         F.col("column_name"))
    return long.join(n, "column_name", "left").select(
        "column_name", dtype.alias("dtype"), F.coalesce("n_distinct", F.lit(0)).cast("bigint").alias("n_distinct"),
        "sample_value")


def categorical_profile(df: DataFrame, cols=CATEGORICAL_FEATURES) -> DataFrame:
    """Distinct count and top value (ties -> smallest) per categorical column.

    Two partial aggregates, no window: (column, value) counts, then per column
    the count of values and ``min_by(value, (-count, value))``, so even a
    column with as many distinct values as rows is merged map-side."""
    counts = long_format(df, list(cols)).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("cnt"))
    top = F.min_by(F.struct("value", "cnt"), F.struct((-F.col("cnt")).alias("k"), F.col("value").alias("v")))
    return (counts.groupBy("column_name")
                  .agg(F.count(F.lit(1)).alias("n_distinct"), top.alias("t"))
                  .select("column_name", "n_distinct", F.col("t.value").alias("top_value"),
                          F.col("t.cnt").alias("top_count")))


def numeric_profile(df: DataFrame, cols=NUMERIC_FEATURES) -> DataFrame:
    long = long_format(df, list(cols), cast="double")
    return long.groupBy("column_name").agg(
        F.round(F.avg("value"), 2).alias("mean"), F.round(F.stddev_samp("value"), 2).alias("std"),
        F.round(F.min("value"), 2).alias("min"), F.round(F.max("value"), 2).alias("max"))


def describe(df: DataFrame, cols=NUMERIC_FEATURES, exact: bool = True) -> DataFrame:
    """count/mean/std/min/quartiles/max per numeric column; the quartiles are
    exact and read from the counted values (``common.quantiles``), or with
    ``exact=False`` from quantile sketches."""
    long = long_format(df, list(cols), cast="double")
    stats = long.groupBy("column_name").agg(
        F.count("value").alias("count"), F.round(F.avg("value"), 6).alias("mean"),
        F.round(F.stddev_samp("value"), 6).alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    wanted = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    if exact:
        q = quantiles(long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n")), wanted, ("column_name",))
    else:
        q = sketched_quantiles(df, list(cols), wanted)
    out = stats.join(q, "column_name", "left")  # one row per column on both sides
    return out.select("column_name", "count", "mean", "std", "min",
                      *[F.round(c, 6).alias(c) for c in ("q25", "q50", "q75")], "max")


def crosstab(df: DataFrame, row: str, col: str, values: list) -> DataFrame:
    """Two-way contingency table, one column ``{col}_{v}`` per listed value."""
    return df.groupBy(row).agg(*[F.count_if(F.col(col) == F.lit(v)).alias(f"{col}_{v}") for v in values])


def box_stats(df: DataFrame, value: str, by: str = TARGET, exact: bool = True) -> DataFrame:
    """Quartiles, 1.5*IQR whiskers and outlier count per group, all from the
    counted (group, value) pairs; raw rows are shuffled by none of them.
    With ``exact=False`` the quartiles come from quantile sketches."""
    hist = df.groupBy(by, F.col(value).cast("double").alias("value")).agg(F.count(F.lit(1)).alias("n")) \
             .filter(F.col("value").isNotNull())
    ends = hist.groupBy(by).agg(F.min("value").alias("min"), F.max("value").alias("max"))
    wanted = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    q = quantiles(hist, wanted, (by,)) if exact else sketched_quantiles(df, [value], wanted, [by]).drop("column_name")
    stats = ends.join(q, by)
    stats = stats.withColumns({"lo_fence": F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")),
                               "hi_fence": F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))})
    joined = hist.join(broadcast_if_small(stats.select(by, "lo_fence", "hi_fence")), by)
    inside = (F.col("value") >= F.col("lo_fence")) & (F.col("value") <= F.col("hi_fence"))
    whiskers = joined.groupBy(by).agg(
        F.min(F.when(inside, F.col("value"))).alias("lower_whisker"),
        F.max(F.when(inside, F.col("value"))).alias("upper_whisker"),
        F.sum(F.when(inside, 0).otherwise(F.col("n"))).cast("bigint").alias("n_outliers"))
    return stats.join(whiskers, by).select(
        by, *[F.round(c, 6).alias(c) for c in ["min", "q1", "median", "q3", "max", "lower_whisker",
                                                 "upper_whisker"]], "n_outliers")


def _bin(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    width = hi - lo
    raw = F.floor((x - lo) / width * F.lit(float(bins)))
    return F.when(width > 0, F.least(raw, F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")


def histogram(df: DataFrame, col: str, bins: int = HIST_BINS, by: str = TARGET) -> DataFrame:
    """Equal-width bins over [min, max] (last edge closed), counted per class."""
    x = F.col(col).cast("double")
    st = scalar_stats(df, lo=F.min(x), hi=F.max(x))
    lo, hi = st["lo"], st["hi"]
    b = _bin(x, lo, hi, bins)
    out = df.groupBy(by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(by, "bin",
                      F.round(lo + F.col("bin") * (hi - lo) / F.lit(float(bins)), 6).alias("bin_lo"),
                      F.round(lo + (F.col("bin") + 1) * (hi - lo) / F.lit(float(bins)), 6).alias("bin_hi"),
                      "n")


def multi_histogram(df: DataFrame, cols: list[str], bins: int = HIST_BINS, by: str = TARGET) -> DataFrame:
    """Histograms of several columns in one job: unpivot, per-feature range,
    then a single grouped count."""
    long = long_format(df, cols, "feature", "value", ids=[by], cast="double")
    st = scalar_stats(df, **{f"{k}{i}": f(F.col(c).cast("double")) for i, c in enumerate(cols)
                             for k, f in (("lo", F.min), ("hi", F.max))})
    rng = [(F.col("feature") == c, st[f"lo{i}"], st[f"hi{i}"]) for i, c in enumerate(cols)]
    lo, hi = (F.coalesce(*[F.when(r[0], r[k]) for r in rng]) for k in (1, 2))
    j = long.withColumns({"lo": lo, "hi": hi})
    b = _bin(F.col("value"), F.col("lo"), F.col("hi"), bins)
    out = j.groupBy("feature", by, b.alias("bin"), "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
    return out.select("feature", by, "bin",
                      F.round(F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / F.lit(float(bins)), 6).alias("bin_lo"),
                      F.round(F.col("lo") + (F.col("bin") + 1) * (F.col("hi") - F.col("lo")) / F.lit(float(bins)), 6).alias("bin_hi"),
                      "n")


def distribution_columns(df: DataFrame, cols=NUMERIC_FEATURES, limit: int | None = None) -> list[str]:
    """Numeric columns with more than two distinct values (all, or the first ``limit``).
    A column has a third value if one lies strictly between its ends."""
    ends = scalar_stats(df, **{f"{k}{i}": f(c) for i, c in enumerate(cols) for k, f in (("lo", F.min), ("hi", F.max))})
    row = df.agg(*[F.coalesce(F.bool_or((F.col(c) > ends[f"lo{i}"]) & (F.col(c) < ends[f"hi{i}"])), F.lit(False))
                   .alias(c) for i, c in enumerate(cols)]).first()
    return [c for c in cols if row[c]][:limit]


def feature_distributions(df: DataFrame, cols=NUMERIC_FEATURES, bins: int = HIST_BINS) -> DataFrame:
    return multi_histogram(df, distribution_columns(df, cols), bins)


def scatter_bins(df: DataFrame, x: str = "tenure", y: str = "MonthlyCharges", bins: int = 20,
                 by: str = TARGET) -> DataFrame:
    """2-D binned point counts (the scalable form of a scatter plot)."""
    xv, yv = F.col(x).cast("double"), F.col(y).cast("double")
    st = scalar_stats(df, xlo=F.min(xv), xhi=F.max(xv), ylo=F.min(yv), yhi=F.max(yv))
    xlo, xhi, ylo, yhi = st["xlo"], st["xhi"], st["ylo"], st["yhi"]
    return df.groupBy(by, _bin(xv, xlo, xhi, bins).alias("x_bin"), _bin(yv, ylo, yhi, bins).alias("y_bin")) \
             .agg(F.count(F.lit(1)).alias("n"))
