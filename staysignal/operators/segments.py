"""Filters, per-group top-k, top-n reports and unions.

Top-n reports use ``orderBy(...).limit(n)``, which Spark plans as
TakeOrderedAndProject: each task keeps only its own n best rows, so the
final merge sees n x tasks rows no matter how large the table is.
Per-group top-k uses ``row_number`` over a partition by the group key; the
groups here are (feature, value) aggregates or single customers, so no
window partition grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import ID_COL, TARGET
from ..functions import cleaning as C


def non_numeric_audit(df: DataFrame, col: str) -> DataFrame:
    """Rows whose value is present but not a number."""
    return df.filter(C.is_non_numeric(col))


def top_n(df: DataFrame, order: list[Column], n: int, columns: list | None = None) -> DataFrame:
    out = df.orderBy(*order).limit(n)
    return out.select(*columns) if columns else out


def worst_segment_per_feature(df: DataFrame, features: list[str], target: str = TARGET) -> DataFrame:
    """For each feature, the value with the highest churn rate (ties -> the
    smallest value).  unpivot -> group -> rank inside each feature."""
    long = df.select(target, *[F.col(f).cast("string").alias(f) for f in features]) \
             .unpivot([target], features, "feature", "value")
    g = long.groupBy("feature", "value").agg(F.avg(target).alias("rate"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("feature").orderBy(F.desc("rate"), F.asc("value"))
    return (g.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") == 1)
             .select("feature", "value", F.round(F.col("rate") * 100, 4).alias("churn_rate_pct"), "n"))


def union_sources(a: DataFrame, b: DataFrame) -> DataFrame:
    """Concatenate two extracts by column name; columns missing on one side
    become NULL."""
    return a.unionByName(b, allowMissingColumns=True)


def head_preview(df: DataFrame, n: int, key: str = ID_COL) -> DataFrame:
    return df.orderBy(key).limit(n)
