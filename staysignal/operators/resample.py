"""Splits, folds, sampling, class weights and label masking.

Exact stratified ranks without a window per class
------------------------------------------------
A ``row_number() over (partition by label ...)`` puts a whole class in one
task -- with two classes, half the table per task.  Instead every row gets a
deterministic hash ``h`` and a bucket ``b = h * B / H``:

1. count rows per (stratum, bucket)  -- a partial aggregate, <= strata x B rows (B follows the row count);
2. running count of earlier buckets per stratum -- a window over that small
   table, joined back on (stratum, bucket) (broadcast only if the planner
   measures it to be small: the strata are the caller's columns);
3. rank inside (stratum, bucket) -- windows over ~n / (strata x B) rows each.

rank = offset(stratum, bucket) + in-bucket rank is the exact position of the
row in its stratum when ordered by (h, key).  Splits and folds are then plain
predicates on that rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASH_HEX_DIGITS = 15
HASH_MOD = 16 ** HASH_HEX_DIGITS


def row_hash(key: Column, seed: int = 42) -> Column:
    """Deterministic pseudo-random value in [0, 2^60) from an id of any type:
    the leading hex digits of the MD5 of ``<id text>:<seed>`` (NULL ids hash
    like the empty text), which other engines reproduce."""
    text = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, HASH_HEX_DIGITS), 16, 10).cast("bigint")


BUCKET_ROWS = 20_000


def stratified_rank(df: DataFrame, key: str, strata: list[str] | None = None, seed: int = 42,
                    buckets: int | None = None) -> DataFrame:
    """Adds ``__h`` (hash), ``rank`` (0-based position in the stratum by
    (hash, key)) and ``stratum_n`` (stratum size).  The number of hash buckets
    follows the row count (BUCKET_ROWS each); ranks don't depend on it."""
    strata = list(strata or [])
    buckets = buckets or max(1, -(-df.count() // BUCKET_ROWS))
    h = row_hash(F.col(key), seed)
    d = df.withColumn("__h", h).withColumn("__b", (F.col("__h") / float(HASH_MOD) * buckets).cast("int"))
    counts = d.groupBy(*strata, "__b").agg(F.count(F.lit(1)).alias("__cnt"))
    w = Window.partitionBy(*strata).orderBy("__b") if strata else Window.orderBy("__b")
    offsets = counts.select(*strata, "__b",
                            (F.sum("__cnt").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
                             - F.col("__cnt")).alias("__off"),
                            F.sum("__cnt").over(Window.partitionBy(*strata)).alias("stratum_n"))
    names = {c: f"__s{i}" for i, c in enumerate(strata)}
    offsets = offsets.withColumnsRenamed({**names, "__b": "__ob"})
    cond = [F.col("__b") == F.col("__ob")] + [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]
    d = d.join(offsets, cond).drop("__ob", *names.values())
    wb = Window.partitionBy(*strata, "__b").orderBy("__h", key)
    return d.withColumn("rank", (F.col("__off") + F.row_number().over(wb) - 1).cast("bigint")) \
            .drop("__b", "__off")


def _n_take(frac: float, n: Column) -> Column:
    return F.floor(F.lit(float(frac)) * n + F.lit(0.5))


def split(df: DataFrame, key: str, test_fraction: float = 0.2, strata: list[str] | None = None,
          seed: int = 42) -> DataFrame:
    """Adds ``split`` = 'test' for the first round(f * n_stratum) rows of each
    stratum in hash order, 'train' otherwise."""
    if not 0.0 < test_fraction < 1.0:
        raise ValueError("test_fraction must be in (0, 1)")
    r = stratified_rank(df, key, strata, seed)
    out = r.withColumn("split", F.when(F.col("rank") < _n_take(test_fraction, F.col("stratum_n")), "test")
                       .otherwise("train"))
    return out.drop("__h", "rank", "stratum_n")


def kfold(df: DataFrame, key: str, k: int = 5, strata: list[str] | None = None, seed: int = 42) -> DataFrame:
    """Adds ``fold`` in 0..k-1 (stratified round-robin over the hash order),
    usable as ``CrossValidator(foldCol='fold')``."""
    r = stratified_rank(df, key, strata, seed)
    return r.withColumn("fold", (F.col("rank") % k).cast("int")).drop("__h", "rank", "stratum_n")


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows chosen by the smallest hashes (TakeOrdered: n rows per task)."""
    return df.withColumn("__h", row_hash(F.col(key), seed)).orderBy("__h", key).limit(n).drop("__h")


def class_weights(df: DataFrame, label: str = "Churn") -> DataFrame:
    """Balanced weights n / (classes * n_c): one tiny aggregate."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    tot = F.sum("n_c").over(Window.partitionBy())            # <= #classes rows
    ncls = F.count(F.lit(1)).over(Window.partitionBy())
    return counts.select(label, "n_c", F.round(tot / (ncls * F.col("n_c")), 6).alias("weight"))


def with_class_weight(df: DataFrame, label: str = "Churn", out: str = "weight") -> DataFrame:
    """Attach the balanced weight per row (weightCol for Spark ML)."""
    w = class_weights(df, label).select(label, F.col("weight").alias(out))
    return df.join(w, label)  # one row per class: Spark broadcasts it by its measured size


def mask_labels(df: DataFrame, key: str, label: str = "Churn", hidden: float = 0.8, seed: int = 42) -> DataFrame:
    """Hide a fraction of labels as -1 (semi-supervised input)."""
    h = row_hash(F.col(key), seed)
    return df.withColumn("masked_label", F.when(h < F.lit(int(hidden * HASH_MOD)), F.lit(-1))
                         .otherwise(F.col(label).cast("int")))
