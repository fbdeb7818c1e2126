"""SMOTE: synthetic minority rows by interpolation towards near neighbours
(SURVEY 2.9), applied to an assembled feature array.

Counts follow the original rule: n_new = int(ratio * n_majority - n_minority).
Parents are assigned deterministically (every minority row gets
n_new // n_min children, the first n_new % n_min rows in hash order one
more), so the total is exact and no row is sampled on the driver.  Each
child interpolates towards one of its parent's k neighbours (``neighbors.knn``,
exact, over distinct minority vectors) with a hash-seeded step in [0, 1).
Only minority rows enter the neighbour search; a parent without any other
distinct minority vector yields copies of itself, so the count stays exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .neighbors import knn
from .resample import stratified_rank


def smote(df: DataFrame, key: str, vec: str, label: str, ratio: float = 0.8, k: int = 5, seed: int = 42,
          block_size: int = 64, neighbours=None) -> DataFrame:
    """Returns ``df`` plus synthetic minority rows: ``synthetic`` = true, a
    NULL ``key``, and the pair (``parent_key``, ``child``) naming each one.
    Ids may be of any type; other columns of ``df`` are NULL in new rows.
    ``neighbours(rows, key, vec, k, seed)`` replaces the exact search."""
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) != 2:
        raise ValueError("SMOTE needs exactly two classes")
    minority = min(counts, key=lambda c: (counts[c], c))
    majority = max(counts, key=lambda c: (counts[c], -c))
    n_min, n_maj = counts[minority], counts[majority]
    n_new = int(ratio * n_maj - n_min)
    base = df.withColumn("synthetic", F.lit(False))
    if n_new <= 0:
        return base
    mino = df.filter(F.col(label) == minority).select(key, vec)
    q, rem = divmod(n_new, n_min)
    ranked = stratified_rank(mino, key, None, seed).select(key, vec, "rank")
    parents = ranked.withColumn("n_children", F.lit(q) + F.when(F.col("rank") < rem, 1).otherwise(0)) \
                    .filter(F.col("n_children") > 0)
    kids = parents.select(key, vec, F.explode(F.sequence(F.lit(0), F.col("n_children") - 1)).alias("child"))
    nn = neighbours(mino, key, vec, k, seed) if neighbours else knn(mino, key, vec, k=k, block_size=block_size, seed=seed)
    avail = nn.groupBy(key).agg(F.max("nbr_rank").alias("k_avail"))
    kids = kids.join(avail, key, "left")
    pick = (F.pmod(F.xxhash64(F.col(key), F.col("child"), F.lit(seed)), F.col("k_avail")) + 1).cast("int")
    kids = kids.withColumn("nbr_rank", pick)
    kids = kids.join(nn.select(key, "nbr_rank", "nbr_id"), [key, "nbr_rank"], "left") \
               .withColumn("nbr_id", F.coalesce(F.col("nbr_id"), F.col(key)))
    nb_vec = mino.select(F.col(key).alias("nbr_id"), F.col(vec).alias("__nb"))
    kids = kids.join(nb_vec, "nbr_id")
    u = F.pmod(F.xxhash64(F.col(key), F.col("child"), F.lit(seed + 1)), F.lit(1000003)) / F.lit(1000003.0)
    kids = kids.withColumn("__u", u)
    new_vec = F.zip_with(F.col(vec), F.col("__nb"), lambda a, b: a + F.col("__u") * (b - a))
    syn = kids.select(F.lit(None).cast(df.schema[key].dataType).alias(key), new_vec.alias(vec),
                      F.lit(minority).cast(df.schema[label].dataType).alias(label),
                      F.lit(True).alias("synthetic"),
                      F.col(key).alias("parent_key"), "child", F.col("nbr_id").alias("neighbor_key"))
    return base.unionByName(syn, allowMissingColumns=True)
