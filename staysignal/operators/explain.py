"""Model-agnostic attributions for fitted (e.g. tree) models (SURVEY 2.11,
re-aimed from library TreeSHAP).

Permutation-sampling Shapley values against a baseline row (the training
mean): for each row and each of ``permutations`` seeded feature orders,
features switch from baseline to the row's value one at a time; the change
in predicted probability at each switch is credited to that feature and
averaged over orders.  Per row the contributions sum exactly to
p(row) - p(baseline).  Every (row, order, step) is one scored row: a fixed
fan-out of permutations x (features + 1), scored in one model pass; windows
run over the (features + 1) steps of one (row, order) only.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def permutation_shapley(model, rows: DataFrame, id_col: str, baseline: list[float], names: list[str],
                        permutations: int = 8, seed: int = 42, features_col: str = "features") -> DataFrame:
    d = len(baseline)
    x = vector_to_array(F.col(features_col))
    base = rows.select(id_col, x.alias("x"))
    ex = base.withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
    keyed = F.array(*[F.struct(F.xxhash64(F.col(id_col), F.col("m"), F.lit(j), F.lit(seed)).alias("h"),
                               F.lit(j).alias("j")) for j in range(d)])
    ex = ex.withColumn("perm", F.transform(F.array_sort(keyed), lambda s: s["j"]))
    ex = ex.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(d))))
    b = F.array(*[F.lit(float(v)) for v in baseline])
    hybrid = F.transform(F.sequence(F.lit(0), F.lit(d - 1)),
                         lambda j: F.when(F.array_position(F.col("perm"), j) - 1 < F.col("t"),
                                          F.element_at(F.col("x"), j + 1))
                                    .otherwise(F.element_at(b, j + 1)))
    scored = model.transform(ex.withColumn(features_col, array_to_vector(hybrid)))
    p = vector_to_array(F.col("probability"))[1]
    s = scored.select(id_col, "m", "t", "perm", p.alias("p"))
    w = Window.partitionBy(id_col, "m").orderBy("t")  # d + 1 rows per window
    steps = s.withColumn("diff", F.col("p") - F.lag("p").over(w)).filter(F.col("t") >= 1)
    steps = steps.withColumn("j", F.element_at(F.col("perm"), F.col("t")))
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("j") + 1)
    return (steps.groupBy(id_col, name.alias("feature"))
                 .agg(F.round(F.avg("diff"), 6).alias("contribution")))
