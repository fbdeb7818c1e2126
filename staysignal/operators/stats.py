"""Statistical tests as aggregates.

Each test reduces the table to a handful of sufficient statistics per group
(counts, means, variances) with partial aggregation, then forms the
statistic from that one small row.  P-values are exact and are computed in
Python from that one row:

* chi-square: ``chi2_pvalue``, a scalar function of the one-row result.
* t tests: two-sided p from the exact Student-t CDF via the regularized
  incomplete beta (``t_pvalue``) on the driver from the one-row result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chi2_pvalue(stat: float | None, dof: int | None) -> float | None:
    """Upper tail of the chi-square distribution: erfc or exp for one or two
    degrees of freedom, then the recurrence in steps of two (all terms are
    positive, so small tails keep their digits)."""
    if stat is None or not dof:
        return None
    half = stat / 2.0
    p, k = (math.erfc(math.sqrt(half)), 1) if dof % 2 else (math.exp(-half), 2)
    while k < dof:
        if half > 0:
            p += math.exp(k / 2.0 * math.log(half) - half - math.lgamma(k / 2.0 + 1.0))
        k += 2
    return min(p, 1.0)


def chi_square(df: DataFrame, a: str, b: str, correction: bool = True) -> DataFrame:
    """Independence test of two categorical columns, one scan of ``df``.

    The table is reduced to its observed (a, b) cells by a partial aggregate;
    marginals and totals are windows over that cell table, whose size is
    bounded by the two domains.  No level grid is built: an unobserved cell
    adds its E, and those sum to N - sum_observed E; with one degree of freedom and
    ``correction`` every |O - E| of the 2x2 table equals one d, shrunk by
    min(0.5, d), while sum 1/E = N * sum_i 1/r_i * sum_j 1/c_j.
    """
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("o"))
    wa, wb, w = Window.partitionBy(a), Window.partitionBy(b), Window.partitionBy()
    c = cells.select(
        "o", F.sum("o").over(wa).alias("ra"), F.sum("o").over(wb).alias("cb"), F.sum("o").over(w).alias("n"),
        F.count(F.lit(1)).over(wa).alias("cells_a"), F.count(F.lit(1)).over(wb).alias("cells_b"))
    e = F.col("ra") * F.col("cb") / F.col("n")
    r, k = (F.round(F.sum(F.lit(1.0) / F.col(x))) for x in ("cells_a", "cells_b"))  # a level's cells add up to one
    agg = c.agg(
        (F.sum(F.pow(F.col("o") - e, 2) / e)
         + F.when(F.count(F.lit(1)) == r * k, 0.0).otherwise(F.first("n") - F.sum(e)))
        .alias("plain"),
        F.max(F.abs(F.col("o") - e)).alias("d"), F.first("n").alias("n"),
        F.sum(F.lit(1.0) / (F.col("ra") * F.col("cells_a"))).alias("inv_r"),
        F.sum(F.lit(1.0) / (F.col("cb") * F.col("cells_b"))).alias("inv_c"),
        ((r - 1) * (k - 1)).cast("bigint").alias("dof"))
    d = F.col("d")
    yates = F.pow(d - F.least(F.lit(0.5), d), 2) * F.col("n") * F.col("inv_r") * F.col("inv_c")
    stat = F.when((F.col("dof") == 1) & F.lit(bool(correction)), yates).otherwise(F.col("plain"))
    out = agg.select(stat.alias("statistic"), "dof")
    p = F.udf(chi2_pvalue, "double")(F.col("statistic"), F.col("dof"))  # one row
    return out.select(F.round("statistic", 6).alias("statistic"), "dof", F.round(p, 6).alias("p_value"))


def group_moments(df: DataFrame, value: str, group: Column, g1, g2) -> DataFrame:
    """n, mean, sample variance of ``value`` for two groups, one row."""
    x = F.col(value).cast("double")
    in1, in2 = group == F.lit(g1), group == F.lit(g2)
    return df.agg(F.count_if(in1).alias("n1"), F.avg(F.when(in1, x)).alias("m1"),
                  F.var_samp(F.when(in1, x)).alias("v1"), F.count_if(in2).alias("n2"),
                  F.avg(F.when(in2, x)).alias("m2"), F.var_samp(F.when(in2, x)).alias("v2"))


def t_test_pooled(df: DataFrame, value: str, group: Column, g1, g2) -> DataFrame:
    m = group_moments(df, value, group, g1, g2)
    n1, n2, m1, m2, v1, v2 = (F.col(c) for c in ("n1", "n2", "m1", "m2", "v1", "v2"))
    sp2 = ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)
    t = (m1 - m2) / F.sqrt(sp2 * (F.lit(1.0) / n1 + F.lit(1.0) / n2))
    return m.select(F.round(t, 6).alias("t_stat"), (n1 + n2 - 2).cast("double").alias("dof"),
                    "n1", "n2", F.round(m1, 6).alias("mean1"), F.round(m2, 6).alias("mean2"))


def t_test_welch(df: DataFrame, value: str, group: Column, g1, g2) -> DataFrame:
    m = group_moments(df, value, group, g1, g2)
    n1, n2, m1, m2, v1, v2 = (F.col(c) for c in ("n1", "n2", "m1", "m2", "v1", "v2"))
    a, b = v1 / n1, v2 / n2
    t = (m1 - m2) / F.sqrt(a + b)
    dof = (a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n2 - 1))
    return m.select(F.round(t, 6).alias("t_stat"), F.round(dof, 6).alias("dof"), "n1", "n2",
                    F.round(m1, 6).alias("mean1"), F.round(m2, 6).alias("mean2"))


# --- exact Student-t p-value for a one-row result (driver side) -------------

def _betacf(a: float, b: float, x: float) -> float:
    """Continued fraction for the incomplete beta (modified Lentz)."""
    tiny, eps = 1e-300, 3e-16
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10000):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        de = d * c
        h *= de
        if abs(de - 1.0) < eps:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbt = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(lbt) * _betacf(a, b, x) / a
    return 1.0 - math.exp(lbt) * _betacf(b, a, 1.0 - x) / b


def t_pvalue(t: float, dof: float) -> float:
    """Two-sided p-value of Student's t."""
    if t is None or dof is None or dof <= 0 or math.isnan(t):
        return float("nan")
    return betainc(dof / 2.0, 0.5, dof / (dof + t * t))


def decision(result, level: float = 0.05) -> str:
    """Whether equal means are rejected at ``level`` by a t test's one-row result."""
    return "reject" if t_pvalue(result["t_stat"], result["dof"]) < level else "fail to reject"
