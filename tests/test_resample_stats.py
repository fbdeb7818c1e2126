"""Distributed splits / folds against a brute-force ranking, and the
statistical tests against direct formulas."""

import hashlib
import math

import pandas as pd
from pyspark.sql import functions as F

from staysignal.operators import resample as R
from staysignal.operators import stats as ST


def frame(spark, n=997):
    rows = [(k, int(k % 7 == 0 or k % 5 == 1)) for k in range(1, n + 1)]
    return spark.createDataFrame(rows, "k long, Churn int")


def brute_rank(pdf, strata):
    pdf = pdf.copy()
    pdf["h"] = [int(hashlib.md5(f"{k}:42".encode()).hexdigest()[:15], 16) for k in pdf["k"]]
    pdf = pdf.sort_values(["h", "k"])
    pdf["rank"] = pdf.groupby(strata).cumcount() if strata else range(len(pdf))
    return pdf


def test_stratified_split_is_exact(spark):
    df = frame(spark)
    got = R.split(df, "k", 0.2, ["Churn"], seed=42).toPandas().set_index("k")["split"]
    pdf = brute_rank(df.toPandas(), ["Churn"])
    n = pdf.groupby("Churn")["k"].transform("count")
    want = pd.Series(["test" if r < math.floor(0.2 * c + 0.5) else "train" for r, c in zip(pdf["rank"], n)],
                     index=pdf["k"])
    assert (got.sort_index() == want.sort_index()).all()


def test_small_buckets_still_exact(spark):
    df = frame(spark, 300)
    a = R.stratified_rank(df, "k", ["Churn"], buckets=7).select("k", "rank").toPandas().set_index("k")["rank"]
    pdf = brute_rank(df.toPandas(), ["Churn"]).set_index("k")["rank"]
    assert (a.sort_index() == pdf.sort_index()).all()


def test_split_takes_large_text_and_null_ids(spark):
    big = spark.range(1000).select((F.col("id") * 7 + 10 ** 15).alias("k"))
    assert R.split(big, "k", 0.2).filter("split = 'test'").count() == 200
    text = big.select(F.concat(F.lit("cust-"), F.col("k").cast("string")).alias("k"))
    assert R.split(text, "k", 0.2).filter("split = 'test'").count() == 200
    assert R.kfold(text, "k", 5).groupBy("fold").count().count() == 5
    nulls = spark.createDataFrame([(None, "a"), ("x", None), ("y", None), (None, "a")], "k string, s string")
    assert R.split(nulls, "k", 0.5, ["s"]).groupBy("s", "split").count().count() == 4


def test_fold_sizes_balanced(spark):
    folds = R.kfold(frame(spark), "k", 5, ["Churn"]).groupBy("Churn", "fold").count().toPandas()
    for _, g in folds.groupby("Churn"):
        assert g["count"].max() - g["count"].min() <= 1


def test_class_weights_balanced(spark):
    w = {r.Churn: r.weight for r in R.class_weights(frame(spark)).collect()}
    n1 = sum(1 for k in range(1, 998) if k % 7 == 0 or k % 5 == 1)
    assert abs(w[1] - 997 / (2 * n1)) < 1e-6


def test_chi_square_yates_and_plain(spark):
    # 2x2 table [[10, 20], [30, 15]]
    rows = [("a", 0)] * 10 + [("a", 1)] * 20 + [("b", 0)] * 30 + [("b", 1)] * 15
    df = spark.createDataFrame(rows, "g string, y int")
    obs = [[10, 20], [30, 15]]
    n = 75.0
    r = [30, 45]
    c = [40, 35]
    plain = sum((obs[i][j] - r[i] * c[j] / n) ** 2 / (r[i] * c[j] / n) for i in range(2) for j in range(2))
    yates = sum((abs(obs[i][j] - r[i] * c[j] / n) - 0.5) ** 2 / (r[i] * c[j] / n) for i in range(2) for j in range(2))
    assert abs(ST.chi_square(df, "g", "y", correction=False).first().statistic - round(plain, 6)) < 1e-6
    got = ST.chi_square(df, "g", "y", correction=True).first()
    assert abs(got.statistic - round(yates, 6)) < 1e-6 and got.dof == 1
    assert abs(got.p_value - math.erfc(math.sqrt(yates / 2))) < 1e-6


def test_t_pvalue_known_values():
    assert abs(ST.t_pvalue(2.0, 10.0) - 0.073388) < 1e-5
    assert abs(ST.t_pvalue(0.0, 5.0) - 1.0) < 1e-12
    assert ST.t_pvalue(-2.9, 1000.0) < 0.01


def test_welch_matches_direct_formula(spark):
    a = [1.0, 2.0, 4.0, 7.0, 11.0]
    b = [2.0, 2.5, 3.0]
    df = spark.createDataFrame([(x, 1) for x in a] + [(x, 0) for x in b], "v double, g int")
    r = ST.t_test_welch(df, "v", F.col("g"), 1, 0).first()
    import statistics as s
    va, vb = s.variance(a) / len(a), s.variance(b) / len(b)
    t = (s.mean(a) - s.mean(b)) / math.sqrt(va + vb)
    assert abs(r.t_stat - round(t, 6)) < 1e-6


def test_chi_square_tail_values():
    for stat, dof, want in [(3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (7.814727903251179, 3, 0.05),
                            (18.307038053275146, 10, 0.05), (100.0, 1, 1.523970604832105e-23), (0.0, 3, 1.0)]:
        assert abs(ST.chi2_pvalue(stat, dof) / want - 1) < 1e-9
