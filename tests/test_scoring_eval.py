"""Scoring, bands and evaluation curves against brute-force references."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from staysignal.functions.bands import cohort_tenure_band, eda_tenure_band, notebook_tenure_band
from staysignal.functions.scorecard import probability
from staysignal.operators import evaluate as EV


def one_customer(**over):
    base = dict(customerID="X", gender="Male", SeniorCitizen=0, tenure=12, Contract="Month-to-month",
                InternetService="Fiber optic", PaymentMethod="Electronic check", TechSupport="No",
                OnlineSecurity="No", MonthlyCharges=75.0)
    base.update(over)
    return base


def score_rows(spark, rows):
    df = spark.createDataFrame(rows)
    return [r.p for r in df.select(probability().alias("p")).collect()]


def test_probability_in_unit_interval_and_monotone(spark):
    risky = one_customer(tenure=2)
    loyal = one_customer(tenure=60, Contract="Two year", InternetService="DSL", PaymentMethod="Mailed check")
    p_risky, p_loyal = score_rows(spark, [risky, loyal])
    assert 0.0 <= p_loyal < p_risky <= 1.0


def test_band_edges_are_right_closed(spark):
    df = spark.createDataFrame([(t,) for t in [0, 12, 13, 72, 73, 100, 101]], "tenure long")
    got = df.select("tenure", eda_tenure_band().alias("e"), cohort_tenure_band().alias("c"),
                    notebook_tenure_band().alias("n")).orderBy("tenure").collect()
    table = {r.tenure: (r.e, r.c, r.n) for r in got}
    assert table[0] == (None, "0–12", None)
    assert table[12] == ("0-12", "0–12", "0-1 Year")
    assert table[13] == ("13-24", "12–24", "1-2 Years")
    assert table[72] == ("61-72", "60–72", "5+ Years")
    assert table[73] == ("73+", None, None)
    assert table[101] == (None, None, None)


def brute_auc(y, p):
    pos = [pi for yi, pi in zip(y, p) if yi == 1]
    neg = [pi for yi, pi in zip(y, p) if yi == 0]
    s = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in itertools.product(pos, neg))
    return s / (len(pos) * len(neg))


def brute_ap(y, p):
    order = sorted(set(p), reverse=True)
    P = sum(y)
    ap, prev_r = 0.0, 0.0
    for t in order:
        tp = sum(1 for yi, pi in zip(y, p) if pi >= t and yi == 1)
        fp = sum(1 for yi, pi in zip(y, p) if pi >= t and yi == 0)
        r = tp / P
        ap += (r - prev_r) * tp / (tp + fp)
        prev_r = r
    return ap


def test_roc_auc_and_ap_match_brute_force_with_ties(spark):
    rng = np.random.default_rng(7)
    y = [int(v) for v in rng.integers(0, 2, 300)]
    p = [round(float(v), 2) for v in rng.random(300)]  # many ties
    df = spark.createDataFrame(list(zip(range(300), y, p)), "customerID long, y int, p double")
    assert abs(EV.roc_auc(df).first().roc_auc - brute_auc(y, p)) < 1e-6
    assert abs(EV.average_precision(df).first().average_precision - brute_ap(y, p)) < 1e-6


def test_threshold_metrics_zero_division(spark):
    df = spark.createDataFrame([(1, 0, 0.1), (2, 0, 0.2)], "customerID long, y int, p double")
    r = EV.metrics_at_threshold(df).first()
    assert r.precision == 0.0 and r.recall == 0.0 and r.f1 == 0.0 and r.accuracy == 1.0


def test_threshold_curve_matches_per_threshold_counts(spark):
    rng = np.random.default_rng(3)
    y = [int(v) for v in rng.integers(0, 2, 200)]
    p = [round(float(v), 4) for v in rng.random(200)]
    df = spark.createDataFrame(list(zip(range(200), y, p)), "customerID long, y int, p double")
    curve = {round(r.threshold, 6): r for r in EV.threshold_curve(df).collect()}
    for t in EV.threshold_grid()[::7]:
        tp = sum(1 for a, b in zip(y, p) if b >= t and a == 1)
        fp = sum(1 for a, b in zip(y, p) if b >= t and a == 0)
        fn = sum(1 for a, b in zip(y, p) if b < t and a == 1)
        prec = tp / (tp + fp) if tp + fp else 0.0
        assert abs(curve[round(t, 6)].precision - round(prec, 6)) < 1e-9
        assert abs(curve[round(t, 6)].recall - round(tp / (tp + fn), 6)) < 1e-9


def test_linear_contributions_sum_to_margin(spark):
    from staysignal.functions.scorecard import margin
    rows = [one_customer(customerID=str(i), tenure=i * 5, MonthlyCharges=20.0 + i) for i in range(12)]
    df = spark.createDataFrame(rows)
    contrib = EV.linear_contributions(df)
    sums = contrib.groupBy("customerID").agg(F.sum("contribution").alias("s"), F.first("base_margin").alias("b"))
    z = df.select("customerID", margin().alias("z"))
    for r in sums.join(z, "customerID").collect():
        assert abs(r.s + r.b - r.z) < 1e-4
