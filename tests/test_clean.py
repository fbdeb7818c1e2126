"""Cleaning: cases re-expressed from the original unit tests, plus the
deliberate idempotence fix for integer-coded flags."""

from pyspark.sql import functions as F

from staysignal.operators import clean as K
from staysignal.sources.files import RAW_SCHEMA


def raw_rows():
    base = dict(customerID="A1", gender="Female", SeniorCitizen=0, Partner="Yes", Dependents="No", tenure=1,
                PhoneService="No", MultipleLines="No phone service", InternetService="DSL",
                OnlineSecurity="No", OnlineBackup="Yes", DeviceProtection="No", TechSupport="No",
                StreamingTV="No", StreamingMovies="No", Contract="Month-to-month", PaperlessBilling="Yes",
                PaymentMethod="Electronic check", MonthlyCharges=29.85, TotalCharges="29.85", Churn="No")
    r2 = dict(base, customerID="A2", tenure=34, TotalCharges="1889.5", Churn="Yes", Partner=" No")
    r3 = dict(base, customerID="A3", tenure=0, TotalCharges=" ", Churn="No", OnlineSecurity=None)
    r4 = dict(base, customerID="A4", tenure=2, TotalCharges="108.15", Churn="Yes", MultipleLines=None)
    return [base, r2, r3, r4]


def make(spark, rows):
    cols = [f.name for f in RAW_SCHEMA.fields]
    return spark.createDataFrame([tuple(r[c] for c in cols) for r in rows], RAW_SCHEMA)


def test_id_dropped_and_flags_are_ints(spark):
    out = K.clean(make(spark, raw_rows()))
    assert "customerID" not in out.columns
    types = dict(out.dtypes)
    for c in ["Partner", "Dependents", "PhoneService", "PaperlessBilling", "Churn", "SeniorCitizen"]:
        assert types[c] == "int"
    assert out.count() == 4
    assert {r.Partner for r in out.collect()} == {0, 1}


def test_no_nulls_after_cleaning(spark):
    out = K.clean(make(spark, raw_rows()))
    for c in out.columns:
        assert out.filter(F.col(c).isNull()).count() == 0


def test_blank_total_filled_with_monthly_times_tenure(spark):
    out = K.clean(make(spark, raw_rows()), keep_id=True)
    assert out.filter(F.col("customerID") == "A3").first().TotalCharges == 0.0
    assert out.filter(F.col("customerID") == "A2").first().TotalCharges == 1889.5


def test_bad_label_drops_row(spark):
    rows = raw_rows()
    rows[1] = dict(rows[1], Churn="Maybe")
    assert K.clean(make(spark, rows)).count() == 3


def test_null_services_filled(spark):
    out = K.clean(make(spark, raw_rows()), keep_id=True)
    assert out.filter(F.col("customerID") == "A3").first().OnlineSecurity == "No internet service"
    assert out.filter(F.col("customerID") == "A4").first().MultipleLines == "No"


def test_input_untouched(spark):
    df = make(spark, raw_rows())
    before = df.collect()
    K.clean(df).collect()
    assert df.collect() == before


def test_integer_flags_are_idempotent(spark):
    once = K.clean(make(spark, raw_rows()), keep_id=True)
    twice = K.clean(once.select([F.col(c).cast("string") if c in ("Partner", "Churn") else F.col(c)
                                 for c in once.columns]), keep_id=True, strict=False)
    a = sorted((r.customerID, r.Partner, r.Churn) for r in once.collect())
    b = sorted((r.customerID, r.Partner, r.Churn) for r in twice.collect())
    assert a == b


def test_strict_labels_reproduce_original_map(spark):
    rows = [dict(r, Churn="1") for r in raw_rows()]
    assert K.clean(make(spark, rows)).count() == 0
    assert K.clean(make(spark, rows), strict=False).count() == 4


def test_score_input_keeps_rows_and_leaves_bad_total_null(spark):
    rows = raw_rows()
    rows[0] = dict(rows[0], TotalCharges="N/A")
    out = K.preprocess_score_input(make(spark, rows).drop("Churn"))
    assert out.count() == 4
    got = {r.customerID: r.TotalCharges for r in out.collect()}
    assert got["A1"] is None and got["A3"] is None and got["A2"] == 1889.5


def test_ffill_global_matches_sequential_fill(spark):
    import pandas as pd
    vals = [None, "a", None, None, "b", None, None, None, "c", None]
    pdf = pd.DataFrame({"k": range(10), "x": vals})
    df = spark.createDataFrame(pdf)
    got = K.ffill(df.repartition(4), ["x"], "k").orderBy("k").toPandas()["x"].tolist()
    want = pdf["x"].ffill().tolist()
    assert [None if (v is None or v != v) else v for v in got] == [None if v != v or v is None else v for v in want]


def test_ffill_keyed_with_hot_and_null_keys(spark):
    import numpy as np
    rng = np.random.default_rng(5)
    n = 120
    grp = ["hot" if i % 3 else ("b" if i % 2 else None) for i in range(n)]  # one key holds 2/3 of rows
    vals = [None if rng.random() < 0.6 else float(i) for i in range(n)]
    rows = [(i, g, v) for i, (g, v) in enumerate(zip(grp, vals))]
    df = spark.createDataFrame(rows, "k long, g string, x double")
    got = {r.k: r.x for r in K.ffill(df.repartition(4), ["x"], "k", partition_by=["g"]).collect()}
    last, want = {}, {}
    for i, g, v in rows:
        if v is not None:
            last[g] = v
        want[i] = v if v is not None else last.get(g)
    assert got == want


def test_only_decimal_numbers_are_numbers(spark):
    from staysignal.functions.cleaning import to_number
    texts = ["12.5", " 3 ", "-1e2", ".5", "7.", "NaN", "5d", "5f", "Infinity", "", " ", "1,5", None]
    got = [r.v for r in spark.createDataFrame([(t,) for t in texts], "t string").select(to_number("t").alias("v"))
           .collect()]
    assert got == [12.5, 3.0, -100.0, 0.5, 7.0] + [None] * 8
