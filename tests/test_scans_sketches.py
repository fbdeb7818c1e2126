"""Ordered scans (forward fill, running sums) against sequential ones, sketches against exact figures, the history."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from staysignal.operators import clean as K
from staysignal.operators import common as O
from staysignal.operators import profile as P
from staysignal.streaming import history as H

from .conftest import SF


def rows(n=400, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        key = rng.choice(["hot"] * 6 + ["b", "c", None, "empty"])
        v = None if key == "empty" or rng.random() < 0.7 else rng.randint(0, 99)
        out.append((key, i, f"t{i:05d}", f"2024-01-01 00:{i // 60 % 60:02d}:{i % 60:02d}", v, None if rng.random() < 0.9 else f"s{i}"))
    rng.shuffle(out)
    return out


def filled(data, at, keyed):
    last, out = {}, {}
    for r in sorted(data, key=lambda r: r[at]):
        k = r[0] if keyed else 0
        was = last.setdefault(k, [None, None])
        for j in (0, 1):
            if r[4 + j] is not None:
                was[j] = r[4 + j]
        out[r[1]] = tuple(was)
    return out


@pytest.mark.parametrize("order,at", [("n", 1), ("text", 2), ("ts", 3)])
@pytest.mark.parametrize("keyed", [False, True])
def test_forward_fill_by_any_order_column(spark, order, at, keyed):
    data = rows()
    df = spark.createDataFrame(data, "key string, n long, text string, ts string, v int, s string")
    df = df.withColumn("ts", F.to_timestamp("ts")).repartition(5)
    got = K.ffill(df, ["v", "s"], order, ["key"] if keyed else None)
    assert got.columns == df.columns and got.schema["ts"].dataType == df.schema["ts"].dataType
    assert {r.n: (r.v, r.s) for r in got.collect()} == filled(data, at, keyed)
    plan = got._jdf.queryExecution().toString()
    assert "Window" not in plan
    assert K.ffill(df.limit(0), ["v"], order).count() == 0


def test_running_sums_keep_columns_and_types(spark):
    rng = random.Random(4)
    data = [(rng.choice("xyz"), i, rng.randint(0, 9), rng.random()) for i in range(500)]
    df = spark.createDataFrame(data, "g string, i long, a int, f double").repartition(6)
    got = O.running_sums(df, [F.col("g"), F.col("i")], ["a", "f"]).collect()
    a = f = 0
    for r, want in zip(sorted(got, key=lambda r: (r.g, r.i)), sorted(data)):
        a, f = a + want[2], f + want[3]
        assert tuple(r[:4]) == want and r.cum_a == a and abs(r.cum_f - f) < 1e-9


def test_quantile_sketches_within_the_stated_rank_error(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=40_000), np.full(15_000, 0.25), rng.exponential(size=5_000) * 50])
    df = spark.createDataFrame([(float(v), int(i % 2)) for i, v in enumerate(x)], "v double, g int").repartition(9)
    odd = spark.createDataFrame([(None, 0), (float("nan"), 1)], "v double, g int")
    qs = {f"q{q}": q / 100 for q in (1, 25, 50, 75, 99)}
    got = O.sketched_quantiles(df.union(odd), ["v"], qs).first()
    for name, q in qs.items():
        low, high = (x < got[name]).mean(), (x <= got[name]).mean()
        assert low - O.RANK_ERROR <= q <= high + O.RANK_ERROR
    by = {r.g: r for r in O.sketched_quantiles(df, ["v"], qs, ["g"]).collect()}
    assert set(by) == {0, 1} and O.sketched_quantiles(odd.filter("v is null"), ["v"], qs).first()["q50"] is None


def test_sketched_tables_beside_exact_ones(spark):
    from staysignal.plans.context import cust, raw
    c = cust(spark, SF)
    n = c.count()
    exact, near = ({r[0]: r for r in P.describe(c, exact=e).collect()} for e in (True, False))
    for k, r in exact.items():
        assert near[k]["mean"] == r["mean"] and near[k]["max"] == r["max"]
        values = np.sort([v[0] for v in c.select(F.col(k).cast("double")).collect()])
        for q, name in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75")):
            assert (values < near[k][name]).mean() - 2 / n <= q <= (values <= near[k][name]).mean() + 2 / n
    a, b = ({r[0]: r for r in f(raw(spark, SF)).collect()} for f in (P.column_profile, P.column_profile_sketched))
    assert set(a) == set(b)
    for k, r in a.items():
        assert abs(b[k]["n_distinct"] - r["n_distinct"]) <= 0.03 * r["n_distinct"]
        assert (b[k]["dtype"], b[k]["sample_value"]) == (r["dtype"], r["sample_value"])
    assert P.box_stats(c, "MonthlyCharges", exact=False).count() == 2
    gaps = c.withColumn("MonthlyCharges", F.when(F.col("tenure") > 3, F.col("MonthlyCharges")))
    assert K.impute(gaps, gaps, ["MonthlyCharges"], "median", exact=False).filter("MonthlyCharges is null").count() == 0


def test_many_distinct_values_within_three_percent(spark):
    df = spark.range(60_000).select(F.col("id"), (F.col("id") % 7).alias("few"), F.lit(None).cast("string").alias("none"))
    got = {r.column_name: r.n_distinct for r in P.column_profile_sketched(df).collect()}
    assert abs(got["id"] - 60_000) < 1800 and got["few"] == 7 and got["none"] == 0


def test_replayed_batch_adds_no_row(spark, tmp_path):
    from staysignal.plans.q_value import batch_input
    customers = batch_input(spark, SF)
    req = spark.createDataFrame([(i, f"C{i % 40}") for i in range(90)] + [(900, "nobody"), (901, None)], "event_id long, customerID string")
    req = req.withColumn("ts", (F.lit(1_700_000_000) + F.col("event_id") % 30).cast("timestamp"))
    path = str(tmp_path / "history")
    parts = [H.score_requests(req.filter(c), customers) for c in ("event_id < 50", "event_id >= 50")]
    for i in (0, 1, 1, 0):
        H.append_batch(parts[i], i, path)
    known = {r[0] for r in customers.select("customerID").collect()}
    want = {(r.event_id, r.customerID) for r in req.collect() if r.customerID in known}
    got = [(r.event_id, r.customerID) for r in spark.read.parquet(path).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    newest = H.recent(spark.read.parquet(path), 7).collect()
    order = sorted(want, key=lambda w: (w[0] % 30, w[0]), reverse=True)[:7]
    assert [(r.event_id, r.customerID) for r in newest] == order


def test_stream_restarts_where_it_stopped(spark, tmp_path):
    from staysignal.plans.q_value import batch_input
    land, path, chk = (str(tmp_path / n) for n in ("land", "history", "chk"))
    customers = batch_input(spark, SF)
    req = spark.createDataFrame([(i, f"C{i}") for i in range(20)], "event_id long, customerID string").withColumn(
        "ts", F.lit(1_700_000_000).cast("timestamp"))
    for part in ("event_id < 12", "event_id >= 12", "event_id < 0"):
        req.filter(part).select("event_id", "ts", "customerID").write.mode("append").parquet(land)
        H.start_history(spark, land, customers, path, chk, files_per_batch=1).awaitTermination()
    got = sorted(r.event_id for r in spark.read.parquet(path).collect())
    known = {r[0] for r in customers.select("customerID").collect()}
    assert got == [i for i in range(20) if f"C{i}" in known]
