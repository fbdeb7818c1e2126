"""Driver contract, sources and streaming."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from staysignal.sources import files as FS

from .conftest import SF


def test_oracles_cover_registered_queries():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) > 100


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert {"customerID", "action_id", "rank", "roi_pct", "break_even_months"} <= set(df.columns)


def test_scan_csv_missing_path_raises(spark):
    with pytest.raises(FileNotFoundError):
        FS.scan_csv(spark, "/nonexistent/customers.csv", fallback="/nonexistent/other.csv")


def test_required_columns_check(spark):
    df = spark.createDataFrame([(1, 2.0)], "tenure long, MonthlyCharges double")
    with pytest.raises(ValueError, match="Contract"):
        FS.required_columns_check(df, ["tenure", "MonthlyCharges", "Contract"])


def test_jdbc_reader_needs_bounds_for_partitioning(spark):
    with pytest.raises(ValueError):
        FS.jdbc_reader(spark, "jdbc:postgresql://db/x", "customers", partition_column="id")
    r = FS.jdbc_reader(spark, "jdbc:postgresql://db/x", "customers", "id", 0, 1000, 16)
    assert r is not None


def test_stream_equals_batch(spark):
    q, o = E.queries(), E.oracle_sql()
    a = sorted(map(tuple, q["score_stream"](spark, SF).collect()))
    b = sorted(map(tuple, q["score_batch"](spark, SF).collect()))
    assert a == b


def test_sinks_round_trip(spark):
    from staysignal.session import shared_path
    from staysignal.sources import sinks as SK
    lb = spark.createDataFrame([("lr", 0.8, 0.85), ("rf", 0.79, 0.83)], "name string, accuracy double, roc_auc double")
    path = shared_path(spark, "metrics-test")
    SK.sink_csv(lb, path)
    back = spark.read.option("header", "true").option("inferSchema", "true").csv(path)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, lb.collect()))
    SK.write_json_sidecar(spark, path + "-meta", {"cat_cols": ["a"], "num_cols": ["b"]})
    assert SK.read_json_sidecar(spark, path + "-meta") == {"cat_cols": ["a"], "num_cols": ["b"]}


def test_csv_round_trip_keeps_dirt(spark):
    from staysignal.session import shared_path
    df = spark.createDataFrame([("C1", " Yes", " ", None)], "customerID string, Partner string, TotalCharges string, "
                                                            "Dependents string")
    path = shared_path(spark, "csv-dirt")
    FS.write_csv(df, path)
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField(c, T.StringType()) for c in df.columns])
    back = FS.scan_csv(spark, path, schema=schema).first()
    assert back.Partner == " Yes" and back.TotalCharges == " " and back.Dependents is None


def test_csv_columns_are_found_by_name(spark):
    from pyspark.sql import types as T
    from staysignal.session import shared_path
    df = spark.createDataFrame([("C1", 3, "Male"), ("C2", 4, None)], "customerID string, tenure long, gender string")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields])
    want = sorted(map(tuple, df.collect()))
    for i, (frame, index) in enumerate([(df, "_c0"), (df, None), (df.select("gender", "customerID", "tenure"), None),
                                        (df.withColumn("extra", F.lit("x")), "Unnamed: 0")]):
        path = shared_path(spark, f"csv-by-name-{i}")
        FS.write_csv(frame, path, index_col=index)
        assert sorted(map(tuple, FS.scan_csv(spark, path, schema=schema).collect())) == want
        assert sorted(r[:3] for r in map(tuple, FS.scan_csv_upload(
            spark, path, schema=schema, required=["tenure"]).collect())) == want
    FS.write_csv(df.drop("tenure"), path, index_col=None)
    with pytest.raises(ValueError, match="tenure"):
        FS.scan_csv(spark, path, schema=schema)
    with pytest.raises(ValueError, match="tenure"):
        FS.scan_csv_upload(spark, path, schema=schema, required=["tenure"])


def test_stream_keeps_rows_with_nulls(spark):
    from staysignal.plans.context import raw
    from staysignal.session import shared_path
    from staysignal.streaming.score_stream import start_scoring
    landing, out = shared_path(spark, "null-landing"), shared_path(spark, "null-out")
    src = raw(spark, SF).limit(20).withColumn("gender", F.lit(None).cast("string")) \
                        .withColumn("TotalCharges", F.lit("not a number"))
    src.write.parquet(landing)
    start_scoring(spark, landing, out, shared_path(spark, "null-chk")).awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == 20 and got.filter("TotalCharges IS NULL AND gender IS NULL AND p IS NOT NULL").count() == 20
