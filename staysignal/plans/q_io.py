"""Plans for sources, sinks and the streaming scorer.

Each plan first materialises data Spark derives from the given tables
(the raw customer view) into the shared checkpoint folder, then reads it
back through the connector under test, so the work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import CATEGORICAL_FEATURES, ID_COL, NUMERIC_FEATURES, TARGET
from ..operators import clean as K
from ..operators import resample as R
from ..sources import files as FS
from ..sources import sinks as SK
from ..session import shared_path
from ..streaming.score_stream import start_scoring
from .catalog import query
from .context import cust, raw
from .oracle import ORACLE, oracle
from . import q_clean, q_profile, q_sample  # noqa: F401  (oracles reused below)
from .q_value import _SCORE_OUT, BATCH_SUMMARY_SQL, bsql


@query("scan_csv")
def q_scan_csv(spark, sf):
    path = shared_path(spark, "customers-csv")
    FS.write_csv(raw(spark, sf), path)
    return FS.scan_csv(spark, path + "-missing", fallback=path)


@query("scan_csv_plain")
def q_scan_csv_plain(spark, sf):
    """A file without an index column."""
    path = shared_path(spark, "customers-plain-csv")
    FS.write_csv(raw(spark, sf), path, index_col=None)
    return FS.scan_csv(spark, path)


@query("scan_csv_reordered")
def q_scan_csv_reordered(spark, sf):
    """A file with its columns in another order."""
    path = shared_path(spark, "customers-reordered-csv")
    df = raw(spark, sf)
    FS.write_csv(df.select(*reversed(df.columns)), path, index_col=None)
    return FS.scan_csv(spark, path)


for _name in ("scan_csv", "scan_csv_plain", "scan_csv_reordered"):
    oracle(_name, ORACLE["scan_parquet"])


@query("scan_csv_upload")
def q_scan_csv_upload(spark, sf):
    path = shared_path(spark, "upload-csv")
    FS.write_csv(raw(spark, sf), path)
    return FS.scan_csv_upload(spark, path)


oracle("scan_csv_upload", ORACLE["scan_parquet"].replace("SELECT * FROM raw",
                                                         "SELECT *, NULL::VARCHAR AS _corrupt_record FROM raw"))


@query("list_sources")
def q_list_sources(spark, sf):
    return FS.list_sources(spark, sf)


@query("sink_cleaned")
def q_sink_cleaned(spark, sf):
    path = shared_path(spark, "cleaned")
    SK.write_parquet(K.clean(raw(spark, sf)), path)
    return spark.read.parquet(path)


oracle("sink_cleaned", ORACLE["clean_pipeline"])


@query("sink_train_test")
def q_sink_train_test(spark, sf):
    s = R.split(cust(spark, sf), ID_COL, 0.2, [TARGET])
    path = shared_path(spark, "train-test")
    SK.sink_train_test(spark, s, path, CATEGORICAL_FEATURES, NUMERIC_FEATURES)
    meta = SK.read_json_sidecar(spark, f"{path}/columns")
    if meta["cat_cols"] != CATEGORICAL_FEATURES:
        raise AssertionError("column sidecar did not round-trip")
    return spark.read.parquet(f"{path}/data")


oracle("sink_train_test", q_sample.split_sql("*"))


@query("sink_scores")
def q_sink_scores(spark, sf):
    from .q_value import batch_scored, q_batch_summary
    path = shared_path(spark, "scores")
    SK.sink_scores(batch_scored(spark, sf), q_batch_summary(spark, sf), path)
    summary = spark.read.parquet(f"{path}/summary")  # one row
    scores = spark.read.parquet(f"{path}/scores").select(*_SCORE_OUT, "CLV_Estimate", "Revenue_at_Risk")
    return scores.withColumns({c: summary.select(c).scalar() for c in summary.columns})


oracle("sink_scores", bsql(
    f"SELECT {', '.join(_SCORE_OUT)}, CLV_Estimate, Revenue_at_Risk, total, churn_n, stay_n, churn_rate_pct, "
    "mean_prob_pct FROM bsc, bsum", f"bsum AS ({BATCH_SUMMARY_SQL})"))


@query("score_stream")
def q_score_stream(spark, sf):
    """Raw customers land as several parquet files; an availableNow stream
    scores them all (rows whose TotalCharges does not parse too)."""
    landing = shared_path(spark, "landing")
    raw(spark, sf).repartition(4).write.mode("overwrite").parquet(landing)
    out, chk = shared_path(spark, "stream-out"), shared_path(spark, "stream-chk")
    q = start_scoring(spark, landing, out, chk)
    q.awaitTermination()
    return spark.read.parquet(out).select(*_SCORE_OUT)


oracle("score_stream", ORACLE["score_batch"])
