"""Table writers.  Every writer targets a shared path (on a
cluster: under ``spark.checkpoint.dir`` or a table location), never a
machine-local folder, and overwrites atomically per path."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_json_sidecar(spark: SparkSession, path: str, meta: dict) -> None:
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "meta string") \
         .coalesce(1).write.mode("overwrite").text(path)


def read_json_sidecar(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def sink_train_test(spark: SparkSession, split_df: DataFrame, path: str, cat_cols: list[str],
                    num_cols: list[str]) -> None:
    """Train and test rows in one table partitioned by ``split`` plus a JSON
    sidecar with the column lists."""
    write_parquet(split_df, f"{path}/data", ["split"])
    write_json_sidecar(spark, f"{path}/columns", {"cat_cols": cat_cols, "num_cols": num_cols})


def sink_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def sink_scores(scored: DataFrame, summary: DataFrame, path: str) -> None:
    write_parquet(scored, f"{path}/scores")
    write_parquet(summary, f"{path}/summary")
