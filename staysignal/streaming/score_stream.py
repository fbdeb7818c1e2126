"""Stateless streaming scorer.

``readStream`` of raw customer files -> the same cleaning and scoring
expressions as the batch path -> ``writeStream`` to a parquet table.  No
state, so every micro-batch result equals the batch result for the same
rows; the checkpoint location lives in the shared checkpoint folder so a
restarted query resumes exactly where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.clean import preprocess_score_input
from ..operators.scoring import score_batch
from ..sources.files import RAW_SCHEMA


def scored_stream(spark: SparkSession, landing_dir: str, max_files_per_trigger: int = 100) -> DataFrame:
    raw = (spark.readStream.schema(RAW_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
           .parquet(landing_dir))
    return score_batch(preprocess_score_input(raw.drop("Churn")))


def start_scoring(spark: SparkSession, landing_dir: str, out_dir: str, checkpoint_dir: str,
                  available_now: bool = True) -> StreamingQuery:
    q = (scored_stream(spark, landing_dir).writeStream.format("parquet").option("path", out_dir)
         .option("checkpointLocation", checkpoint_dir).outputMode("append"))
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="30 seconds")
    return q.start()
