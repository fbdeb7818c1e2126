"""Prediction history: an append-only table of scored requests.

A stream of requests (id, time, customer) is joined with the customer table, scored, valued and appended by
``foreachBatch``.  A micro-batch owns one folder named by its id and overwrites it, so a batch that is replayed after a
failure adds no row.  Scoring is stateless; the history is what accumulates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..constants import ID_COL, RECENT_N
from ..operators.scoring import Scorer, add_clv, score_batch
from ..functions import scorecard

REQUEST = "event_id long, ts timestamp, customerID string"
KEPT = ["event_id", "ts", ID_COL, "Contract", "tenure", "MonthlyCharges", "InternetService", "TechSupport",
        "Churn_Probability", "Prediction", "Risk_Level", "CLV_Estimate", "Revenue_at_Risk"]


def append_batch(scored: DataFrame, batch_id: int, path: str) -> None:
    """Write a micro-batch into its own folder of the history; a replay overwrites what it wrote before."""
    scored.select(*KEPT).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def score_requests(requests: DataFrame, customers: DataFrame, scorer: Scorer = scorecard.score) -> DataFrame:
    """Requests with their customer's attributes, scored and valued.  An unknown customer has no prediction."""
    return add_clv(score_batch(requests.join(customers, ID_COL), scorer))


def start_history(spark: SparkSession, landing_dir: str, customers: DataFrame, path: str, checkpoint_dir: str,
                  files_per_batch: int = 100, available_now: bool = True) -> StreamingQuery:
    """Score the requests that land in ``landing_dir`` (parquet files) into the history at ``path``."""
    requests = spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", files_per_batch).parquet(landing_dir)
    q = (score_requests(requests, customers).writeStream.option("checkpointLocation", checkpoint_dir)
         .foreachBatch(lambda batch, batch_id: append_batch(batch, batch_id, path)))
    return (q.trigger(availableNow=True) if available_now else q.trigger(processingTime="30 seconds")).start()


def recent(history: DataFrame, n: int = RECENT_N) -> DataFrame:
    """The newest ``n`` predictions (each task keeps ``n`` rows)."""
    return history.select(*KEPT).orderBy(F.desc("ts"), F.desc("event_id")).limit(n)
