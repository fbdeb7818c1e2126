"""Shared inputs of the registered plans: the raw and cleaned customer view.

The raw view (orders aggregated per customer, joined to customers) is the
expensive, shared part of every plan.  It is written once per session and
input directory as a parquet table in the shared checkpoint folder
(``spark.checkpoint.dir``) and read back by every later plan: the lineage is
cut (an executor loss re-reads the table instead of replaying the orders
aggregation), and each plan scans only the columns it needs.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession

from ..operators.clean import clean
from ..session import shared_path
from ..sources.customer_view import raw_customers

_LOCK = threading.Lock()
_TABLES: dict[tuple[str, str], str] = {}


def materialize_raw(spark: SparkSession, sf_dir: str) -> str:
    """Write the raw view for ``sf_dir`` once per application; return its path."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    with _LOCK:
        path = _TABLES.get(key)
        if path is None:
            path = shared_path(spark, "raw-customers")
            raw_customers(spark, sf_dir).write.mode("overwrite").parquet(path)
            _TABLES[key] = path
    return path


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(materialize_raw(spark, sf_dir))


def cust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned customer view with ``customerID`` kept (tiebreaks, joins)."""
    return clean(raw(spark, sf_dir), keep_id=True)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.scorecard import score
    return score(cust(spark, sf_dir))
