"""Substring dedup with fixed-block anchors (see ``repeats``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import remove_repeats

WINDOW = 20


def substring_dedup(docs: DataFrame, window: int = WINDOW, **options) -> DataFrame:
    """Words ``[^\\x20\\x09-\\x0D]+`` in runs of ``window`` that start earlier
    elsewhere are removed; kept words are joined by one space."""
    return remove_repeats(docs, window, "words", "blocks", **options)


def digest(docs: DataFrame) -> DataFrame:
    out = substring_dedup(docs.select("doc_id", "text"), with_text=False)
    return out.select("doc_id", F.col("n_tokens").alias("n_words"), "n_removed", "kept_sha256")


ORACLE = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
p AS (
  SELECT doc_id, UNNEST(range(1, len(ws) - 18)) AS i, ws FROM w WHERE len(ws) >= 20),
k AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS s FROM p),
d AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM k),
gone AS (
  SELECT DISTINCT doc_id, UNNEST(range(i, i + 20)) AS j FROM d WHERE r > 1),
g AS (
  SELECT doc_id, list(j) AS js FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(js), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(list_transform(list_filter(range(1, len(ws) + 1),
    lambda j: js IS NULL OR NOT list_contains(js, j)), lambda j: ws[j]), ' '), '')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id)
"""
