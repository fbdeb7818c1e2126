"""Line dedup by winnowing over line hashes (see ``repeats``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import remove_repeats

RUN = 3
SINGLE = 8  # a line of fewer bytes outside white space (blank, "}", "Yes.") goes only within a repeated run


def line_dedup(docs: DataFrame, run: int = RUN, **options) -> DataFrame:
    """Runs of at least ``run`` lines that also start earlier are removed.  The
    smallest line hash of every ``run`` consecutive lines is a fingerprint, so
    no repeated run of that length is missed; matches are extended both ways."""
    return remove_repeats(docs, run, "lines", "winnow", **options)


def digest(docs: DataFrame) -> DataFrame:
    out = line_dedup(docs.select("doc_id", "text"), with_text=False)
    return out.select("doc_id", F.col("n_tokens").alias("n_lines"), F.col("n_removed").alias("n_removed_lines"),
                      "kept_sha256")


def repeated_lines(docs: DataFrame, run: int = RUN, single: int = SINGLE, **options) -> DataFrame:
    """As ``line_dedup``, and every line of at least ``single`` bytes outside white space that also
    occurs earlier is removed by itself, whatever its neighbours are."""
    return remove_repeats(docs, run, "lines", "winnow", single=single, **options)


def digest_repeated(docs: DataFrame) -> DataFrame:
    out = repeated_lines(docs.select("doc_id", "text"), with_text=False)
    return out.select("doc_id", F.col("n_tokens").alias("n_lines"), F.col("n_removed").alias("n_removed_lines"),
                      "kept_sha256")


ORACLE = """
WITH w AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS ls FROM documents),
p AS (
  SELECT doc_id, UNNEST(range(1, len(ls) - 1)) AS i, ls FROM w WHERE len(ls) >= 3),
d AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY ls[i:i + 2] ORDER BY doc_id, i) AS r FROM p),
gone AS (
  SELECT DISTINCT doc_id, UNNEST(range(i, i + 3)) AS j FROM d WHERE r > 1),
g AS (
  SELECT doc_id, list(j) AS js FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(coalesce(len(js), 0) AS BIGINT) AS n_removed_lines,
  sha256(coalesce(array_to_string(list_transform(list_filter(range(1, len(ls) + 1),
    lambda j: js IS NULL OR NOT list_contains(js, j)), lambda j: ls[j]), chr(10)), '')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id)
"""

ORACLE_REPEATED = f"""
WITH w AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS ls FROM documents),
p AS (
  SELECT doc_id, UNNEST(range(1, len(ls) + 1)) AS i, ls FROM w),
d AS (
  SELECT doc_id, i, {RUN} AS n, row_number() OVER (PARTITION BY ls[i:i + {RUN - 1}] ORDER BY doc_id, i) AS r
  FROM p WHERE i + {RUN - 1} <= len(ls)
  UNION ALL
  SELECT doc_id, i, 1 AS n, row_number() OVER (PARTITION BY ls[i] ORDER BY doc_id, i) AS r
  FROM p WHERE strlen(regexp_replace(ls[i], '[\\x20\\x09-\\x0D]+', '', 'g')) >= {SINGLE}),
gone AS (
  SELECT DISTINCT doc_id, UNNEST(range(i, i + n)) AS j FROM d WHERE r > 1),
g AS (
  SELECT doc_id, list(j) AS js FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(coalesce(len(js), 0) AS BIGINT) AS n_removed_lines,
  sha256(coalesce(array_to_string(list_transform(list_filter(range(1, len(ls) + 1),
    lambda j: js IS NULL OR NOT list_contains(js, j)), lambda j: ls[j]), chr(10)), '')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id)
"""
