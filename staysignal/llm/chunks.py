"""Chunks of consecutive ids: rows dealt out so that every task holds a bounded
amount of text and chunk numbers follow the order of the ids."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions

CHUNK_BYTES = 12 << 20
COARSE = 256
WEIGHT_BYTES = 1024  # a row counts once, and once more for each of these


def _numbered(docs: DataFrame, key: str, edges: list[float], name: str) -> DataFrame:
    """``docs`` with the number of the range [edge, next edge) that holds ``key``; below the first edge counts as in
    the first range, null as below it.  ``edges`` ascend; the look-up is a binary search."""
    if len(edges) < 2:
        return docs.withColumn(name, F.lit(0).cast("long"))
    inf = float("inf")
    docs = docs.withColumn("__at", F.coalesce(F.col(key).cast("double"), F.lit(-inf)))
    ranges = Bucketizer(splits=[-inf, *edges[1:], inf], inputCol="__at", outputCol=name)
    return ranges.transform(docs).drop("__at").withColumn(name, F.col(name).cast("long"))


def in_chunks(docs: DataFrame, key: str, size, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, int, int]:
    """``docs`` with a column ``chunk``; also the number of rows and of ``size`` units.

    Boundaries are quantiles of the ids in which a row weighs by its size, so
    long texts with neighbouring ids don't share a chunk, and gaps between ids
    don't matter.  Beyond 256 chunks each of the 256 quantile ranges is cut by
    quantiles of its own; only boundaries reach the driver, one for each chunk.
    Rows of one id are in one chunk; a null id counts as the smallest.
    """
    spark = docs.sparkSession
    sized = docs.select(F.col(key).alias("k"), F.coalesce(size, F.lit(0)).cast("long").alias("s"))
    copies = F.sequence(F.lit(0).cast("long"), F.floor(F.col("s") / WEIGHT_BYTES).cast("long"))
    weighted = sized.select("k", "s", F.posexplode(copies).alias("pos", "copy")).drop("copy")
    first = F.col("pos") == 0
    probs = [i / COARSE for i in range(COARSE)]
    stats = weighted.agg(F.count_if(first).alias("n"), F.sum(F.when(first, F.col("s"))).alias("size"),
                         F.percentile_approx("k", probs, 20 * COARSE).alias("q")).first()
    n, total, q = stats["n"], int(stats["size"] or 0), stats["q"] or []
    want = max(partitions(spark), math.ceil(total / chunk_bytes), 1)
    edges = sorted({float(x) for x in q[::max(1, COARSE // want)]})
    fine = math.ceil(want / max(1, len(edges))) if want > COARSE else 1
    if fine > 1:
        cuts = (_numbered(weighted.filter("k is not null"), "k", edges, "range").groupBy("range")
                .agg(F.percentile_approx("k", [i / fine for i in range(fine)], 20 * fine).alias("q")).collect())
        edges = sorted({float(x) for r in cuts for x in r["q"]})
    return _numbered(docs, key, edges, "chunk"), n, total
