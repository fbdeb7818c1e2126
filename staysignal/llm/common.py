"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared checkpoint folder and read back:
    the lineage is cut and a lost executor costs no recomputation."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_hash(col: str) -> Column:
    """crc32 of an id's decimal text, the fold rule of the labelled operators."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising mixer over uint64 (every input bit reaches every output bit)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column and the n+1 row offsets into
    them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.cast(pa.large_string()).combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    else:
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, np.int64)[column.offset:column.offset + n + 1]
    buf = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def string_array(buf: np.ndarray, off: np.ndarray) -> pa.Array:
    """Inverse of ``text_buffer`` for the text of one task's rows."""
    arr = pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(np.ascontiguousarray(off, dtype=np.int64)),
                                           pa.py_buffer(np.ascontiguousarray(buf)))
    return arr.cast(pa.string())


def byte_slices(batch: pa.RecordBatch, column: int, most: int = 4 << 20, rows: int = 4096):
    """``batch`` in slices of at most ``rows`` rows and about ``most`` bytes of text in ``column`` (one row at least)."""
    size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), np.int64)
    upto, at = np.cumsum(size), 0
    while at < batch.num_rows:
        end = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, side="right"))
        end = min(max(at + 1, end), at + rows, batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def bits_for(n: float) -> int:
    return max(1, math.ceil(math.log2(max(2.0, float(n)))))
