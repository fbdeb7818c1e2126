"""Exact dedup by a Golomb-coded fingerprint exchange.

Chunks of fingerprints (never texts) send their sorted, Golomb-coded hashes to
the owners of the hash ranges and get back bitmaps of the hashes that occur
more than once.  Only the rows marked so, the suspects, are shuffled with
their texts, and only byte-equal texts count as equal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import golomb
from .chunks import in_chunks
from .common import bits_for, partitions, written
from .exchange import MESSAGE, asked, messages, owners_of

ROW_BYTES = 64  # of a fingerprint row; a chunk holds CHUNK_BYTES of them
CHUNK_BYTES = 4 << 20


def _values(group: pa.Table, width: int) -> np.ndarray:
    column = group.column("sha")
    head = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)[:, :8]
    return head.copy().view(">u8").ravel().astype(np.uint64) >> np.uint64(64 - width)


def suspects(docs: DataFrame, key: str, sha) -> DataFrame:
    """(id, fingerprint, whether its hash may occur again) of every row."""
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.unhex(sha).alias("sha"))
    rows, n, _ = in_chunks(rows, "id", F.lit(ROW_BYTES), CHUNK_BYTES)
    owner_bits = bits_for(max(partitions(docs.sparkSession), n * ROW_BYTES // CHUNK_BYTES))
    width = min(62, max(owner_bits + 8, bits_for(n) + 12))

    def send(group: pa.Table) -> pa.Table:
        values, counts = np.unique(_values(group, width), return_counts=True)
        number = group.column("chunk")[0].as_py()
        owners, cuts = owners_of(values, width, owner_bits)
        return messages([(int(o), number, golomb.encode(values[a:b]) + np.packbits(counts[a:b] > 1).tobytes())
                         for o, a, b in zip(owners, cuts, cuts[1:])])

    def bitmaps(chunks: list[int], texts: list[bytes]) -> dict[int, bytes]:
        values = [golomb.decode(m) for m in texts]
        often = [np.unpackbits(np.frombuffer(m, np.uint8, offset=golomb.size(m)), count=len(v)) > 0
                 for m, v in zip(texts, values)]
        every, counts = np.unique(np.concatenate(values), return_counts=True)
        shared = every[counts > 1]
        out = {}
        for number, v, twice in zip(chunks, values, often):
            again = twice | np.isin(v, shared, assume_unique=True)
            if again.any():
                out[number] = np.packbits(again).tobytes()
        return out

    def mark(group: pa.Table, answers: pa.Table) -> pa.Table:
        if not group.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.binary()), pa.array([], pa.bool_())],
                            names=["id", "sha", "suspect"])
        own = _values(group, width)
        values = np.unique(own)
        owners, cuts = owners_of(values, width, owner_bits)
        got = dict(zip(answers.column("dest").to_pylist(), answers.column("message").to_pylist()))
        again = np.zeros(len(values), bool)
        for o, a, b in zip(owners, cuts, cuts[1:]):
            if int(o) in got:
                again[a:b] = np.unpackbits(np.frombuffer(got[int(o)], np.uint8), count=b - a) > 0
        flags = again[np.searchsorted(values, own)]
        return pa.table([group.column("id"), group.column("sha"), pa.array(flags)], names=["id", "sha", "suspect"])

    by_chunk = rows.groupBy("chunk")
    answers = asked(by_chunk.applyInArrow(send, MESSAGE), bitmaps)
    return by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(mark, "id long, sha binary, suspect boolean")


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null counts as the empty text; texts are equal if their bytes are.  The
    largest id of a group stays; a null id counts as the smallest.  Rows
    that repeat id and text are one document: all of them say the same.
    An empty table gives an empty result.
    """
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    sha = F.sha2(whole.cast("binary"), 256)
    marked = written(suspects(docs, key, sha), "fingerprints")
    single = marked.filter("not suspect").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("size"),
                                                 "sha")
    doubted = marked.filter("suspect").select(F.col("id").alias("__id"), F.col("sha").alias("__sha")).distinct()
    texts = docs.select(F.col(f"`{key}`").cast("long").alias("id"), whole.alias("text"), F.unhex(sha).alias("sha"))
    # the suspects with their texts, written because they are read twice
    bodies = written(texts.join(doubted, F.col("id").eqNullSafe(F.col("__id")) & (F.col("sha") == F.col("__sha")),
                                "left_semi"), "suspects")
    groups = written(bodies.groupBy("sha", "text").agg(F.max("id").alias("keep_id"), F.count("*").alias("size")),
                     "copies")
    proved = bodies.join(groups, ["sha", "text"]).select("id", "keep_id", "size", "sha")
    out = single.unionByName(proved)
    return out.select(F.col("id").alias("doc_id"), "keep_id", F.col("size").alias("group_size"),
                      F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
                      F.lower(F.hex("sha")).alias("text_sha256"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that are copies of a row that stays."""
    sha = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    kept = exact_dedup(docs).filter("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    return docs.join(kept, docs["doc_id"].eqNullSafe(F.col("__id")) & (sha == F.col("__sha")), "left_semi")


def digest(docs: DataFrame) -> DataFrame:
    return exact_dedup(docs)


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
