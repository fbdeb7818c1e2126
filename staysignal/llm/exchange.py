"""Hash exchange between chunks of rows and hash owners.

A *chunk* (some rows of the input, small enough for one task) sends every
owner one message with the sorted hashes of the owner's range; the owner
compares the messages of all chunks and answers each chunk.  Both directions
are ordinary shuffles of rows (dest, chunk, message), so lost tasks are
simply run again, and a hash that a third of all rows share still travels
once per chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MESSAGE = "dest long, chunk long, message binary"
_ARROW = pa.schema([("dest", pa.int64()), ("chunk", pa.int64()), ("message", pa.binary())])


def messages(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    d, c, m = zip(*rows) if rows else ((), (), ())
    return pa.table([pa.array(d, pa.int64()), pa.array(c, pa.int64()), pa.array(m, pa.binary())], schema=_ARROW)


def owners_of(sorted_values: np.ndarray, width: int, owner_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Owner numbers present and the n+1 cuts of ``sorted_values`` by owner
    (the top ``owner_bits`` of ``width``-bit values)."""
    owner = (sorted_values >> np.uint64(width - owner_bits)).astype(np.int64)
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    return owner[first], np.append(first, len(owner))


def asked(sent: DataFrame, answer) -> DataFrame:
    """Run ``answer(chunks, messages) -> {chunk: message}`` for each owner.  A negative
    ``dest`` is a note of a chunk to itself and is passed on as it is.
    The answers have the chunk in ``chunk`` and the owner in ``dest``."""

    def own(group: pa.Table) -> pa.Table:
        dest = group.column("dest")[0].as_py()
        chunks, texts = group.column("chunk").to_pylist(), group.column("message").to_pylist()
        if dest < 0:
            return messages([(dest, c, m) for c, m in zip(chunks, texts)])
        order = np.argsort(np.array(chunks), kind="stable")
        out = answer([chunks[i] for i in order], [texts[i] for i in order])
        return messages([(dest, c, m) for c, m in out.items()])

    return sent.groupBy("dest").applyInArrow(own, MESSAGE)
