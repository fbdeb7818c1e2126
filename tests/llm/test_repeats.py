import hashlib

import pytest

from staysignal.llm import golomb, op2_substring, op7_lines
from tests.llm.fixtures import documents, empty, rows, words


def brute(rows_, n, parts, glue):
    """Tokens kept by the definition: a run of n that also starts earlier goes."""
    first = {}
    for i, t in rows_:
        ts = parts(t)
        for p in range(len(ts) - n + 1):
            k = tuple(ts[p:p + n])
            at = (-1 << 70 if i is None else i, p)
            first[k] = min(first.get(k, at), at)
    out = []
    for i, t in rows_:
        ts = parts(t)
        gone = set()
        for p in range(len(ts) - n + 1):
            if first[tuple(ts[p:p + n])] < (-1 << 70 if i is None else i, p):
                gone.update(range(p, p + n))
        kept = glue.join(x for j, x in enumerate(ts) if j not in gone)
        out.append((i, len(ts), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [4, 20])
@pytest.mark.parametrize("chunk_bytes", [300, 1 << 20])
def test_words_against_brute_force(spark, window, chunk_bytes):
    got = op2_substring.substring_dedup(documents(spark), window, chunk_bytes=chunk_bytes)
    got = sorted(((r[0], r[1], r[2], r[3]) for r in got.collect()), key=str)
    assert got == brute([(r[0], r[1]) for r in rows()], window, words, b" ")


@pytest.mark.parametrize("run", [2, 3])
def test_lines_against_brute_force(spark, run):
    lines = lambda t: [] if t is None else t.encode().split(b"\n")
    got = op7_lines.line_dedup(documents(spark), run, chunk_bytes=500).collect()
    assert sorted(((r[0], r[1], r[2], r[3]) for r in got), key=str) == brute([(r[0], r[1]) for r in rows()], run, lines, b"\n")


def test_single_lines_between_other_neighbours_go(spark):
    line = "A whole sentence that many documents hold."
    texts = [f"own {i} a\n{line}\n{'}' if i % 2 else 'Yes.'}\n\n  \nown {i} b" for i in range(6)]
    texts += [f"{line}\nlast\n{line}", line, "", None, "p\n}\n\nq", "p\n}\n\nq\nr", "漢字漢\nx", "y\n漢字漢"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for chunk_bytes in (60, 1 << 20):
        got = {r["doc_id"]: r["kept_text"] for r in op7_lines.repeated_lines(docs, chunk_bytes=chunk_bytes).collect()}
        assert got[0] == texts[0] and all(line not in (got[i] or "") for i in range(1, 8))
        assert got[1] == "own 1 a\n}\n\n  \nown 1 b"  # short and blank lines stay
        assert (got[6], got[7], got[8], got[9]) == ("last", "", "", None)
        assert got[10] == texts[10] and got[11] == "r"  # ... unless in a repeated run of three
        assert got[12] == texts[12] and got[13] == "y"  # bytes count, not letters


def test_spans_text_and_carried_columns(spark):
    docs = documents(spark)
    got = op2_substring.substring_dedup(docs, carry=docs.columns).collect()
    assert got[0].asDict().keys() >= {*docs.columns, "spans", "kept_text"}
    for r in got:
        ws = words(r["text"])
        gone = {j for s in r["spans"] for j in range(s["start"], s["start"] + s["length"])}
        assert len(gone) == r["n_removed"]
        kept = b" ".join(w for j, w in enumerate(ws) if j not in gone)
        assert (r["kept_text"] or "").encode() == kept and (r["kept_text"] is None) == (r["text"] is None)


def test_empty_tables(spark):
    assert op2_substring.digest(empty(spark)).count() == 0
    assert op7_lines.digest(empty(spark)).count() == 0


def test_golomb_round_trip():
    import numpy as np
    rng = np.random.default_rng(1)
    for n, top in ((0, 10), (1, 1 << 60), (2, 5), (1000, 1000), (5000, 1 << 62), (3000, 50)):
        v = np.sort(rng.integers(0, top, n, dtype=np.uint64))
        code = golomb.encode(v)
        assert (golomb.decode(b"xx" + code + b"yy", 2) == v).all() and golomb.size(code) == len(code)


def test_chunks_are_balanced_by_size_and_follow_ids(spark):
    from pyspark.sql import functions as F

    from staysignal.llm.chunks import in_chunks
    # ids with a gap of 10**15 between two halves; the last 40 ids hold nine tenths of the text
    ids = spark.range(4000).select(F.when(F.col("id") < 2000, F.col("id")).otherwise(F.col("id") + 10**15).alias("id"),
                                   F.when(F.col("id") >= 3960, 90_000).otherwise(100).alias("size"))
    ids = ids.union(spark.createDataFrame([(None, None)], "id long, size int"))
    for chunk in (200_000, 2_000):  # fewer and more than 256 chunks
        rows_, n, total = in_chunks(ids, "id", F.col("size"), chunk)
        got = rows_.collect()
        assert (n, total) == (4001, 40 * 90_000 + 3960 * 100)
        got.sort(key=lambda r: (r["id"] is not None, r["id"]))
        numbers = [r["chunk"] for r in got]
        assert numbers == sorted(numbers) and numbers[0] == 0
        held = {}
        for r in got:
            held[r["chunk"]] = held.get(r["chunk"], 0) + max(1024, r["size"] or 0)
        assert max(held.values()) <= 2 * max(90_000, chunk * 2)
        assert len(held) > (256 if chunk == 2_000 else 20)
