"""Spelling variants by blocked Gram matrices of letter counts.

One inserted, deleted or replaced letter moves a word's vector of letter counts
by a squared distance of 1 or 2.  Words lie in blocks by their length (the
count vector summed over a few classes of letters), so near words lie in the
same block or in an adjacent one: a replaced letter moves one unit from a class
to another, an added one makes a class longer.  Squared distances of adjacent
blocks come from one NumPy product of their count matrices,
|a|^2 + |b|^2 - 2 a.b; the pairs at most two apart are verified letter by letter.
Each adjacent pair of blocks meets once, where the words of the lesser block
visit; large blocks are cut into sub-blocks that meet in pairs.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from operator import ne

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, table, written
from .graph import grouped, in_blocks

LEAST_LENGTH = 7
LEAST_COUNT = 2
RATIO = 10  # a form is at least so many times as frequent
HOME = 512  # home words of a sub-block
TILE = 2048  # words multiplied at once
BROADCAST_BLOCKS = 400_000  # block sizes of some 20 bytes each
RUN = re.compile("[A-Za-zÀ-ÿ]+")
DELETE = 31
HELD_WORDS = 1 << 18


def result(key: int | None, run: str, prefix: int) -> str:
    """The run of document ``key``, without one letter if crc32 of "<doc_id>:<run>" is divisible by 31;
    ``prefix`` is the crc32 of "<doc_id>:".  A null id deletes nothing."""
    if key is None:
        return run
    h = zlib.crc32(run.encode(), prefix)
    if h % DELETE:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1:]


def words_of(key: int | None, text: str | None) -> Counter:
    """Words of one text with their counts, those of fewer than LEAST_LENGTH letters left out."""
    prefix = zlib.crc32(f"{key}:".encode())
    out: Counter = Counter()
    lower = (text or "").encode().lower().decode()  # bytes.lower changes A-Z alone
    for run, n in Counter(r for r in RUN.findall(lower) if len(r) >= LEAST_LENGTH).items():
        word = result(key, run, prefix)
        if len(word) >= LEAST_LENGTH:
            out[word] += n
    return out


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n of the words that occur at least LEAST_COUNT times overall.  Tasks count first; words are shuffled."""
    def count(batches):
        held: Counter = Counter()

        def rows(c: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c.keys(), pa.string()), pa.array(c.values(), pa.int64())],
                                              names=["word", "n"])
        for b in batches:
            for part in byte_slices(b, 1):
                for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    held.update(words_of(k, t))
                    if len(held) > HELD_WORDS:
                        yield rows(held)
                        held.clear()
        if held:
            yield rows(held)

    counted = docs.select(F.col(f"`{key}`").cast("long"), F.col(f"`{text}`")).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


# ---- blocks -------------------------------------------------------------------------------------------------------
def letter_counts(words: list[str], classes: np.ndarray, m: int) -> np.ndarray:
    """How many letters of each class every word has."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    of = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
    return np.bincount(of * m + classes[points], minlength=len(words) * m).reshape(-1, m)


def letter_classes(words: DataFrame, m: int) -> np.ndarray:
    """Class of each code point below 256: the letters dealt to ``m`` classes of about equal weight, frequent first."""
    letters = words.select(F.explode(F.split("word", "")).alias("c")).filter("c <> ''").groupBy("c").count()
    classes, load = np.zeros(256, np.int64), [0] * m
    for r in sorted(letters.collect(), key=lambda r: (-r["count"], r["c"])):  # at most 90 letters
        i = load.index(min(load))
        classes[ord(r["c"])] = i
        load[i] += r["count"]
    return classes


def adjacent(m: int) -> np.ndarray:
    """Steps from a block to the adjacent ones whose words it visits: itself, one letter more in a class, or one
    moved from a class to a later one (the opposite move is the other block's visit)."""
    eye = np.eye(m, dtype=np.int64)
    moved = [eye[j] - eye[i] for i in range(m) for j in range(i + 1, m)]
    return np.array([np.zeros(m, np.int64), *eye, *moved])


def keys_of(counts: np.ndarray) -> pa.Array:
    """Each row of class counts as bytes: one for a count, four in a row with counts above 255."""
    if not len(counts) or counts.max() < 256:
        raw = np.ascontiguousarray(counts.astype(np.uint8))
        return pa.Array.from_buffers(pa.binary(counts.shape[1]), len(counts), [None, pa.py_buffer(raw)]).cast(pa.binary())
    return pa.array([row.astype(np.uint8 if row.max() < 256 else "<u4").tobytes() for row in counts], pa.binary())


def placed(words: DataFrame, classes: np.ndarray, m: int, visits: bool) -> DataFrame:
    """bucket, word, n and home of every word: its own block and, with ``visits``, the adjacent ones."""
    steps = adjacent(m) if visits else adjacent(m)[:1]

    def f(batches):
        for b in batches:
            for part in byte_slices(b, 0):
                own = letter_counts(part.column(0).to_pylist(), classes, m)
                for k, step in enumerate(steps):
                    at = own + step
                    some = np.flatnonzero((at >= 0).all(axis=1))
                    rows = part.take(pa.array(some))
                    yield pa.RecordBatch.from_arrays([keys_of(at[some]), *rows.columns, pa.array(np.full(len(some), k == 0))],
                                                     names=["bucket", "word", "n", "home"])
    return words.select("word", "n").mapInArrow(f, "bucket binary, word string, n long, home boolean")


# ---- near pairs ---------------------------------------------------------------------------------------------------
def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced letter makes one word the other."""
    if len(a) == len(b):
        return sum(map(ne, a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) != 1:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at:] == b[at + 1:]


def near_in(words: list[str], home: np.ndarray, part: np.ndarray) -> list[tuple[int, int]]:
    """Near pairs (i, j) of one meeting of two sub-blocks: each pair with a home word, of different parts (or of the
    one part if there is but one), home pairs once."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    letters = np.zeros(256, np.int64)
    present = np.unique(points)
    letters[present] = np.arange(len(present))
    counts = letter_counts(words, letters, len(present))
    exact = np.float32 if max(map(len, words)) < 2000 else np.float64  # squares stay below 2^24 or 2^53
    x = counts.astype(exact)
    square = (x * x).sum(axis=1)
    alone = (part == part[0]).all()
    found: list[tuple[int, int]] = []
    homes = np.flatnonzero(home)
    for a in range(0, len(homes), TILE):
        left = homes[a:a + TILE]
        for c in range(0, len(words), TILE):
            right = np.arange(c, min(c + TILE, len(words)))
            gap = square[left][:, None] + square[right][None, :] - 2 * (x[left] @ x[right].T)
            p, q = np.nonzero((gap <= 2) & (gap > 0))  # 0: the same letters, so no single edit
            i, j = left[p], right[q]
            keep = (~home[j] | (i < j)) & (alone | (part[i] != part[j]))
            found += [(u, v) for u, v in zip(i[keep].tolist(), j[keep].tolist()) if one_edit(words[u], words[v])]
    return found


def near_words(words: DataFrame, home: int = HOME) -> DataFrame:
    """word, near, near_n: every near pair of ``words`` (word, n; distinct words), in both directions."""
    total = words.count()
    m = max(4, round(math.log2(max(2, total)) / 3))  # finer blocks for more words
    classes = letter_classes(words, m)
    sizes = written(placed(words, classes, m, visits=False).groupBy("bucket").agg(F.count("*").alias("size")), "blocks")
    if sizes.count() <= BROADCAST_BLOCKS:  # otherwise a shuffled join of the same rows
        sizes = F.broadcast(sizes)
    members = placed(words, classes, m, visits=True).join(sizes, "bucket")
    met = in_blocks(members, "bucket", "size", "word", home)

    def pairs(t: pa.Table) -> pa.Table | None:
        own = t["home"].to_numpy(zero_copy_only=False)
        if t.num_rows < 2 or not own.any():
            return None
        found = near_in(t["word"].to_pylist(), own, t["blk"].to_numpy())
        if not found:
            return None
        i, j = (pa.array(c) for c in zip(*[*found, *((v, u) for u, v in found)]))
        return pa.table([t["word"].take(i), t["word"].take(j), t["n"].take(j)], names=["word", "near", "near_n"])

    met = met.select("bucket", "bi", "bj", "blk", "home", "word", "n")
    return grouped(met, ["bucket", "bi", "bj"], pairs, "word string, near string, near_n long")


# ---- forms --------------------------------------------------------------------------------------------------------
def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of ``words`` (word, n), a written table."""
    near = near_words(words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    has = F.coalesce(-F.col("best.less") >= ratio * F.col("n"), F.lit(False))
    out = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best.near")).alias("form"),
        F.when(has, -F.col("best.less")).alias("form_n"))
    out = written(out, "forms")
    # a form is at least ``ratio`` times as frequent, so chains end soon; every round doubles the steps followed
    state = out.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        state = written(state, "roots")
        further = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if state.join(further, "root", "left_semi").isEmpty():
            break
        state = state.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return out.join(state, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"),
                                                  "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Words of all whole texts with their near words' count, form and root.

    A null, empty or letterless text has no word; repeated rows count each
    (with the same deletions); a null id deletes no letter; of equally frequent
    near words the first by code points is taken; an empty table gives an
    empty result.  Other columns aren't read.
    """
    return variants(written(vocabulary(docs, key, text), "vocabulary"))


def digest(docs: DataFrame) -> DataFrame:
    return spelling_variants(docs)


def query(spark, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))


# crc32 by the reflected polynomial's table, which the SQL builds by its rule; near words by the words without one letter
# (inserted, deleted) and by patterns with one letter blanked (replaced).
ORACLE = f"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, z:
    CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(0, 256)) AS i)),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[A-Za-zÀ-ÿ]+')) AS run FROM documents WHERE text IS NOT NULL),
counted AS (
  SELECT doc_id, run, COUNT(*) AS c, doc_id || ':' || run AS named, hex(encode(doc_id || ':' || run)) AS x
  FROM runs WHERE length(run) >= {LEAST_LENGTH} GROUP BY doc_id, run),
hashed AS (
  SELECT run, c, xor(list_reduce([4294967295] || list_transform(range(0, length(x) // 2),
      lambda i: CAST('0x' || substring(x, CAST(2 * i + 1 AS INT), 2) AS BIGINT)),
    lambda h, b: xor(h // 256, t[xor(h % 256, b) + 1])), 4294967295) AS h
  FROM counted, crc),
voc AS (
  SELECT word, CAST(SUM(c) AS BIGINT) AS n FROM (
    SELECT c, CASE WHEN h % {DELETE} = 0
      THEN left(run, CAST(h % length(run) AS INT)) || substring(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word
    FROM hashed) d
  WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING SUM(c) >= {LEAST_COUNT}),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM voc),
less AS (SELECT DISTINCT word, n, left(word, CAST(i - 1 AS INT)) || substring(word, CAST(i + 1 AS INT)) AS k FROM places),
blank AS (SELECT word, n, left(word, CAST(i - 1 AS INT)) || '_' || substring(word, CAST(i + 1 AS INT)) AS k FROM places),
near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM blank a JOIN blank b ON a.k = b.k AND a.word <> b.word
  UNION ALL SELECT l.word, v.word, v.n FROM less l JOIN voc v ON v.word = l.k
  UNION ALL SELECT v.word, l.word, l.n FROM less l JOIN voc v ON v.word = l.k),
best AS (
  SELECT word, COUNT(*) OVER (PARTITION BY word) AS n_near, near, near_n FROM near
  QUALIFY ROW_NUMBER() OVER (PARTITION BY word ORDER BY near_n DESC, encode(near)) = 1),
forms AS (
  SELECT voc.word, n, COALESCE(n_near, 0) AS n_near, CASE WHEN near_n >= {RATIO} * n THEN near END AS form,
         CASE WHEN near_n >= {RATIO} * n THEN near_n END AS form_n
  FROM voc LEFT JOIN best USING (word)),
walk AS (
  SELECT word, form, word AS at, form AS next FROM forms
  UNION ALL SELECT w.word, w.form, f.word, f.form FROM walk w JOIN forms f ON w.next = f.word)
SELECT f.word, f.form, w.at AS root, f.n, f.n_near, f.form_n
FROM walk w JOIN forms f ON f.word = w.word WHERE w.next IS NULL
"""
